"""Arithmetic modulo 2^127 - 1 on numpy arrays of numbers, in limbs of 26 bits (the last axis).

Products of limbs fit 64 bits; 2^130 counts as 8 and 2^127 as 1, so a product is folded back without a division.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

PRIME = 2**127 - 1
LIMBS, BITS = 5, 26
MASK, TOP = (1 << BITS) - 1, (1 << 23) - 1  # of a limb, and of the last one
_P = np.array([MASK, MASK, MASK, MASK, TOP], np.int64)
AT_ONCE = 1 << 18  # numbers worked on at a time


def pack(numbers: list[str]) -> np.ndarray:
    """Limbs of hexadecimal numbers of at most 32 digits."""
    raw = np.frombuffer(b"".join(bytes.fromhex(x.zfill(32)) for x in numbers), ">u8").astype(np.uint64).reshape(-1, 2)
    high, low, m = raw[:, 0], raw[:, 1], np.uint64(MASK)
    parts = [low & m, low >> np.uint64(26) & m, (low >> np.uint64(52) | high << np.uint64(12)) & m, high >> np.uint64(14) & m, high >> np.uint64(40)]
    return _carried(np.stack(parts, 1).astype(np.int64))


def unpack(x: np.ndarray, digits: int = 32) -> list[str]:
    """Hexadecimal numbers of at least `digits` digits, below the prime."""
    limbs = x.astype(np.uint64)
    low = limbs[:, 0] | limbs[:, 1] << np.uint64(26) | limbs[:, 2] << np.uint64(52)
    high = limbs[:, 2] >> np.uint64(12) | limbs[:, 3] << np.uint64(14) | limbs[:, 4] << np.uint64(40)
    return [f"{((h << 64) | n) % PRIME:0{digits}x}" for h, n in zip(high.tolist(), low.tolist())]


def _carried(x: np.ndarray) -> np.ndarray:
    """Limbs within their bits again; x is changed."""
    for _ in range(2):
        for i in range(LIMBS - 1):
            x[..., i + 1] += x[..., i] >> BITS
            x[..., i] &= MASK
        x[..., 0] += x[..., 4] >> 23
        x[..., 4] &= TOP
    x[..., 1] += x[..., 0] >> BITS
    x[..., 0] &= MASK
    return x


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _carried(a + b)


def sub(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _carried(a + (_P - b))


def mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(np.broadcast_shapes(a.shape, b.shape), np.int64)
    for i in range(LIMBS):
        for j in range(LIMBS):
            part = a[..., i] * b[..., j]
            out[..., (i + j) % LIMBS] += part if i + j < LIMBS else part << 3
    return _carried(out)


def inverse(a: np.ndarray) -> np.ndarray:
    """The power to 2^127 - 3, by squares."""
    out, square = a, mul(a, a)
    for _ in range(125):  # bits 2 to 126 of the exponent are set, bit 1 is not
        square = mul(square, square)
        out = mul(out, square)
    return out


@lru_cache(4096)
def coefficients(secret: str, threshold: int) -> np.ndarray:
    """The secret, then threshold - 1 numbers that follow from it."""
    return pack([secret] + [hashlib.sha256(f"{secret}|{j}".encode()).hexdigest()[:30] for j in range(1, threshold)])


def evaluate(secrets: list[str], xs: list[str], threshold: int) -> list[str]:
    """Each secret's polynomial at x, by Horner's rule over all rows at once."""
    names = {s: n for n, s in enumerate(dict.fromkeys(secrets))}
    table = np.stack([coefficients(s, threshold) for s in names])
    of, x = np.array([names[s] for s in secrets]), pack(xs)
    y = table[of, threshold - 1]
    for t in range(threshold - 2, -1, -1):
        y = add(mul(y, x), table[of, t])
    return unpack(y)


def at_zero(xs: list[list[str]], ys: list[list[str]]) -> list[str]:
    """For each list of points, the value at 0 of the polynomial through them, by Lagrange's formula; 30 digits or more."""
    out, by_size = [""] * len(xs), {}
    for g, points in enumerate(xs):
        by_size.setdefault(len(points), []).append(g)
    for n, groups in by_size.items():
        step = max(1, AT_ONCE // max(n, 1))
        for i in range(0, len(groups), step):
            some = groups[i : i + step]
            x, y = (pack([v for g in some for v in side[g]]).reshape(len(some), n, LIMBS) for side in (xs, ys))
            one = np.array([1, 0, 0, 0, 0], np.int64)
            # x_i times all differences x_j - x_i, and the product of all x
            below, whole = x, np.broadcast_to(one, (len(some), LIMBS))
            for j in range(n):
                apart = sub(x[:, j : j + 1], x)
                apart[:, j] = one
                below, whole = mul(below, apart), mul(whole, x[:, j])
            terms = mul(y, inverse(below))
            total = np.zeros((len(some), LIMBS), np.int64)
            for j in range(n):
                total = add(total, terms[:, j])
            for g, secret in zip(some, unpack(mul(total, whole), 30)):
                out[g] = secret
    return out
