"""Cross-tokenizer alignment against brute force over whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from tallyveil.llm import alignment
from tallyveil.llm.tokens import byte_characters

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def brute(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = {chr(c): n for n, c in byte_characters().items()}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    links, groups = [], []
    for _, t in rows:
        x, y = a.encode(" " + (t or ""), add_special_tokens=False).ids, b.encode(t or "")
        bx, by = [bytes(back[c] for c in a.id_to_token(i)) for i in x], [piece(i) for i in y]
        if not t or b"".join(bx) != b"".join(by) or b"".join(bx) != (" " + t).encode():
            links.append(None)
            groups.append("")
            continue
        ex, ey = np.cumsum([len(v) for v in bx]), np.cumsum([len(v) for v in by])
        mine, j = [], 0
        for i, (p, n) in enumerate(zip(ex, map(len, bx))):
            while j and ey[j - 1] > p - n:
                j -= 1
            while j < len(y) and ey[j] - len(by[j]) < p:
                if ey[j] > p - n:
                    mine.append((x[i], y[j]))
                j += 1
        links.append((mine, len(x), len(y)))
        text, i, j = [], 0, 0
        for stop in sorted(set(ex.tolist()) & set(ey.tolist())):
            k, m = int(np.searchsorted(ex, stop)) + 1, int(np.searchsorted(ey, stop)) + 1
            text.append(",".join(map(str, x[i:k])) + "|" + ",".join(map(str, y[j:m])))
            i, j = k, m
        groups.append(";".join(text))
    count = Counter(p for one in links if one for p in one[0])
    top = Counter()
    for (_, y), c in count.items():
        top[y] = max(top[y], c)
    out = []
    for (doc, _), one, g in zip(rows, links, groups):
        if not one:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            mine, na, nb = one
            out.append((doc, na, nb, g.count(";") + 1, len(mine), sum(count[p] == top[p[1]] for p in mine), sum(count[p] for p in mine), hashlib.sha256(g.encode()).hexdigest()))
    return out


def odd_texts():
    dice = random.Random(7)
    bits = ["word", "Wörter", " ", "  ", "\n", "\n\n", "\t", "'s", "'ll", "123", "4", "...", "<s>", "<|endoftext|>", "<0x41>", "<unk>", "日本語", "é", "́", "　", " ", " ", "\x00", "\U0001f600", "Ω", "-", "x" * 70, "ﬁ", "I", "İ", "\x85", "\x1c"]
    return ["".join(dice.choice(bits) for _ in range(dice.randint(1, 30))) for _ in range(400)]


ROWS = [(1, None), (2, ""), (3, " "), (4, "\n"), (5, "same text here"), (6, "same text here"), (7, "a▁b and more"), (8, "z" * 20_000), (9, "word " * 20_000), (None, "no id"), (None, None), (5, "same text here")]
ROWS += list(enumerate(odd_texts(), 100))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "x", b"y") for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, chunk int, pair string, bucket binary").repartition(40, "text")


@pytest.mark.parametrize("limit", [alignment.BROADCAST_PAIRS, 0])
def test_equals_brute_force(docs, limit):
    """Both ways of the second pass; 40 partitions make a tree of three levels."""
    got = alignment.align(docs, A, B, limit)
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, brute(ROWS)))


def test_empty_table(docs):
    assert alignment.align(docs.where("false"), A, B).count() == 0
    assert [tuple(r)[1:] for r in alignment.align(docs.where("text IS NULL"), A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, alignment.align(docs, A, B).collect())) == sorted(brute(rows))


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 32, 50_000, np.uint32))
    built = alignment.PerfectHash.loads(alignment.PerfectHash.build(keys).dumps())
    assert sorted(built.index(keys).tolist()) == list(range(len(keys)))
    assert 8 * len(built.words) < len(keys)
    assert len(alignment.PerfectHash.build(keys[:0]).index(keys)) == len(keys)
