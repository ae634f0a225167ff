"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyveil.llm import variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def edits(w, alphabet):
    for i in range(len(w) + 1):
        for c in alphabet:
            yield w[:i] + c + w[i:]
            if i < len(w):
                yield w[:i] + c + w[i + 1 :]
        if i < len(w):
            yield w[:i] + w[i + 1 :]


def brute(rows):
    n = Counter()
    for i, t in rows:
        for run in RUN.findall(t or ""):
            w = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                n[w] += 1
    n = {w: c for w, c in n.items() if c >= 2}
    alphabet = sorted({c for w in n for c in w})
    near = {w: {v for v in edits(w, alphabet) if v in n and v != w} for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def corpus():
    dice = random.Random(3)
    letters = "abcdefgh" + "éß×÷Àÿ"
    base = ["".join(dice.choice(letters) for _ in range(dice.randint(6, 12))) for _ in range(25)] + ["aaaaaaaa", "abababab", "babababa"]
    rows = []
    for i in range(250):
        words = []
        for _ in range(60):
            w = dice.choice(base[: 1 + dice.randint(0, len(base) - 1)])
            for _ in range(dice.choice([0] * 40 + [1, 1, 2])):
                at, c = dice.randrange(len(w)), dice.choice(letters)
                w = dice.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]]) or "a"
            words.append(dice.choice([w, w, w.upper(), w.title()]))
        rows.append((i, dice.choice([" ", "-", "1", "日"]).join(words)))
    rows += [(i, "alphabets " * 400 + "Alphabetz " * 15 + "alphabeqz") for i in range(510, 514)]
    rows += [(500, None), (501, ""), (502, "123 ---"), (None, rows[0][1]), (None, rows[0][1]), (3, rows[3][1]), (503, "q" * 30_000 + " " + "q" * 29_999 + "r"), (504, "q" * 30_000 + " " + "q" * 29_999 + "r")]
    return rows


@pytest.mark.parametrize("block", [variants.BLOCK, 6])
def test_equals_brute_force(spark, block):
    """Also with blocks dealt into tiles of three words; other columns clash with those of the work."""
    rows = [r for r in corpus() if not (r[1] or "").startswith("q")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, key int, word string").repartition(5)
    got = sorted(map(tuple, variants.group_variants(docs, block).collect()), key=lambda r: r[0])
    want = brute(rows)
    assert got == want
    assert any(r[1] and r[2] != r[1] for r in want) and any(r[4] > 1 for r in want)


def test_long_words(spark):
    rows = [r for r in corpus() if (r[1] or "").startswith("q")]
    got = {r.word[-1]: r for r in variants.group_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got["q"].n_near == got["r"].n_near == 1 and got["r"].n == 2 and len(got["r"].word) == 30_000


def test_empty_table(spark):
    assert variants.group_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert variants.group_variants(spark.createDataFrame([(1, None), (2, "short words")], "doc_id long, text string")).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(map(tuple, variants.group_variants(docs).collect()), key=lambda r: r[0])
    assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_more_sets_find_the_same(spark):
    rows = [(w, n) for w, *_, n, _, _ in brute([r for r in corpus() if not (r[1] or "").startswith("q")])]
    words = spark.createDataFrame(rows, "word string, n long")
    weights = np.arange(variants.LETTERS)
    found = [sorted(map(tuple, variants.near_words(words, variants.letter_sets(weights, s)).collect())) for s in (3, 4, 5, 6)]
    assert found[0] and all(f == found[0] for f in found)
