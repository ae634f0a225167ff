"""Null ids, repeated rows and clashing columns for every operator; the whole pipeline against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tallyveil.llm import bpe_fst, editwalk, packing, parityjoin, perplexity, quality, sstable, substring, urlfilter, variants
from tallyveil.llm.queries import RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = " ".join(f"w{i % 61}x{i % 43}" for i in range(120))
ROWS = [(None, TEXT), (None, None), (None, TEXT), (5, TEXT), (5, TEXT), (5, "other words"), (6, ""), (7, "tie a"), (8, "tie b"), (9, TEXT + " end")]


@pytest.fixture(scope="module")
def odd(spark):
    clash = [(i, t, "en", "k", 1, b"v", 2.0, True) for i, t in ROWS]
    return spark.createDataFrame(clash, "doc_id long, text string, lang string, key string, chunk int, node binary, score double, kept boolean").repartition(3)


def counted(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_rows_are_kept_one_by_one(odd):
    ids = Counter((i,) for i, _ in ROWS)
    words = Counter((i, len(WORD.findall(t or ""))) for i, t in ROWS)
    assert counted(perplexity.quality_rules(odd), "doc_id", "n_words") == words
    assert counted(substring.digests(odd), "doc_id", "n_words") == words
    assert counted(editwalk.fingerprint_documents(odd), "doc_id", "n_chars") == Counter((i, len(t or "")) for i, t in ROWS)
    assert counted(quality.score_documents(odd, quality.grow(np.zeros((0, len(quality.FEATURES))), np.zeros(0))), "doc_id") == ids
    assert counted(sstable.digests(odd, P.path("word_bpe_49k.json"), 2), "doc_id") == ids
    assert counted(parityjoin.link_documents(odd, parityjoin.Spec(words=3, percent=90)), "doc_id") == ids


def test_byte_bpe_of_null_and_repeated_ids(odd):
    import base64

    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((i, len(library.encode_ordinary(t or ""))) for i, t in ROWS)
    assert counted(bpe_fst.digests(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), "doc_id", "n_tokens") == want


def test_packing_of_null_and_repeated_ids(odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = Counter()
    for i, t in ROWS:
        want[i] += len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in packing.pack_documents(odd, P.path("byte_bpe_50k.json")).collect():
        got[r.doc_id] += r.length
    assert got == want


def test_urls_with_null_and_repeated_ids(spark):
    urls = ["http://a.com/en/1", "http://a.com/en/1", None, "no scheme", "http://b.net/de/x?y=1", "http://c.org/es/2", "http://d.com/fr", "http://example.com/en/7"]
    rows = [(None if n % 3 == 0 else n // 2, u, "h", "p", "v", 1.0) for n, u in enumerate(urls * 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, verdict string, suffix double").repartition(4)
    got = urlfilter.classify(pages, RULES)
    assert counted(got, "page_id") == Counter((r[0],) for r in rows)
    assert got.where("host = '' AND path != ''").count() == 0 and got.where("rule IS NOT NULL AND host = 'd.com'").count() == 0
    by_host = defaultdict(set)
    for r in got.where("rule IS NOT NULL").collect():
        by_host[r.host, r.path].add(r.verdict)
    assert all(len(v) == 1 for v in by_host.values()) and by_host["example.com", "/en/7"] == {"allow"}


def test_variants_of_repeated_rows_count_each(spark):
    rows = [(1, "spelling spelling"), (1, "spelling spelling"), (2, None)]
    got = variants.group_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.n for r in got) in (4,)


def test_pipeline_equals_its_stages_by_brute_force(spark):
    """Quality by the classifier's own scores, exact and near copies by all pairs, packed tokens by the library."""
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    packed = pipeline.run(spark, sf).collect()
    good = {r.doc_id for r in quality.score_documents(docs, quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect() if r.predicted}
    text = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id in good}
    groups = defaultdict(list)
    for i, t in text.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append(i)
    kept = {min(g, key=lambda i: (-len(text[i]), i)) for g in groups.values()}

    def shingles(t):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = {i: shingles(text[i]) for i in kept}
    root = {i: i for i in kept}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(kept)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    found = {r.doc_id for r in packed}
    assert found <= kept and len({find(i) for i in kept}) == len(found) == len({find(i) for i in found})
    pieces = defaultdict(list)
    for r in packed:
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens))
    for parts in pieces.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:])) and sum(p[1] for p in parts) == parts[0][2]
    sequences = defaultdict(list)
    for r in packed:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:])) and sum(p[1] for p in parts) <= 2048
    from tokenizers import Tokenizer

    from tallyveil.llm import pii

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    stays = pii.mask(docs.where(F.col("doc_id").isin(sorted(found)))).collect()
    assert {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in stays} == {i: p[0][2] for i, p in pieces.items()}
