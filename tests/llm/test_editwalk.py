"""Fingerprints by edit embedding against a plain walk, and near classes."""

import hashlib
import random

import numpy as np
import pytest

from tallyveil.llm import editwalk as E
from tallyveil.llm.arrowtext import mix


def embedded(text):
    """The emitted string, step by step."""
    cls = E.classes(np.array([ord(c) for c in text], np.uint32)).tolist() if text else []
    bit = (E.WAITS == 1).reshape(-1, E.PERIOD)
    i, out = 0, []
    while i < len(text):
        out.append(text[i])
        i += int(bit[cls[i]][(len(out) - 1) % E.PERIOD])
    return out


def plain(text):
    out = embedded(text)
    level = 0
    while len(out) >> level >= 2 * E.CELLS:
        level += 1
    at = [a for a in E.drawn(level).tolist() if a < len(out)]
    u = np.uint64
    return f"{level}:" + "".join("%x" % int(mix(mix(np.array([a], u)) + u(ord(out[a])))[0] >> u(60)) for a in at)


def brute(rows):
    order = sorted(((i is not None, i or 0, t or ""), i) for i, t in rows)
    texts, ids = [k[2] for k, _ in order], [i for _, i in order]
    out = []
    for i, t, after in zip(ids, texts, texts[1:] + texts[:1]):
        h = len(t) // 2
        edited = t[: len(t) - h] + after[:h]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), plain(t), plain(edited), E.likeness(E.parsed(plain(t)), E.parsed(plain(edited))), E.likeness(E.parsed(plain(t)), E.parsed(plain(after)))))
    return out


def texts():
    dice = random.Random(5)
    words = ["".join(dice.choice("abcdefghijklmnopqrstuvwxyzäé") for _ in range(dice.randint(2, 9))) for _ in range(300)]
    out = [" ".join(dice.choice(words) for _ in range(dice.choice([1, 3, 30, 200, 900]))) for _ in range(150)]
    return out + [None, "", "", "x", "日本\U0001f600 \x00", "same", "same", "ab" * 30_000]


@pytest.fixture(scope="module")
def rows():
    ids = list(range(1000, 1000 + len(texts())))
    random.Random(6).shuffle(ids)
    return list(zip(ids, texts()))


key = lambda r: tuple("" if v is None else str(v) for v in r)


@pytest.mark.parametrize("bins,few,chars", [(1, 64, 4 << 20), (40, 3, 3000)])
def test_equals_step_by_step_walk(spark, rows, monkeypatch, bins, few, chars):
    frame = spark.createDataFrame([(i, t, 1, True) for i, t in rows], "doc_id long, text string, bin int, guest boolean").repartition(6)
    assert sorted(map(key, E.fingerprint_documents(frame, bins).collect())) == sorted(map(key, brute(rows)))
    monkeypatch.setattr(E, "FEW", few)
    monkeypatch.setattr(E, "SLICE_CHARS", chars)
    got = [b for b in E._neighbours(_sorted_batches(rows))]
    assert sorted(key(r.values()) for b in got for r in b.to_pylist()) == sorted(map(key, brute(rows)))


def _sorted_batches(rows):
    import pyarrow as pa

    order = sorted((i, t or "") for i, t in rows)
    for i, t in order:
        yield pa.RecordBatch.from_pydict({"bin": [0], "guest": [False], "doc_id": [i], "text": [t]})
    yield pa.RecordBatch.from_pydict({"bin": [0], "guest": [True], "doc_id": [order[0][0]], "text": [order[0][1]]})


def test_null_and_repeated_ids(spark):
    rows = [(None, "b b b"), (None, "a a"), (None, None), (7, "seven"), (7, "other seven"), (7, "seven"), (9, ""), (8, "eight")]
    for bins in (1, 8):
        got = E.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bins)
        assert sorted(map(key, got.collect())) == sorted(map(key, brute(rows)))
    one = E.fingerprint_documents(spark.createDataFrame([(None, "only")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert E.fingerprint_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_edits_stay_near(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = E.fingerprint_documents(docs).where("n_chars >= 100").collect()
    assert np.mean([r.near_edited for r in got]) > 0.4 and np.mean([r.near_next for r in got]) < 0.15
    assert np.mean([r.near_edited > r.near_next for r in got]) > 0.98
    dice, like = random.Random(1), []
    for t in texts()[:100]:
        if len(t) > 1000:
            at = dice.randrange(len(t))
            a, b = E.fingerprints([t, t[:at] + "#" + t[at + 1 + dice.randint(0, 3) :]])
            like.append(E.likeness(a, b))
    assert np.mean(like) > 0.8


def test_levels_compare():
    text = " ".join(f"w{i * i % 997}" for i in range(4000))
    a, b = E.fingerprints([text, text + " and a little more"])
    assert E.likeness(a, b) > 0.95
    n = next(n for n in range(1000, len(text)) if E.fingerprints([text[:n]])[0][0] > E.fingerprints([text[: n - 1]])[0][0])
    a, b = E.fingerprints([text[: n - 20], text[: n + 20]])
    assert a[0] + 1 == b[0] and E.likeness(a, b) > 0.9
    pick = np.random.default_rng(2).random((E.BANDS, E.SAMPLED))
    assert set(E.band_keys(a, pick)) & set(E.band_keys(b, pick))


def test_near_classes(spark):
    dice, rows, classes = random.Random(9), [], {}
    for g in range(40):
        text = " ".join("".join(dice.choice("abcdefghijklmnop") for _ in range(dice.randint(2, 8))) for _ in range(dice.choice([40, 300])))
        for c in range(dice.choice([1, 2, 5])):
            rows.append((100 * g + c, text if c < 3 else text + " tail"))
            classes[100 * g + c] = 100 * g
    rows += [(9001, None), (9002, ""), (None, "no id")]
    classes |= {9001: 9001, 9002: 9001}
    prints = E.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.class_id for r in E.near_classes(prints).collect()}
    assert got.pop(None) is None and got == classes
    assert E.near_classes(prints.where("false")).count() == 0


def shaken(dice, print_, differing, cells):
    level, _, symbols = print_.partition(":")
    out = list(symbols[:cells])
    for at in dice.sample(range(len(out)), differing):
        out[at] = dice.choice([c for c in "0123456789abcdef" if c != out[at]])
    return f"{level}:" + "".join(out)


def test_pairs_at_the_threshold_share_a_key():
    dice = random.Random(12)
    for most in range(1, 2 * E.CELLS + 1):
        for least in {most, most - 1, (13 * most + 15) // 16, dice.randint((13 * most + 15) // 16, most)}:
            differing = least - (13 * most + 15) // 16
            if differing < 0 or least == most and not differing:
                continue
            a = "3:" + "".join(dice.choice("0123456789abcdef") for _ in range(most))
            b = shaken(dice, a, differing, least)
            both = E.Prints.of([a, b])
            assert E.likeness(E.parsed(a), E.parsed(b)) >= E.LIKE and both.alike(np.array([0]), np.array([1])).all()
            keys, rows = E.part_keys(both)
            assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist()), (most, least)
            turns = [E.part_keys(both, t, E.TURNS)[0] for t in range(E.TURNS)]
            assert sorted(np.concatenate(turns).tolist()) == sorted(keys.tolist())


@pytest.mark.parametrize("tile", [4, 1024])
def test_near_classes_hold_every_link(spark, monkeypatch, tile):
    monkeypatch.setattr(E, "TILE", tile)
    dice, prints = random.Random(13), []
    for _ in range(30):  # chains of texts, each at the threshold to the one before; some at the next level
        n = dice.choice([8, 14, 30, 51, 52, 60, 128, 150, 200, 255])
        prints.append(f"{dice.choice([0, 2])}:" + "".join(dice.choice("0123456789abcdef") for _ in range(n)))
        for _ in range(dice.randint(1, 9)):
            prints.append(shaken(dice, dice.choice(prints[-3:]), 0, 256))
            n = len(prints[-1].partition(":")[2])
            prints[-1] = shaken(dice, prints[-1], n - (13 * n + 15) // 16, n)
    for n in (210, 230, 256):
        a = "1:" + "".join(dice.choice("0123456789abcdef") for _ in range(n))
        up = "".join("%x" % x for x in E.at_level(E.parsed(a), 2).tolist())
        up += "0" * max(0, E.CELLS - len(up))
        prints += [a, shaken(dice, "2:" + up, len(E.at_level(E.parsed(a), 2)) - 104, 256) if n > 210 else "2:" + up]
    prints = list(dict.fromkeys(prints))
    dice.shuffle(prints)
    parsed = [E.parsed(p) for p in prints]
    find = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if E.likeness(parsed[i], parsed[j]) >= E.LIKE and find[i] != find[j]:
                low, high = sorted((find[i], find[j]))
                find = [low if f == high else f for f in find]
    assert len(set(find)) < len(prints) / 2
    rows = [(1000 + i, p) for i, p in enumerate(prints)] + [(1000, prints[0]), (None, prints[1])]
    got = E.near_classes(spark.createDataFrame(rows, "doc_id long, fingerprint string").repartition(3)).collect()
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == {1000 + i: 1000 + f for i, f in enumerate(find)}


def test_a_tile_makes_fewer_links_than_rows():
    import pyarrow as pa

    dice, prints = random.Random(14), []
    for n in (150, 200, 255):  # the same cells at a level and the one above
        a = "1:" + "".join(dice.choice("0123456789abcdef") for _ in range(n))
        up = "".join("%x" % x for x in E.at_level(E.parsed(a), 2).tolist()).ljust(E.CELLS, "0")
        prints += [shaken(dice, x, dice.randint(0, 14), 256) for x in [a] * 40 + ["2:" + up] * 20]
    prints += [f"1:{dice.choice('0123456789abcdef') * 140}" for _ in range(9)] + ["0:", "0:a", "0:ab"]
    parsed, n = [E.parsed(p) for p in prints], len(prints)
    side = [i % 2 for i in range(n)]
    for tile, halves, some in ((0, False, n), (1, True, n), (2, False, 30), (3, False, 0)):
        first = [i < some for i in range(n)]
        columns = {"met": [tile] * n, "low": [0] * n, "high": [int(halves)] * n, "node": list(range(n)), "root": [i - i % 3 for i in range(n)], "side": side, "first": first, "fingerprint": prints}
        for size in (n, 25):  # in one tile, and in small ones
            rows = pa.RecordBatch.from_pydict(columns | {"met": [100 * tile + i // size for i in range(n)]})
            links = [(r["a"], r["b"]) for b in E._tile_task(iter([rows.slice(0, 40), rows.slice(40)])) for r in b.to_pylist()]
            want = [i - i % 3 for i in range(n)]
            got = list(want)
            alike = [(i, j) for i in range(n) for j in range(i) if i // size == j // size and (first[i] or first[j]) and not (halves and side[i] == side[j]) and E.likeness(parsed[i], parsed[j]) >= E.LIKE]
            for find, pairs in ((want, alike), (got, links)):
                for i, j in pairs:
                    low, high = sorted((find[i], find[j]))
                    find[:] = [low if f == high else f for f in find]
            assert got == want and len(links) < n and set(map(frozenset, links)) <= set(map(frozenset, alike)), (tile, size)
            assert len(alike) > 5 * n or not some or halves or size < n or some < n


def test_pairs_at_the_threshold_share_two_parts():
    dice = random.Random(15)
    for most in range(8, 2 * E.CELLS + 1):
        for least in {most, most - 1, (13 * most + 15) // 16}:
            a = "3:" + "".join(dice.choice("0123456789abcdef") for _ in range(most))
            both = E.Prints.of([a, shaken(dice, a, least - (13 * most + 15) // 16, least)])
            keys, rows = E.part_keys(both, every=True)
            shared = set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())
            assert E.weak(both).any() or len({k & 31 for k in shared}) > 1, (most, least)


def test_a_common_passage_is_told_apart(spark, monkeypatch):
    """Many texts share a part; those alike are found by another one, short ones by comparing."""
    monkeypatch.setattr(E, "MANY", 20)
    dice, prints, handed = random.Random(16), [], []
    for n in [130] * 150 + [250] * 150 + [70] * 40:
        prints.append(f"{0 if n == 70 else 3}:" + "123456789" * 2 + "".join(dice.choice("0123456789abcdef") for _ in range(n - 18)))
        for _ in range(dice.choice([0] * 40 + [1, 2])):
            tail = shaken(dice, "3:" + prints[-1].partition(":")[2][18:], n - (13 * n + 15) // 16, n)
            prints.append(prints[-1][: prints[-1].index(":") + 19] + tail[2:])
    find, parsed = list(range(len(prints))), [E.parsed(p) for p in prints]
    for i in range(len(prints)):
        for j in range(max(0, i - 3), i):
            if E.likeness(parsed[i], parsed[j]) >= E.LIKE:
                find = [min(find[i], find[j]) if f in (find[i], find[j]) else f for f in find]
    whole, rows = E.settle, [(i, p) for i, p in enumerate(prints)]
    monkeypatch.setattr(E, "settle", lambda df, name, *more: handed.append((name, out := whole(df, name, *more))) or out)
    got = E.near_classes(spark.createDataFrame(rows, "doc_id long, fingerprint string").repartition(3)).collect()
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(find))
    assert next(df for name, df in handed if name == "walk-many").count() > len(prints) / 2
