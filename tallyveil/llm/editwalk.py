"""Document fingerprints by a randomised edit embedding, near copies by parts of them.

Embedding: a pointer walks over a text's characters. At step j it emits the character under it, and moves on if a bit
shared by all texts, drawn for (j mod PERIOD, character), is set. Two texts' walks take the same steps until an edit, and
meet again soon after it; so edit distance becomes Hamming distance between the emitted strings, which are about twice
as long. A character is emitted from step j until the next set bit of its own, so a walk needs one look-up a character.

Fingerprint: one step is drawn from every cell of 2^level steps, where the level makes 128 to 255 cells of the string;
the cells cover the whole string. The step of a cell is that of one of its halves, so a fingerprint of a level holds
those of all higher levels, and texts of different levels compare at the higher one. Each drawn step gives four bits, a
hash of the step and the character emitted. The fingerprint is ``level:hex``, the likeness of two is the part of cells
that agree, less what chance gives.

Classes: parts of the cells with one cell left out are keys by the pigeonhole, so texts as alike as LIKE always share
one; the likeness of their whole fingerprints decides. ``band_keys`` samples cells for a quick look-up of near copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import U64, give_back, mix
from .components import connected
from .shared import settle

PERIOD = 4096
CLASSES = 255  # of characters; class 255 is never used
CELLS = 128  # a fingerprint has this many cells at least (a short text: one a step), fewer than twice as many
SLICE_CHARS = 4 << 20
FEW = 64  # fewer walks than this go one by one
BANDS, SAMPLED = 12, 8
LIKE = 0.8
# cells of the shorter fingerprint (from, below), cells of a part, cells of it that a key leaves out
TIERS = ((0, 12, 3, 0), (12, 29, 6, 1), (29, 52, 8, 1), (52, 2 * CELLS + 1, 9, 1))
TURNS = 3
TILE = 1024
SMALL = 32  # rows of a tile whose pairs are listed
MANY = 256  # members of a key that may be told apart by a second one
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _waits() -> np.ndarray:
    """[class * PERIOD + step] -> steps until the pointer moves on, from there on."""
    bit = np.random.Generator(np.random.PCG64(41)).integers(0, 2, (CLASSES + 1, PERIOD)).astype(bool)
    bit[:, -1] |= ~bit.any(1)
    place = np.where(np.concatenate([bit, bit], 1), np.arange(2 * PERIOD), 2 * PERIOD)
    following = np.minimum.accumulate(place[:, ::-1], 1)[:, ::-1][:, :PERIOD]
    return (following - np.arange(PERIOD) + 1).astype(np.int64).ravel()


WAITS = _waits()
_HALF = 0x9E3779B97F4A7C15


def classes(cp: np.ndarray) -> np.ndarray:
    return (mix(cp.astype(U64) + U64(7)) % U64(CLASSES)).astype(np.uint8)


def walk(cls: np.ndarray, off: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The step at which each character is first emitted, for texts at off[:-1]..off[1:] whose walks begin at steps `begin`.

    One element more than characters for each text: the step after its last one. Text t's part begins at off[t] + t.
    """
    n = np.diff(off)
    out = np.empty(len(cls) + len(n), np.int64)
    at = off[:-1] + np.arange(len(n))
    out[at] = begin
    order = np.argsort(-n, kind="stable")
    live = int((n > 0).sum())
    size, source, target, step = n[order], off[:-1][order].copy(), at[order] + 1, begin[order].astype(np.int64)
    i = 0
    while live >= FEW:
        stop = int(size[live - 1])  # all of these have as many characters
        s, here = step[:live], source[:live]
        to = target[:live]
        while i < stop:
            s += WAITS[(cls[here + i].astype(np.int64) << 12) | (s & (PERIOD - 1))]
            out[to + i] = s
            i += 1
        live = int(np.searchsorted(-size[:live], -i))
    table = None
    for k in range(live):
        if table is None:
            table = _tables()
        j, part = int(step[k]), []
        for c in cls[source[k] + i : source[k] + size[k]].tolist():
            j += table[c][j & 4095]
            part.append(j)
        out[target[k] + i : target[k] + size[k]] = part
    return out


_table: list[list[int]] = []


def _tables() -> list[list[int]]:
    if not _table:
        _table.extend(WAITS.reshape(-1, PERIOD).tolist())
    return _table


def level_of(steps: int) -> int:
    """Cells of 2^level steps: fewer than twice CELLS of them."""
    return max(0, int(steps).bit_length() - CELLS.bit_length())


_drawn: dict[tuple[int, int], np.ndarray] = {}


def descend(level: int, to: int, n: int) -> np.ndarray:
    """For the first n cells of a level, the index of the cell of level `to` that stands for each."""
    at = np.arange(n, dtype=np.int64)
    for k in range(level, to, -1):
        at = 2 * at + (mix(at.astype(U64) + U64(k * _HALF % (1 << 64))) & U64(1)).astype(np.int64)
    return at


def drawn(level: int) -> np.ndarray:
    """The steps drawn at a level."""
    if level not in _drawn:
        _drawn[level] = descend(level, 0, 2 * CELLS)
    return _drawn[level]


_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def fingerprint(cp: np.ndarray, first: np.ndarray) -> tuple[int, np.ndarray]:
    """Level and symbols (0 to 15) of a text from its code points and its walk's steps, one more than characters."""
    steps = int(first[-1])
    level = level_of(steps)
    at = drawn(level)
    at = at[at < steps]
    char = cp[np.searchsorted(first, at, "right") - 1]
    return level, (mix(mix(at.astype(U64)) + char.astype(U64)) >> U64(60)).astype(np.uint8)


def shown(print_: tuple[int, np.ndarray]) -> str:
    return f"{print_[0]}:" + _HEX[print_[1]].tobytes().decode()


def parsed(text: str) -> tuple[int, np.ndarray]:
    level, _, symbols = text.partition(":")
    raw = np.frombuffer(symbols.encode(), np.uint8)
    return int(level), np.where(raw > 57, raw - 87, raw - 48).astype(np.uint8)


def at_level(print_: tuple[int, np.ndarray], level: int) -> np.ndarray:
    """The symbols of a fingerprint at its own or a higher level."""
    own, symbols = print_
    if own == level:
        return symbols
    at = descend(level, own, 2 * CELLS)
    return symbols[at[at < len(symbols)]]


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Part of the cells that agree, less the sixteenth that chance gives; cells of the longer text alone disagree."""
    level = max(a[0], b[0])
    x, y = at_level(a, level), at_level(b, level)
    most, least = max(len(x), len(y)), min(len(x), len(y))
    if not most:
        return 1.0
    return max(0.0, (16 * int((x[:least] == y[:least]).sum()) / most - 1) / 15)


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"), off


def fingerprints(texts: list[str]) -> list[tuple[int, np.ndarray]]:
    """The fingerprint of each whole text."""
    cp, off = _code_points(texts)
    first = walk(classes(cp), off, np.zeros(len(texts), np.int64))
    return [fingerprint(cp[a:b], first[a + t : b + t + 1]) for t, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist()))]


def _compared(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows of all texts but the last, each with the text after it."""
    cp, off = _code_points(texts)
    cls, n = classes(cp), np.diff(off)
    first = walk(cls, off, np.zeros(len(n), np.int64))
    half = n[:-1] // 2
    kept = n[:-1] - half  # characters of the edited text that are the text's own: its walk goes on from there
    taken = np.minimum(half, n[1:])
    tail_off = np.concatenate([[0], np.cumsum(taken)])
    source = np.repeat(off[1:-1] - tail_off[:-1], taken) + np.arange(tail_off[-1])
    tail = walk(cls[source], tail_off, first[off[:-2] + np.arange(len(half)) + kept])
    prints, edited, digests = [], [], []
    for t in range(len(n)):
        a, b = int(off[t]), int(off[t + 1])
        prints.append(fingerprint(cp[a:b], first[a + t : b + t + 1]))
        if t < len(half):
            k, c, d = int(kept[t]), int(tail_off[t]), int(tail_off[t + 1])
            edited.append(fingerprint(np.concatenate([cp[a : a + k], cp[b : b + d - c]]), np.concatenate([first[a + t : a + t + k], tail[c + t : d + t + 1]])))
            digests.append(hashlib.sha256((texts[t][:k] + texts[t + 1][: d - c]).encode()).hexdigest())
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(ids[:-1], pa.int64()), "n_chars": pa.array(n[:-1]), "edited_sha256": pa.array(digests, pa.string()), "fingerprint": pa.array(map(shown, prints[:-1]), pa.string()), "edited_fingerprint": pa.array(map(shown, edited), pa.string()),
        "near_edited": pa.array(map(likeness, prints, edited), pa.float64()), "near_next": pa.array(map(likeness, prints, prints[1:]), pa.float64()),
    })


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task in order; a guest row ends each bin and gets no row of its own."""
    give_back()
    ids, texts, held = [], [], 0
    for batch in batches:
        for bin_, guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bin", "guest", "doc_id", "text"))):
            if guest and not texts:
                continue  # one guest of the bin has come already
            ids.append(doc_id)
            texts.append(text)
            held += len(text)
            if guest or held > SLICE_CHARS and len(texts) > 1:
                yield _compared(ids, texts)
                ids, texts = ([], []) if guest else ([doc_id], [text])
                held = sum(map(len, texts))
    give_back()


def _dealer(bounds: list[int], first: int | None):
    """Rows (bin, guest, doc_id, text): each row in its bin, and the task's first row of a bin also in the bin before."""
    edges = np.array(bounds, np.int64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guests: dict[int, tuple[str, int | None]] = {}
        for batch in batches:
            ids, null = batch.column("doc_id"), np.asarray(batch.column("doc_id").is_null())
            place = np.where(null, 0, np.searchsorted(edges, ids.fill_null(0).to_numpy(), "right"))
            values = ids.to_pylist()
            begins = ~null & (place > 0) & np.isin(ids.fill_null(0).to_numpy(), edges)
            starts = np.array([v == first for v in values], bool)
            for at, to in [*((i, int(place[i]) - 1) for i in np.flatnonzero(begins).tolist()), *((i, len(edges)) for i in np.flatnonzero(starts).tolist())]:
                text = batch.column("text")[at].as_py()
                if to not in guests or text < guests[to][0]:
                    guests[to] = (text, values[at])
            yield pa.RecordBatch.from_pydict({"bin": pa.array(place, pa.int32()), "guest": pa.array(np.zeros(len(place), bool)), "doc_id": ids, "text": batch.column("text")})
        for to, (text, doc_id) in guests.items():
            yield pa.RecordBatch.from_pydict({"bin": pa.array([to], pa.int32()), "guest": pa.array([True]), "doc_id": pa.array([doc_id], pa.int64()), "text": pa.array([text], pa.string())})

    return task


def fingerprint_documents(docs: DataFrame, bins: int | None = None) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and how like they and the next document's are.

    The edited text ends with the next document's beginning in place of its own second half. The next document is that
    of the next doc_id; rows of one doc_id are ordered by text, null doc_ids come first, and the last row's next is the
    first. Null text: empty. Equal texts have equal fingerprints; two empty texts have likeness 1. Other columns are not
    read. Rows of one doc_id go to one task, which reads them one slice after another.

    Documents are dealt into bins of consecutive doc_ids, whose bounds are doc_ids that occur: so the first document of
    each bin, which also ends the bin before it, is known before the shuffle, and text is shuffled once.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bins = bins or 4 * tasks
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows, known, least, found = docs.agg(F.count("*"), F.count("doc_id"), F.min("doc_id"), F.percentile_approx("doc_id", [i / bins for i in range(bins)], 10 * bins)).first()
    bounds = sorted({x for x in found or () if x > least})
    dealt = docs.mapInArrow(_dealer(bounds, least if rows == known else None), "bin int, guest boolean, doc_id long, text string")
    return dealt.repartition(tasks, "bin").sortWithinPartitions("bin", "guest", "doc_id", "text").mapInArrow(_neighbours, SCHEMA)


def band_keys(print_: tuple[int, np.ndarray], pick: np.ndarray) -> np.ndarray:
    """Keys of a fingerprint's bands: of its first n cells, for the three highest n that are multiples of 16.

    A text that nearly fills its level has the bands of the next one, too; so texts whose numbers of cells differ by a
    sixteenth at least, and mostly by up to a fifth, have common bands. Texts of under 48 steps: only those of as many.
    """
    level, symbols = print_
    q = len(symbols) // 16 * 16
    views = [(level, symbols, n) for n in (q, q - 16, q - 32)] if q >= 48 else [(level, symbols, len(symbols))]
    if q >= 208:
        above = at_level(print_, level + 1)
        views.append((level + 1, above, len(above) // 16 * 16))
    out = []
    for level, symbols, n in views:
        h = np.full(len(pick), level << 16 | n, U64) + (np.arange(len(pick), dtype=U64) << U64(32))
        for column in (pick.T * n).astype(np.int64) if n else ():
            h = mix(h) + symbols[column].astype(U64)
        out.append(mix(h))
    return np.concatenate(out)


@dataclass(frozen=True)
class Prints:
    """Fingerprints as rows of symbols, at their own level and the next one; 16 stands after the last cell."""

    level: np.ndarray
    own: np.ndarray
    above: np.ndarray

    @staticmethod
    def of(texts: list[str]) -> Prints:
        parts = [t.partition(":") for t in texts]
        level = np.fromiter((int(p[0]) for p in parts), np.int64, len(parts))
        raw = np.frombuffer("".join(p[2] for p in parts).encode(), np.uint8)
        own = np.full((len(parts), 2 * CELLS), 16, np.uint8)
        own[np.arange(2 * CELLS) < np.array([len(p[2]) for p in parts], int)[:, None]] = np.where(raw > 57, raw - 87, raw - 48)
        above = np.full((len(parts), CELLS), 16, np.uint8)
        for k in np.unique(level).tolist():
            above[level == k] = own[level == k][:, descend(k + 1, k, CELLS)]
        return Prints(level, own, above)

    def alike(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the rows i have a likeness of LIKE at least to the rows j.

        Where levels differ by two or more, the shorter text has half as many cells as the longer one at most.
        """
        out = np.zeros(len(i), bool)
        for up in (-1, 0, 1):
            at = np.flatnonzero(self.level[j] - self.level[i] == up)
            for part in np.array_split(at, len(at) // TILE + 1):
                x = (self.above if up > 0 else self.own)[i[part]]
                y = (self.above if up < 0 else self.own)[j[part]]
                most = np.maximum((x < 16).sum(1), (y < 16).sum(1))
                least = min(x.shape[1], y.shape[1])
                agree = ((x[:, :least] == y[:, :least]) & (x[:, :least] < 16)).sum(1)
                out[part] = 16 * agree >= 13 * most  # a likeness of 0.8
        return out


def apart(cells: np.ndarray) -> np.ndarray:
    """The most cells that differ within the shorter of two alike fingerprints, which has this many cells."""
    return 3 * cells // 16


def part_keys(prints: Prints, turn: int = 0, turns: int = 1, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and the rows they are of: any two alike fingerprints have a key in common. Turns deal the parts out.

    The low five bits of a key are its part. every: keys of all parts that have room, not just as many as needed; any
    two alike fingerprints that are not ``weak`` then have keys in common in two parts.

    The first cells are cut into parts of `width` cells, more parts than half the cells that may differ. So in one part
    of an alike pair one cell at most differs, and the keys of a part are its cells but one. Of fewer than twelve cells:
    more parts than cells that may differ, and keys of whole parts. The range of the shorter one's number of cells
    decides the width, so one near the end of a range has the parts of both. Of different levels, those of 104 cells or
    more at the next level can be alike to one of that level.
    """
    keys, rows = [], []
    for level, cells, fewest in ((prints.level, prints.own, 0), (prints.level + 1, prints.above, 13 * CELLS // 16)):
        n = (cells < 16).sum(1)
        for tier, (low, high, width, but) in enumerate(TIERS):
            least = np.minimum(n, high - 1)
            parts = least // width if every else np.minimum(apart(least) // (1 + but) + 1, least // width)
            parts[(n < max(low, fewest)) | (-(-13 * n // 16) >= high)] = 0
            for i in range(turn, int(parts.max(initial=0)), turns):
                of = np.flatnonzero(parts > i)
                held = (cells[of, i * width : (i + 1) * width].astype(U64) << (4 * np.arange(width, dtype=U64))).sum(1, dtype=U64)
                for out in range(width) if but else (width,):
                    tag = mix((level[of].astype(U64) << U64(32)) + U64(tier << 24 | i << 8 | out))
                    keys.append(mix((held & ~(U64(15) << U64(4 * out))) ^ tag) & ~U64(31) | U64(i))
                    rows.append(of)
    if not keys:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(rows)


def weak(prints: Prints) -> np.ndarray:
    """Whether a longer fingerprint can be alike to this one with a key of one part only in common."""
    out = np.zeros(len(prints.level), bool)
    for cells, fewest in ((prints.own, 0), (prints.above, 13 * CELLS // 16)):
        n = (cells < 16).sum(1)
        for low, high, width, but in TIERS:
            out |= (n >= max(low, fewest)) & (n < high) & (n // width - apart(n) // (1 + but) < 2)
    return out


def _graded_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            yield part.append_column("weak", pa.array(weak(Prints.of(part.column("fingerprint").to_pylist())), pa.bool_()))


def _finer_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the members of a key in all of its other parts."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            keys, rows = part_keys(Prints.of(part.column("fingerprint").to_pylist()), every=True)
            met, node, own = (part.column(c).to_numpy() for c in ("met", "node", "part"))
            other = (keys & U64(31)) != own[rows].astype(U64)
            keys, rows = keys[other], rows[other]
            keys = (mix(keys ^ mix(met.view(U64))[rows]) & ~U64(31)) | (keys & U64(31))
            for k in range(0, len(keys), 1 << 17):
                yield pa.RecordBatch.from_pydict({"key": keys[k : k + (1 << 17)].view(np.int64), "node": node[rows[k : k + (1 << 17)]]})


def _keys_task(turn: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                keys, rows = part_keys(Prints.of(part.column("fingerprint").to_pylist()), turn, TURNS)
                node = part.column("node").to_numpy()
                for k in range(0, len(keys), 1 << 17):
                    yield pa.RecordBatch.from_pydict({"key": keys[k : k + (1 << 17)].view(np.int64), "node": node[rows[k : k + (1 << 17)]]})

    return task


def _met(key: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    """(met, node, part) of whole keys with several nodes; keys with the same nodes have the same name `met`."""
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    runs = np.diff(np.append(first, len(key)))
    name = np.add.reduceat(mix(node.view(U64)), first) if len(key) else np.zeros(0, U64)
    several = np.repeat(runs > 1, runs)
    return pa.RecordBatch.from_pydict({"met": np.repeat(mix(name).view(np.int64), runs)[several], "node": node[several], "part": (key[several] & 31).astype(np.int32)})


def _met_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a node has a key once."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = (batch.column(c).to_numpy() for c in ("key", "node"))
        held.append((key, node))
        if key[-1] != held[0][0][0]:
            key, node = map(np.concatenate, zip(*held))
            last = int(np.searchsorted(key, key[-1]))
            yield _met(key[:last], node[:last])
            held = [(key[last:], node[last:])]
    if held:
        yield _met(*map(np.concatenate, zip(*held)))


def _alike_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        prints = Prints.of(batch.column("fa").to_pylist() + batch.column("fb").to_pylist())
        yield batch.filter(pa.array(prints.alike(np.arange(n), np.arange(n, 2 * n)), pa.bool_())).select(["a", "b"])


def planes(cells: np.ndarray) -> np.ndarray:
    """[bit, word, row]: the symbols' five bits, each of 2 * CELLS cells in 64-bit words."""
    full = np.full((len(cells), 2 * CELLS), 16, np.uint8)
    full[:, : cells.shape[1]] = cells
    return np.stack([np.ascontiguousarray(np.packbits(full >> b & 1, axis=1).view(U64).T) for b in range(5)])


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """[row of x, row of y]: in how many cells they differ, those of the longer one alone included."""
    out = np.zeros((x.shape[2], y.shape[2]), np.int16)
    for word in range(x.shape[1]):
        some = x[0, word][:, None] ^ y[0, word]
        for bit in range(1, 5):
            some |= x[bit, word][:, None] ^ y[bit, word]
        out += np.bitwise_count(some)
    return out


def tile_links(prints: Prints, root: np.ndarray, side: np.ndarray, first: np.ndarray, halves: bool) -> list[tuple[int, int]]:
    """Links that join the roots of a tile as all of its links do, fewer than rows.

    Compared are pairs of different roots, of which a row at least is `first`, and in halves, of different sides.
    """
    label, out = np.unique(root, return_inverse=True)[1], []
    views = [(planes(c), (c < 16).sum(1)) for c in (prints.own, prints.above)]
    for level in np.unique(prints.level).tolist():
        rows = np.flatnonzero(prints.level == level)
        below = np.flatnonzero(prints.level == level - 1)
        for other, (bits, n) in ((rows, views[0]), (below, views[1])):
            for mine, theirs in ((rows[first[rows]], other), (rows[~first[rows]], other[first[other]])):
                for part in np.array_split(mine, len(mine) // 64 + 1):
                    if not len(part) or not len(theirs):
                        continue
                    most = np.maximum(views[0][1][part][:, None], n[theirs])
                    good = 16 * differing(views[0][0][:, :, part], bits[:, :, theirs]) <= 3 * most  # a likeness of 0.8
                    good &= label[part][:, None] != label[theirs]
                    if halves:
                        good &= side[part][:, None] != side[theirs]
                    for k in np.flatnonzero(good.any(1)).tolist():
                        near = theirs[good[k]]
                        labels, at = np.unique(label[near], return_index=True)
                        new = labels != label[part[k]]
                        out += [(int(part[k]), j) for j in near[at[new]].tolist()]
                        label[np.isin(label, labels)] = label[part[k]]
    return out


def small_links(prints: Prints, root: np.ndarray, side: np.ndarray, first: np.ndarray, halves: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """As tile_links, of all tiles of SMALL rows at most at once."""
    tile = np.repeat(np.arange(len(begin)), end - begin)
    i, step, out, found = np.flatnonzero((end - begin <= SMALL)[tile]), 1, [], {}

    def top(x: tuple[int, int]) -> tuple[int, int]:
        while x in found:
            x = found[x]
        return x

    while len(i := i[i + step < end[tile[i]]]):
        j = i + step
        use = (root[i] != root[j]) & (first[i] | first[j]) & (~halves[i] | (side[i] != side[j]))
        x, y = i[use], j[use]
        good = prints.alike(x, y)
        for a, b in zip(x[good].tolist(), y[good].tolist()):
            u, v = top((int(tile[a]), int(root[a]))), top((int(tile[b]), int(root[b])))
            if u != v:
                found[v] = u
                out.append((a, b))
        step += 1
    return out


def _tile_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between different roots of each tile. Rows come sorted by tile; a tile has 2 * TILE rows or so."""
    held: list[pa.RecordBatch] = []
    names = ["met", "low", "high"]

    def links(table: pa.Table) -> pa.RecordBatch:
        tile = np.stack([table[c].to_numpy() for c in names], 1)
        node, root, side, first = (table[c].to_numpy() for c in ("node", "root", "side", "first"))
        prints = Prints.of(table["fingerprint"].to_pylist())
        begin = np.flatnonzero(np.append(True, (tile[1:] != tile[:-1]).any(1)))
        end = np.append(begin[1:], len(tile))
        pairs = small_links(prints, root, side, first, tile[:, 1] != tile[:, 2], begin, end)
        for a, b in zip(begin.tolist(), end.tolist()):
            if b - a > SMALL and (root[a:b] != root[a]).any():
                some = Prints(prints.level[a:b], prints.own[a:b], prints.above[a:b])
                pairs += [(a + i, a + j) for i, j in tile_links(some, root[a:b], side[a:b], first[a:b], tile[a, 1] != tile[a, 2])]
        at = np.array(pairs, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_pydict({"a": node[at[:, 0]], "b": node[at[:, 1]]})

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < TILE:
            continue
        table = pa.Table.from_batches(held)
        same = np.logical_and.reduce([table[c].to_numpy() == batch.column(c)[-1].as_py() for c in names])
        last = int(same.argmax())
        if last:
            yield links(table.slice(0, last))
        held = table.slice(last).combine_chunks().to_batches()
    if held:
        yield links(pa.Table.from_batches(held))


def near_classes(prints: DataFrame) -> DataFrame:
    """prints(doc_id, fingerprint, ...) with class_id: the smallest doc_id reachable by links from the row's fingerprint.

    Fingerprints are linked where their likeness is at least LIKE; no link is left out, since any two such fingerprints
    share a key (``part_keys``). Keys are made and met in TURNS, so that they never lie on disk all at once. Each member
    of a key is compared with its smallest. Then, where a key holds several components, all are compared across
    components in tiles of bounded size, of which only links that join components leave. A key of MANY members, most of
    them apart, is told apart by a second key first, of another of its parts: alike fingerprints share two parts, except
    to short texts and a few lengths (``weak``), whose rows are compared with all of the key. So texts that have one
    passage in common cost no square of their number; texts with most parts in common that are not linked do.
    A row without doc_id has no part in this.
    """
    groups = prints.where("doc_id IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    groups = groups.withColumn("node", F.xxhash64("fingerprint"))
    groups = settle(groups.mapInArrow(_graded_task, "fingerprint string, least long, node long, weak boolean"), "walk-groups")
    met_task = lambda keys: keys.repartition("key").sortWithinPartitions("key").mapInArrow(_met_task, "met long, node long, part int")
    once = lambda met: met.groupBy("met", "node").agg(F.min("part").alias("part"))
    met = None
    for turn in range(TURNS):
        keys = groups.select("fingerprint", "node").mapInArrow(_keys_task(turn), "key long, node long")
        rows = settle(once(met_task(keys)), "walk-met")
        met = rows if met is None else met.unionByName(rows)
    met = settle(once(met), "walk-met")
    hubs = met.groupBy("met").agg(F.min("node").alias("a"))
    pairs = met.join(hubs, "met").where("node != a").select("a", F.col("node").alias("b")).distinct()
    of = lambda node, fp: groups.select(F.col("node").alias(node), F.col("fingerprint").alias(fp))
    links = settle(pairs.join(of("a", "fa"), "a").join(of("b", "fb"), "b").select("a", "b", "fa", "fb").mapInArrow(_alike_task, "a long, b long"), "walk-links")
    comp = settle(connected(links), "walk-comp")

    root_of = lambda met, *more: met.join(comp, "node", "left").select("met", "node", F.coalesce("root", "node").alias("root"), *more)
    rooted = settle(root_of(met, "part"), "walk-rooted")
    sizes = rooted.groupBy("met").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.expr("count_if(node = root)").alias("alone")).where("lo != hi AND n > 2")
    rows = settle(rooted.join(sizes.select("met", F.expr(f"n > {MANY} AND 8 * alone >= 7 * n").alias("finer")), "met"), "walk-rows")
    many = settle(rows.where("finer").join(groups.select("node", "fingerprint", "weak"), "node"), "walk-many")
    fine = settle(once(met_task(many.where("NOT weak").mapInArrow(_finer_task, "key long, node long"))), "walk-met")
    parts = [rows.where("NOT finer").select("met", "node", "root", F.lit(True).alias("first")), many.select("met", "node", "root", F.col("weak").alias("first")), root_of(fine, F.lit(True).alias("first"))]
    rest = settle(parts[0].unionByName(parts[1]).unionByName(parts[2]), "walk-rest")
    several = rest.groupBy("met").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("first").alias("some")).where("lo != hi AND some").selectExpr("met", "cast(ceil(n / {t}) AS int) AS tiles".format(t=TILE))
    rest = rest.join(several, "met").withColumn("side", F.pmod(F.xxhash64("node", "met"), F.col("tiles")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)"))).selectExpr("met", "node", "root", "first", "side", "least(side, other) AS low", "greatest(side, other) AS high")
    rest = rest.join(groups.select("node", "fingerprint"), "node").repartition("met", "low", "high").sortWithinPartitions("met", "low", "high")
    more = settle(rest.mapInArrow(_tile_task, "a long, b long").distinct(), "walk-links")
    if not more.isEmpty():
        comp = settle(connected(links.unionByName(more)), "walk-comp")

    of_node = groups.join(comp, "node", "left").select("fingerprint", "least", F.coalesce("root", "node").alias("root"))
    classes_ = of_node.groupBy("root").agg(F.min("least").alias("class_id"))
    named = of_node.join(classes_, "root").select("fingerprint", "class_id")
    return prints.join(named, "fingerprint", "left").select(*prints.columns, "class_id")
