"""Substring deduplication: words inside passages that stand in the corpus more than once.

A window is a run of WINDOW words. A word goes if a window over it has the same words as a window that
starts anywhere else. Two passes over the corpus find those windows:

1. Every task keeps a count-min sketch of fixed size, the tasks' sketches are merged block by block,
   and the merged one is broadcast. Counters stop at two, since only "once" and "more" matter, so a
   sketch is two bitmaps and only the second is broadcast. What is counted for a window is its minimizer:
   the smallest hash of its runs of GRAM words, at every place where it stands. Equal windows have the same
   minimizer, each at a place of its own, so the estimate for a window is never below its true count;
   a minimizer serves ten windows or so, and the sketch holds ten times as many.
2. Windows whose estimate is two or more are grouped exactly, by a hash of 128 bits of their words. Only
   the ones found to be alone are taken back: an aggregate with one row per window, combined before the
   shuffle, so that a window found in a third of all documents is no burden on any task.

The sketch's size is a parameter. With more words than it is made for, more windows are grouped that need
not be, and the second pass grows up to grouping all windows; none is lost.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.scratch import settle

WINDOW = 35
GRAM = 16
# The sketch: rows, and counters in each (a power of two); a bitmap has ROWS * COUNTERS / 8 bytes.
ROWS = 2
COUNTERS = 1 << 27
BLOCK_BYTES = 1 << 16
# Tasks of the first pass for each core, each with a sketch.
TASKS_PER_CORE = 8
# Texts are worked on together up to so many bytes.
PIECE_BYTES = 1 << 20
# Windows that go to Spark in one batch.
LISTED = 1 << 16

_GAPS = np.zeros(256, bool)
_GAPS[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x + _ODD * np.uint64(salt + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


# Two families of hashes: a number for each byte, and the base its place in a word is weighed by.
_LETTERS = [_mixed(np.arange(256, dtype=np.uint64), 100 + f) for f in range(2)]
_BASES = [int(_mixed(np.array([f], np.uint64), 200)[0]) | 1 for f in range(2)]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(raw: bytes, family: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``raw`` start, and a 64-bit hash of each."""
    starts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    data = np.frombuffer(raw, np.uint8)
    while at < len(raw):
        end = min(at + PIECE_BYTES, len(raw))
        while end < len(raw) and not _GAPS[data[end]]:
            end += 1
        piece = data[at:end]
        gap = _GAPS[piece]
        edges = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
        first, last = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        if len(first):
            sizes = last - first
            before = np.cumsum(sizes) - sizes
            place = np.arange(before[-1] + sizes[-1]) - np.repeat(before, sizes)
            value = _LETTERS[family][piece[~gap]] * _powers(_BASES[family], int(sizes.max()))[place]
            hashes.append(_mixed(np.add.reduceat(value, before), family))
            starts.append(first + at)
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def run_hashes(words: np.ndarray, size: int, family: int = 0) -> np.ndarray:
    """A hash of every run of ``size`` words, from runs of half the size."""
    base, out, done, at = _BASES[family], None, 0, words
    length = 1
    while True:
        if size & length:
            if out is None:
                out = at
            else:
                n = len(words) - done - length + 1
                out = out[:n] + np.uint64(pow(base, done, 2**64)) * at[done:done + n] if n > 0 else words[:0]
            done += length
        if done == size:
            return out
        n = len(at) - length
        at = at[:n] + np.uint64(pow(base, length, 2**64)) * at[length:] if n > 0 else words[:0]
        length *= 2


def _slid(values: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every run of ``size`` values."""
    span = 1
    while span * 2 <= size:
        values = pick(values[:-span], values[span:]) if len(values) > span else values[:0]
        span *= 2
    left = size - span
    return pick(values[:-left], values[left:]) if left and len(values) > left else values if not left else values[:0]


class Piece:
    """Some texts, their words in a row, and which windows lie within one text."""

    def __init__(self, texts: list[bytes], window: int):
        self.raw = b"\n".join(texts)
        self.starts, self.words = word_hashes(self.raw, 0)
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.last = np.searchsorted(self.starts, ends)  # words up to the end of each text
        self.first = np.concatenate(([0], self.last[:-1]))
        self.window = window
        n = max(0, len(self.words) - window + 1)
        home = np.repeat(self.last, self.last - self.first)[:n]
        self.inside = np.arange(n) + window <= home

    def minimizers(self, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """The minimizer of every window, and the values of all places that are the minimizer of a
        window over them (with ties, each place)."""
        grams = _mixed(run_hashes(self.words, gram), 7) | np.uint64(1)  # 0 stands for no window
        span = self.window - gram + 1
        least = _slid(grams, span, np.minimum)
        seen = np.where(self.inside, least, np.uint64(0))
        edge = np.zeros(span - 1, np.uint64)
        highest = _slid(np.concatenate((edge, seen, edge)), span, np.maximum)
        return least, grams[(highest == grams) & (highest > 0)] if len(seen) else grams[:0]


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about PIECE_BYTES of text, or one longer text, and their texts."""
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        at, used = 0, 0
        for i, size in enumerate(pc.binary_length(texts).to_pylist()):
            if used and used + size > PIECE_BYTES:
                yield batch.slice(at, i - at), texts.slice(at, i - at).to_pylist()
                at, used = i, 0
            used += size
        if at < len(texts):
            yield batch.slice(at), texts.slice(at).to_pylist()


def _cells(values: np.ndarray, counters: int) -> Iterator[np.ndarray]:
    for row in range(ROWS):
        yield (_mixed(values, 300 + row) & np.uint64(counters - 1)).astype(np.int64) + row * counters


class Sketch:
    """A count-min sketch with counters that stop at two: ``once`` and ``twice`` are bitmaps."""

    def __init__(self, counters: int):
        self.counters = counters
        self.once = np.zeros(ROWS * counters // 8, np.uint8)
        self.twice = np.zeros(ROWS * counters // 8, np.uint8)

    def add(self, values: np.ndarray) -> None:
        for cells in _cells(values, self.counters):
            cells, n = np.unique(cells, return_counts=True)
            at, bit = cells >> 3, np.uint8(1) << (cells & 7).astype(np.uint8)
            again = (n > 1) | ((self.once[at] & bit) > 0)
            np.bitwise_or.at(self.twice, at[again], bit[again])
            np.bitwise_or.at(self.once, at, bit)


def repeated(values: np.ndarray, twice: np.ndarray, counters: int) -> np.ndarray:
    """Whether the estimate of each value is two or more."""
    out = np.ones(len(values), bool)
    for cells in _cells(values, counters):
        out &= (twice[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 > 0
    return out


def _sketcher(window: int, gram: int, counters: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Sketch(counters)
        for _, texts in pieces(batches):
            held.add(Piece(texts, window).minimizers(gram)[1])
        for at in range(0, len(held.once), BLOCK_BYTES):
            once = held.once[at:at + BLOCK_BYTES]
            if once.any():
                packed = [zlib.compress(x, 1) for x in (once, held.twice[at:at + BLOCK_BYTES])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at // BLOCK_BYTES], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)],
                    names=["block", "once", "twice"])

    return sketch


def _merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of partial sketches into one of each; a task holds its own blocks only."""
    held: dict[int, tuple] = {}
    for batch in batches:
        for block, *both in zip(*(batch.column(c).to_pylist() for c in ("block", "once", "twice"))):
            once, twice = (np.frombuffer(zlib.decompress(x), np.uint8) for x in both)
            if block in held:
                o, t = held[block]
                once, twice = o | once, t | twice | (o & once)
            held[block] = once, twice
    for block, (_, twice) in held.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), pa.array([zlib.compress(twice, 1)], pa.binary())],
            names=["block", "twice"])


def merged_sketch(docs: DataFrame, window: int, gram: int, counters: int) -> np.ndarray:
    """The bitmap of counters at two of the whole corpus, ROWS * counters / 8 bytes."""
    tasks = TASKS_PER_CORE * docs.sparkSession.sparkContext.defaultParallelism
    partial = docs.coalesce(tasks).mapInArrow(
        _sketcher(window, gram, counters), "block int, once binary, twice binary")
    merged = partial.repartition("block").mapInArrow(_merger, "block int, twice binary")
    out = np.zeros(ROWS * counters // 8, np.uint8)
    for r in merged.collect():
        at = r["block"] * BLOCK_BYTES
        out[at:at + BLOCK_BYTES] = np.frombuffer(zlib.decompress(r["twice"]), np.uint8)
    return out


def _splitter(held, window: int, gram: int, counters: int):
    """Each text as its words, and the runs of its windows with an estimate of two or more."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = held.value
        for rows, texts in pieces(batches):
            piece = Piece(texts, window)
            least, _ = piece.minimizers(gram)
            new = np.flatnonzero(np.concatenate((np.ones(min(1, len(least)), bool), least[1:] != least[:-1])))
            hit = np.repeat(repeated(least[new], twice, counters), np.diff(np.append(new, len(least)))) & piece.inside
            edges = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
            first, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            # Windows within one text only: a run never crosses into the next, as the last ones are not inside.
            cut = np.searchsorted(first, piece.last)
            offsets = pa.array(np.concatenate(([0], cut)), pa.int32())
            home = np.searchsorted(piece.last, first, side="right")
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array([b" ".join(t.split()) for t in texts], pa.binary()),
                 pa.array(piece.last - piece.first, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(first - piece.first[home], pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(end - first, pa.int32()))],
                names=["doc_id", "text", "n_words", "first", "windows"])

    return split


def _keys(text: bytes, first: list[int], windows: list[int], window: int) -> tuple[np.ndarray, ...]:
    """Start and 128-bit hash of the windows in the given runs of a text."""
    at = np.concatenate([np.arange(a, a + n) for a, n in zip(first, windows)])
    return at, *(run_hashes(word_hashes(text, f)[1], window, f)[at].view(np.int64) for f in range(2))


def _lister(window: int):
    """row, k1 and k2 of every window in the runs."""
    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x)) for x in zip(*held)], names=["row", "k1", "k2"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            columns = (batch.column(c) for c in ("row", "text", "first", "windows"))
            for row, text, *runs in zip(*columns):
                at, one, two = _keys(text.as_py(), *(x.as_py() for x in runs), window)
                held.append((np.full(len(at), row.as_py()), one, two))
                n += len(at)
                if n >= LISTED:
                    yield batch_of(held)
                    held, n = [], 0
        if held:
            yield batch_of(held)

    return windows


def _remover(window: int):
    """The words outside all repeated windows; ``alone`` has the keys of windows that are not."""
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed = [], []
            for text, first, n, total, alone in zip(*(
                    batch.column(c) for c in ("text", "first", "windows", "n_words", "alone"))):
                text, total, alone = text.as_py(), total.as_py(), alone.as_py()
                edges = np.zeros(total + 1, np.int32)
                if alone:
                    at, one, two = _keys(text, first.as_py(), n.as_py(), window)
                    single = {(x["k1"], x["k2"]) for x in alone}
                    at = at[[k not in single for k in zip(one.tolist(), two.tolist())]]
                    edges[at] += 1
                    np.subtract.at(edges, at + window, 1)
                else:
                    at, n = np.array(first.as_py()), np.array(n.as_py())
                    np.add.at(edges, at, 1)
                    np.subtract.at(edges, at + n - 1 + window, 1)
                gone = np.cumsum(edges[:-1]) > 0
                kept.append(b" ".join(w for w, g in zip(text.split(b" "), gone.tolist()) if not g))
                removed.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    return remove


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, counters: int = COUNTERS) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space, in UTF-8) per row of
    ``docs`` (doc_id, text; other columns are ignored).

    Words are runs of other characters than ASCII white space. A NULL or empty text has no words and
    keeps none; a text of fewer than ``window`` words keeps all. Repeated rows, with or without the same
    doc_id, are documents of their own, so all their windows are repeated. Windows are judged on the
    input. No rows give no rows. A task needs memory for about 15 times its longest text, and for the sketch.
    """
    if counters & (counters - 1) or ROWS * counters < 8 * BLOCK_BYTES:
        raise ValueError("counters must be a power of two, and their bitmap a block or more")
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    held = spark.sparkContext.broadcast(merged_sketch(rows.select("text"), window, gram, counters))
    runs = T.ArrayType(T.IntegerType())
    schema = rows.select("doc_id").schema.add("text", "binary").add("n_words", "long").add(
        "first", runs).add("windows", runs)
    # Settled, so that a row keeps its number.
    found = settle(rows.mapInArrow(_splitter(held, window, gram, counters), schema).withColumn(
        "row", F.monotonically_increasing_id()))
    held.unpersist()
    marked = found.where(F.size("first") > 0)
    keys = marked.select("row", "text", "first", "windows").mapInArrow(_lister(window), "row long, k1 long, k2 long")
    # The smallest row number of a window that stands alone is the number of its only row.
    single = keys.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("row").alias("row")).where("n = 1")
    alone = settle(single.groupBy("row").agg(F.collect_list(F.struct("k1", "k2")).alias("alone")))
    schema = rows.select("doc_id").schema.add("n_words", "long").add("n_removed", "long").add("kept", "binary")
    cut = marked.join(alone, "row", "left").mapInArrow(_remover(window), schema)
    whole = found.where(F.size("first") == 0).select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("text").alias("kept"))
    return whole.union(cut)
