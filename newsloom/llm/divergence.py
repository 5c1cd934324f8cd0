"""Source divergence audit with in-mapper stripes.

How far do the sources of one language differ in the words they use? A task folds whole documents
into stripes: for each (language, term) the number of documents with the term and its occurrences in
each source. When its stripes outgrow a fixed memory it writes them and starts afresh. Stripes are
shuffled by their key, merged in key order as a stream, and those of terms in too few documents
go. From merged stripes alone come the totals of all groups and, task by task, the divergences: one
stripe gives a term's share in every source of its language at once.

Shares are integers, in parts of SCALE plus one, with PRIOR added to each count; all arithmetic is exact.
"""

import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.scratch import settle

MIN_DOCS = 30
PRIOR = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
# A task writes its stripes when they hold so many entries (a source in a stripe), or their terms so
# many bytes; it folds texts into them in pieces of about so many bytes.
STRIPE_ENTRIES = 2_000_000
TERM_BYTES = 64 << 20
PIECE_BYTES = 8 << 20
# Stripes merged at once.
MERGED_ROWS = 100_000
# Rows of one language's totals, each with a share of its stripes.
SALTS = 64

# Terms are runs of ASCII letters and of characters beyond ASCII; only A-Z are lowered. In UTF-8 all
# bytes of a character beyond ASCII are 128 or more, so a table of bytes tells terms from gaps.
_BYTES = bytes(range(256))
_LOWERED = bytes(b if b >= 128 or _BYTES[b:b + 1].isalpha() else 32 for b in range(256)).lower()

STRIPES = "lang string, term string, docs long, sources array<string>, counts array<long>"


def terms(texts: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray]:
    """The terms of texts in UTF-8, in order, and how many each text has."""
    letters = np.frombuffer(b" ".join(texts).translate(_LOWERED), np.uint8)
    gap = letters == 32
    edges = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
    first, last = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    ends = np.concatenate(([0], np.cumsum(last - first))).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(letters[~gap])])
    return found, np.diff(np.searchsorted(first, np.cumsum([len(t) + 1 for t in texts])), prepend=0)


class Numbers(dict):
    """Numbers for keys, in the order in which they are first asked for."""

    def __missing__(self, key) -> int:
        self[key] = number = len(self)
        return number


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each key once, in order, with the sums of its values."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], *(np.add.reduceat(v[order], first) for v in values)


class Stripes:
    """The stripes of a task. Terms and (language, source) groups are numbered by hash tables; the hash of
    a stripe is kept as sorted entries (term, group) with documents and occurrences."""

    def __init__(self):
        self.terms, self.groups, self.term_bytes = Numbers(), Numbers(), 0
        none = np.zeros(0, np.int64)
        self.folded, self.waiting, self.n_waiting = (none, none, none), [], 0

    def add(self, groups: list[tuple[str, str]], texts: list[bytes]) -> None:
        """Fold whole documents."""
        found, sizes = terms(texts)
        known, coded = len(self.terms), found.dictionary_encode()
        number = np.array([self.terms[t] for t in coded.dictionary.to_pylist()], np.int64)
        said = number[coded.indices.to_numpy()]
        home = np.repeat(np.arange(len(texts)), sizes)
        self.term_bytes += sum(map(len, islice(reversed(self.terms), len(self.terms) - known)))
        group = np.array([self.groups[g] for g in groups], np.int64)
        # Once per document and term, then per group and term.
        width = len(self.terms) or 1
        pairs, n = np.unique(home * width + said, return_counts=True)
        keys = (pairs % width << 32) + group[pairs // width]
        self.waiting.append(_summed(keys, np.ones(len(keys), np.int64), n))
        self.n_waiting += len(self.waiting[-1][0])
        if self.n_waiting > STRIPE_ENTRIES // 2:
            self._fold()

    def _fold(self) -> None:
        self.folded = _summed(*map(np.concatenate, zip(self.folded, *self.waiting)))
        self.waiting, self.n_waiting = [], 0

    def full(self) -> bool:
        return len(self.folded[0]) >= STRIPE_ENTRIES or self.term_bytes >= TERM_BYTES

    def written(self) -> Iterator[pa.RecordBatch]:
        self._fold()
        keys, docs, counts = self.folded
        if not len(keys):
            return
        langs, names = Numbers(), Numbers()
        of_group = np.array([(langs[lang], names[source]) for lang, source in self.groups], np.int64)
        term, lang, source = keys >> 32, *of_group[keys & 0xFFFFFFFF].T
        order = np.lexsort((lang, term))
        term, lang, source, docs, counts = (x[order] for x in (term, lang, source, docs, counts))
        first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (lang[1:] != lang[:-1]))))
        spelled = pa.array([t.decode("utf-8", "replace") for t in self.terms], pa.string())
        yield _stripes(
            pa.array(list(langs), pa.string()).take(pa.array(lang[first])), spelled.take(pa.array(term[first])),
            np.add.reduceat(docs, first), np.append(first, len(term)),
            pa.array(list(names), pa.string()).take(pa.array(source)), counts)


def _stripes(langs, terms, docs, cuts, sources, counts) -> pa.RecordBatch:
    cuts = pa.array(cuts, pa.int32())
    return pa.RecordBatch.from_arrays(
        [langs, terms, pa.array(docs, pa.int64()), pa.ListArray.from_arrays(cuts, sources),
         pa.ListArray.from_arrays(cuts, pa.array(counts, pa.int64()))],
        names=["lang", "term", "docs", "sources", "counts"])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole documents into stripes, written whenever they are full."""
    held = Stripes()
    for batch in batches:
        if not len(batch):
            continue
        column = batch.column("text").cast(pa.binary())
        groups = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
        # Pieces end with the first document that brings them to PIECE_BYTES.
        piece = np.cumsum(pc.binary_length(column).to_numpy()) // PIECE_BYTES
        cuts = [0, *(np.flatnonzero(piece[1:] != piece[:-1]) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            held.add(groups[a:b], column.slice(a, b - a).to_pylist())
            if held.full():
                yield from held.written()
                held = Stripes()
    yield from held.written()


def merged(rows: pa.RecordBatch, min_docs: int) -> pa.RecordBatch:
    """Stripes in key order into one for each key, without those of fewer than ``min_docs`` documents."""
    lang, term = rows.column("lang"), rows.column("term")
    differs = pc.or_(pc.not_equal(term[1:], term[:-1]), pc.not_equal(lang[1:], lang[:-1]))
    new = np.concatenate(([True], differs.to_numpy(zero_copy_only=False)))
    first = np.flatnonzero(new)
    docs = np.add.reduceat(rows.column("docs").to_numpy(), first)
    kept = docs >= min_docs
    lists = rows.column("sources")
    key = np.repeat(np.cumsum(new) - 1, pc.list_value_length(lists).to_numpy())
    coded = lists.flatten().dictionary_encode()
    mine = kept[key]
    width = len(coded.dictionary) or 1
    entries, counts = _summed(key[mine] * width + coded.indices.to_numpy()[mine],
                              rows.column("counts").flatten().to_numpy()[mine])
    number, source = np.divmod(entries, width)
    cuts = np.searchsorted(number, np.append(np.flatnonzero(kept), len(kept)))
    at = pa.array(first[kept])
    return _stripes(lang.take(at), term.take(at), docs[kept], cuts, coded.dictionary.take(pa.array(source)), counts)


def _merger(min_docs: int):
    """``merged`` over a stream. The rows of the last key wait for more; many rows of one key are merged
    on the way, so that memory does not grow with them."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < MERGED_ROWS:
                continue
            rows = pa.concat_batches(held)
            same = pc.and_(pc.equal(rows.column("term"), rows.column("term")[-1]),
                           pc.equal(rows.column("lang"), rows.column("lang")[-1]))
            cut = len(rows) - pc.sum(same).as_py()
            if cut:
                yield merged(rows.slice(0, cut), min_docs)
                held = [rows.slice(cut)]
            else:
                held = [merged(rows, 0)]
        if sum(map(len, held)):
            yield merged(pa.concat_batches(held), min_docs)

    return merge


def stripes(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, docs (how many hold the term), sources and counts (occurrences in each, none of
    them 0) of every term in at least ``min_docs`` documents of its language."""
    empty = F.lit("")
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("lang", "source", "text")))
    folded = rows.mapInArrow(_fold, STRIPES)
    return folded.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(
        _merger(min_docs), STRIPES)


def shares(counts: np.ndarray, totals: np.ndarray, kept_terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept_terms)), by long division, in thousands:
    the product may be too large for a long, its remainders are not."""
    below = totals + PRIOR * kept_terms
    whole, rest = np.divmod(counts + PRIOR, below)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + digits
    return whole + 1


def _diverger(top: int):
    """Merged stripes with their language's totals into partial sums of the pairs' divergences, and
    each group's ``top`` terms of this task. The sums of a language take 8 bytes for each of its pairs,
    as many as the result has rows."""
    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [dict(zip(("lang", "source", "part", "item", "value"), r)) for r in found],
            schema=pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()),
                              ("item", pa.string()), ("value", pa.int64())]))

    def diverge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, apart, best = {}, {}, {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            where = {}
            for i, lang in enumerate(langs):
                where.setdefault(lang, []).append(i)
            for lang, at in where.items():
                if lang not in known:
                    info = {c: batch.column(c)[at[0]].as_py() for c in ("groups", "totals", "kept_terms", "total")}
                    known[lang] = info | {"place": {s: j for j, s in enumerate(info["groups"])}}
                    apart[lang] = np.zeros((len(info["groups"]),) * 2, np.int64)
                info = known[lang]
                place, n = info["place"], len(info["groups"])
                counts = np.zeros((len(at), n), np.int64)
                for row, i in enumerate(at):
                    for s, c in zip(batch.column("sources")[i].as_py(), batch.column("counts")[i].as_py()):
                        counts[row, place[s]] = c
                p = shares(counts, np.array(info["totals"], np.int64)[None, :], info["kept_terms"])
                q = shares(counts.sum(axis=1), np.int64(info["total"]), info["kept_terms"])
                for s in range(n):
                    apart[lang][s] += np.abs(p - p[:, s:s + 1]).sum(axis=0)
                more = p - q[:, None]
                names = [batch.column("term")[i].as_py() for i in at]
                for s in np.flatnonzero(((counts > 0) & (more > 0)).any(axis=0)):
                    held = best.setdefault((lang, info["groups"][s]), [])
                    held += [(-int(more[r, s]), names[r].encode())
                             for r in np.flatnonzero((counts[:, s] > 0) & (more[:, s] > 0))]
                    best[lang, info["groups"][s]] = heapq.nsmallest(top, held)
        for lang, sums in apart.items():
            names = known[lang]["groups"]
            for s, source in enumerate(names):
                yield rows([(lang, source, "pair", other, int(sums[s, r]))
                            for r, other in enumerate(names) if r != s])
        for (lang, source), held in best.items():
            yield rows([(lang, source, "term", term.decode(), -value) for value, term in held])

    return diverge


def divergences(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value and rank for every (lang, source) of ``docs`` (text, lang, source;
    other columns are ignored).

    Part ``pair``: each other source of the language with the sum over all kept terms of how far the two
    sources' shares differ, 0 where no term is kept. Part ``term``: the kept terms that the source uses
    more than its language does, by how much, the ``top`` first of them. Ranks go by falling value, then by
    item in UTF-8.

    NULL in any of the three columns counts as the empty text, which is a language or source like others.
    A group whose documents have no term is there with counts of 0. Repeated rows are documents of
    their own. A language with one source has no pairs; an empty table gives no rows.
    """
    empty = F.lit("")
    merged = settle(stripes(docs, min_docs))
    groups = docs.select(F.coalesce(F.col("lang").cast("string"), empty).alias("lang"),
                         F.coalesce(F.col("source").cast("string"), empty).alias("source")).distinct()
    flat = merged.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e"))
    totals = flat.groupBy("lang", F.col("e.sources").alias("source")).agg(F.sum("e.counts").alias("n"))
    sizes = merged.groupBy("lang").agg(F.count("*").alias("kept_terms"))
    # One row per language, as wide as it has sources.
    known = settle(groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("g"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
    ).join(sizes, "lang", "left").select(
        "lang", F.col("g.source").alias("groups"), F.col("g.n").alias("totals"), "total",
        F.coalesce("kept_terms", F.lit(0)).alias("kept_terms")))
    # A language's stripes are dealt over SALTS copies of its row, so none of them is one task.
    copies = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = merged.withColumn("salt", F.pmod(F.hash("term"), F.lit(SALTS)))
    found = settle(dealt.join(copies, ["lang", "salt"]).drop("salt", "docs").mapInArrow(
        _diverger(top), "lang string, source string, part string, item string, value long"))

    pair = F.explode("groups")
    pairs = known.select("lang", "groups", pair.alias("source")).select(
        "lang", "source", F.explode("groups").alias("item")).where("source <> item")
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    firsts = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(firsts).select(
        "lang", "source", "part", "item", "value", "rank")
