"""Benchmark decontamination: an inverted index of test items, asked with every training passage.

The index holds BM25 impacts, each divided by the score of the item asked with its own text, so a
passage that holds all of an item scores about 1 on it whatever the item's length. Items lie in
blocks in order of their ids; for each term the index keeps the largest impact in each block
(block-max). A document is cut into overlapping passages twice as long as the longest item, so any
item lies whole in one of them. Passages whose block maxima cannot reach the threshold are
passed over; the others are searched by WAND, which returns every item at or above the threshold.
An item counts as found when its question and its answer both recur in that passage, by the share
of their word n-grams.
"""

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.scratch import settle

K1, B = 1.2, 0.75
MIN_SCORE = 0.5
MIN_QUESTION, MIN_ANSWER = 0.6, 0.5
QUESTION_GRAM, ANSWER_GRAM = 5, 3
# Items share a block of the index in fours. Frequent terms that together give no item more than
# this part of the threshold are left to the second look. One index is broadcast at a time and holds at most
# this many items and characters; more items make more indexes, made and asked one after another.
BLOCK = 4
FREQUENT_PART = 0.4
INDEX_ITEMS = 20_000
INDEX_CHARS = 32_000_000

TERM = re.compile(r"\w+")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
FOUND = "array<struct<item_id: bigint, score: double, question: double, answer: double>>"


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


def grams(ws: list[str], n: int) -> set:
    n = min(n, len(ws))
    return {tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)} if n else set()


def parts(text: str) -> tuple[list[str], list[str]]:
    """Question and answer of an item: its last sentence with words is the answer, if any stands
    before it; else all of it is the question."""
    sentences = [w for w in map(terms, SENTENCE_END.split(text)) if w]
    if len(sentences) < 2:
        return (sentences[0] if sentences else []), []
    return [w for s in sentences[:-1] for w in s], sentences[-1]


def _codes(found) -> np.ndarray:
    return np.sort(np.fromiter((c for c in found if c is not None and c >= 0), np.int64))


class _Lists:
    """Lists of (target, gain), one per term, end to end; ``given`` is what terms that are not asked
    may add to each target."""

    def __init__(self, targets: list[np.ndarray], gains: list[np.ndarray], given: np.ndarray):
        self.sizes = np.array([len(t) for t in targets], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.targets = np.concatenate(targets) if targets else np.zeros(0, np.int64)
        self.gains = np.concatenate(gains) if gains else np.zeros(0)
        self.given = given

    def reaching(self, asked: np.ndarray, least: float) -> np.ndarray:
        sizes = self.sizes[asked]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[asked] - ends + sizes, sizes)
        sums = np.bincount(self.targets[at], self.gains[at], len(self.given))
        return np.flatnonzero(sums + self.given >= least - 1e-9)


@dataclass
class Whole:
    """What scores and passages take from the whole benchmark: its items with words, their words, those
    of the longest one, and by term the number of items that have it."""

    items: int
    words: int
    longest: int
    df: dict[str, int]


class Index:
    """BM25 over items [(item_id, text)]; items without words are left out, they occur in nothing. An
    index of a part of the benchmark is given the counts of the whole."""

    def __init__(self, items: list[tuple[int, str]], whole: Whole | None = None):
        kept = sorted((i, t) for i, t in items if i is not None and terms(t or ""))
        self.ids = [i for i, _ in kept]
        spelled = [terms(t) for _, t in kept]
        split = [parts(t) for _, t in kept]
        self.questions = [grams(q, QUESTION_GRAM) for q, _ in split]
        self.answers = [grams(a, ANSWER_GRAM) for _, a in split]
        self.sizes = [(min(QUESTION_GRAM, len(q)), min(ANSWER_GRAM, len(a))) for q, a in split]
        counts = [Counter(ws) for ws in spelled]
        whole = whole or Whole(len(kept), sum(map(len, spelled)), max(map(len, spelled), default=0),
                               Counter(t for c in counts for t in c))
        self.longest, df = whole.longest, whole.df
        mean = whole.words / max(1, whole.items)
        postings: dict[str, list] = {}
        for i, c in enumerate(counts):
            norm = K1 * (1 - B + B * len(spelled[i]) / mean)
            gain = {t: math.log(1 + (whole.items - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + norm)
                    for t, n in c.items()}
            own = sum(gain.values())
            for t, g in gain.items():
                postings.setdefault(t, []).append((i, g / own))
        # Terms by falling document frequency; the first ones, as long as they give no item more
        # than a part of the threshold, need not be asked to find out whether an item is possible.
        ordered = sorted(postings, key=lambda t: (-df[t], t))
        self.number = {t: k for k, t in enumerate(ordered)}
        self.items = [np.array([i for i, _ in postings[t]]) for t in ordered]
        self.impacts = [np.array([g for _, g in postings[t]]) for t in ordered]
        self.top = [float(g.max()) for g in self.impacts]
        given, self.frequent = np.zeros(len(kept) + 1), 0
        for items_, impacts in zip(self.items, self.impacts):
            given[items_] += impacts
            if given.max() > FREQUENT_PART * MIN_SCORE:
                given[items_] -= impacts
                break
            self.frequent += 1
        blocks, maxima = [], []
        for items_, impacts in zip(self.items, self.impacts):
            at, first = np.unique(items_ // BLOCK, return_index=True)
            blocks.append(at)
            maxima.append(np.maximum.reduceat(impacts, first))
        self.item_lists = _Lists(self.items, self.impacts, given)
        most_given = np.zeros(len(kept) // BLOCK + 1)
        np.maximum.at(most_given, np.arange(len(given)) // BLOCK, given)
        self.block_lists = _Lists(blocks, maxima, most_given)

    def live_blocks(self, found: np.ndarray, least: float) -> np.ndarray:
        """Which blocks could hold an item that these terms bring to ``least``: first by the maxima of
        the blocks, then by the items of those that are left."""
        rare = found[found >= self.frequent]
        if not len(rare) or not len(self.block_lists.reaching(rare, least)):
            return np.zeros(0, int)
        return np.unique(self.item_lists.reaching(rare, least) // BLOCK)

    def wand(self, found: list[int], live: np.ndarray, least: float) -> list[tuple[int, float]]:
        """Every item at or above ``least``, with its score: document-at-a-time over the cursors of
        the terms, moving to a pivot before which no item can reach ``least``, and over whole
        blocks that are not live."""
        lists = []
        for t in found:
            keep = np.isin(self.items[t] // BLOCK, live)
            if keep.any():
                lists.append([0, self.items[t][keep].tolist(), self.impacts[t][keep].tolist(), self.top[t]])
        out = []
        while lists:
            lists.sort(key=lambda x: x[1][x[0]])
            bound, pivot = 0.0, None
            for x in lists:
                bound += x[3]
                if bound >= least - 1e-9:
                    pivot = x[1][x[0]]
                    break
            if pivot is None:
                break
            score, left = 0.0, []
            at_pivot = lists[0][1][lists[0][0]] == pivot
            for x in lists:
                if at_pivot and x[1][x[0]] == pivot:
                    score += x[2][x[0]]
                    x[0] += 1
                elif not at_pivot and x[1][x[0]] < pivot:
                    x[0] = int(np.searchsorted(x[1], pivot))
                if x[0] < len(x[1]):
                    left.append(x)
            lists = left
            if at_pivot and score >= least:
                out.append((pivot, score))
        return out

    def verify(self, item: int, passage: list[str]) -> tuple[float, float] | None:
        """Shares of the question's and the answer's n-grams in the passage, if both are enough."""
        n, m = self.sizes[item]
        question = len(self.questions[item] & grams(passage, n)) / len(self.questions[item])
        if question < MIN_QUESTION:
            return None
        if not self.answers[item]:
            return question, 1.0
        answer = len(self.answers[item] & grams(passage, m)) / len(self.answers[item])
        return (question, answer) if answer >= MIN_ANSWER else None

    def search(self, text: str, least: float = MIN_SCORE) -> list[tuple]:
        """(item_id, score, question share, answer share) of each item found in the text, from the
        passage where it scores highest; by item_id."""
        ws = terms(text)
        get = self.number.get
        if not len(self.live_blocks(_codes(map(get, set(ws))), least)):
            return []
        codes = [get(w, -1) for w in ws]
        best: dict[int, tuple] = {}
        step = self.longest
        for at in range(0, max(1, len(ws) - step), step):
            found = _codes(set(codes[at:at + 2 * step]))
            live = self.live_blocks(found, least)
            if not len(live):
                continue
            passage = ws[at:at + 2 * step]
            for item, score in self.wand(found.tolist(), live, least):
                shares = self.verify(item, passage)
                if shares and (item not in best or score > best[item][1]):
                    best[item] = (self.ids[item], score, *shares)
        return [best[i] for i in sorted(best)]


def _spelled(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: terms(t or ""))


class Indexes:
    """So many indexes, each made when it is its turn."""

    def __init__(self, n: int, make: Callable[[int], Index]):
        self.n, self.make = n, make

    def __len__(self) -> int:
        return self.n


def indexes(benchmark: DataFrame) -> Indexes:
    """The items in indexes of bounded size, by a hash of the item's id; all with the counts of the
    whole benchmark, so that a score does not depend on their number. The driver reads one part at a
    time."""
    size = benchmark.agg(F.count("*"), F.sum(F.length("text"))).first()
    n = max(1, math.ceil(size[0] / INDEX_ITEMS), math.ceil((size[1] or 0) / INDEX_CHARS))
    if n == 1:
        return Indexes(1, lambda _: Index([
            (r["item_id"], r["text"]) for r in benchmark.select("item_id", "text").toLocalIterator()]))
    items = settle(benchmark.where("item_id IS NOT NULL").select(
        "item_id", "text", F.pmod(F.xxhash64("item_id"), F.lit(n)).alias("part"),
        F.pandas_udf(_spelled, "array<string>")("text").alias("words")).where(F.size("words") > 0))
    count, words, longest = items.agg(
        F.count("*"), F.sum(F.size("words").cast("long")), F.max(F.size("words"))).first()
    held = settle(items.select("part", F.explode(F.array_distinct("words")).alias("term")).groupBy(
        "part", "term").count())
    df = settle(held.join(held.groupBy("term").agg(F.sum("count").alias("df")), "term").select(
        "part", "term", "df"))

    def index(i: int) -> Index:
        known = {r["term"]: r["df"] for r in df.where(F.col("part") == i).toLocalIterator()}
        rows = items.where(F.col("part") == i).select("item_id", "text").toLocalIterator()
        return Index([(r["item_id"], r["text"]) for r in rows], Whole(count, words or 0, longest or 0, known))

    return Indexes(n, index)


def _looker(index, least: float):
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[
                {"item_id": i, "score": s, "question": q, "answer": a}
                for i, s, q, a in index.value.search(t or "", least)] for t in texts], dtype=object)

    return look


def _found(docs: DataFrame, index: Index, least: float) -> tuple[Column, Broadcast]:
    """A column of ``docs`` with the items of one index found in ``text``: FOUND, in order of item_id;
    empty for NULL and empty texts. And the broadcast that it reads."""
    sent = docs.sparkSession.sparkContext.broadcast(index)
    return F.pandas_udf(_looker(sent, least), FOUND)("text"), sent


def clean(docs: DataFrame, benchmark: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` in which no item is found. Of several indexes each is asked in a job of its
    own with the rows that the ones before it left, and given up after it."""
    parts = indexes(benchmark)

    def left(docs: DataFrame, index: Index) -> DataFrame:
        found, sent = _found(docs, index, least)
        docs = docs.where(F.size(found) == 0)
        if len(parts) > 1:
            docs = settle(docs)
            sent.destroy()
        return docs

    for i in range(len(parts)):
        docs = left(docs, parts.make(i))
    return docs


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """doc_id, item_id, score, question_share, answer_share for every pair of a row of ``docs`` and an
    item that it holds. Repeated rows and repeated items give repeated pairs; other columns are ignored.
    Of several indexes each is asked in a job of its own, which reads ``docs``, and given up after it."""
    parts = indexes(benchmark)

    def pairs(index: Index) -> DataFrame:
        column, sent = _found(docs, index, least)
        found = docs.select("doc_id", F.explode(column).alias("m")).select(
            "doc_id", "m.item_id", F.round("m.score", 6).alias("score"),
            F.round("m.question", 6).alias("question_share"), F.round("m.answer", 6).alias("answer_share"))
        if len(parts) > 1:
            found = settle(found)
            sent.destroy()
        return found

    return reduce(DataFrame.union, [pairs(parts.make(i)) for i in range(len(parts))])
