"""Toxicity by maximum-scoring segments.

Every token has a log-odds score: how many more toxic than other labelled texts it stands in, with a
Dirichlet prior from all of them together, less a drift that makes the mean score of clean text
negative. A token is known by itself or by its first letters, so that other forms of a known word
count too. A linear scan finds all maximal scoring segments of a text. Segment scores of
clean text follow an extreme-value law, whose rate is solved from the scores and whose size
constant is set from clean labelled texts; by it each segment gets the number of equally good ones
expected by chance in a text so long. A text's evidence is the sum over its significant segments,
and a logistic curve, fitted on labelled texts, makes a probability of it.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.scratch import settle

# Letters keep their combining marks, so that a word is one token in every script. Texts are learnt from
# and scored with this one pattern, by ``tokens_of``.
TOKEN = regex.compile(r"[\w\p{M}]+")
# The model is fitted on labelled documents of a sample: of each class about so many (by a hash of the
# doc_id), of each text all tokens; one in CALIBRATE of them sets the constants only. The model's terms are
# those with the highest scores, at most TERMS (its size when broadcast). A worker remembers the scores of CACHE words.
FIT_DOCS = 10_000
CALIBRATE = 4
TERMS = 20_000
CACHE = 300_000
STEMS = (4, 5, 6)
PRIOR = 50.0
FLOOR = 0.5
MIN_TOXIC_DOCS = 5
MIN_SCORE = 1.0
DRIFT = 0.05
SIGNIFICANT = 1.0
THRESHOLD = 0.3


def tokens_of(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def segments(at: np.ndarray, gains: np.ndarray, length: int, drift: float) -> list[tuple]:
    """All maximal scoring segments (start, end, score) of a text of ``length`` tokens in which the
    tokens ``at`` score ``gains`` and every other one ``-drift``. Linear: a stack of candidates with
    the running totals before and after each; a new one is merged with those it rises above."""
    stack: list[tuple] = []
    total, last = 0.0, -1
    for i, g in zip(at.tolist(), gains.tolist()):
        total -= drift * (i - last - 1)
        before, total, last = total, total + g, i
        start, left = i, before
        while stack:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= left:
                k = stack[k][4]
            if k < 0 or stack[k][3] >= total:
                break
            start, left = stack[k][0], stack[k][2]
            del stack[k:]
        else:
            k = -1
        if not stack:
            k = -1
        stack.append((start, i + 1, left, total, k))
    return [(a, b, right - left) for a, b, left, right, _ in stack]


class Scores(dict):
    """Score by word, None for words that neither themselves nor by a stem are among the terms."""

    def __init__(self, terms: dict[str, float]):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> float | None:
        if len(self) >= CACHE:
            self.clear()
        known = [self.terms[f] for f in (word, *(word[:n] + "*" for n in STEMS if len(word) > n))
                 if f in self.terms]
        self[word] = max(known) if known else None
        return self[word]

    def __reduce__(self):
        return Scores, (self.terms,)


class Model:
    """Token scores and the constants that turn segments into a probability."""

    def __init__(self, scores: dict[str, float], drift: float, rate: float, size: float,
                 weight: float, bias: float):
        self.scores, self.drift, self.rate, self.size = Scores(scores), drift, rate, size
        self.weight, self.bias = weight, bias

    def passages(self, text: str) -> list[tuple[int, int, float, float]]:
        """(first token, end token, score, expected number by chance) of every significant passage."""
        tokens = tokens_of(text)
        hits = [(i, s) for i, s in enumerate(map(self.scores.__getitem__, tokens)) if s is not None]
        if not hits:
            return []
        at, gains = np.array([i for i, _ in hits]), np.array([s for _, s in hits])
        out = []
        for a, b, score in segments(at, gains, len(tokens), self.drift):
            chance = self.size * len(tokens) * math.exp(-self.rate * score)
            if chance < SIGNIFICANT:
                out.append((a, b, score, chance))
        return out

    def evidence(self, text: str) -> float:
        return sum(-math.log(max(c, 1e-300) / SIGNIFICANT) for *_, c in self.passages(text))

    def score(self, text: str) -> float:
        z = self.weight * math.log1p(self.evidence(text)) + self.bias
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _rate(gains: np.ndarray, shares: np.ndarray, drift: float) -> float:
    """The positive rate at which the mean of exp(rate * score) over clean text is 1."""
    rest = 1 - shares.sum()
    excess = lambda r: (shares * np.exp(np.minimum(r * gains, 500))).sum() + rest * math.exp(-r * drift) - 1
    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 100:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Weight and bias by Newton steps on the log-likelihood, with a weak prior."""
    w, b = 0.0, math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w * x + b, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((y - p) * x).sum() - 0.01 * w, (y - p).sum()])
        h = np.array([[(v * x * x).sum() + 0.01, (v * x).sum()], [(v * x).sum(), v.sum()]])
        step = np.linalg.solve(h, g)
        w, b = w + step[0], b + step[1]
        if abs(step).max() < 1e-9:
            break
    return max(float(w), 0.0), float(b)


def fit_sample(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of about FIT_DOCS labelled documents of each class, dealt by a hash of the id."""
    known = labels.select("doc_id", "toxic").where("toxic IN (0, 1) AND doc_id IS NOT NULL").distinct()
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    dealt = F.pmod(F.xxhash64(F.lit(8), F.col("doc_id")), F.lit(1 << 20)) / float(1 << 20)
    share = lambda c: min(1.0, FIT_DOCS / max(1, sizes.get(c, 0)))
    return known.where(dealt < F.when(F.col("toxic") == 1, share(1)).otherwise(share(0)))


def fit(labelled: DataFrame) -> Model:
    """A model from rows (doc_id, text, toxic 0 or 1). Documents and tokens are counted in Spark;
    what comes to the driver is the terms kept and about FIT_DOCS / CALIBRATE evidence sums per class."""
    rows = labelled.where("toxic IN (0, 1) AND text IS NOT NULL").select("doc_id", "text", "toxic")
    part = F.pmod(F.xxhash64(F.lit(9), F.col("doc_id")), F.lit(CALIBRATE))
    rows = settle(rows.withColumn("part", part))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    words = rows.where("part > 0").select("toxic", F.explode(
        F.pandas_udf(_distinct_tokens, "array<string>")("text")).alias("word"))
    by_word = words.groupBy("word").agg(
        F.sum(F.col("toxic").cast("long")).alias("bad"),
        F.sum(1 - F.col("toxic").cast("long")).alias("good"))
    stems = [F.when(F.length("word") > n, F.concat(F.substring("word", 1, n), F.lit("*")))
             for n in STEMS]
    forms = F.explode(F.array_compact(F.array(F.col("word"), *stems))).alias("term")
    counted = settle(by_word.select(forms, "bad", "good").groupBy("term").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    all_bad, all_good = (x or 0 for x in counted.agg(F.sum("bad"), F.sum("good")).first())
    # Prior counts: one part equal for all, one in proportion to a token's share of all labelled text.
    prior = FLOOR + PRIOR * (F.col("bad") + F.col("good")) / float(max(1, all_bad + all_good))
    odds = lambda n, total: F.log((n + prior) / (total + PRIOR - n - prior))
    delta = odds(F.col("bad"), float(all_bad)) - odds(F.col("good"), float(all_good))
    spread = F.sqrt(1 / (F.col("bad") + prior) + 1 / (F.col("good") + prior))
    kept = counted.where(F.col("bad") >= MIN_TOXIC_DOCS).select(
        "term", "good", (delta - 1.96 * spread).alias("score")).where(
        F.col("score") >= MIN_SCORE).orderBy(F.desc("score"), "term").limit(TERMS).collect()
    scores = {r["term"]: r["score"] - DRIFT for r in kept}
    if not scores:
        return Model({}, DRIFT, 1.0, 1.0, 0.0, math.log((sizes.get(1, 0) + 1) / (sizes.get(0, 0) + 1)))
    shares = np.array([(r["good"] + 0.5) / (all_good + 1.0) for r in kept])
    rate = _rate(np.array(list(scores.values())), shares, DRIFT)
    send, fresh = rows.sparkSession.sparkContext.broadcast, rows.where("part = 0")
    draft = Model(scores, DRIFT, rate, 1.0, 1.0, 0.0)
    best = fresh.where("toxic = 0").select(
        F.pandas_udf(_best_of(send(draft)), "double")("text").alias("m"))
    # The size constant: the mean over clean texts, as the law gives it for a constant of 1.
    size = max(best.agg(F.avg("m")).first()[0] or 0.0, 1e-6)
    model = Model(scores, DRIFT, rate, size, 1.0, 0.0)
    seen = fresh.select("toxic", F.pandas_udf(_evidence_of(send(model)), "double")("text").alias("e"))
    seen = seen.toPandas()
    weight, bias = _logistic(np.log1p(seen["e"].to_numpy(float)), seen["toxic"].to_numpy(float))
    return Model(scores, DRIFT, rate, size, weight, bias)


def _distinct_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: list(dict.fromkeys(tokens_of(t))))


def _best_of(held):
    """exp(rate * best segment score) / length of a text: its mean over clean texts estimates the size
    constant; 0 where nothing scores."""
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = held.value
        for texts in batches:
            out = []
            for t in texts:
                n = len(tokens_of(t))
                found = [s for *_, s, _ in m.passages(t)] if n else []
                out.append(math.exp(min(m.rate * max(found), 20)) / n if found else 0.0)
            yield pd.Series(out, dtype="float64")

    return best


def _evidence_of(held):
    def evidence(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([held.value.evidence(t or "") for t in texts], dtype="float64")

    return evidence


def _score_of(held):
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([held.value.score(t or "") for t in texts], dtype="float64")

    return score


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from THRESHOLD on) per row of ``docs``.

    The model is fitted on labelled rows that are not held out and sees their texts only. NULL and
    empty texts have no evidence and get the lowest score. A label of NULL is none; rows repeated in
    ``docs`` are scored each. Without labelled rows every text gets one score.
    """
    # The sample is bounded by FIT_DOCS, so its ids are broadcast and no text is shuffled.
    sample = F.broadcast(fit_sample(labels.where(~held_out())))
    model = fit(docs.select("doc_id", "text").join(sample, "doc_id"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(
        "doc_id", held_out().alias("held_out"),
        F.pandas_udf(_score_of(held), "double")("text").alias("score"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
