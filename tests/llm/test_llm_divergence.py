import re
from collections import Counter, defaultdict
from random import Random

import numpy as np
import pyarrow as pa

from newsloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, min_docs, top):
    said = defaultdict(Counter)
    docs, sources = defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate(LOW) for t in TERM.findall(text or "")]
        said[lang, source].update(terms)
        docs[lang].update(set(terms))
        sources[lang].add(source)
    out = []
    for lang, names in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q = shares(sum((said[lang, s] for s in names), Counter()))
        p = {s: shares(said[lang, s]) for s in names}
        for s in names:
            pair = [(sum(abs(p[s][t] - p[r][t]) for t in kept), r) for r in names if r != s]
            term = [(p[s][t] - q[t], t) for t in kept if said[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def corpus(r):
    words = [f"{a}{b}" for a in "abXéж漢" for b in "cdßñ"] + ["A", "é", "zz"]
    rows = []
    for _ in range(200):
        text = r.choice([" ", "_", "1", "\x00", "-\n"]).join(r.choices(words, weights=range(1, len(words) + 1), k=r.randint(0, 30)))
        rows.append((text, r.choice(["en", "de", None, "xx"]), r.choice(["a", "b", "B", "é", None, ""])))
    return rows + [(None, "en", "quiet"), ("", "none", "a"), ("12 _", "none", "b"), ("solo", "one", "a")]


def test_against_counting_by_hand(spark):
    rows = corpus(Random(6))
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(6)
    for min_docs, top in ((30, 50), (3, 4), (1, 2)):
        got = divergence.divergences(docs, min_docs, top)
        assert sorted(map(tuple, got.collect())) == by_hand(rows, min_docs, top), min_docs


def test_spills_and_merges_change_nothing(spark, monkeypatch):
    rows = corpus(Random(7))
    batch = pa.RecordBatch.from_pydict({
        "lang": [r[1] or "" for r in rows], "source": [r[2] or "" for r in rows], "text": [r[0] or "" for r in rows]})
    want = None
    for entries, merged in ((10**6, 10**6), (40, 7), (1, 1)):
        monkeypatch.setattr(divergence, "STRIPE_ENTRIES", entries)
        monkeypatch.setattr(divergence, "MERGED_ROWS", merged)
        monkeypatch.setattr(divergence, "PIECE_BYTES", 10 * entries)
        folded = pa.Table.from_batches(list(divergence._fold(iter([batch.slice(0, 0), batch])))).sort_by(
            [("lang", "ascending"), ("term", "ascending")])
        assert len(folded) > 150 or entries > 40
        out = [r for b in divergence._merger(3)(iter(folded.to_batches(max_chunksize=3))) for r in b.to_pylist()]
        got = {(r["lang"], r["term"]): (r["docs"], dict(zip(r["sources"], r["counts"]))) for r in out}
        assert len(got) == len(out) and got and (want is None or got == want)
        want = got


def test_shares_are_exact():
    r = Random(8)
    for _ in range(300):
        total = r.randint(0, 10**14)
        n, kept = r.randint(0, total), r.randint(1, 10**6)
        want = 1 + 10**9 * (n + 5) // (total + 5 * kept)
        assert divergence.shares(np.array([n]), np.array([total]), kept).tolist() == [want]


def test_odd_rows(odd, none):
    rows = [(r["text"], r["lang"], r["source"]) for r in odd.collect()]
    for min_docs in (1, 30):
        got = divergence.divergences(odd, min_docs, 50)
        assert sorted(map(tuple, got.collect())) == by_hand(rows, min_docs, 50)
    assert divergence.divergences(none).collect() == []
