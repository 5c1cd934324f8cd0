import hashlib
import re
from collections import Counter
from random import Random

import numpy as np
import pytest

from newsloom.llm import substrings
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(rows, window):
    texts = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, texts):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for j in range(i, i + window)}
        out.append((doc_id, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"]).decode()) for r in df.collect()), key=str)


def corpus(r):
    """Texts with shared passages around the window's length, copies, and passages repeated in one text."""
    passages = [prose(900 + i, n).split() for i, n in enumerate((6, 7, 8, 12, 30, 80))]
    rows = []
    for i in range(60):
        w = prose(i + 1, r.randint(0, 60)).split()
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(w))
            w[at:at] = r.choice(passages)
        rows.append((i, r.choice([" ", "\n", " \t "]).join(w)))
    rows += [(100 + i, rows[i][1]) for i in range(8)] + [(0, rows[0][1])]
    rows += [(200, "a b " * 40), (201, "a b " * 40 + "c"), (202, "x " * 7), (203, "y " * 8), (204, "x\x0bx\x0cx x x x x"),
             (205, "é\xa0ü 😀 \x85 ß"), (206, prose(77, 20_000) + " " + prose(77, 50))]
    return rows


@pytest.mark.parametrize("counters", [1 << 18, 1 << 22])
def test_against_every_window(spark, counters):
    """Nothing is lost, whether the sketch is nearly empty or says "twice" for almost all."""
    rows = corpus(Random(4))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(substrings.remove_repeats(docs, 7, 4, counters)) == by_hand(rows, 7)


def test_run_hashes():
    r = np.random.default_rng(3)
    words = r.integers(0, 2**63, 60).astype(np.uint64)
    base = substrings._BASES[0]
    for size in (1, 2, 3, 7, 16, 35, 60):
        want = [sum(int(w) * base**k for k, w in enumerate(words[i:i + size])) % 2**64 for i in range(61 - size)]
        assert substrings.run_hashes(words, size).tolist() == want
    assert len(substrings.run_hashes(words, 61)) == 0


def test_estimates_are_never_below_the_counts():
    r = np.random.default_rng(5)
    held = substrings.Sketch(1 << 18)
    values = r.integers(0, 1 << 40, 400_000).astype(np.uint64)
    values[:1000] = values[1000:2000]
    for part in np.split(values, 8):
        held.add(part)
    assert substrings.repeated(values[:1000], held.twice, 1 << 18).all()
    blank = substrings.Sketch(1 << 22)
    blank.add(values[2000:4000])
    assert substrings.repeated(values[2000:4000], blank.twice, 1 << 22).mean() < 0.01


def test_odd_rows(spark, odd, none):
    got = found(substrings.remove_repeats(odd, counters=1 << 18))
    assert got == by_hand([(r["doc_id"], r["text"]) for r in odd.collect()], 35)
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0" and got[0][3] == ""
    assert substrings.remove_repeats(none, counters=1 << 18).collect() == []
    with pytest.raises(ValueError):
        substrings.remove_repeats(odd, counters=1000)
