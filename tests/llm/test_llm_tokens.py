from random import Random

from newsloom.llm import tokens

PATH = tokens.model_path()


def test_pre_tokens_add_up():
    whole, counts, r = tokens._processor(PATH), tokens.Counts({}, PATH), Random(8)
    assert tokens.separable(PATH)
    texts = ["", " ", "  ", "a b", "  a  b ", "a\nb", " \n  \n x", "<s>x</s> hi", "ﬁ é é 　x\tq", "a" * 9000, "\x00 x",
             "▁ a▁b ▁▁ c", "a▁ b", "😀 😀😀", "1234 56,7"]
    texts += ["".join(r.choice("ab  ▁é\n1<s>😀") for _ in range(r.randint(0, 30))) for _ in range(3000)]
    assert [counts.of(t) for t in texts] == [len(whole.encode(t)) for t in texts]


def test_cache_stays_small(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 5)
    counts = tokens.Counts({" the": 1}, PATH)
    for i in range(50):
        counts.of(f"the word{i}")
    assert len(counts) <= 6 and " the" in counts and counts.of("the the") == 2


def test_odd_rows(odd, none):
    whole = tokens._processor(PATH)
    got = tokens.count_tokens(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        t = r["text"] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(t.encode()), len(whole.encode(t)))
        assert r["over_limit"] == (r["n_tokens"] > 4096)
    assert tokens.count_tokens(none).collect() == []


def test_given_documents(spark):
    whole = tokens._processor(PATH)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert all(r["n_tokens"] == len(whole.encode(r["text"])) for r in tokens.count_tokens(docs).collect())
