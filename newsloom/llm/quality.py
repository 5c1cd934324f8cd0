"""Quality rules: how far a document's make-up lies from what is usual in its language.

Everything here is column expressions. A document is described by base counts, by a histogram of
character classes and by a histogram of the common words of its language. The reference of a
language is the sum of its documents' histograms, each scaled to the same weight so that a long
text counts no more than a short one, over all documents that are long enough to judge and hold few
symbols. A document is compared with its language's reference by Jensen-Shannon distance (base 2,
0 to 1).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import let, words

# The most frequent function words of four languages, most frequent first.
COMMON_WORDS = {
    "de": ["die", "der", "und", "in", "zu", "den", "das", "nicht", "von", "sie", "ist", "des",
           "sich", "mit", "dem", "ein"],
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "was", "for", "on", "as",
           "with", "be", "by"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con",
           "no", "una"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour",
           "qui", "dans", "par"],
}
# Documents of any other language, or of none, share one reference and are judged by characters only.
OTHER = "other"

# Each class is taken out of what the classes before it left over.
CLASSES = (
    ("lower", r"\p{Ll}+"),
    ("space", r"[\x20\x09-\x0D]+"),
    ("upper", r"\p{Lu}+"),
    ("letter", r"[\p{L}\p{M}]+"),
    ("digit", r"[0-9]+"),
    ("stop", r"""[.,;:!?'"()-]+"""),
    ("symbol", r"[#*$%&|<>]+"),
)

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
# A reference is made of texts of so many characters or more.
MIN_CHARS_JUDGED = 400
# The guard of short texts: the error of a histogram falls with the root of its size, and a limit (least,
# base, slope) is the larger of least and base + slope / sqrt(characters or words).
CHAR_LIMIT = (0.21, 0.1, 2.4)
WORD_LIMIT = (0.28, 0.2, 0.9)
MAX_REFERENCE_SYMBOL_PERCENT = 1
SCALE = 10_000


def _repeated(words_of: Column) -> Column:
    """How many words lie in windows of WINDOW words found at least twice in the text. The words are
    bound once: a filter moved below the projection that splits them would split them per window."""
    def windows(ws: Column) -> Column:
        return F.transform(
            F.slice(ws, 1, F.greatest(F.size(ws) - (WINDOW - 1), F.lit(0))),
            lambda _, i: F.xxhash64(F.slice(ws, i + 1, WINDOW)))

    def covered(positions: Column) -> Column:
        reach = F.transform(positions, lambda p, i: F.least(
            F.lit(WINDOW), F.coalesce(F.get(positions, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    def doubled(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda x, i: F.coalesce(
            (x.h == F.get(pairs, i - 1).h), F.lit(False)) | F.coalesce(
            (x.h == F.get(pairs, i + 1).h), F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x.p))

    def count(hs: Column) -> Column:
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(
            F.size(F.array_distinct(hs)) < F.size(hs),
            let(let(pairs, doubled), covered),
        ).otherwise(0)

    return let(let(words_of, windows), count)


def with_histograms(docs: DataFrame) -> DataFrame:
    """``_q_words``, ``_q_chars`` (counts by CLASSES, the rest last), ``_q_common`` (counts of the
    language's common words, all other words last; NULL without a list) and ``_q_lang``."""
    text = F.coalesce("text", F.lit(""))
    lang = F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).otherwise(OTHER)
    out = docs.withColumns({"_q_text": text, "_q_words": words(text), "_q_lang": lang})
    rest = "_q_text"
    for name, pattern in CLASSES:
        out = out.withColumn(f"_q_no_{name}", F.regexp_replace(rest, pattern, ""))
        rest = f"_q_no_{name}"
    left = ["_q_text", *(f"_q_no_{name}" for name, _ in CLASSES)]
    counts = [F.length(a) - F.length(b) for a, b in zip(left, left[1:])] + [F.length(left[-1])]
    listed = F.lit(None).cast("array<string>")
    for code, common in COMMON_WORDS.items():
        listed = F.when(F.col("_q_lang") == code, F.array(*map(F.lit, common))).otherwise(listed)
    longest = max(len(w) for common in COMMON_WORDS.values() for w in common)

    def histogram(short: Column) -> Column:
        found = F.transform(listed, lambda w: F.size(short) - F.size(F.array_remove(short, w)))
        others = let(found, lambda f: F.concat(f, F.array(
            F.size("_q_words") - F.aggregate(f, F.lit(0), lambda a, x: a + x))))
        return others

    # Only short words can be common ones; the rest need no comparing.
    common = let(F.filter("_q_words", lambda w: F.length(w) <= longest), histogram)
    return out.withColumns({
        "_q_chars": F.array(*counts), "_q_common": common, "_q_symbols": counts[-2],
    }).drop(*left[1:])


def references(docs: DataFrame) -> DataFrame:
    """One row per listed language, and OTHER for all documents together: ``_q_ref_lang``,
    ``_q_ref_chars``, ``_q_ref_common``, each a sum of shares in 1/SCALE. At most five rows."""
    h = with_histograms(docs.select("text", "lang"))
    n_common = len(next(iter(COMMON_WORDS.values()))) + 1

    def summed(column: str, width: int, total: str) -> Column:
        # The condition stands inside the sums: as a filter it would be pushed below the
        # projections and the histograms computed twice.
        return F.array(*(
            F.sum(F.expr(f"CASE WHEN _q_ok THEN ({column}[{i}] * {SCALE}L) div {total} END"))
            for i in range(width)))

    n, w = F.length("_q_text"), F.size("_q_words")
    judged = h.select(
        "_q_lang", "_q_chars", "_q_common", n.alias("_q_n"), w.alias("_q_w"),
        ((n >= MIN_CHARS_JUDGED) & (w >= MIN_WORDS)
         & (100 * F.col("_q_symbols") <= MAX_REFERENCE_SYMBOL_PERCENT * n)).alias("_q_ok"),
    )
    sums = judged.groupBy("_q_lang").agg(
        summed("_q_chars", len(CLASSES) + 1, "_q_n").alias("c"),
        summed("_q_common", n_common, "_q_w").alias("w"),
    )
    both = sums.withColumn(
        "_q_ref_lang", F.explode(F.array_distinct(F.array(F.col("_q_lang"), F.lit(OTHER)))))
    add = lambda column, width: F.array(*(F.sum(F.col(column)[i]) for i in range(width)))
    return both.groupBy("_q_ref_lang").agg(
        add("c", len(CLASSES) + 1).alias("_q_ref_chars"), add("w", n_common).alias("_q_ref_common"))


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms; NULL when either is NULL; one that is all
    zero counts as equal to any."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def compare(p: Column, q: Column) -> Column:
        terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
        return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))

    def shares(a: Column) -> Column:
        return let(total(a), lambda t: F.when(t > 0, F.transform(a, lambda x: x / t)))

    return let(shares(counts), lambda p: let(shares(reference), lambda q: compare(p, q)))


def limit(parts: tuple[float, float, float], size: Column) -> Column:
    """The largest distance at which a text of ``size`` is kept."""
    least, base, slope = parts
    return F.greatest(F.lit(least), F.lit(base) + F.lit(slope) / F.sqrt(F.greatest(size, F.lit(1))))


def assess(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts, both distances and the verdict ``kept``.

    Added columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    char_distance, word_distance, kept; columns of these names are replaced, and those whose names begin with
    _q_ are left out. A NULL or empty text has no words and fails the base.
    A NULL or unlisted language is compared with the characters of all documents together and has
    no word_distance; neither has a text without words, nor an empty one a char_distance. Where no text
    of a language is long enough for a reference, distances are 0 and the base alone decides. Rows
    repeated in ``docs`` are judged each for itself; an empty table gives an empty result.
    """
    docs = docs.drop(*(c for c in docs.columns if c.startswith("_q_")))
    refs = F.broadcast(references(docs))  # at most five rows
    lines = F.filter(F.split("_q_text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    h = with_histograms(docs).withColumn("_q_lines", lines)
    h = h.withColumns({
        "n_words": F.size("_q_words").cast("long"),
        "word_chars": F.length(F.array_join("_q_words", "")).cast("long"),
        "n_symbols": F.col("_q_symbols").cast("long"),
        "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "n_repeat_words": _repeated(F.col("_q_words")).cast("long"),
        "_q_n": F.length("_q_text"),
    }).drop("_q_text", "_q_words", "_q_lines", "_q_symbols")
    h = h.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    j = h.join(refs, F.col("_q_lang") == F.col("_q_ref_lang"), "left")
    j = j.withColumns({
        "char_distance": F.when(F.col("_q_n") > 0,
                                F.round(distance(F.col("_q_chars"), F.col("_q_ref_chars")), 6)),
        "word_distance": F.when((F.col("n_words") > 0) & F.col("_q_common").isNotNull(),
                                F.round(distance(F.col("_q_common"), F.col("_q_ref_common")), 6)),
    })
    far = (F.coalesce("char_distance", F.lit(0.0)) > limit(CHAR_LIMIT, F.col("_q_n"))) | (
        F.coalesce("word_distance", F.lit(0.0)) > limit(WORD_LIMIT, F.col("n_words")))
    # One expression over both sides of the join: a conjunction would be taken apart when it is
    # filtered, and its base half be moved onto the scan and computed a second time there.
    kept = F.forall(F.array(~F.col("base_failed"), ~far), lambda x: x)
    return j.withColumn("kept", kept).drop(
        "_q_lang", "_q_chars", "_q_common", "_q_n", "_q_ref_lang", "_q_ref_chars", "_q_ref_common")
