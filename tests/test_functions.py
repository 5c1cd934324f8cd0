import datetime as dt
import re
import unicodedata
import uuid

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from newsloom.functions import chunking, dates, html, ids, questions, rendering, text

QUICK = settings(
    max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


# --- text ------------------------------------------------------------------------------------


def test_clean_golden_rows(one):
    def clean(values, byline):
        return one(lambda c: text.clean(c, byline=byline), values)

    raw = ["a\n\n\n\nb\tc\r\nd", "|a | b|\n|---|---|\n1 end", "|a|b|\r\n1 end", "x​y",
           "body 　", "body\n\n\n|||\n1", None]
    assert clean(raw, False) == [
        "a\n\nb c \nd", "a | b\n--- | ---\n1 end", "|a|b| \n1 end", "xy", "body", "body\n\n1", None
    ]
    signed = ["a\n\n\n\nb\tc\r\nd", "body\n\nĐỗ An (theo BBC)", "body\nđỗ an (tổng hợp)",
              "body\n" + "N" * 81 + ".", "body\n" + "N" * 83, "body\n1 end", "one line"]
    assert clean(signed, True) == [
        "a\n\nb c ", "body\n", "body", "body", "body\n" + "N" * 83, "body\n1 end", "one line"
    ]


@QUICK
@given(st.lists(st.text(st.sampled_from(" \n\t\r\x1c 　aéế|"), max_size=12),
                min_size=1, max_size=8))
def test_strip_and_nfc_agree_with_python(one, values):
    assert one(text.strip, values) == [v.strip() for v in values]
    assert one(text.nfc, values) == [unicodedata.normalize("NFC", v) for v in values]
    assert one(text.is_blank, values) == [v.strip() == "" for v in values]


@QUICK
@given(st.lists(st.text(st.sampled_from("aĐđ1\n (.)theo"), max_size=30), min_size=1, max_size=8))
def test_byline_agrees_with_python(one, values):
    pattern = re.compile(
        rf"\n[{text.BYLINE_LETTERS}][^\n]{{0,80}}"
        rf"(?:\s*\((?:{text.BYLINE_SOURCES})[^\)]{{0,60}}\))?\.?\s*$", re.IGNORECASE)
    assert one(text.strip_byline, values) == [pattern.sub("", v) for v in values]


@QUICK
@given(st.lists(st.text(st.sampled_from("ab| \n\r"), max_size=20), min_size=1, max_size=8))
def test_tables_agree_with_python(one, values):
    def flat(v):
        return "\n".join(
            " | ".join(c.strip() for c in line.split("|") if c.strip())
            if re.fullmatch(r"\|.+\|", line, re.S) else line
            for line in v.split("\n"))

    assert one(text.flatten_tables, values) == [flat(v) for v in values]


def test_letter_class_holds_both_cases(one):
    marks = questions.VIETNAMESE_LETTERS
    values = [*marks, *marks.upper(), "a", "z", "ß", "ñ", "1", ""]
    want = [bool(re.search(f"[{marks}]", v, re.I)) for v in values]
    assert one(lambda c: c.rlike(text.letter_class(marks)), values) == want


# --- dates and ids ---------------------------------------------------------------------------


def test_dates(one):
    values = ["Thứ sáu, 22/5/2026, 18:45 (GMT+7)", "Thứ Hai, 20/11/2023, 9:05 (GMT-3)",
              "1/2/2024, 10:00 (GMT+5:30)", "1/2/2024, 10:00 (GMT+30)",
              "1/2/2024, 10:00 (GMT+99999999999)", "31/2/2024, 10:00", "1/1/2024, 24:00", "", None,
              "yesterday", "1/1/0000, 10:00"]

    def shown(fn):
        return one(lambda c: F.date_format(fn(c), "yyyy-MM-dd HH:mm"), values)

    none = [None] * 6
    assert shown(dates.parse_local) == [
        "2026-05-22 18:45", None, "2024-02-01 10:00", "2024-02-01 10:00", "2024-02-01 10:00", *none]
    assert shown(dates.parse_utc) == [
        "2026-05-22 11:45", "2023-11-20 12:05", "2024-02-01 03:00", None, None, *none]


def test_uuid5_agrees_with_python(one):
    names = ["https://a/x_chunk_0", "đội bóng_chunk_1", "_chunk_0", ""]
    assert one(ids.uuid5_url, names) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_blank_urls_do_not_share_ids(spark):
    rows = spark.createDataFrame([("", 0, "x"), (None, 0, "y"), ("u", None, "z")], "u string, i int, t string")
    got = [r[0] for r in rows.select(ids.chunk_id(F.col("u"), F.col("i"), F.col("t"))).collect()]
    assert len(set(got)) == 3
    assert got[2] == str(uuid.uuid5(uuid.NAMESPACE_URL, "u_chunk_0"))


# --- chunking --------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab .!?\n"), max_size=200), st.integers(5, 40), st.integers(0, 4))
def test_recursive_chunks_cover_the_text(value, size, overlap):
    chunks = chunking.split_recursive(value, size, overlap)
    at = 0
    for c in chunks:
        assert 0 < len(c) <= size and c == c.strip()
        assert c in value
    # Nothing but white space is lost: the chunks appear in order and cover every other character.
    covered = [False] * len(value)
    for c in chunks:
        found = value.find(c, max(0, at - size))
        assert found != -1
        covered[found:found + len(c)] = [True] * len(c)
        at = found + len(c)
    assert chunks or not value.strip()
    joined = "".join(chunks)
    assert set(value.split()) == set() or len("".join(joined.split())) >= len("".join(value.split()))


def test_recursive_chunks_hand_worked():
    split = chunking.split_recursive
    assert split("") == [] and split(None) == [] and split(" \n ") == []
    assert split("x" * 800) == ["x" * 800]
    assert [len(c) for c in split("x" * 801)] == [800, 151]
    assert split("aaaa. bbbb. cccc", 8, 0) == ["aaaa", ". bbbb", ". cccc"]
    assert split("aa bb cc dd", 6, 3) == ["aa bb", "bb cc", "cc dd"]
    assert split("one\n\ntwo\n\nthree", 9, 0) == ["one\n\ntwo", "three"]


def test_recursive_column_matches_function(one):
    values = ["word " * 700, "a. " * 900, "x" * 3000, "short", "", None]
    assert one(chunking.chunk_recursive, values) == [chunking.split_recursive(v) for v in values]


def test_splitter_from_sql(spark):
    chunking.register_sql(spark)
    got = spark.sql("SELECT posexplode(chunk_text(repeat('x', 801)))").collect()
    assert [(r[0], len(r[1])) for r in got] == [(0, 800), (1, 151)]


@QUICK
@given(st.lists(st.integers(0, 60), min_size=1, max_size=5))
def test_fixed_chunks(one, sizes):
    values = ["".join(chr(97 + i % 26) for i in range(n)) for n in sizes]
    for v, chunks in zip(values, one(lambda c: chunking.chunk_fixed(c, 20, 5), values)):
        assert all(len(c) == 20 for c in chunks[:-1])
        assert "".join([*chunks[:1], *[c[5:] for c in chunks[1:]]]) == v


# --- pages -----------------------------------------------------------------------------------


def test_unescape_once(one):
    values = ["a &amp; b", "&amp;lt;", "&lt;b&gt;", "&#7879;&#x1F4D6;", "&eacute;&nbsp;&yuml;",
              "&nope; & &#xD800; &#0;", "plain", None, "&amp", "&copy;&copy;"]
    assert one(html.unescape, values) == [
        "a & b", "&lt;", "<b>", "ệ\U0001f4d6", "é ÿ", "&nope; & &#xD800; &#0;", "plain",
        None, "&amp", "©©"]


def test_page_fields(one):
    page = ('<html><head><!-- <title>no</title> --><script>"<title>no</title>"</script>'
            '<TITLE lang="vi">Tin &amp; <b>bóng</b></TITLE></head><body><nav>menu</nav>'
            '<span class="up date x">Thứ Hai, 1/1/2024</span><div class="ad">buy</div>'
            '<article><h1>Head</h1><p>One<br>two  three<p><b>four</b><aside>no</aside></article>'
            '<footer>end</footer></body></html>')
    pages = [page, "<p>only</p> text", "<main>m</main>", "", None,
             '<span class="update">x</span><title></title>']
    assert one(html.title, pages) == ["Tin & bóng", "", "", "", None, ""]
    assert one(html.date_text, pages) == ["Thứ Hai, 1/1/2024", "", "", "", None, ""]
    assert one(html.main_text, pages)[:5] == ["Head\nOne\ntwo three\nfour", "only\ntext", "m", "", None]


# --- questions and rendering -----------------------------------------------------------------


def test_time_preference(one):
    asked = {"Tin trong tháng 24h": 720, "TUẦN NÀY": 168, "7 ngày qua": 168, "hôm nay": 24,
             "trong 3 giờ qua": 3, "last 36 h please": 36, "36hôm": 12, "hi": 12,
             "99999999999999h": 2**31 - 1, "99999h": 99999, "trong 10000 giờ": 10000, "0h": 0}
    assert one(questions.time_preference, asked) == list(asked.values())


def test_question_functions(one):
    assert one(questions.extract_feed_url, ["x HTTP://a/b.RSS y", "http://a/b.rssx", "no"]) == [
        "HTTP://a/b.RSS", None, None]
    assert one(questions.detect_language, ["Đá bóng", "ball", "ẳ", "CHÚ Ý", ""]) == [
        "vi", "en", "en", "vi", "en"]
    assert one(questions.validate_label, [" Sports_Wiki ", "other", "", None, "OFF_TOPIC\n"]) == [
        "sports_wiki", "sports_news", "sports_news", "sports_news", "off_topic"]
    rules = [("off_topic", "(?i)pizza"), ("sports_wiki", "(?i)who")]
    assert one(lambda c: questions.classify_rules(c, rules), ["Who likes pizza", "who", "score"]) == [
        "off_topic", "sports_wiki", "sports_news"]
    assert one(questions.decline_text, ["nấu phở", "pizza"]) == [
        questions.DECLINE_VI, questions.DECLINE_EN]


def test_parse_blocks(spark):
    block = rendering.context_block(
        F.lit(1), F.lit("T"), F.lit(None), F.lit("D"), F.lit("line\nmore"))
    row = spark.range(1).select(
        rendering.parse_blocks(F.concat(block, F.lit("\n\n\n\nstray"))).alias("b"),
        rendering.parse_blocks(F.lit(rendering.NOT_FOUND_TEXT)).alias("none"),
        rendering.parse_blocks(F.lit("Lỗi khi query database: x")).alias("error"),
        rendering.parse_blocks(F.lit("")).alias("empty"),
    ).first()
    assert [tuple(x) for x in row["b"]] == [("T", "N/A", "D", "line\nmore"), ("", "", "", "")]
    assert row["none"] == row["error"] == row["empty"] == []


def test_summary_and_source(one):
    text_ = "One. Two! Three? Four. Five. Six."
    assert one(rendering.summary, [text_, "No end"]) == ["One. Two! Three? Four. Five.", "No end"]
    assert one(rendering.source_url, ["see https://vi.wikipedia.org/wiki/A now", "none"]) == [
        "https://vi.wikipedia.org/wiki/A", "https://wikipedia.org"]


def test_prompt_marks_old_and_warned(spark):
    warned = rendering.context_block(
        F.lit(2), F.lit("T"), F.lit("u"), F.lit("d"), F.lit("x" * 700),
        warning=rendering.recency_warning(F.lit(12), F.lit(None).cast("string")), prompt=True)
    row = spark.range(1).select(
        warned.alias("w"),
        rendering.news_prompt(F.lit("q"), F.lit("c"), F.lit("OLD")).alias("old"),
        rendering.news_prompt(F.lit("q"), F.lit("c"), F.lit("RECENT")).alias("new"),
    ).first()
    assert "⚠️  Không có tin trong 12 giờ qua. Tin gần nhất: N/A" in row["w"]
    assert row["w"].endswith("x" * 600) and not row["w"].endswith("x" * 601)
    assert rendering.OLD_NOTE in row["old"] and rendering.OLD_NOTE not in row["new"]


def test_as_of_is_explicit(spark):
    from newsloom.operators.retrieval import as_time

    at = dt.datetime(2024, 1, 31)
    assert spark.range(1).select(F.date_format(as_time(at), "yyyy-MM-dd")).first()[0] == "2024-01-31"
    assert spark.range(1).select(as_time(None).isNotNull()).first()[0]


def test_markup_of_all_kinds(one):
    from newsloom.functions import html

    nested = "<body>x<article>one<article>inner</article>two</article><p>gap</p><article>three</article>y</body>"
    quoted = "<article>a<div class='x ad'>no</div><div class=ad>no</div><form>b</form></article>"
    assert one(html.main_text, [nested, quoted]) == ["oneinnertwo\nthree", "ab"]
    assert one(html.date_text, ["<span class='date'>1</span>", "<span class=date>2</span>", '<span id=a class="x date">3</span>',
                                "<span class=dates>4</span>"]) == ["1", "2", "3", ""]
    assert one(html.unescape, ["&OElig;&Scaron;&#150;&#x80;&apos;&nope;"]) == ["ŒŠ–€'&nope;"]


def test_main_text_by_elements(one):
    from newsloom.functions import html

    cases = {
        "<nav-bar>menu</nav-bar><article>one <nav>n</nav> two</article>": "one two",
        "<article>a<div class=ad>x<div>y</div>tail</div>b</article>": "ab",
        "<article>a<aside>b<aside>c</aside>c</aside>d</article>": "ad",
        "<article>text</article><p>related</p><article><a href=x>teaser one</a></article>": "text",
        "<article><a>only links</a></article><article><a>more</a></article>": "only links\nmore",
        "<article>one <nav>lost end</article><p>after": "one",
        "<article>no end <b>bold": "no end bold",
        "<article> <br> </article><main>in main</main>": "in main",
        "<article>a</b>b</p>c<svg/>d<script>'<article>'</script>e<!-- <nav> -->f</article>": "ab\ncdef",
        "<body><aside><article>x</article></aside>rest</body>": "rest",
        "a < b &amp; c": "a < b & c",
        "<div>" * 5000 + "<article>deep</article>": "deep",
        "<articles>x</articles><article>y</article>": "y",
    }
    assert one(html.main_text, list(cases)) == list(cases.values())
    assert one(html.main_text, ["", None, "<script>x"]) == ["", None, ""]


def test_page_files_and_json_lines(spark, tmp_path):
    from newsloom import schemas
    from newsloom.operators.ingest import extract_pages
    from newsloom.sources import articles

    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "a.html").write_text(
        "<head><link href='http://x/a' rel='canonical'><title>T</title></head><article>body</article>")
    (tmp_path / "pages" / "b.html").write_text("<article>other</article>")
    pages = articles.read_page_files(spark, str(tmp_path / "pages"))
    got = {r["url"].rsplit("/", 1)[1]: r for r in extract_pages(pages).collect()}
    assert got["a"]["url"] == "http://x/a" and got["a"]["content"] == "body" and "b.html" in got

    table = spark.createDataFrame([("u1", "t\n1", "01/02/2024, 10:00", "c", 1), ("u2", "t2", None, "d", 2)], schemas.ARTICLES)
    articles.write_articles(table, str(tmp_path / "json"), "json")
    back = articles.read_articles_json(spark, str(tmp_path / "json"), lines=True)
    assert sorted(r["title"] for r in back.collect()) == ["t\n1", "t2"]


def test_pages_cross_to_python_in_small_batches(spark):
    pages = spark.range(3).select(F.concat(F.lit("<p>a</p> "), F.col("id").cast("string")).alias("v"))
    plan = pages.select(html.main_text(F.col("v")).alias("r"))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_splitter_holds_few_texts_as_python_strings():
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([("wörd " * 4000) + str(i) for i in range(500)] + [None, ""])
    tracemalloc.start()
    got = chunking.split_array(texts, 800, 150, chunking.SEPARATORS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000  # 10 MB of text, twice that as chunks and their list
    assert got.to_pylist()[::100] == [chunking.split_recursive(t) for t in texts.to_pylist()[::100]]
