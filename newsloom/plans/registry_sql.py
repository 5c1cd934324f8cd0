"""DuckDB SQL that states, independently of Spark, what each registered query must return."""

from string import ascii_lowercase, ascii_uppercase

from newsloom.functions.questions import ALL_HOURS, DECLINE_EN, DECLINE_VI, VIETNAMESE_LETTERS
from newsloom.functions.rendering import (
    LOOKUP_REQUEST, NEWS_REQUEST, NOTHING_FOUND_TEXT, NOT_FOUND_TEXT, OLD_NOTE,
)
from newsloom.functions.text import BYLINE_LETTERS, BYLINE_SOURCES
from newsloom.plans.inputs import AS_OF, PHRASES, RULES

NL = "chr(10)"
AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


# --- shared pieces ---------------------------------------------------------------------------

ARTICLES = """articles AS (
  SELECT 'https://' || source || '.example.com/' || doc_id AS url, 'Doc ' || doc_id AS title,
    'Thứ Hai, ' || (1 + doc_id % 31) || '/' || (1 + doc_id % 12) || '/2024, ' || (doc_id % 25)
      || ':' || lpad(CAST(doc_id % 60 AS VARCHAR), 2, '0')
      || CASE doc_id % 4 WHEN 0 THEN ' (GMT+7)' WHEN 1 THEN ' (GMT-3)' WHEN 2 THEN ''
         ELSE ' (GMT+5:30)' END AS date,
    text AS content, doc_id AS seq, lang
  FROM documents)"""


def _parsed(date: str, hour: str) -> str:
    p = rf"'([0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}),\s*([0-9]{{{hour}}}:[0-9]{{2}})'"
    return (
        f"try_strptime(regexp_extract({date}, {p}, 1) || ' ' || regexp_extract({date}, {p}, 2), "
        "'%d/%m/%Y %H:%M')"
    )


def _utc(date: str) -> str:
    zone = rf"regexp_extract({date}, '\(GMT([+-][0-9]+)\)', 1)"
    hours = f"CASE WHEN {zone} = '' THEN 7 ELSE CAST({zone} AS INT) END"
    return f"({_parsed(date, '1,2')} - to_hours({hours}))"


def _uuid5(name: str) -> str:
    h = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({name}))"
    return (
        f"(list_transform([{h}], lambda h: h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' "
        "|| translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' "
        "|| h[21:32]))[1]"
    )


def _chunks(content: str, source: str, columns: str) -> str:
    """Windows of 800 characters every 650, numbered from 0."""
    n = f"CAST(greatest(0, ceil((length({content}) - 800) / 650.0)) AS INT)"
    return (
        f"SELECT {columns}, CAST(i AS INT) AS chunk_index, {n} + 1 AS total_chunks, "
        f"substr({content}, i * 650 + 1, 800) AS text "
        f"FROM (SELECT *, unnest(range({n} + 1)) AS i FROM {source} WHERE {content} <> '')"
    )


CHUNKS = (
    f"chunks AS (SELECT {_uuid5('url' + chr(124) * 2 + chr(39) + '_chunk_' + chr(39) + '||chunk_index')}"
    f" AS chunk_id, *, {_utc('date')} AS published_at FROM ("
    + _chunks("content", "articles", "url, title, date, lang, seq") + "))"
)

_PHRASE = "CASE (conv_id + turn) % 6 " + " ".join(
    f"WHEN {i} THEN {_lit(p)}" for i, p in enumerate(PHRASES)
) + " END"
QUESTIONS = (
    f"questions AS (SELECT conv_id * 1000 + turn AS q_id, text || {_PHRASE} AS question "
    "FROM conversations WHERE role = 'user')"
)


def _hours(q: str) -> str:
    q = f"lower({q})"
    a, b = rf"regexp_extract({q}, 'trong\s*([0-9]+)\s*giờ', 1)", rf"regexp_extract({q}, '([0-9]+)\s*h\b', 1)"
    n = f"coalesce(nullif({a}, ''), nullif({b}, ''))"
    return (
        f"CASE WHEN regexp_matches({q}, 'tháng này|trong tháng') THEN 720 "
        f"WHEN regexp_matches({q}, 'tuần này|trong tuần|7 ngày') THEN 168 "
        f"WHEN regexp_matches({q}, 'hôm nay|trong ngày') THEN 24 "
        f"ELSE coalesce(TRY_CAST({n} AS INT), CASE WHEN {n} IS NULL THEN 12 ELSE {ALL_HOURS} END) END"
    )


def _lang(text: str) -> str:
    return f"CASE WHEN regexp_matches({text}, '(?i)[{VIETNAMESE_LETTERS}]') THEN 'vi' ELSE 'en' END"


def _decline(question: str) -> str:
    return f"CASE WHEN {_lang(question)} = 'vi' THEN {_lit(DECLINE_VI)} ELSE {_lit(DECLINE_EN)} END"


def _kind(question: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({question}, {_lit(p)}) THEN '{k}'" for k, p in RULES)
    return f"CASE {whens} ELSE 'sports_news' END"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\v\x1C-\x1F\x85\xA0\x{{3000}}]+|[\s\v\x1C-\x1F\x85\xA0\x{{3000}}]+$', '', 'g')"


def _byline(c: str) -> str:
    return (
        rf"regexp_replace({c}, '(?i)\n[{BYLINE_LETTERS}][^\n]{{0,80}}"
        rf"(?:\s*\((?:{BYLINE_SOURCES})[^\)]{{0,60}}\))?\.?\s*$', '', 'g')"
    )


def _flat(c: str) -> str:
    cells = (
        "array_to_string(list_filter(list_transform(string_split(line, '|'), "
        f"lambda x: {_strip('x')}), lambda x: x <> ''), ' | ')"
    )
    return (
        f"array_to_string(list_transform(string_split({c}, {NL}), lambda line: "
        rf"CASE WHEN regexp_full_match(line, '(?s)\|.+\|') THEN {cells} ELSE line END), {NL})"
    )


def _spaces(c: str) -> str:
    return _strip(
        rf"regexp_replace(regexp_replace({c}, '\n{{3,}}', {NL} || {NL}, 'g'), '[\t\r]', ' ', 'g')"
    )


def _visible(c: str) -> str:
    return (
        rf"regexp_replace({c}, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|"
        rf"<style\b[^>]*>.*?</style\s*>', '', 'g')"
    )


def _unescape(c: str) -> str:
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"),
                       ("amp", "&")):
        c = f"replace({c}, '&{name};', {_lit(char)})"
    return c


def _title(c: str) -> str:
    return _unescape(rf"regexp_extract({_visible(c)}, '(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>', 1)")


def _main_text(c: str) -> str:
    noise = "|".join(
        rf"<{n}\b[^>]*>.*?</{n}\s*>"
        for n in ("head", "title", "noscript", "template", "iframe", "svg", "nav", "footer", "aside", "form")
    )
    page = f"regexp_replace({_visible(c)}, '(?is){noise}', '', 'g')"
    body = rf"regexp_extract({page}, '(?is)<article\b[^>]*>(.*?)</article\s*>', 1)"
    broken = rf"regexp_replace({body}, '(?i)</?(?:br|hr|p|div|h[1-6]|li|ul|ol|dl|dt|dd|tr|table|section|header|blockquote|pre|figure|figcaption)\b[^>]*>', {NL}, 'g')"
    text = _unescape(rf"regexp_replace({broken}, '(?s)</?[A-Za-z][^>]*>', '', 'g')")
    text = rf"regexp_replace({text}, '[ \t\r\f]+', ' ', 'g')"
    text = rf"regexp_replace({text}, ' ?\n[ \n]*', {NL}, 'g')"
    return f"trim(regexp_replace({text}, '^{chr(92)}n|{chr(92)}n$', '', 'g'))"


def _summary(c: str) -> str:
    marked = rf"regexp_replace({c}, '([.!?])[\s\v\x85\xA0]+', '\1' || chr(1), 'g')"
    return f"array_to_string(string_split({marked}, chr(1))[1:5], ' ')"


# --- similarity ------------------------------------------------------------------------------


def _vector(c: str) -> str:
    """Counts of lower-cased words by MD5 bucket, as 64 doubles."""
    bucket = "CAST('0x' || md5(t)[1:8] AS BIGINT) % 64"
    words = rf"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+')"
    return (
        f"list_transform([list_transform({words}, lambda t: {bucket})], lambda bs: "
        "list_transform(range(64), lambda b: "
        "CAST(len(list_filter(bs, lambda x: x = b)) AS DOUBLE)))[1]"
    )


VECTOR_CHUNKS = f"""c AS (
  SELECT *, {_stamp('published_at')} AS date FROM (
    SELECT vec_id AS chunk_id, CASE WHEN vec_id % 11 <> 0 THEN 'u' || (vec_id % 100) END AS url,
      'Item ' || vec_id AS title, 'label ' || label AS text, CAST(embedding AS DOUBLE[]) AS v,
      CASE WHEN vec_id % 7 <> 0
        THEN TIMESTAMP '2024-01-01' + to_hours(CAST((vec_id * 37) % 720 AS INT)) END AS published_at
    FROM embeddings))"""
VECTOR_QUESTIONS = """q AS (
  SELECT vec_id AS q_id, CAST(embedding AS DOUBLE[]) AS v,
    CASE vec_id % 5 WHEN 1 THEN 12 WHEN 2 THEN 168 WHEN 3 THEN 720 WHEN 4 THEN 2 END AS hours
  FROM embeddings)"""
VECTORS = f"{VECTOR_QUESTIONS},\n{VECTOR_CHUNKS}"
TEXT_CHUNKS = f"c AS (SELECT *, {_vector('text')} AS v FROM chunks)"


def _text_questions(source: str) -> str:
    return (
        f"q AS (SELECT q_id, {_hours('question')} AS hours, {_vector('question')} AS v "
        f"FROM {source})"
    )


SCORED = """scored AS (
  SELECT q_id, hours, chunk_id, url, date, published_at, score FROM (
    SELECT q.q_id, q.hours, c.chunk_id, c.url, c.date, c.published_at,
      floor(list_dot_product(q.v, c.v) / sqrt(q.n2 * c.n2) * 1000000.0 + 0.5) / 1000000.0 AS score
    FROM (SELECT *, list_dot_product(v, v) AS n2 FROM q) q,
         (SELECT *, list_dot_product(v, v) AS n2 FROM c) c
    WHERE q.n2 > 0 AND c.n2 > 0))"""


def _top(k: int, min_score: float | None = None) -> str:
    where = "" if min_score is None else f"WHERE score >= {min_score}"
    return (
        "top AS (SELECT *, CAST(row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) "
        f"AS INT) AS rank FROM scored {where} QUALIFY rank <= {k})"
    )


# Hits of ``top`` reduced to one per url, then by the recency rules, into ``hits``.
UNIQUE = """uniq AS (
  SELECT * FROM top QUALIFY row_number() OVER (
    PARTITION BY q_id, coalesce('u:' || nullif(url, ''), 'c:' || chunk_id) ORDER BY rank) = 1)"""
SELECTED = f"""hits AS (
  SELECT q_id, hours, chunk_id, url, date, published_at, score, CAST(place AS INT) AS rank,
    CASE WHEN mode = 'latest' THEN 'Không có tin trong ' || hours || ' giờ qua. Tin gần nhất: '
      || coalesce(date, 'N/A') END AS recency_warning
  FROM (
    SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY
        CASE WHEN mode <> 'score' THEN published_at END DESC NULLS LAST, rank) AS place
    FROM (
      SELECT *, CASE WHEN hours IS NULL THEN 'score' WHEN n_recent > 0 THEN 'recent'
          WHEN n_dated > 0 THEN 'latest' ELSE 'score' END AS mode
      FROM (
        SELECT *, count(*) FILTER (WHERE recent) OVER (PARTITION BY q_id) AS n_recent,
          count(published_at) OVER (PARTITION BY q_id) AS n_dated
        FROM (SELECT *, coalesce(published_at >= {AS_OF_SQL} - to_hours(hours), FALSE) AS recent
              FROM uniq)))
    WHERE mode = 'score' OR (mode = 'recent' AND recent)
       OR (mode = 'latest' AND published_at IS NOT NULL))
  WHERE place <= CASE WHEN mode = 'latest' THEN 1 ELSE 5 END)"""
STATUS = f"""status AS (
  SELECT q.q_id, CAST(coalesce(n, 0) AS INT) AS docs_found_count,
    CASE WHEN n IS NULL THEN 'NOT_FOUND'
      WHEN newest >= {AS_OF_SQL} - to_hours(hours) THEN 'RECENT' ELSE 'OLD' END AS recency_status
  FROM q LEFT JOIN (SELECT q_id, count(*) AS n, max(published_at) AS newest FROM hits
                    GROUP BY q_id) h ON h.q_id = q.q_id)"""
HIT_COLUMNS = (
    f"SELECT q_id, chunk_id, url, {_stamp('published_at')} AS published_at, score, rank, "
    "recency_warning FROM hits"
)


def _block(title_label: str, chars: int, warning: str) -> str:
    return (
        f"'[' || rank || '] {title_label}: ' || coalesce(title, 'N/A') || {NL} || '    URL: ' || "
        f"coalesce(url, 'N/A') || {NL} || '    Ngày: ' || coalesce(date, 'N/A') || {warning} || "
        f"{NL} || '    Nội dung: ' || substr(text, 1, {chars})"
    )


PLAIN_BLOCK = _block("Nguồn", 500, "''")
PROMPT_BLOCK = _block(
    "Tiêu đề", 600,
    f"CASE WHEN recency_warning IS NULL THEN '' ELSE {NL} || '    ⚠️  ' || recency_warning END",
)


def _joined(block: str) -> str:
    return f"string_agg({block}, {NL} || {NL} ORDER BY rank)"


FULL_HITS = "full_hits AS (SELECT h.*, c.title, c.text FROM hits h JOIN c ON c.chunk_id = h.chunk_id)"

# --- lookup ----------------------------------------------------------------------------------

KB_PAGES = f"""kb_pages AS (
  SELECT page_id, url, title, text,
    CASE WHEN contains(url, '/fr/') THEN 'en' ELSE {_lang('title')} END AS lang,
    lower({_strip('title')}) AS name
  FROM (SELECT page_id, url, {_title('html')} AS title, {_main_text('html')} AS text FROM pages))"""
KB_QUESTIONS = f"""kb_questions AS (
  SELECT * FROM questions
  UNION ALL SELECT -2 * page_id - 1, translate({_title('html')}, '{ascii_lowercase}', '{ascii_uppercase}') FROM pages
  UNION ALL SELECT -2 * page_id - 2, ' about  ' || {_title('html')} FROM pages)"""


def _kb_found(asked: str) -> str:
    return f"""first_pages AS (
  SELECT * FROM kb_pages QUALIFY row_number() OVER (PARTITION BY lang, name ORDER BY page_id, url) = 1),
resolved AS (
  SELECT lang, name, 0 AS step, {_summary('text')} || {NL} || {NL} || '📖 Source: ' || url AS content
  FROM first_pages
  UNION ALL SELECT lang, 'about ' || name, 1, {_summary('text')} FROM first_pages),
tries AS (
  SELECT q_id, name, lang, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS prio FROM (
    SELECT q_id, name, unnest(list_distinct([{_lang('name')}, 'en'])) AS lang FROM (
      SELECT q_id, lower(regexp_replace({_strip('question')}, '\\s+', ' ', 'g')) AS name
      FROM {asked}))),
found AS (
  SELECT t.q_id, t.lang, r.content AS wiki_content
  FROM tries t JOIN resolved r ON r.lang = t.lang AND r.name = t.name
  QUALIFY row_number() OVER (PARTITION BY t.q_id ORDER BY t.prio, r.step) = 1)"""


SEARCH_QUESTIONS = f"""search_questions AS (
  SELECT * FROM questions
  UNION ALL SELECT -page_id - 1,
    'Who knows, ' || array_to_string(list_reverse(string_split({_title('html')}, ' ')), ' ') || '? Tell me, please'
  FROM pages)"""


def _word_set(c: str) -> str:
    return rf"list_sort(list_distinct(regexp_extract_all(lower({c}), '[\p{{L}}\p{{M}}\p{{N}}]+')))"


# Every question against every title.
TITLE_HITS = f"""entries AS (
  SELECT *, {_word_set('title')} AS words FROM (
    SELECT lang, title, url, NULL AS alias_of, page_id FROM kb_pages
    UNION ALL SELECT lang, 'About ' || title, NULL, title, page_id FROM kb_pages)
  QUALIFY len(words) > 0 AND row_number() OVER (
    PARTITION BY lang, words ORDER BY alias_of IS NOT NULL, page_id, url, title) = 1),
title_tries AS (
  SELECT q_id, said, lang, CASE WHEN lang = detected THEN 0 ELSE 1 END AS prio FROM (
    SELECT *, unnest(list_distinct([detected, 'en'])) AS lang FROM (
      SELECT q_id, {_word_set('question')} AS said, {_lang('question')} AS detected FROM search_questions))),
title_hits AS (
  SELECT q_id, prio, t.lang, title, url, alias_of, CAST(len(words) AS INT) AS matched
  FROM title_tries t JOIN entries e ON e.lang = t.lang AND list_has_all(said, words)
  QUALIFY row_number() OVER (
    PARTITION BY q_id, prio ORDER BY len(words) DESC, alias_of IS NOT NULL, page_id, url, title) = 1)"""

SOURCE_URL = r"coalesce(nullif(regexp_extract(wiki_content, '(https?://\S+wikipedia\S+)', 1), ''), 'https://wikipedia.org')"

FEED_LINKS = f"""links AS (
  SELECT 'feed:' || regexp_extract(url, '^https?://([^/]+)', 1) AS feed_url, pos,
    CASE WHEN pos < 4 THEN {_title('html')} END AS title,
    CASE WHEN pos < 4 THEN url ELSE url || 'missing' END AS url
  FROM (SELECT *, unnest([0, 2, 4]) AS pos FROM pages))"""

HISTORY = (
    f"coalesce(string_agg(role || ': ' || text, {NL}) OVER (PARTITION BY conv_id ORDER BY turn "
    "ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '')"
)
STORED = "chunk_id, url, chunk_index, total_chunks, md5(text) AS text_md5, " \
    r"CAST(len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS DOUBLE) AS n_words"

ANSWERS = (
    _with(
        ARTICLES, CHUNKS, QUESTIONS, KB_QUESTIONS,
        f"state AS (SELECT q_id, {_strip('question')} AS question, {_hours('question')} AS hours, "
        f"{_kind(_strip('question'))} AS question_type FROM kb_questions WHERE {_strip('question')} <> '')",
        "news AS (SELECT * FROM state WHERE question_type = 'sports_news')",
        TEXT_CHUNKS, _text_questions("news"), SCORED, _top(5, 0.5), UNIQUE, SELECTED,
        STATUS, FULL_HITS,
        f"cited AS (SELECT q_id, {_joined(PROMPT_BLOCK)} AS context FROM full_hits GROUP BY q_id)",
        KB_PAGES,
        "searched AS (SELECT * FROM state WHERE question_type <> 'off_topic' "
        "AND q_id NOT IN (SELECT q_id FROM hits))",
        _kb_found("searched"),
        "whole AS (SELECT s.*, coalesce(st.recency_status, 'NOT_FOUND') AS recency_status, "
        "CASE WHEN f.wiki_content IS NOT NULL THEN 1 ELSE coalesce(st.docs_found_count, 0) END "
        "AS docs_found_count, f.wiki_content, c.context FROM state s "
        "LEFT JOIN status st ON st.q_id = s.q_id LEFT JOIN found f ON f.q_id = s.q_id "
        "LEFT JOIN cited c ON c.q_id = s.q_id)",
        "routed AS (SELECT *, CASE question_type WHEN 'sports_wiki' THEN 'wikipedia_search' "
        "WHEN 'off_topic' THEN 'generate_answer' ELSE 'retrieve_initial' END AS route, "
        "CASE WHEN question_type = 'off_topic' THEN 'decline' "
        "WHEN coalesce(wiki_content, '') <> '' THEN 'lookup' WHEN docs_found_count > 0 "
        "THEN 'documents' ELSE 'none' END AS answer_source FROM whole)",
    )
    + f"""SELECT q_id, question_type, hours, route, recency_status, docs_found_count, answer_source,
  md5(CASE answer_source WHEN 'decline' THEN {_decline('question')}
    WHEN 'none' THEN {_lit(NOTHING_FOUND_TEXT)} ELSE coalesce(wiki_content, context) END) AS answer_md5,
  md5(CASE answer_source
    WHEN 'lookup' THEN 'Câu hỏi: ' || question || {NL} || {NL} || 'Thông tin từ Wikipedia:' || {NL}
      || wiki_content || {NL} || {NL} || {_lit(LOOKUP_REQUEST)}
    WHEN 'documents' THEN 'Câu hỏi: ' || question || {NL} || {NL} || 'Context từ database:'
      || CASE WHEN recency_status = 'OLD' THEN {_lit(OLD_NOTE)} ELSE '' END || {NL} || {NL}
      || context || {NL} || {NL} || {_lit(NEWS_REQUEST)} END) AS prompt_md5
FROM routed"""
)

ORACLES: dict[str, str] = {
    "feed_list": "SELECT url AS feed_url FROM pages",
    "feed_items": _with(FEED_LINKS)
    + "SELECT feed_url, CAST(pos AS INT) AS pos, title, url FROM links",
    "articles_json": _with(ARTICLES)
    + """SELECT seq, CAST(pos AS INT) AS pos, url, title, date, md5(content) AS content_md5
FROM (SELECT *, unnest([0, 1]) AS pos FROM articles WHERE lang NOT IN ('de', 'es'))""",
    "articles_newest_first": _with(ARTICLES)
    + f"SELECT seq, url, {_stamp(_parsed('date', '2'))} AS local_ts FROM articles",
    "answer_log": _with(QUESTIONS)
    + f"""SELECT '{AS_OF}' AS ts, question, round(length(question) / 7, 3) AS elapsed_seconds,
  'OLD' AS recency_status, 0 AS crawl_count, 0 AS n_crawled,
  CAST(len(string_split(question, ' ')) AS INT) AS docs_found_count, answer AS final_answer,
  '[{{"role":"human","text":' || CAST(to_json(question) AS VARCHAR) || '}},{{"role":"ai","text":'
    || CAST(to_json(answer) AS VARCHAR) || '}}]' AS messages
FROM (SELECT *, {_decline('question')} AS answer FROM questions)""",
    "page_title": f"SELECT page_id, {_title('html')} AS title FROM pages",
    "page_date": "SELECT page_id, '' AS plain, 'Thứ & ' || url AS date FROM pages",
    "page_text": f"""SELECT page_id, CAST(length(t) AS INT) AS n_chars, md5(t) AS text_md5
FROM (SELECT page_id, {_main_text('html')} AS t FROM pages)""",
    "drop_blank": "SELECT doc_id FROM documents WHERE lang NOT IN ('de', 'fr', 'es')",
    "parse_date_local": _with(ARTICLES)
    + f"SELECT seq, {_stamp(_parsed('date', '2'))} AS local_ts FROM articles",
    "parse_date_utc": _with(ARTICLES)
    + f"SELECT seq, {_stamp(_utc('date'))} AS published_at FROM articles",
    "chunk_id": _with(ARTICLES)
    + f"""SELECT seq, {_uuid5("title || ' đội bóng'")} AS title_id,
  {_uuid5("CASE WHEN content LIKE 'T%' THEN 'content:' || sha256(content) ELSE url END "
          "|| '_chunk_' || (seq % 5)")} AS chunk_id FROM articles""",
    "text_nfc": "SELECT doc_id, md5(nfc_normalize(text || ' e' || chr(770) || chr(769) || ' a' "
    "|| chr(776) || ' ' || text)) AS text_md5 FROM documents",
    "zero_width": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "flatten_tables": f"""SELECT doc_id, md5({_flat('t')}) AS text_md5 FROM (
  SELECT doc_id, '| a |' || source || '||  b|' || {NL} || '|---|---|' || {NL} || 'x | y' || {NL}
    || '|a|b|' || chr(13) || {NL} || '||' || {NL} || '|||' || {NL} || text || {NL} || '| ' || lang
    || '|' AS t FROM documents)""",
    "normalize_spaces": f"""SELECT doc_id, md5({_spaces('t')}) AS text_md5 FROM (
  SELECT doc_id, '  ' || {NL} || replace(replace(text, {NL}, {NL} || {NL} || {NL} || {NL}), ', ',
    ',' || chr(9) || chr(13)) || chr(13) || {NL} || chr(160) || chr(12288) || ' ' AS t
  FROM documents)""",
    "strip_byline": f"""SELECT doc_id, md5({_byline('t')}) AS text_md5 FROM (
  SELECT doc_id, CASE WHEN lang = 'en' THEN text || {NL} || 'đỗ An (theo BBC). ' ELSE text END AS t
  FROM documents)""",
    "clean_text": f"""SELECT doc_id, md5({_byline(_spaces(_flat("replace(nfc_normalize(t), chr(65279), '')")))})
  AS text_md5 FROM (
  SELECT doc_id, chr(65279) || '|a | ' || source || '|' || repeat({NL}, 4) || text || ' e'
    || chr(769) || chr(9) || {NL} || 'Đỗ An' || {NL} AS t FROM documents)""",
    "chunk_fixed": "SELECT doc_id, chunk_index, CAST(length(t) AS INT) AS n_chars, md5(t) AS text_md5 "
    f"FROM (SELECT doc_id, chunk_index, text AS t FROM ({_chunks('content', '(SELECT doc_id, text AS content FROM documents)', 'doc_id')}))",
    "chunk_metadata": _with(ARTICLES, CHUNKS)
    + f"SELECT chunk_id, url, title, date, {_stamp('published_at')} AS published_at, chunk_index, "
    "total_chunks FROM chunks",
    "chunks_per_article": _with(ARTICLES, CHUNKS)
    + "SELECT url, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM chunks GROUP BY url",
    "embed_hash": r"""SELECT doc_id, CAST(b AS INT) AS bucket, CAST(count(*) AS INT) AS n FROM (
  SELECT doc_id, CAST('0x' || md5(t)[1:8] AS BIGINT) % 64 AS b FROM (
    SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS t FROM documents))
GROUP BY doc_id, b""",
    "time_preference": _with(QUESTIONS)
    + f"SELECT q_id, {_hours('question')} AS hours FROM questions",
    "extract_feed_url": "SELECT page_id, CASE WHEN contains(url, 'https') THEN 'HTTPS://' "
    "|| regexp_extract(url, '[^/]*$') || '/tin.RSS' END AS feed_url FROM pages",
    "detect_lang": f"""SELECT doc_id, detected, CASE WHEN regexp_matches(text, '(?i)[äöüß]') THEN 'de'
  ELSE detected END AS detected_of_three, CASE detected WHEN 'en' THEN 'en' ELSE 'vi,en' END
  AS candidates FROM (SELECT doc_id, text, {_lang('text')} AS detected FROM documents)""",
    "validate_label": """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'sports_wiki'
  WHEN 'system' THEN 'off_topic' ELSE 'sports_news' END AS question_type FROM conversations""",
    "classify_rules": _with(QUESTIONS)
    + f"SELECT q_id, {_kind('question')} AS question_type FROM questions",
    "question_state": _with(QUESTIONS)
    + f"""SELECT q_id, {_strip('question')} AS question, {_hours('question')} AS hours,
  'sports_news' AS question_type, 0 AS crawl_count, 'NOT_FOUND' AS recency_status,
  0 AS docs_found_count, '' AS final_answer, CAST(NULL AS VARCHAR) AS wiki_content FROM questions""",
    "route_questions": _with(QUESTIONS)
    + f"""SELECT q_id, CASE {_kind('question')} WHEN 'sports_wiki' THEN 'wikipedia_search'
  WHEN 'off_topic' THEN 'generate_answer' ELSE 'retrieve_initial' END AS route FROM questions""",
    "route_union": _with(QUESTIONS)
    + f"""SELECT q_id, CASE k WHEN 'sports_news' THEN 'news' WHEN 'sports_wiki' THEN 'lookup'
  ELSE 'decline' END AS branch, CASE WHEN k = 'off_topic' THEN {_decline('question')} END
  AS final_answer FROM (SELECT *, {_kind('question')} AS k FROM questions)""",
    "summary_n": f"SELECT doc_id, {_summary('text')} AS summary FROM documents",
    "new_articles_anti": """WITH arrived AS (
  SELECT CASE WHEN source <> 'src3' THEN source || '/' || string_split(text, ' ')[1] END AS url,
    doc_id AS seq, lang FROM documents)
SELECT url, min(seq) AS seq FROM arrived a WHERE lang <> 'de' AND NOT EXISTS (
  SELECT 1 FROM arrived e WHERE e.lang = 'de' AND e.url IS NOT DISTINCT FROM a.url)
GROUP BY url""",
    "merge_counts": """SELECT CAST(count(DISTINCT text) FILTER (WHERE text NOT LIKE 'T%') AS BIGINT)
  AS new_count, count(DISTINCT text) AS total FROM documents""",
    "ingest_stats": _with(FEED_LINKS)
    + """SELECT feed_url, CAST(count(*) FILTER (WHERE pos < 4) AS BIGINT) AS succeeded,
  CAST(count(*) FILTER (WHERE pos = 4) AS BIGINT) AS failed FROM links GROUP BY feed_url""",
    "feed_rollup": _with(FEED_LINKS)
    + "SELECT feed_url, count(*) AS inserted FROM links GROUP BY ROLLUP (feed_url)",
    "chunk_upsert": _with(ARTICLES, CHUNKS)
    + f"""SELECT chunk_id, chunk_index, md5(CASE WHEN regexp_matches(text, '[äöüß]') THEN 'changed ' || text
  ELSE text END) AS text_md5 FROM chunks
UNION ALL SELECT {_uuid5("'new ' || chunk_id")}, chunk_index, md5(text) FROM chunks""",
    "chunk_store_versions": _with(
        ARTICLES.replace("text AS content", f"string_split(text, {NL})[1] AS content"), CHUNKS,
        ARTICLES.replace("articles AS", "before AS"),
    )
    + f"""SELECT chunk_id, chunk_index, total_chunks, md5(text) AS text_md5 FROM chunks
UNION ALL SELECT {_uuid5("url || '_chunk_' || chunk_index")}, chunk_index, total_chunks, md5(text)
FROM ({_chunks('content', "(SELECT * FROM before WHERE url NOT IN (SELECT url FROM chunks))", 'url')})""",
    "merge_messages": """SELECT conv_id || '-' || turn AS message_id, role,
  md5(CASE role WHEN 'assistant' THEN 'changed ' || text ELSE text END) AS text_md5 FROM conversations""",
    "cosine_topk": _with(VECTORS, SCORED, _top(5))
    + "SELECT q_id, chunk_id, score, rank FROM top",
    "cosine_topk_grid": _with(VECTORS, SCORED, _top(5, 0.2))
    + "SELECT q_id, chunk_id, score, rank FROM top",
    "cosine_near_pairs": _with(VECTORS, SCORED)
    + "SELECT q_id, chunk_id, score FROM scored WHERE score >= 0.25 AND q_id < chunk_id",
    "score_threshold": _with(VECTORS, SCORED, _top(20))
    + "SELECT q_id, chunk_id, score FROM top WHERE score >= 0.3",
    "dedup_hits_by_url": _with(VECTORS, SCORED, _top(20, 0.2), UNIQUE)
    + "SELECT q_id, chunk_id, url, rank FROM uniq",
    "recency_window": f"SELECT event_id FROM events WHERE ts >= {AS_OF_SQL} - "
    "to_hours(CAST(user_id % 300 AS INT))",
    "retrieve": _with(VECTORS, SCORED, _top(20, 0.2), UNIQUE, SELECTED) + HIT_COLUMNS,
    "retrieve_distance": _with(
        VECTORS, SCORED, _top(20).replace("top AS", "nearest AS"),
        "top AS (SELECT * REPLACE (round(1 - score, 6) AS score) FROM nearest "
        "WHERE round(1 - score, 6) >= 0.5)",
        UNIQUE, SELECTED,
    )
    + HIT_COLUMNS,
    "retrieve_text": _with(
        ARTICLES, CHUNKS, QUESTIONS, TEXT_CHUNKS, _text_questions("questions"), SCORED,
        _top(20, 0.5), UNIQUE, SELECTED,
    )
    + HIT_COLUMNS,
    "recency_status": _with(VECTORS, SCORED, _top(20, 0.2), UNIQUE, SELECTED, STATUS)
    + "SELECT * FROM status",
    "render_context": _with(VECTORS, SCORED, _top(20, 0.2), UNIQUE, SELECTED, FULL_HITS)
    + f"SELECT q_id, {_joined(PLAIN_BLOCK)} AS context, {_joined(PROMPT_BLOCK)} AS prompt_context "
    "FROM full_hits GROUP BY q_id",
    "context_tool": _with(VECTORS, SCORED, _top(5, 0.4), UNIQUE, SELECTED, FULL_HITS)
    + f"""SELECT q.q_id, coalesce(c.context, {_lit(NOT_FOUND_TEXT)}) AS context FROM q LEFT JOIN (
  SELECT q_id, {_joined(PLAIN_BLOCK)} AS context FROM full_hits GROUP BY q_id) c ON c.q_id = q.q_id""",
    "parse_blocks": _with(VECTORS, SCORED, _top(20, 0.2), UNIQUE, SELECTED, FULL_HITS)
    + "SELECT q_id, rank - 1 AS pos, title, coalesce(url, 'N/A') AS url, "
    "coalesce(date, 'N/A') AS date, text FROM full_hits",
    "kb_lookup": _with(QUESTIONS, KB_QUESTIONS, KB_PAGES, _kb_found("kb_questions"))
    + f"SELECT q_id, lang, md5(wiki_content) AS content_md5, {SOURCE_URL} AS source_url FROM found",
    "title_search": _with(QUESTIONS, SEARCH_QUESTIONS, KB_PAGES, TITLE_HITS)
    + "SELECT q_id, lang, title, url, alias_of, matched FROM title_hits "
    "QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY prio) = 1",
    "kb_lookup_search": _with(
        QUESTIONS, SEARCH_QUESTIONS, KB_PAGES, _kb_found("search_questions"), TITLE_HITS,
        f"""all_found AS (
  SELECT t.q_id, t.lang, t.prio, r.step, r.content FROM tries t JOIN resolved r USING (lang, name)
  UNION ALL
  SELECT h.q_id, h.lang, CASE WHEN h.lang = 'en' THEN 1 ELSE 0 END, 2,
    {_summary('p.text')} || CASE WHEN h.alias_of IS NULL THEN {NL} || {NL} || '📖 Source: ' || p.url ELSE '' END
  FROM title_hits h JOIN first_pages p ON p.lang = h.lang AND p.name = lower({_strip('coalesce(h.alias_of, h.title)')}))""",
    )
    + "SELECT q_id, lang, md5(content) AS content_md5 FROM all_found "
    "QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY prio, step) = 1",
    "lookup_docs": _with(QUESTIONS, KB_QUESTIONS, KB_PAGES, _kb_found("kb_questions"))
    + f"SELECT f.q_id, 'Wikipedia: ' || question AS title, {SOURCE_URL} AS url, '{AS_OF}' AS date, "
    "'wikipedia' AS source FROM found f JOIN kb_questions k ON k.q_id = f.q_id",
    "answer_source": _with(QUESTIONS)
    + f"""SELECT q_id, CASE WHEN {_kind('question')} = 'off_topic' THEN 'decline'
  WHEN length(question) % 2 = 0 THEN 'lookup' WHEN length(question) % 3 > 0 THEN 'documents'
  ELSE 'none' END AS answer_source, CASE WHEN length(question) % 3 > 0 THEN 'generate_answer'
  ELSE 'wikipedia_search' END AS route FROM questions""",
    "answers": ANSWERS,
    "history_running": """SELECT conv_id, turn,
  count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS position,
  CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)
    AS BIGINT) AS history_chars FROM conversations""",
    "history_last_n": f"SELECT conv_id, turn, {HISTORY} AS history FROM conversations",
    "ingest_run": _with(
        f"articles AS (SELECT url, {_main_text('html')} AS content FROM pages)",
    )
    + f"SELECT {_uuid5(chr(34) + 'url' + chr(34) + ' ' + chr(124) * 2 + ' ' + _lit('_chunk_') + ' ' + chr(124) * 2 + ' chunk_index')} AS "
    + f"{STORED} FROM ({_chunks('content', '(SELECT url, ' + _spaces('content') + ' AS content FROM articles)', 'url')})",
    "stream_ingest": _with(
        ARTICLES.replace("text AS content", _spaces("text") + " AS content"), CHUNKS
    )
    + f"SELECT {STORED} FROM chunks",
    "stream_dedup_late": "SELECT event_id, event_type, user_id, value FROM events",
    "stream_dedup": "SELECT event_id, event_type, user_id, value FROM events",
    "history_sparse": f"""SELECT conv_id, turn * 86400000 + conv_id % 1000 AS turn, {HISTORY} AS history,
  count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS position,
  CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)
    AS BIGINT) AS history_chars FROM (SELECT * FROM conversations)""",
    "stream_sessions_late": f"SELECT conv_id, turn, {HISTORY} AS history FROM conversations",
    "stream_sessions": f"SELECT conv_id, turn, {HISTORY} AS history FROM conversations",
}
