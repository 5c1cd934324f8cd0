"""DuckDB SQL for the queries that SQL can express, written from their definitions."""

from newsloom.llm import centroids, divergence, mixing, quality, substrings

ORACLES: dict[str, str] = {}


def _quality() -> str:
    texts = """
    SELECT doc_id, lang, coalesce(text, '') AS t,
      list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws
    FROM documents"""
    strip, names = "t", []
    for name, pattern in quality.CLASSES:
        quoted = pattern.replace("'", "''")
        names.append((name, strip, f"regexp_replace({strip}, '{quoted}', '', 'g')"))
        strip = f"no_{name}"
    layers, source = [], "texts"
    for name, _, expr in names:
        layers.append(f"l_{name} AS (SELECT *, {expr} AS no_{name} FROM {source})")
        source = f"l_{name}"
    left = ["t", *(f"no_{n}" for n, _, _ in names)]
    chars = ", ".join(f"length({a}) - length({b})" for a, b in zip(left, left[1:]))
    lists = " ".join(
        f"WHEN '{code}' THEN {listed!r}" for code, listed in quality.COMMON_WORDS.items())
    codes = ", ".join(f"'{c}'" for c in quality.COMMON_WORDS)
    n_chars = len(quality.CLASSES) + 1
    n_common = len(quality.COMMON_WORDS["en"]) + 1

    def js(p: str, q: str) -> str:
        return f"""(SELECT sqrt(greatest(sum(
            CASE WHEN a > 0 THEN a * log2(a / ((a + b) / 2)) ELSE 0 END
            + CASE WHEN b > 0 THEN b * log2(b / ((a + b) / 2)) ELSE 0 END) / 2, 0))
          FROM (SELECT unnest(list_transform({p}, lambda x: x / list_sum({p}))) AS a,
                       unnest(list_transform({q}, lambda x: x / list_sum({q}))) AS b))"""

    def limit(parts: tuple[float, float, float], n: str) -> str:
        least, base, slope = parts
        return f"greatest({least}, {base} + {slope} / sqrt(greatest({n}, 1)::DOUBLE))"

    def sums(column: str, total: str, width: int) -> str:
        return "[" + ", ".join(
            f"sum(CASE WHEN ok THEN {column}[{i}] * {quality.SCALE} // {total} END)"
            for i in range(1, width + 1)) + "]"

    def add(column: str, width: int) -> str:
        return "[" + ", ".join(f"sum({column}[{i}])" for i in range(1, width + 1)) + "]"

    following = ", ".join(f"lead(w, {i}) OVER o" for i in range(1, quality.WINDOW))
    return f"""
WITH texts AS ({texts}),
{", ".join(layers)},
shaped AS (
  SELECT doc_id, t, ws, CASE WHEN lang IN ({codes}) THEN lang ELSE '{quality.OTHER}' END AS code,
    [{chars}, length({left[-1]})] AS chars,
    length({left[-2]}) - length({left[-1]}) AS symbols,
    CASE lang {lists} END AS listed
  FROM {source}),
counted AS (
  SELECT *, len(ws) AS n, length(t) AS m,
    list_transform(listed, lambda w: len(list_filter(ws, lambda x: x = w))) AS found
  FROM shaped),
hist AS (
  SELECT *, CASE WHEN listed IS NOT NULL THEN list_append(found, n - list_sum(found)) END AS common,
    m >= {quality.MIN_CHARS_JUDGED} AND n >= {quality.MIN_WORDS}
      AND 100 * symbols <= {quality.MAX_REFERENCE_SYMBOL_PERCENT} * m AS ok
  FROM counted),
sums AS (
  SELECT code, {sums("chars", "m", n_chars)} AS c, {sums("common", "n", n_common)} AS w
  FROM hist GROUP BY code),
refs AS (
  SELECT code, {add("c", n_chars)} AS c, {add("w", n_common)} AS w FROM (
    SELECT code, c, w FROM sums WHERE code <> '{quality.OTHER}'
    UNION ALL SELECT '{quality.OTHER}', c, w FROM sums) GROUP BY code),
spelled AS (
  SELECT doc_id, unnest(range(1, n + 1)) AS p, unnest(ws) AS w FROM hist),
windows AS (
  SELECT doc_id, p, concat_ws(' ', w, {following}) AS w FROM spelled
  WINDOW o AS (PARTITION BY doc_id ORDER BY p)
  QUALIFY lead(w, {quality.WINDOW - 1}) OVER o IS NOT NULL),
twice AS (
  SELECT doc_id, p FROM windows
  QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
reach AS (
  SELECT doc_id, sum(least({quality.WINDOW}, coalesce(nxt - p, {quality.WINDOW}))) AS k FROM (
    SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS nxt FROM twice)
  GROUP BY doc_id),
lines AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)),
    lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS ls FROM texts),
base AS (
  SELECT h.doc_id, n AS n_words, list_sum(list_transform(ws, lambda w: length(w))) AS wc, symbols,
    len(ls) - len(list_distinct(ls)) AS dup, coalesce(k, 0) AS k,
    n < {quality.MIN_WORDS} OR 100 * coalesce(k, 0) > {quality.MAX_REPEAT_PERCENT} * n AS failed,
    m, CASE WHEN m > 0 THEN round({js("chars", "c")}, 6) END AS cd,
    CASE WHEN n > 0 AND common IS NOT NULL
      THEN round({js("common", "w")}, 6) END AS wd
  FROM hist h JOIN lines USING (doc_id) LEFT JOIN reach USING (doc_id) LEFT JOIN refs USING (code))
SELECT doc_id, n_words, coalesce(wc, 0)::BIGINT AS word_chars, symbols AS n_symbols,
  dup AS n_dup_lines, k::BIGINT AS n_repeat_words, failed AS base_failed,
  NOT failed AND coalesce(cd, 0) <= {limit(quality.CHAR_LIMIT, "m")}
    AND coalesce(wd, 0) <= {limit(quality.WORD_LIMIT, "n_words")} AS kept,
  cd AS char_distance, wd AS word_distance
FROM base"""


ORACLES["op1_quality_rules"] = _quality()

# The level is the highest share per unit of weight at which the sources give the whole: every
# number of closed sources, taken in order of cap per weight, is tried. A document's place in its
# source's seeded order is known to Spark's hash only, so no SQL is given for what each one yields.
MIX_TARGETS = f"""
WITH sized AS (
  SELECT source, len(list_filter(regexp_split_to_array(coalesce(text, ''),
    '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS s FROM sized GROUP BY source),
weighed AS (
  SELECT source, s, {mixing.MAX_EPOCHS} * s AS cap,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sources),
tried AS (
  SELECT *, (sum(s) OVER () - coalesce(sum(cap) OVER before, 0))
      / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (
    ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT source, s AS source_size, least(cap, w * (SELECT max(level) FROM tried)) AS target
FROM weighed"""


def _substrings(window: int = substrings.WINDOW) -> str:
    return f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
places AS (SELECT r, ws, unnest(range(1, len(ws) - {window - 2})) AS i FROM docs WHERE len(ws) >= {window}),
windows AS MATERIALIZED (SELECT r, i, array_to_string(ws[i:i + {window - 1}], ' ') AS k FROM places),
twice AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT r, unnest(range(i, i + {window})) AS p
  FROM windows WHERE k IN (SELECT k FROM twice)),
spread AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM docs),
kept AS (
  SELECT r, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n
  FROM spread ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)"""


def _centroids(clusters: int = centroids.CLUSTERS, rounds: int = centroids.ROUNDS) -> str:
    def assigned(n: int) -> str:
        return f"""a{n} AS MATERIALIZED (
  SELECT r, c, d FROM (
    SELECT r, c, d, row_number() OVER (PARTITION BY r ORDER BY d, c) AS nth FROM (
      SELECT r, c, sum((x - y) * (x - y)) AS d FROM parts JOIN c{n} USING (i) GROUP BY r, c))
  WHERE nth = 1)"""

    def moved(n: int) -> str:
        return f"""c{n + 1} AS MATERIALIZED (
  SELECT c, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS y
  FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM parts JOIN a{n} USING (r) GROUP BY c, i)
  UNION ALL SELECT c, i, y FROM c{n} WHERE c NOT IN (SELECT c FROM a{n}))"""

    steps = ",\n".join(f"{assigned(n)},\n{moved(n)}" for n in range(rounds))
    dims = centroids.DIMS
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
    list_transform(embedding, lambda x: floor({centroids.SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = {dims}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
parts AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept),
first AS (
  SELECT row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || vec_id), v) - 1 AS c, v FROM kept),
c0 AS MATERIALIZED (
  SELECT c, unnest(v) AS y, generate_subscripts(v, 1) AS i FROM first WHERE c < {clusters}),
{steps},
{assigned(rounds)},
named AS (
  SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance,
  (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN named USING (c)"""


def _divergence() -> str:
    share = lambda n, total: (
        f"1 + ({divergence.SCALE}::HUGEINT * ({n} + {divergence.PRIOR})) // ({total} + {divergence.PRIOR} * v)")
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts
  FROM documents),
said AS (
  SELECT r, lang, source,
    translate(unnest(ts), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM docs),
kept AS MATERIALIZED (
  SELECT lang, term FROM said GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.MIN_DOCS}),
counts AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS n FROM said JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS MATERIALIZED (
  SELECT lang, source, coalesce(sum(n), 0) AS total, coalesce(any_value(v), 0) AS v
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN counts USING (lang, source)
  LEFT JOIN sizes USING (lang) GROUP BY lang, source),
shares AS MATERIALIZED (
  SELECT lang, source, term, coalesce(n, 0) AS n, {share("coalesce(n, 0)", "total")} AS p
  FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
langs AS (
  SELECT lang, term, {share("sum(n)", "any_value(t)")} AS q
  FROM counts JOIN (SELECT lang, sum(total) AS t, any_value(v) AS v FROM groups GROUP BY lang) USING (lang)
  GROUP BY lang, term, v),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(d, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS d
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
    GROUP BY x.lang, x.source, y.source) s
  ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
found AS (
  SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares JOIN langs USING (lang, term)
  WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, (row_number() OVER (
    PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
  FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}"""


ORACLES["op11_substring_dedup"] = _substrings()
ORACLES["op12_centroid_clusters"] = _centroids()
ORACLES["op13_source_divergence"] = _divergence()
