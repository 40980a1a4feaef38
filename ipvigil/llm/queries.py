"""The dealt operators as registered queries with production parameters, and the SQL of those that SQL can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ipvigil.llm import (
    automata, conversations, decontaminate, divergence, licences, lines, phrases, pieces, quality, simhash, substrings, toxicity, warc,
)
from ipvigil.llm.frames import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Score every document; see `toxicity`."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"), ~toxicity.held_out())
    scored = toxicity.score(docs, model, ["doc_id"])
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", predicted.alias("predicted"))


@query
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines, deleted lines and the digest of what is left, per document; see `lines`."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    made = lines.rebuilt(docs, lines.repeated_windows(docs), ["doc_id"])
    return made.select(
        "doc_id", F.col("line_count").alias("n_lines"), F.col("line_removed").alias("n_removed"),
        F.col("line_sha256").alias("kept_sha256"),
    )


CHECKS["op1_line_dedup"] = f"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
compared AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM split WHERE trim(line, ' ') <> ''),
joined AS (
  SELECT doc_id, k, string_agg(trim(line, ' '), chr(10)) OVER w AS content, count(*) OVER w AS n
  FROM compared WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND {lines.RUN - 1} FOLLOWING)),
firsts AS (
  SELECT doc_id, k, row_number() OVER (PARTITION BY content ORDER BY doc_id, k) AS nth FROM joined WHERE n = {lines.RUN}),
gone AS (
  SELECT DISTINCT c.doc_id, c.i FROM compared c JOIN firsts f
  ON f.doc_id = c.doc_id AND f.nth > 1 AND c.k BETWEEN f.k AND f.k + {lines.RUN - 1})
SELECT s.doc_id, CAST(count(*) FILTER (trim(s.line, ' ') <> '') AS BIGINT) AS n_lines, CAST(count(g.i) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(s.line, chr(10) ORDER BY s.i) FILTER (g.i IS NULL), '')) AS kept_sha256
FROM split s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.i = s.i
GROUP BY s.doc_id
"""


@query
def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document; see `simhash`."""
    found = simhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows found in every document; see `decontaminate`."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    made = decontaminate.matched(docs, table(spark, folder, "benchmark"), ["doc_id"])
    hit = F.aggregate(
        F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), F.lit(0).cast("long"),
        lambda total, i: total + F.get("spans", i + 1) - F.get("spans", i),
    )
    return made.select(
        "doc_id", "n_words", F.when(F.size("spans") > 0, hit).otherwise(0).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"), F.col("longest").alias("longest_match"),
    )


_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""
CHECKS["op7_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item, least(len(w), {decontaminate.WINDOW}) AS n, array_to_string(w[k:k + {decontaminate.WINDOW - 1}], ' ') AS content, k
  FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - {decontaminate.WINDOW - 1}, 1))) AS k FROM b WHERE len(w) > 0)),
distinct_windows AS (SELECT DISTINCT n, content FROM iw),
dw AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS content
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k
        FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hits AS (SELECT dw.* FROM dw JOIN distinct_windows USING (n, content)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT h.doc_id, iw.item FROM hits h JOIN iw USING (n, content)) GROUP BY doc_id),
same AS (
  SELECT DISTINCT h.doc_id, iw.item, h.k AS p, iw.k - h.k AS diagonal, h.n FROM hits h JOIN iw USING (n, content)),
runs AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item, diagonal ORDER BY p) AS run FROM same),
longest AS (
  SELECT doc_id, max(size) AS longest_match
  FROM (SELECT doc_id, item, diagonal, run, max(n) + count(*) - 1 AS size FROM runs GROUP BY ALL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated, CAST(coalesce(longest_match, 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""


@query
def op6_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document, their digest, and whether decoding gives the text back; see `pieces`."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    made = pieces.encoded(docs, pieces.model_bytes(), ["doc_id"])
    joined = F.sha2(F.array_join("ids", " "), 256)
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), joined.alias("ids_sha256"), "round_trip")


@query
def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Archive every page and read the archives back; see `warc`."""
    return warc.archived(table(spark, folder, "pages"))


CHECKS["op5_warc"] = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {warc.LEAST} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to, true AS intact
FROM p LEFT JOIN f USING (payload_digest)
"""


@query
def op3_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint of every document and of its edited text; see `phrases`."""
    return phrases.with_next(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op4_licences(spark: SparkSession, folder: str) -> DataFrame:
    """License notices in every document; see `licences`."""
    made = licences.scanned(table(spark, folder, "documents").select("doc_id", "text"), ["doc_id"])
    return made.select(
        "doc_id", F.size("licences").cast("long").alias("n_licences"), F.array_join("licences.name", ",").alias("names"),
        F.coalesce(F.array_max("licences.containment"), F.lit(0.0)).alias("containment"),
    )


@query
def op2_substrings(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated 100-byte strings removed from every document; see `substrings`."""
    return substrings.deduplicated(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op9_automata(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated 13-word windows removed from every document; see `automata`."""
    return automata.deduplicated(table(spark, folder, "documents").select("doc_id", "text"))


CHECKS["op9_automata"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, k, array_to_string(w[k:k + {automata.LENGTH - 1}], ' ') AS content
  FROM (SELECT *, unnest(generate_series(1, len(w) - {automata.LENGTH - 1})) AS k FROM d WHERE len(w) >= {automata.LENGTH})),
firsts AS (SELECT content, min(doc_id) AS first FROM windows GROUP BY content),
gone AS (
  SELECT DISTINCT doc_id, p FROM (
    SELECT doc_id, unnest(generate_series(k, k + {automata.LENGTH - 1})) AS p FROM windows JOIN firsts USING (content) WHERE doc_id > first)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (
  SELECT doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY w.p) FILTER (g.p IS NULL) AS kept
  FROM words w LEFT JOIN gone g USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

CHECKS["op2_substrings"] = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
windows AS (
  SELECT doc_id, k, substr(h, 2 * k - 1, {2 * substrings.LENGTH}) AS content
  FROM (SELECT *, unnest(generate_series(1, n - {substrings.LENGTH - 1})) AS k FROM d WHERE n >= {substrings.LENGTH})),
repeated AS (
  SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY content ORDER BY doc_id, k) AS nth FROM windows) WHERE nth > 1),
breaks AS (
  SELECT doc_id, k, k > coalesce(lag(k) OVER (PARTITION BY doc_id ORDER BY k) + {substrings.LENGTH}, 0) AS starts FROM repeated),
runs AS (
  SELECT doc_id, min(k) AS a, max(k) + {substrings.LENGTH} AS b
  FROM (SELECT doc_id, k, count(*) FILTER (starts) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM breaks) GROUP BY doc_id, run),
pieces AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS before,
    row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) = 1 AS last FROM runs),
kept AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
    string_agg(substr(h, 2 * before - 1, 2 * (a - before)), '' ORDER BY a) || max(CASE WHEN last THEN substr(h, 2 * b - 1) ELSE '' END) AS kept
  FROM pieces JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(from_hex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query
def op12_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, base rules and the verdict on every document; see `quality`."""
    return quality.judged(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"), ["doc_id"])


#: CRC-32 of the UTF-8 bytes of a word, byte by byte with a table of 256 values that eight shifts each make.
_CRC_TABLE = """SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, i:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) x(n)"""


def crc_sql(column: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text column, where `t` is the table."""
    data = f"list_transform(range(strlen({column})), lambda i: CAST('0x' || substr(hex(encode({column})), CAST(2 * i + 1 AS INT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


CHECKS["op12_quality"] = f"""
WITH crc AS ({_CRC_TABLE}),
d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t0,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
windows AS (SELECT r, k, array_to_string(w[k:k + {quality.WINDOW - 1}], ' ') AS content
  FROM (SELECT *, unnest(generate_series(1, len(w) - {quality.WINDOW - 1})) AS k FROM d WHERE len(w) >= {quality.WINDOW})),
twice AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY r, content) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(k, k + {quality.WINDOW - 1})) AS p FROM twice) GROUP BY r),
lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n
  FROM (SELECT r, unnest(string_split(t0, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
base AS (
  SELECT d.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t0, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)),
judged AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.REPEATED} * n_words AS base_failed FROM base),
grams AS (
  SELECT r, word AS g FROM words
  UNION ALL SELECT r, word || ' ' || lead(word) OVER (PARTITION BY r ORDER BY p) FROM words),
buckets AS (SELECT g, {crc_sql("g")} % {quality.BUCKETS} AS bucket FROM (SELECT DISTINCT g FROM grams WHERE g IS NOT NULL), crc),
trusted AS (
  SELECT doc_id FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL)
  ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT {quality.TRUSTED}),
marked AS (SELECT r, bucket, doc_id IN (FROM trusted) AS good FROM grams JOIN buckets USING (g) JOIN d USING (r)),
counts AS (
  SELECT b AS bucket, CAST(count(m.bucket) AS DOUBLE) AS n, CAST(count(*) FILTER (m.good) AS DOUBLE) AS good
  FROM range({quality.BUCKETS}) x(b) LEFT JOIN marked m ON m.bucket = b GROUP BY b),
weights AS (
  SELECT bucket, CAST(floor(1000000 * ln(((good + 1) / (sum(good) OVER () + {quality.BUCKETS}))
    / ((n + 1) / (sum(n) OVER () + {quality.BUCKETS})))) AS BIGINT) AS weight FROM counts),
scores AS (
  SELECT r, CAST(floor(CAST(sum(weight) AS DOUBLE) / (1000 * count(*))) AS BIGINT) AS score FROM marked JOIN weights USING (bucket) GROUP BY r),
ranked AS (
  SELECT score, row_number() OVER (ORDER BY score) AS nth, count(*) OVER () AS total
  FROM judged JOIN scores USING (r) WHERE NOT base_failed AND doc_id IN (FROM trusted))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score,
  NOT base_failed AND coalesce(score >= (SELECT min(score) FROM ranked WHERE nth > floor(total / {quality.TAIL})), true) AS kept
FROM judged LEFT JOIN scores USING (r)
"""


@query
def op13_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of every damaged conversation, its cheapest repair and the digest of what that leaves; see `conversations`."""
    return conversations.reported(conversations.damaged(table(spark, folder, "conversations")))


def _steps(label: str, moves: list[tuple[int, str, str, str, str]]) -> str:
    """A struct of the four states' labels: for each the least of its own and of those that lead to it."""
    fields = []
    for state in range(4):
        ways = [f"{label}.s{a}" if not edit else f"struct_pack(c := {label}.s{a}.c + {cost}, a := {label}.s{a}.a || '{edit}', t := {label}.s{a}.t || {text})"
                for a, b, edit, cost, text in moves if b == state]
        fields.append(f"s{state} := list_min([{', '.join(ways)}])" if ways else f"s{state} := {label}.s{state}")
    return f"struct_pack(r := x.r, {', '.join(fields)})"


def _repair_sql() -> str:
    """One row's step from labels `x` (of the rows before) and `y.r` (the row): inserts, then the row's own edit."""
    stay = [(s, s, "", "", "") for s in range(4)]
    said = "chr(10) || "
    insert = [(a, b, "I", str(conversations.INSERT), f"{said}'{role}:'") for a, (role, b) in conversations.NEXT.items()]
    grown = "x"
    for _ in range(3):
        grown = f"list_transform([{grown}], lambda x: {_steps('x', stay + insert)})[1]"
    never, extra = "1000000000", f"CASE WHEN y.r.cut THEN {conversations.TRUNCATED} ELSE 0 END"
    edits = [(s, s, "D", str(conversations.DELETE), "''") for s in range(4)]
    edits += [(a, b, "R", f"CASE WHEN y.r.bad THEN {never} ELSE {conversations.REROLE} + {extra} END", f"{said}'{role}:' || y.r.text") for a, (role, b) in conversations.NEXT.items()]
    edits += [(a, b, "K", f"CASE WHEN y.r.bad OR y.r.role[1] <> '{initial}' THEN {never} ELSE {extra} END", f"{said}y.r.role || ':' || y.r.text")
              for (a, initial), b in conversations.KEPT.items()]
    return f"list_transform([{grown}], lambda x: {_steps('x', edits)})[1]"


def _label(cost: str) -> str:
    return f"struct_pack(c := {cost}, a := '', t := '')"


_START = f"s0 := {_label('0')}, " + ", ".join(f"s{s} := {_label('1000000000')}" for s in (1, 2, 3))
CHECKS["op13_conversations"] = f"""
WITH crc AS ({_CRC_TABLE}),
keyed AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
cases AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("k")} % 20 AS n FROM keyed, crc),
rows AS (
  SELECT conv_id, turn, CASE WHEN n = 4 THEN 'user' ELSE role END AS role,
    CASE n WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM cases, range(CASE n WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS i FROM rows),
marked AS (
  SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT blank AND NOT again) AS truncated,
    count(*) FILTER (i > 1 AND before[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal,
    list(struct_pack(r := struct_pack(role := role, text := text, bad := blank OR again, cut := cut), {_START}) ORDER BY i) AS listed
  FROM marked GROUP BY conv_id),
solved AS (
  SELECT *, list_reduce(list_prepend(struct_pack(r := listed[1].r, {_START}), listed), lambda x, y: {_repair_sql()}) AS x FROM counted),
ended AS (
  SELECT *, list_min([x.s0, struct_pack(c := x.s2.c + {conversations.INSERT}, a := x.s2.a || 'I', t := x.s2.t || chr(10) || 'assistant:'), x.s3]) AS best FROM solved)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query
def op11_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Distances between the sources of each lang, and the terms that stand out in each source; see `divergence`."""
    return divergence.audit(table(spark, folder, "documents").select("text", "lang", "source"))


CHECKS["op11_divergence"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
words AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT r) >= {divergence.LEAST}),
groups AS (SELECT DISTINCT lang, source FROM d),
found AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN found f USING (lang, source, term)),
shares AS (
  SELECT *, 1 + CAST({divergence.SCALE} AS HUGEINT) * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM dense),
langs AS (
  SELECT lang, term, 1 + CAST({divergence.SCALE} AS HUGEINT) * (n + 1) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM dense GROUP BY ALL)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM shares JOIN langs USING (lang, term) WHERE n > 0 AND p > q),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS nth FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(nth AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR nth <= {divergence.TOP}
"""
