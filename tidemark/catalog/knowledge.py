"""Facts: from replies to one knowledge base and its context."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import inputs as I
from tidemark.catalog.registry import query
from tidemark.operators import corpus, facts
from tidemark.sources.files import table

DOT = lambda c: F.array_join(c, ".")


@query("flatten_kb", I.extend("""
SELECT doc_id AS seq, CAST(pos AS BIGINT) AS pos, path, kind, value FROM (
  SELECT doc_id, 0 AS pos, 'characters.' || src || '.gender' AS path, 'scalar' AS kind, json_extract_string(body, '$.characters.' || src || '.gender') AS value FROM r
  UNION ALL SELECT doc_id, 1, 'characters.' || src || '.titles_held', 'list', json_extract_string(body, '$.characters.' || src || '.titles_held[0]') FROM r
  UNION ALL SELECT doc_id, 2, 'characters.' || src || '.titles_held', 'list', json_extract_string(body, '$.characters.' || src || '.titles_held[1]') FROM r
  UNION ALL SELECT doc_id, 3, 'characters.' || src || '.aliases', 'list', json_extract_string(body, '$.characters.' || src || '.aliases') FROM r
  UNION ALL SELECT doc_id, 4, 'terminology.skills.w' || (doc_id % 7), 'scalar', json_extract_string(body, '$.terminology.skills.w' || (doc_id % 7)) FROM r
  UNION ALL SELECT doc_id, 5, 'gender_fixes', 'list', json_extract_string(body, '$.gender_fixes[0]') FROM r)""",
  {"r": "SELECT r.doc_id, r.body, d.source AS src FROM replies r JOIN documents d ON d.doc_id = r.doc_id WHERE r.doc_id % 4 <> 3"}, "replies"))
def flatten_kb(spark, folder):
    parsed = facts.parse_replies(I.replies(spark, folder)).withColumnRenamed("doc_id", "seq")
    f = facts.flatten_kb(parsed)
    return f.select("seq", "pos", DOT("path").alias("path"), "kind", "value")


@query("merge_scalars", I.sql("SELECT path, value, first_seq, first_pos, n_mentions FROM merged_scalars", "merged_scalars"))
def merge_scalars(spark, folder):
    return facts.merge_scalars(I.facts(spark, folder)).withColumn("path", DOT("path"))


@query("merge_lists", I.sql("SELECT path, value, seq, pos FROM merged_lists", "merged_lists"))
def merge_lists(spark, folder):
    return facts.merge_lists(I.facts(spark, folder)).withColumn("path", DOT("path"))


@query("merge_lists_distinct", I.sql("""SELECT path, value, min(seq * 10 + pos) // 10 AS seq, min(seq * 10 + pos) % 10 AS pos
  FROM facts WHERE kind = 'list' GROUP BY path, value""", "facts"))
def merge_lists_distinct(spark, folder):
    return facts.merge_lists(I.facts(spark, folder), distinct=True).withColumn("path", DOT("path"))


@query("merge_facts", I.sql("SELECT seq, pos, path, kind, value FROM merged", "merged"))
def merge_facts(spark, folder):
    return facts.merge_facts(I.facts(spark, folder)).withColumn("path", DOT("path"))


# Paths change kind here: user facts are a scalar in some partial results and a branch in others.
MIXED = """
SELECT event_id AS seq, 0 AS pos, CASE WHEN k % 4 = 0 THEN 'p' || user_id ELSE 'p' || user_id || '.' || event_type END AS path,
  CASE WHEN k % 4 = 1 THEN 'list' ELSE 'scalar' END AS kind, 'v' || k AS value FROM ev"""


@query("drop_overwritten", I.extend("""
SELECT seq, path, kind, value FROM (
  SELECT f.*, max(CASE WHEN kind = 'scalar' THEN seq END) OVER (PARTITION BY path) AS s,
    max(CASE WHEN kind = 'list' THEN seq END) OVER (PARTITION BY path) AS l,
    max(CASE WHEN path LIKE '%.%' THEN seq END) OVER (PARTITION BY split_part(path, '.', 1)) AS branch,
    max(CASE WHEN path NOT LIKE '%.%' THEN seq END) OVER (PARTITION BY split_part(path, '.', 1)) AS leaf FROM mixed f)
WHERE (kind = 'scalar' OR s IS NULL OR s <= seq) AND (kind = 'list' OR l IS NULL OR l <= seq)
  AND (path LIKE '%.%' OR branch IS NULL OR branch <= seq) AND (path NOT LIKE '%.%' OR leaf IS NULL OR leaf <= seq)""",
    {"mixed": MIXED}, "ev"))
def drop_overwritten(spark, folder):
    e = I.events(spark, folder)
    k, user = F.col("k"), F.concat(F.lit("p"), F.col("user_id").cast("string"))
    f = e.select(F.col("event_id").alias("seq"), F.lit(0).cast("bigint").alias("pos"),
                 F.when(k % 4 == 0, F.array(user)).otherwise(F.array(user, F.col("event_type"))).alias("path"),
                 F.when(k % 4 == 1, "list").otherwise("scalar").alias("kind"),
                 F.concat(F.lit("v"), k.cast("string")).alias("value"))
    return facts.drop_overwritten(f).select("seq", DOT("path").alias("path"), "kind", "value")


VOTES = """
SELECT path, arg_min(value, (-n, value)) AS value, CAST(max(n) AS BIGINT) AS n_votes, CAST(sum(n) AS BIGINT) AS n_mentions,
  count(*) AS n_values FROM (SELECT path, value, count(*) AS n FROM {src} GROUP BY path, value) GROUP BY path"""
SOURCE_LANG = "SELECT source AS path, lang AS value FROM documents"


def _source_lang(spark, folder):
    return table(spark, folder, "documents").select(
        F.array("source").alias("path"), F.col("lang").alias("value"))


@query("majority", I.extend("SELECT * FROM v", {"src": SOURCE_LANG, "v": VOTES.format(src="src")}))
def majority(spark, folder):
    return facts.majority(_source_lang(spark, folder)).withColumn("path", DOT("path"))


@query("discrepancies", I.extend("""SELECT path, path || ': kept ' || value || ' (' || n_votes || ' of ' || n_mentions || ')' AS note
  FROM v WHERE n_values > 1""", {"src": SOURCE_LANG, "v": VOTES.format(src="src")}))
def discrepancies(spark, folder):
    return facts.discrepancies(facts.majority(_source_lang(spark, folder))).withColumn("path", DOT("path"))


@query("kb_counts", I.sql("""
SELECT count(DISTINCT CASE WHEN path LIKE 'characters.%' THEN split_part(path, '.', 2) END) AS characters,
  count(CASE WHEN path LIKE 'terminology.%' THEN 1 END) AS terms FROM merged""", "merged"))
def kb_counts(spark, folder):
    return facts.kb_counts(facts.merge_facts(I.facts(spark, folder)))


@query("kb_chars", I.extend("""
SELECT CAST(2 + (SELECT sum(CASE WHEN path = 'relationships' THEN length(value) + 8 * len(json_keys(value)) + 5 ELSE length(value) + 2 END
    + CASE WHEN kind = 'list' THEN 2 * len(string_split(path, '.')) + 4 ELSE 0 END) FROM merged)
  + (SELECT sum(length(k) + 6 + 2 * d + CASE WHEN scalar THEN 0 ELSE 2 * d + 2 END) FROM nodes) AS BIGINT) AS kb_chars""", {"nodes": """
SELECT p, max(k) AS k, max(len(string_split(p, '.'))) AS d, bool_or(leaf AND kind = 'scalar') AS scalar FROM (
  SELECT list_aggregate(ps[1:i], 'string_agg', '.') AS p, ps[i] AS k, i = len(ps) AS leaf, kind
  FROM (SELECT DISTINCT string_split(path, '.') AS ps, kind FROM merged), LATERAL (SELECT unnest(range(1, len(ps) + 1)) AS i))
GROUP BY p"""}, "merged"))
def kb_chars(spark, folder):
    return facts.kb_chars(facts.merge_facts(I.facts(spark, folder)))


@query("synthesise", I.extend("""
SELECT m.seq, m.pos, m.path, m.kind, CASE WHEN m.kind = 'scalar' THEN v.value ELSE m.value END AS value
FROM merged m LEFT JOIN v ON v.path = m.path UNION ALL
SELECT m.seq + 2305843009213693952, m.pos, 'gender_fixes', 'list', v.path || ': kept ' || v.value || ' (' || n_votes || ' of ' || n_mentions || ')'
FROM v JOIN merged m ON m.path = v.path AND m.kind = 'scalar' WHERE n_values > 1""",
    {"src": "SELECT path, value FROM facts WHERE kind = 'scalar'", "v": VOTES.format(src="src")}, "merged"))
def synthesise(spark, folder):
    return facts.synthesise(I.facts(spark, folder), limit=2 ** 60).withColumn("path", DOT("path"))


@query("synthesise_large", I.sql("SELECT seq, pos, path, kind, value FROM merged", "merged"))
def synthesise_large(spark, folder):
    """Above the size nothing is voted on: the plain merge."""
    return facts.synthesise(I.facts(spark, folder), limit=10).withColumn("path", DOT("path"))


CONTEXT = {
    "lists": """SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq, pos) AS rn FROM merged WHERE kind = 'list'""",
    "people": """
SELECT 1 AS section, printf('%019d|%019d', born // 10, born % 10) AS ord, name || ': ' || coalesce(gender, 'unknown') || ' (unknown)'
  || CASE WHEN aliases IS NULL THEN '' ELSE ', aliases: ' || aliases END AS line
FROM (SELECT split_part(path, '.', 2) AS name, min(seq * 10 + pos) AS born,
  max(CASE WHEN path LIKE '%.gender' THEN value END) AS gender,
  string_agg(CASE WHEN path LIKE '%.aliases' THEN value END, ', ' ORDER BY seq, pos) AS aliases
  FROM merged WHERE path LIKE 'characters.%' GROUP BY 1)""",
    "terms": """
SELECT *, row_number() OVER (PARTITION BY cat ORDER BY seq, pos) AS rn, min(seq * 10 + pos) OVER (PARTITION BY cat) AS born
FROM (SELECT split_part(path, '.', 2) AS cat, split_part(path, '.', 3) AS w, value, seq, pos FROM merged WHERE path LIKE 'terminology.%')""",
    "lines": """
SELECT * FROM people UNION ALL
SELECT 2, printf('%019d|%019d', seq, pos), '  ' || json_extract_string(value, '$.from') || ' → ' || json_extract_string(value, '$.to')
  || ': "' || json_extract_string(value, '$.address_term') || '"' FROM lists WHERE path = 'relationships' AND rn <= 40 UNION ALL
SELECT DISTINCT 3, printf('%019d|', born), '  [' || upper(cat) || ']' FROM terms UNION ALL
SELECT 3, printf('%019d|%019d|%019d', born, seq, pos), '    ' || w || ' → ' || value FROM terms WHERE rn <= 20 UNION ALL
SELECT 4, printf('%019d|%019d', seq, pos), '  • ' || value FROM lists WHERE path = 'gender_fixes' AND rn <= 10 UNION ALL
SELECT 5, '', '--- HONORIFICS POLICY ---' || chr(10) || '  ' || value FROM merged WHERE path = 'honorifics_policy'""",
    "context": """
SELECT left('=== CHARACTER & GRAMMAR BIBLE ===' || chr(10) || chr(10) || string_agg(CASE section WHEN 1 THEN '--- CHARACTERS ---'
  WHEN 2 THEN chr(10) || '--- RELATIONSHIPS (how A addresses B) ---' WHEN 3 THEN chr(10) || '--- TERMINOLOGY ---'
  WHEN 4 THEN chr(10) || '--- KNOWN GENDER ERRORS TO WATCH ---' ELSE '' END || chr(10) || body, chr(10) ORDER BY section), {n}) AS context
FROM (SELECT section, string_agg(line, chr(10) ORDER BY ord) AS body FROM lines GROUP BY section)""",
}


def _context(n: int) -> dict[str, str]:
    return {**CONTEXT, "context": CONTEXT["context"].replace("{n}", str(n))}


@query("pack_context", I.extend("SELECT context FROM context", _context(3500), "merged"))
def pack_context(spark, folder):
    return facts.pack_context(facts.merge_facts(I.facts(spark, folder)), 3500)


@query("pack_context_whole", I.extend("SELECT context FROM context", _context(1_000_000), "merged"))
def pack_context_whole(spark, folder):
    return facts.pack_context(facts.merge_facts(I.facts(spark, folder)), 1_000_000)


@query("attach_context", I.extend("""
SELECT doc_id, chunk_no, md5((SELECT context FROM context) || chr(10) || chr(10) || '=== RAW CHAPTER TEXT (' || doc_id || ' [part ' || chunk_no || '/'
  || n_chunks || ']) ===' || chr(10) || chr(10) || text) AS digest FROM c""",
    {**_context(3500), "c": """SELECT doc_id, i + 1 AS chunk_no, n AS n_chunks, substr(text, CAST(i * 1800 + 1 AS BIGINT), 2000) AS text
  FROM (SELECT *, (length(text) + 1799) // 1800 AS n FROM documents), LATERAL (SELECT unnest(range(0, n)) AS i)"""}, "merged"))
def attach_context(spark, folder):
    context = facts.pack_context(facts.merge_facts(I.facts(spark, folder)), 3500)
    chunks = corpus.chunk_text(table(spark, folder, "documents").select("doc_id", "text"), 2000, 200)
    return corpus.attach_context(chunks, context, F.col("doc_id").cast("string")).select(
        "doc_id", "chunk_no", F.md5(F.col("prompt").cast("binary")).alias("digest"))
