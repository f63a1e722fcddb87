"""Text rules, chunks, incremental runs and volumes."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidemark.catalog import inputs as I
from tidemark.catalog.registry import query
from tidemark.functions import text as T
from tidemark.operators import audit, corpus, facts
from tidemark.operators.usage import INPUT_PRICE
from tidemark.sources.files import scan_files, table

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
TITLE = r"""list_aggregate(list_transform(regexp_extract_all(replace(stem, '_', ' '), '\p{L}+|\P{L}+'),
      lambda w: upper(left(w, 1)) || lower(substr(w, 2))), 'string_agg', '')"""
RUN_DATE = "2024-01-31"
WORK = "Collected Works"

CHUNKS = """
SELECT doc_id, i + 1 AS chunk_no, n AS n_chunks, i * {step} AS start, substr(text, CAST(i * {step} + 1 AS BIGINT), {size}) AS text
FROM (SELECT *, (length(text) + {step} - 1) // {step} AS n FROM {src}), LATERAL (SELECT unnest(range(0, n)) AS i)"""


def chunks_sql(src: str = "documents", size: int = 2000, overlap: int = 200) -> str:
    return CHUNKS.format(step=size - overlap, size=size, src=src)


@query("chunk_cost_by_source", I.extend("""
SELECT source, count(*) AS n_chunks, CAST(sum(length(text) // 4) AS BIGINT) AS tokens,
  round(CAST(sum(length(text) // 4) AS DOUBLE) / 1000000 * 5, 4) AS cost
FROM c GROUP BY source""", {"c": chunks_sql().replace("SELECT doc_id,", "SELECT doc_id, source,")}))
def chunk_cost_by_source(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "source", "text")
    return (corpus.chunk_text(d, 2000, 200).groupBy("source")
            .agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(T.est_tokens(F.col("text"))).alias("tokens"))
            .withColumn("cost", F.round(F.col("tokens") / 1_000_000 * INPUT_PRICE, 4)))


@query("scan_files", "SELECT 'documents.parquet' AS file_name, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents")
def scan(spark, folder):
    return (scan_files(spark, folder, "documents.parquet", "parquet").groupBy("file_name")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")))


@query("safe_filename", f"""SELECT page_id, trim(regexp_replace(url, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}\\s-]', '_', 'g'), {WS}) AS name FROM pages""")
def safe_filename(spark, folder):
    return table(spark, folder, "pages").select("page_id", T.safe_filename(F.col("url")).alias("name"))


@query("chapter_keys", I.sql("SELECT doc_id, vol_key, vol, chap, stem FROM chapters", "chapters"))
def chapter_keys(spark, folder):
    return I.chapters(spark, folder).select("doc_id", "vol_key", "vol", "chap", "stem")


@query("filter_volumes", I.sql("SELECT doc_id, file_name FROM chapters WHERE vol IN (3, 7, 11)", "chapters"))
def filter_volumes(spark, folder):
    return corpus.filter_volumes(I.chapters(spark, folder), [3, 7, 11]).select("doc_id", "file_name")


@query("chapters_sorted", I.sql("SELECT doc_id, file_name, vol, chap FROM chapters ORDER BY vol, chap, stem", "chapters"))
def chapters_sorted(spark, folder):
    return I.chapters(spark, folder).orderBy("vol", "chap", "stem").select("doc_id", "file_name", "vol", "chap")


@query("run_counts", f"""SELECT CASE WHEN length(trim(text, {WS})) >= 100 THEN 'pending' ELSE 'skipped' END AS status,
  count(*) AS n FROM documents GROUP BY 1""")
def run_counts(spark, folder):
    return corpus.run_counts(corpus.with_status(table(spark, folder, "documents").select("text")))


@query("volume_counts", I.sql("""SELECT vol_key, count(*) AS n_chapters, min(chap) AS first_chap, max(chap) AS last_chap
  FROM chapters GROUP BY vol_key""", "chapters"))
def volume_counts(spark, folder):
    return corpus.volume_counts(I.chapters(spark, folder))


# Replies around the text of each document: reasoning blocks and tags in different places.
@query("clean_reply", f"""
SELECT doc_id, length(x) AS n_chars, md5(x) AS digest FROM (
  SELECT doc_id, trim(CASE WHEN doc_id % 3 = 2 THEN text ELSE regexp_replace(text, 'thinking\n(?s:.*?)\n', '', 'g') END, {WS}) AS x
  FROM documents)""")
def clean_reply(spark, folder):
    d = table(spark, folder, "documents")
    wrap = lambda a, b: F.concat(F.lit(a), F.col("text"), F.lit(b))
    raw = (F.when(F.col("doc_id") % 3 == 0, wrap("<think>a\nb</think>x<cleaned_text>\n ", "\n</cleaned_text> tail"))
           .when(F.col("doc_id") % 3 == 1, wrap("<thought>q</thought>thinking\nsome\n", ""))
           .otherwise(wrap("  <think></think>", "\n\n")))
    x = T.clean_reply(raw)
    return d.select("doc_id", F.length(x).cast("bigint").alias("n_chars"), F.md5(x.cast("binary")).alias("digest"))


@query("extract_json", I.sql("""
SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN '{}' ELSE body END AS kb, doc_id % 4 = 3 AS failed
FROM replies""", "replies"))
def extract_json(spark, folder):
    return facts.parse_replies(I.replies(spark, folder)).select("doc_id", "kb", "failed")


@query("unfence", I.sql("""SELECT doc_id, regexp_replace(regexp_replace(raw, '```json\\s*', '', 'g'), '```\\s*', '', 'g') AS body FROM replies""", "replies"))
def unfence(spark, folder):
    return I.replies(spark, folder).select("doc_id", T.unfence(F.col("raw")).alias("body"))


@query("render_chapter", I.sql(f"""
SELECT doc_id, '# ' || title || chr(10) || chr(10) || '<p class="meta">' || upper(replace(vol_key, '_', ' '))
  || ' · Cleaned {RUN_DATE} · {WORK}</p>' || chr(10) || chr(10) || trim(body, {WS}) || chr(10) AS page FROM (
  SELECT doc_id, vol_key,
    {TITLE} AS title,
    regexp_replace(regexp_replace(regexp_replace(replace(text, '. ', '.' || chr(10) || ' ***' || chr(10)),
      '(?m)^\\s*[*\\-—–]{{2,}}\\s*$', chr(10) || '---' || chr(10), 'g'),
      '\n---\n', chr(10) || chr(10) || '---' || chr(10) || chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS body
  FROM chapters)""", "chapters"))
def render_chapter(spark, folder):
    c = I.chapters(spark, folder)
    body = F.replace(F.col("text"), F.lit(". "), F.lit(".\n ***\n"))
    page = T.render_chapter(T.title_from_stem(F.col("stem")), body, F.col("vol_key"), RUN_DATE, WORK)
    return c.select("doc_id", page.alias("page"))


@query("chunk_text", I.extend("SELECT doc_id, chunk_no, n_chunks, start, length(text) AS n_chars, md5(text) AS digest FROM c",
                              {"c": chunks_sql()}))
def chunk_text(spark, folder):
    c = corpus.chunk_text(table(spark, folder, "documents").select("doc_id", "text"), 2000, 200)
    return c.select("doc_id", "chunk_no", "n_chunks", "start", F.length("text").cast("bigint").alias("n_chars"),
                    F.md5(F.col("text").cast("binary")).alias("digest"))


@query("chunk_label", I.extend("SELECT doc_id, chunk_no, stem || ' [part ' || chunk_no || '/' || n_chunks || ']' AS label FROM c",
                               {"c": chunks_sql("chapters").replace("SELECT doc_id,", "SELECT doc_id, stem,")}, "chapters"))
def chunk_label(spark, folder):
    c = corpus.chunk_text(I.chapters(spark, folder).select("doc_id", "stem", "text"), 2000, 200)
    return c.select("doc_id", "chunk_no", corpus.chunk_label(F.col("stem")).alias("label"))


@query("chunk_budget", """
SELECT doc_id, CASE WHEN tight THEN least(n, 16000) ELSE n END AS used_chars,
  64000 - (CASE WHEN tight THEN least(n, 16000) ELSE n END + 1000) AS max_text
FROM (SELECT doc_id, 3 * length(text) AS n, 64000 - (3 * length(text) + 1000) < 15000 AS tight FROM documents)""")
def chunk_budget(spark, folder):
    used, left = T.chunk_limit(F.repeat("text", F.lit(3)))
    return table(spark, folder, "documents").select(
        "doc_id", F.length(used).cast("bigint").alias("used_chars"), left.cast("bigint").alias("max_text"))


@query("est_tokens", "SELECT lang, CAST(sum((length(text) + length(source)) // 4) AS BIGINT) AS tokens FROM documents GROUP BY lang")
def est_tokens(spark, folder):
    d = table(spark, folder, "documents")
    return d.groupBy("lang").agg(F.sum(T.est_tokens(F.col("text"), F.col("source"))).alias("tokens"))


@query("qa_gate", "SELECT doc_id, (3500 + length(text) + 2 * 4 * length(text)) // 4 <= 32000 AS qa FROM documents")
def qa_gate(spark, folder):
    ctx = F.repeat(F.lit("x"), F.lit(3500))
    return table(spark, folder, "documents").select(
        "doc_id", T.qa_fits(ctx, F.col("text"), F.repeat("text", F.lit(4))).alias("qa"))


@query("overflow_split", """
SELECT doc_id, CASE WHEN length(text) > 4000 THEN left(text, 1000) || '...' || chr(10) || chr(10)
  || '📄 **Full diagnostic report attached below.**' ELSE text END AS shown,
  CASE WHEN length(text) > 4000 THEN length(text) END AS attached_chars FROM documents""")
def overflow_split(spark, folder):
    t = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id", T.overflow_view(t).alias("shown"), F.length(T.overflow_attachment(t)).cast("bigint").alias("attached_chars"))


@query("stitch_chunks", I.extend("""
SELECT doc_id, CAST(part AS BIGINT) AS part_no, length(t) AS n_chars, md5(t) AS digest,
  CASE WHEN bool_or(t <> '') OVER (PARTITION BY doc_id) THEN 'processed' ELSE 'error' END AS status FROM (
  SELECT doc_id, (chunk_no - 1) // 1000 AS part, string_agg(nullif(CASE WHEN chunk_no > 1 THEN substr(text, 201) ELSE text END, ''),
    chr(10) || chr(10) ORDER BY chunk_no) AS t FROM c GROUP BY doc_id, part)""", {"c": chunks_sql()}))
def stitch_chunks(spark, folder):
    c = corpus.chunk_text(table(spark, folder, "documents").select("doc_id", "text"), 2000, 200)
    s = corpus.stitch_chunks(c, "doc_id", drop_overlap=200)
    return s.select("doc_id", F.col("part_no").cast("bigint").alias("part_no"), F.length("text").cast("bigint").alias("n_chars"),
                    F.md5(F.col("text").cast("binary")).alias("digest"), "status")


@query("assemble_pages", """
SELECT doc_id, CAST(i // 10000 AS BIGINT) AS part_no, count(*) AS n_pages, length(string_agg(p, chr(10) ORDER BY i)) AS n_chars,
  md5(string_agg(p, chr(10) ORDER BY i)) AS digest
FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents), LATERAL (SELECT unnest(ps) AS p, unnest(range(len(ps))) AS i)
GROUP BY doc_id, i // 10000""")
def assemble_pages(spark, folder):
    lines = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page_no", "text"))
    return corpus.assemble_pages(lines).select(
        "doc_id", "part_no", "n_pages", F.length("text").cast("bigint").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("chapter_position", I.sql("""SELECT doc_id, vol_key, row_number() OVER (PARTITION BY vol_key ORDER BY vol, chap, stem) - 1
  AS chapter_pos FROM chapters""", "chapters"))
def chapter_position(spark, folder):
    return corpus.chapter_position(I.chapters(spark, folder).select("doc_id", "vol_key", "vol", "chap", "stem")).select(
        "doc_id", "vol_key", "chapter_pos")


@query("assemble_volume", I.sql("""
SELECT vol_key, part_no, count(*) AS n_chapters, length(any_value(lead) || d) AS n_chars, md5(any_value(lead) || d) AS digest FROM (
  SELECT vol_key, part_no, CASE WHEN part_no > 0 THEN chr(10) || chr(10) || '<div style=''page-break-before: always;''></div>' || chr(10) || chr(10)
    ELSE '' END AS lead, string_agg(text, chr(10) || chr(10) || chr(10) || chr(10)
    || '<div style=''page-break-before: always;''></div>' || chr(10) || chr(10) ORDER BY vol, chap, stem) AS d, count(*) AS n
  FROM (SELECT *, (row_number() OVER (PARTITION BY vol_key ORDER BY vol, chap, stem) - 1) // 1000 AS part_no FROM chapters)
  GROUP BY vol_key, part_no) GROUP BY vol_key, part_no, d""", "chapters").replace("count(*) AS n_chapters", "max(n) AS n_chapters"))
def assemble_volume(spark, folder):
    v = corpus.assemble_volume(I.chapters(spark, folder).select("vol_key", "vol", "chap", "stem", "text"))
    return v.select("vol_key", "part_no", "n_chapters", F.length("document").cast("bigint").alias("n_chars"),
                    F.md5(F.col("document").cast("binary")).alias("digest"))


# Labelled documents stand for what an earlier run has done.
@query("new_keys", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def new_keys(spark, folder):
    return corpus.new_keys(table(spark, folder, "documents").select("doc_id"), table(spark, folder, "labels"), "doc_id")


@query("carry_over", """
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'todo' ELSE 'skipped' END AS status
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def carry_over(spark, folder):
    work = table(spark, folder, "documents").select("doc_id")
    todo, done = corpus.carry_over(work, table(spark, folder, "labels").select("doc_id"), "doc_id")
    return todo.withColumn("status", F.lit("todo")).unionByName(done.withColumn("status", F.lit("skipped")))


@query("resolve_chapters", I.sql("""SELECT stem, vol, chap FROM chapters WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
  ORDER BY vol, chap""", "chapters"))
def resolve_chapters(spark, folder):
    done = table(spark, folder, "labels").filter("quality = 1").select("doc_id")
    return corpus.resolve_chapters(I.chapters(spark, folder), done, "doc_id").select("stem", "vol", "chap").orderBy("vol", "chap")


def _structure(side: str) -> str:
    lines = f"string_split({side}, chr(10))"
    count = lambda pattern: f"len(list_filter({lines}, lambda x: regexp_matches(x, '{pattern}')))"
    return ", ".join(f"{sql} AS {name}" for sql, name in (
        (f"len(list_filter({lines}, lambda x: x <> ''))", "paragraphs"), (count(r"^[ \t]*(\*{3,}|-{3,})[ \t]*$"), "scene_breaks"),
        (count("^#{1,6} "), "headings"), (f"length({side})", "chars")))


@query("structure_audit", f"""
SELECT doc_id, r.paragraphs AS raw_paragraphs, r.scene_breaks AS raw_scene_breaks, r.headings AS raw_headings, r.chars AS raw_chars,
  c.paragraphs AS clean_paragraphs, c.scene_breaks AS clean_scene_breaks, c.headings AS clean_headings, c.chars AS clean_chars,
  c.paragraphs >= r.paragraphs AND c.scene_breaks >= r.scene_breaks AND c.headings >= r.headings AS kept,
  round(c.chars / r.chars, 4) AS length_ratio
FROM (SELECT doc_id, {_structure("raw")} FROM audited) r JOIN (SELECT doc_id, {_structure("cleaned")} FROM audited) c USING (doc_id)""".replace(
    "FROM audited", """FROM (SELECT doc_id, raw, CASE WHEN doc_id % 3 = 0 THEN replace(raw, '# ', '') ELSE replace(raw, '. ', '.' || chr(10) || '***' || chr(10)) END AS cleaned
  FROM (SELECT doc_id, '# ' || lang || chr(10) || '---' || chr(10) || text AS raw FROM documents))"""))
def structure_audit(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.concat(F.lit("# "), "lang", F.lit("\n---\n"), "text").alias("text"))
    edited = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("# "), F.lit(""))).otherwise(F.replace("text", F.lit(". "), F.lit(".\n***\n")))
    return audit.structure_audit(corpus.raw_and_clean(d, d.withColumn("text", edited), "doc_id"))


def _edit(text: str, temperature: float) -> str:
    return re.sub("e", "E", text) if len(text) > 500 or temperature > 0.5 else ""


@query("batch_transform", """SELECT doc_id, replace(text, 'e', 'E') AS result, CAST(CASE WHEN length(text) > 500 THEN 1 ELSE 2 END AS BIGINT) AS attempts
  FROM documents""")
def batch_transform(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "text")
    return corpus.batch_transform(d, _edit).select("doc_id", "result", "attempts")


# Terms are the words that open a benchmark passage, written in capitals in the canonical form.
@query("apply_glossary", r"""
WITH g AS (SELECT map_from_entries(list({'k': term, 'v': upper(term)})) AS m FROM (
  SELECT DISTINCT lower(regexp_extract(text, '^[A-Za-z]+')) AS term FROM benchmark) WHERE term <> '')
SELECT doc_id, md5(list_aggregate(list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'),
  lambda w: coalesce(element_at(m, w)[1], w)), 'string_agg', '')) AS digest FROM documents, g""")
def apply_glossary(spark, folder):
    term = F.lower(F.regexp_extract("text", "^[A-Za-z]+", 0))
    glossary = (table(spark, folder, "benchmark").select(term.alias("term")).filter("term <> ''").distinct()
                .withColumn("canonical", F.upper("term")))
    d = table(spark, folder, "documents").select("doc_id", "text")
    return audit.apply_glossary(d, glossary).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("pronoun_audit", r"""
WITH g AS (SELECT lang AS name, CASE WHEN count(*) % 2 = 0 THEN 'male' ELSE 'female' END AS gender FROM documents GROUP BY lang),
s AS (SELECT doc_id, i, regexp_extract_all(t, '\p{L}+') AS ws FROM (SELECT doc_id, string_split_regex(text || '. She met ' || lang || ' and HIS cat. He saw him.', '[.!?\n]+') AS ts FROM documents),
  LATERAL (SELECT unnest(ts) AS t, unnest(range(len(ts))) AS i)),
w AS (SELECT doc_id, i, unnest(ws) AS w FROM s),
n AS (SELECT doc_id, i, min(w) AS name FROM w JOIN g ON g.name = w GROUP BY doc_id, i HAVING min(w) = max(w)),
p AS (SELECT doc_id, i, lower(w) AS pronoun FROM w WHERE lower(w) IN ('he', 'him', 'his', 'himself', 'she', 'her', 'hers', 'herself'))
SELECT doc_id, pronoun, n.name, count(*) AS n, gender FROM p JOIN n USING (doc_id, i) JOIN g ON g.name = n.name
WHERE gender <> CASE WHEN pronoun LIKE 'h%' AND pronoun NOT LIKE 'her%' THEN 'male' ELSE 'female' END GROUP BY doc_id, pronoun, n.name, gender""")
def pronoun_audit(spark, folder):
    d = table(spark, folder, "documents")
    said = F.concat("text", F.lit(". She met "), "lang", F.lit(" and HIS cat. He saw him."))
    genders = d.groupBy(F.col("lang").alias("name")).agg(F.when(F.count(F.lit(1)) % 2 == 0, "male").otherwise("female").alias("gender"))
    mentions = audit.pronoun_mentions(d.select("doc_id", said.alias("text")), genders, "doc_id")
    return audit.pronoun_audit(mentions, genders).select("doc_id", "pronoun", "name", "n", "gender")


@query("gender_audit", """
WITH m AS (SELECT doc_id, 'Mr' AS title, lang AS name, CAST(2 AS BIGINT) AS n FROM documents UNION ALL SELECT doc_id, 'Ms', lang, 1 FROM documents),
g AS (SELECT lang AS name, CASE WHEN count(*) % 2 = 0 THEN 'male' ELSE 'female' END AS gender FROM documents GROUP BY lang)
SELECT doc_id, title, m.name, n, gender FROM m JOIN g ON g.name = m.name
WHERE gender <> CASE title WHEN 'Mr' THEN 'male' ELSE 'female' END""")
def gender_audit(spark, folder):
    d = table(spark, folder, "documents")
    said = F.concat("text", F.lit(" Mr. "), "lang", F.lit(" met Ms "), "lang", F.lit(", Mr "), "lang", F.lit("."))
    genders = d.groupBy(F.col("lang").alias("name")).agg(
        F.when(F.count(F.lit(1)) % 2 == 0, "male").otherwise("female").alias("gender"))
    mentions = audit.title_mentions(d.select("doc_id", said.alias("text")), "doc_id")
    return audit.gender_audit(mentions, genders).select("doc_id", "title", "name", "n", "gender")
