"""Words grouped with the commoner words they differ from by one letter, by PartEnum signatures."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

PARTS = 4
LEAST_LETTERS, LEAST_TIMES = 6, 5
RATIO = 5
SLIP = 199


def corpus_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", letters: int = LEAST_LETTERS,
                 times: int = LEAST_TIMES, slip: int = SLIP) -> DataFrame:
    """``word``, ``n`` (occurrences over all documents, at least ``times``) of words of at least ``letters`` code points.

    Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case.  Where ``slip`` divides the
    crc32 of ``<doc_id>:<run>`` the run loses the code point at that number modulo its length, a slip of the pen that
    every rerun makes alike.  A missing id counts as an empty one, a missing or empty text has no words, repeated rows
    count each, and an empty table gives no rows.  Whole texts are read; other columns are not.
    """
    # Runs only get shorter by a slip, so shorter ones need not leave the text.
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"), F.explode(
        F.expr(rf"regexp_extract_all(`{text}`, '[A-Za-z\\u00C0-\\u00FF]{{{int(letters)},}}', 0)")).alias("run"))
    lower = runs.select("d", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    drawn = lower.select("run", F.crc32(F.concat("d", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = drawn.select(F.when(F.col("h") % slip == 0, slipped).otherwise(F.col("run")).alias("word"))
    return (words.filter(F.length("word") >= letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= times))


def signature_keys(word: str, parts: int = PARTS) -> list[tuple[int, bool]]:
    """(key, whether the word is the longer one there) of every signature of a word.

    The letters of a word are a binary vector: its k-th "e" is one dimension.  One inserted, deleted or replaced letter
    moves at most two dimensions.  The dimensions are dealt into ``parts`` parts by their hash; two words that are at
    most two apart agree on all but two parts, so one of the choices of ``parts`` - 2 parts is equal in both.  With m
    letters in the shorter word, the first or the last m // 2 letters of both are equal as well, as the changed letter
    lies on one side; a signature is a choice of parts, that half and m, so no near pair is without a common one.
    """
    dealt: list[list[int]] = [[] for _ in range(parts)]
    seen: Counter[str] = Counter()
    for letter in word:
        seen[letter] += 1
        code = xxhash.xxh3_64_intdigest(f"{letter}{seen[letter]}")
        dealt[code % parts].append(code)
    sums = [sum(p) & 0xFFFFFFFFFFFFFFFF for p in dealt]  # equal sets have equal sums; verifying sorts out the others
    size = len(word)
    found = []
    for m in (size, size - 1):
        half = m // 2
        for side, piece in enumerate((word[:half], word[size - half:])):
            for chosen in itertools.combinations(range(parts), parts - 2):
                name = f"{m} {side} {piece} {chosen} {[sums[c] for c in chosen]}"
                found.append((xxhash.xxh3_64_intdigest(name) - (1 << 63), m < size))
    return found


def _signed(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2_000):
            words = batch.column(0).slice(at, 2_000).to_pylist()
            rows = [(w, key, longer) for w in words for key, longer in signature_keys(w, parts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows, strict=True), (pa.string(), pa.int64(), pa.bool_()), strict=True)], ["word", "key", "longer"])


def near_pairs(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """``a``, ``b`` for all words that differ by exactly one inserted, deleted or replaced code point, each pair both ways.

    Words meet where a signature is equal and are then compared whole.  The join deals keys, not words, and a hot key
    is split by Spark's skew handling as rows of one side are independent of each other.
    """
    signed = words.select("word").mapInArrow(lambda batches: _signed(batches, parts), "word string, key bigint, longer boolean")
    left = signed.filter(~F.col("longer")).select("key", F.col("word").alias("a"))
    right = signed.select("key", F.col("word").alias("b"), "longer")
    met = left.join(right, "key").filter((F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    pairs = met.select("a", "b").distinct()
    return pairs.union(pairs.select("b", "a"))


def follow(forms: DataFrame) -> DataFrame:
    """``word``, ``root``: where the forms (``word``, ``form``) lead in the end, for words with a form.

    Each round doubles the steps a row has gone, and the counts grow by a factor along a chain, so few rounds are needed.
    """
    ways = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        further = cut_lineage(ways.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        ways = further.drop("_moved")
        if further.filter("_moved").isEmpty():
            return ways


def spelling_groups(words: DataFrame, ratio: int = RATIO, parts: int = PARTS) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root`` for every row of ``words`` (``word``, ``n``).

    The form of a word is its near word of largest ``n`` (ties: the smallest in code-point order) if that is at least
    ``ratio`` times its own, else null; the root is reached by following forms, and is the word itself without one.
    Words must be distinct and not null; rows with a null word or count are left out; other columns are not read.
    An empty table gives no rows.  Nothing is capped: every near word counts.
    """
    words = cut_lineage(words.select("word", "n").filter("word is not null and n is not null"))
    counted = near_pairs(words, parts).join(words.select(F.col("word").alias("b"), F.col("n").alias("_m")), "b")
    best = counted.groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("_m")).alias("m"), F.col("b").alias("word"))).alias("_best"))
    fits = -F.col("_best.m") >= F.col("n") * ratio
    found = cut_lineage(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(fits, F.col("_best.word")).alias("form"), F.when(fits, -F.col("_best.m")).cast("bigint").alias("form_n")))
    roots = follow(found.filter("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return spelling_groups(corpus_words(spark.read.parquet(f"{sf_dir}/documents.parquet")))


#: crc32 by its table of 256 remainders; near words by leaving out one letter.
QUERY_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (
  SELECT d, run, count(*) AS n FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{6,}')),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) GROUP BY ALL),
drawn AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(d || ':' || run)),
    lambda i: ('0x' || substr(hex(encode(d || ':' || run)), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8))) AS h FROM runs, crc),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM drawn)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (
  SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM less a JOIN words b ON a.rest = b.word),
best AS (
  SELECT a, count(*) AS n_near, arg_min(b, (-w.n, b)) AS b, max(w.n) AS m FROM near JOIN words w ON w.word = b GROUP BY a),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN b END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n
  FROM words LEFT JOIN best ON a = word),
steps AS (
  SELECT word, word AS at, form AS next FROM forms
  UNION ALL SELECT s.word, f.word, f.form FROM steps s JOIN forms f ON f.word = s.next)
SELECT f.word, f.form, s.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN steps s ON s.word = f.word AND s.next IS NULL
"""
