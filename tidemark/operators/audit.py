"""Checks of cleaned text against the knowledge base and against its source."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import small_batches

# Titles and the gender they stand for.
TITLE_GENDER = {"Mr": "male", "Mrs": "female", "Ms": "female"}
# Pronouns and their gender.
PRONOUN_GENDER = {"he": "male", "him": "male", "his": "male", "himself": "male", "she": "female", "her": "female", "hers": "female", "herself": "female"}
TITLE_PATTERN = r"\b(Mr|Mrs|Ms)\.? (\p{L}+)"

SHARED_BYTES = 32 << 20
TERM_BYTES = 200  # what a term takes beside its characters


def apply_glossary(df: DataFrame, glossary: DataFrame, text: str = "text", shared_bytes: int = SHARED_BYTES) -> DataFrame:
    """Replace each term by its canonical form in one pass (a replacement is never replaced again).

    ``glossary``: (term, canonical); of a term given twice the smallest form counts, empty and missing ones none.  Terms
    match whole words: the leftmost one first, of several there the longest.  The terms are counted in bytes and go out
    in shards of about ``shared_bytes``, dealt by a hash of their first word; each task walks a text once through the
    automaton of each shard, and what all of them found is chosen from together, so the number of shards changes
    nothing.  Texts are not shuffled and need no key; a missing text stays missing.
    """
    terms = (glossary.filter("term <> '' AND canonical IS NOT NULL").groupBy("term").agg(F.min("canonical").alias("canonical")))
    size = terms.agg(F.sum(F.octet_length("term") + F.octet_length("canonical") + TERM_BYTES)).first()[0] or 0
    shards = -(-size // shared_bytes)
    if not shards:
        return df
    small_batches(df.sparkSession)
    own = F.pmod(F.xxhash64(F.regexp_extract("term", r"^([\p{L}\p{N}_]*)", 1)), F.lit(shards))
    found = [f"_found_{i}" for i in range(shards)]
    out = df
    for i, name in enumerate(found):
        # One shard at a time passes through the driver.
        shared = df.sparkSession.sparkContext.broadcast([(r.term, r.canonical) for r in terms.filter(own == i).toLocalIterator()])
        if shards == 1:  # what is found need not leave the task
            return df.withColumn(text, _replacer(shared)(F.col(text)))
        out = out.withColumn(name, _finder(shared)(F.col(text)))
    replaced = F.pandas_udf(replace_found, "string")
    return out.withColumn(text, replaced(F.col(text), *map(F.col, found))).drop(*found)


def build_automaton(terms: Iterable[tuple[str, str]]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for term, canonical in terms:
        automaton.add_word(term, (len(term), canonical))
    automaton.make_automaton()
    return automaton


def _finder(shared: Broadcast):
    @F.pandas_udf("array<struct<at: int, size: int, canonical: string>>")
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = build_automaton(shared.value)
        for part in texts:
            yield part.map(lambda t: whole_words(automaton, t), na_action="ignore")

    return find


def _replacer(shared: Broadcast):
    @F.pandas_udf("string")
    def replace(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = build_automaton(shared.value)
        for part in texts:
            yield part.map(lambda t: in_place(t, sorted(((at, -size, c) for at, size, c in whole_words(automaton, t)))), na_action="ignore")

    return replace


def whole_words(automaton: ahocorasick.Automaton, text: str) -> list[tuple[int, int, str]]:
    """(start, size, canonical) of all terms in the text that no word character touches."""
    if not len(automaton):
        return []
    word = lambda c: c == "_" or c.isalnum()
    return [(end - size + 1, size, canonical) for end, (size, canonical) in automaton.iter(text)
            if not (end >= size and word(text[end - size])) and not (end + 1 < len(text) and word(text[end + 1]))]


def replace_found(texts: pd.Series, *found: pd.Series) -> pd.Series:
    """Texts with the canonical forms in place of what was found; nothing is replaced twice."""
    out = []
    for text, *parts in zip(texts, *found, strict=True):
        if text is None or text is pd.NA or text != text:
            out.append(None)
            continue
        out.append(in_place(text, sorted(((m["at"], -m["size"], m["canonical"]) for p in parts if p is not None for m in p))))
    return pd.Series(out, dtype=object)


def in_place(text: str, matches: list[tuple[int, int, str]]) -> str:
    """Canonical forms in place of ``matches`` (start, -size, canonical), sorted: leftmost first, the longest of those that begin together."""
    done, pieces = 0, []
    for at, size, canonical in matches:
        if at >= done:
            pieces += [text[done:at], canonical]
            done = at - size
    return "".join([*pieces, text[done:]])


def title_mentions(df: DataFrame, key: str, text: str = "text", pattern: str = TITLE_PATTERN) -> DataFrame:
    """Titles with the name behind them, counted per document."""
    found = F.regexp_extract_all(text, F.lit("(" + pattern + ")"), F.lit(1))
    return (df.select(key, F.explode(found).alias("_m"))
            .select(key, F.regexp_extract("_m", pattern, 1).alias("title"),
                    F.regexp_extract("_m", pattern, 2).alias("name"))
            .groupBy(key, "title", "name").agg(F.count(F.lit(1)).alias("n")))


def pronoun_mentions(df: DataFrame, genders: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Pronouns in sentences that name exactly one known person: ``pronoun``, ``name``, ``n`` per document.

    ``genders``: (name, gender).  Names meet the words of a text by an equi-join, so no text is
    compared with all of them; a sentence with two known names says nothing about either.
    """
    sentences = df.select(key, F.posexplode(F.split(text, r"[.!?\n]+")).alias("_s", "_t"))
    words = sentences.select(key, "_s", F.explode(F.regexp_extract_all("_t", F.lit(r"(\p{L}+)"), F.lit(1))).alias("_w"))
    names = (words.join(genders.select(F.col("name").alias("_w")), "_w").groupBy(key, "_s")
             .agg(F.min("_w").alias("name"), F.max("_w").alias("_other")).filter("name = _other").drop("_other"))
    said = words.select(key, "_s", F.lower("_w").alias("pronoun")).filter(F.col("pronoun").isin(list(PRONOUN_GENDER)))
    return said.join(names, [key, "_s"]).groupBy(key, "pronoun", "name").agg(F.count(F.lit(1)).alias("n"))


def pronoun_audit(mentions: DataFrame, genders: DataFrame) -> DataFrame:
    """Mentions whose pronoun disagrees with the known gender of the only person named with it."""
    of = F.create_map(*[F.lit(x) for pair in PRONOUN_GENDER.items() for x in pair])
    return (mentions.join(genders, "name").withColumn("pronoun_gender", of[F.col("pronoun")])
            .filter(F.col("gender").isin("male", "female") & (F.col("gender") != F.col("pronoun_gender"))))


def gender_audit(mentions: DataFrame, genders: DataFrame) -> DataFrame:
    """Mentions whose title disagrees with the known gender.  ``genders``: (name, gender)."""
    titled = F.create_map(*[F.lit(x) for pair in TITLE_GENDER.items() for x in pair])
    return (mentions.join(genders, "name").withColumn("title_gender", titled[F.col("title")])
            .filter(F.col("gender").isin("male", "female") & (F.col("gender") != F.col("title_gender"))))


def structure(text: Column) -> dict[str, Column]:
    """Counts a faithful edit keeps."""
    lines = lambda p: F.regexp_count(text, F.lit(p))
    return {
        "paragraphs": F.regexp_count(text, F.lit(r"(?:^|\n)[^\n]")),
        "scene_breaks": lines(r"(?m)^[ \t]*(?:\*{3,}|-{3,})[ \t]*$"),
        "headings": lines(r"(?m)^#{1,6} "),
        "chars": F.length(text),
    }


def structure_audit(pairs: DataFrame) -> DataFrame:
    """Compare raw and cleaned structure; ``kept`` when no count went down."""
    raw, clean = structure(F.col("raw")), structure(F.col("cleaned"))
    out = pairs.select(
        *[c for c in pairs.columns if c not in ("raw", "cleaned")],
        *[c.cast("bigint").alias(f"raw_{n}") for n, c in raw.items()],
        *[c.cast("bigint").alias(f"clean_{n}") for n, c in clean.items()])
    kept = F.lit(True)
    for n in ("paragraphs", "scene_breaks", "headings"):
        kept = kept & (F.col(f"clean_{n}") >= F.col(f"raw_{n}"))
    return out.withColumn("kept", kept).withColumn(
        "length_ratio", F.round(F.col("clean_chars") / F.col("raw_chars"), 4))
