"""Text rules for file names, chunks, model replies and rendered chapters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Shape of chapter file names, reply tags and scene breaks.
VOLUME_PATTERN = r"^(\d+)_vol\."
CHAPTER_PATTERN = r"^(\d+)_vol\._(\d+(?:\.\d+)?)"
UNKNOWN_VOLUME = "vol_unknown"
NO_CHAPTER = (9999, 0.0)
PAGE_BREAK = "\n\n<div style='page-break-before: always;'></div>\n\n"

# Sizes in characters.
CONTEXT_CHARS = 128_000
FACT_CHUNK = (CONTEXT_CHARS - 16_000, 500)
CLEAN_OVERLAP = 2_000
MIN_CLEAN_CHARS = 15_000
MIN_TEXT_CHARS = 100
QA_TOKEN_LIMIT = 32_000


def strip(c: Column) -> Column:
    """Remove all white space at both ends; Spark's ``trim`` removes spaces only."""
    return F.btrim(c, F.lit(WHITESPACE))


def safe_filename(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)[^\w\s-]", "_"))


def stem(file_name: Column) -> Column:
    return F.regexp_replace(file_name, r"(?<=.)\.[^.]*$", "")


def volume_key(file_name: Column) -> Column:
    number = F.regexp_extract(file_name, VOLUME_PATTERN, 1)
    padded = F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)
    return F.when(number != "", F.concat(F.lit("vol_"), padded)).otherwise(F.lit(UNKNOWN_VOLUME))


def chapter_volume(file_name: Column) -> Column:
    number = F.nullif(F.regexp_extract(file_name, CHAPTER_PATTERN, 1), F.lit(""))
    return F.coalesce(number.cast("bigint"), F.lit(NO_CHAPTER[0]).cast("bigint"))


def chapter_number(file_name: Column) -> Column:
    number = F.nullif(F.regexp_extract(file_name, CHAPTER_PATTERN, 2), F.lit(""))
    return F.coalesce(number.cast("double"), F.lit(NO_CHAPTER[1]))


def leading_number(file_name: Column) -> Column:
    return F.nullif(F.regexp_extract(file_name, r"^(\d+)", 1), F.lit("")).cast("bigint")


def long_enough(c: Column, min_chars: int = MIN_TEXT_CHARS) -> Column:
    return F.length(strip(c)) >= min_chars


# Forms of reasoning inside a reply, and the tag around its body.
REASONING_PATTERNS = (r"(?s)<thought>.*?</thought>", r"(?s)<think>.*?</think>", r"(?s)thinking\n.*?\n")
BODY_TAG = "cleaned_text"


def strip_reasoning(c: Column) -> Column:
    for pattern in REASONING_PATTERNS:
        c = F.regexp_replace(c, pattern, "")
    return c


def extract_tagged(c: Column, tag: str = BODY_TAG) -> Column:
    pattern = f"(?s)<{tag}>(.*?)</{tag}>"
    return strip(F.when(F.rlike(c, F.lit(pattern)), F.regexp_extract(c, pattern, 1)).otherwise(c))


def clean_reply(c: Column) -> Column:
    """What is kept of a model reply: no reasoning, only the tagged body when there is one."""
    return extract_tagged(strip_reasoning(c))


def unfence(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)```json\s*", ""), r"(?U)```\s*", "")


def extract_json(c: Column) -> Column:
    """JSON text in a reply: the fenced body, else the outermost braces, else null.

    The text itself is kept, because VARIANT sorts keys and the order of keys has a meaning.
    """
    fenced = r"(?sU)```(?:json)?\s*(.*?)\s*```"
    body = F.when(F.rlike(c, F.lit(fenced)), F.regexp_extract(c, fenced, 1)).otherwise(c)
    braces = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.coalesce(F.when(is_json(body), body), F.when(is_json(braces), braces))


def is_json(c: Column) -> Column:
    """One JSON value and nothing behind it.

    The parser stops after the first value, so the text is tried as the only item of a
    list and as the only field of an object: nothing else fits in both.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    return listed.isNotNull() & named.isNotNull()


def normalise_breaks(c: Column) -> Column:
    # (?dmU): Unix line ends only, multi-line anchors, Unicode white space.
    c = F.regexp_replace(c, r"(?dmU)^\s*[*\-—–]{2,}\s*$", "\n---\n")
    c = F.regexp_replace(c, r"\n---\n", "\n\n---\n\n")
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def title_case(c: Column) -> Column:
    """Capital after every character without case, so ``don't`` gives ``Don'T``; ``initcap`` differs."""
    cased = r"\p{IsLowercase}\p{IsUppercase}\p{Lt}"
    runs = F.regexp_extract_all(c, F.lit(f"([{cased}]+|[^{cased}]+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))),
        "",
    )


def title_from_stem(c: Column) -> Column:
    return title_case(F.replace(c, F.lit("_"), F.lit(" ")))


def render_chapter(title: Column, body: Column, volume: Column, run_date: str, work: str) -> Column:
    """Markdown of one chapter: heading, meta line, body."""
    label = F.upper(F.replace(volume, F.lit("_"), F.lit(" ")))
    return F.concat(
        F.lit("# "), title, F.lit('\n\n<p class="meta">'), label,
        F.lit(f" · Cleaned {run_date} · {work}</p>\n\n"),
        strip(normalise_breaks(body)), F.lit("\n"),
    )


def chunk_limit(context: Column) -> tuple[Column, Column]:
    """(context to use, characters left for a chunk).  An over-long context is cut first."""
    half, cut = CONTEXT_CHARS // 2, CONTEXT_CHARS // 8
    full = F.lit(half) - (F.length(context) + 1000)
    tight = full < MIN_CLEAN_CHARS
    used = F.when(tight, F.left(context, F.lit(cut))).otherwise(context)
    return used, F.lit(half) - (F.length(used) + 1000)


def est_tokens(*texts: Column) -> Column:
    """Characters div 4; lengths are added before the division."""
    total = sum((F.length(t).cast("bigint") for t in texts[1:]), F.length(texts[0]).cast("bigint"))
    return F.floor(total / 4)


def qa_fits(context: Column, raw: Column, cleaned: Column, limit: int = QA_TOKEN_LIMIT) -> Column:
    chars = F.length(context) + F.length(raw) + F.lit(2) * F.length(cleaned)
    return F.floor(chars / 4) <= limit


def overflow_view(c: Column, limit: int = 4000, keep: int = 1000) -> Column:
    notice = "...\n\n📄 **Full diagnostic report attached below.**"
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(keep)), F.lit(notice))).otherwise(c)


def overflow_attachment(c: Column, limit: int = 4000) -> Column:
    return F.when(F.length(c) > limit, c)
