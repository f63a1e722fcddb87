"""Knowledge facts: flattening replies, merging partial results, packing a context.

Facts are kept long, one leaf per row:
``seq`` (order of the partial result), ``pos`` (order inside it), ``path``
(array of keys), ``kind`` ('scalar' or 'list') and ``value``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.session import cut_lineage, slice_count

# Sections in the order they are written, and their row limits.
SECTIONS = ["characters", "relationships", "terminology", "gender_fixes", "honorifics_policy"]
LIMITS = {"relationships": 40, "terminology": 20, "gender_fixes": 10}
CONTEXT_TITLE = "=== CHARACTER & GRAMMAR BIBLE ===\n"
HEADINGS = {1: "--- CHARACTERS ---", 2: "\n--- RELATIONSHIPS (how A addresses B) ---",
            3: "\n--- TERMINOLOGY ---", 4: "\n--- KNOWN GENDER ERRORS TO WATCH ---"}
SYNTHESIS_CHARS = T.CONTEXT_CHARS // 2
NOTES_AFTER = 2 ** 61  # notes come behind all facts, in the order of their paths
CONTEXT_LIMIT = 3_000

# Free-form leaves are VARIANT: replies give a string where a list was asked for.
KB_SCHEMA = (
    "characters MAP<STRING, MAP<STRING, VARIANT>>, relationships ARRAY<MAP<STRING, STRING>>, "
    "terminology MAP<STRING, MAP<STRING, STRING>>, gender_fixes ARRAY<STRING>, honorifics_policy STRING"
)
LIST_ATTRIBUTES = ["titles_held", "aliases"]
FACT = "STRUCT<path: ARRAY<STRING>, kind: STRING, value: STRING>"


# --- replies to facts -------------------------------------------------------

def parse_replies(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``kb`` (JSON text, '{}' when unreadable) and ``failed``."""
    kb = T.extract_json(F.col(raw))
    return replies.select("*", F.coalesce(kb, F.lit("{}")).alias("kb"), kb.isNull().alias("failed"))


def coerce_list(v: Column) -> Column:
    """VARIANT to list of text: a scalar becomes a one-item list, empty items go."""
    is_list = F.schema_of_variant(v).startswith("ARRAY")
    one = F.try_variant_get(v, "$", "string")
    many = F.try_variant_get(v, "$", "array<string>")
    return F.filter(F.when(is_list, many).otherwise(F.array(one)),
                    lambda x: x.isNotNull() & (x != ""))


def fill_sections(kb: Column) -> Column:
    """Parsed knowledge base with every section present."""
    return F.struct(
        F.coalesce(kb["characters"], F.from_json(F.lit("{}"), "MAP<STRING, MAP<STRING, VARIANT>>")).alias("characters"),
        F.coalesce(kb["relationships"], F.from_json(F.lit("[]"), "ARRAY<MAP<STRING, STRING>>")).alias("relationships"),
        F.coalesce(kb["terminology"], F.from_json(F.lit("{}"), "MAP<STRING, MAP<STRING, STRING>>")).alias("terminology"),
        F.coalesce(kb["gender_fixes"], F.array().cast("array<string>")).alias("gender_fixes"),
        F.coalesce(kb["honorifics_policy"], F.lit("")).alias("honorifics_policy"),
    )


def flatten_kb(df: DataFrame, kb: str = "kb", seq: str = "seq") -> DataFrame:
    """Knowledge-base JSON to facts; each reply is flattened inside its own row."""

    def fact(path: list[Column], kind: str, value: Column) -> Column:
        return F.struct(F.array(*path).alias("path"), F.lit(kind).alias("kind"), value.alias("value"))

    def attribute(name: Column, entry: Column) -> Column:
        path = [F.lit("characters"), name, entry["key"]]
        as_list = F.transform(coerce_list(entry["value"]), lambda x: fact(path, "list", x))
        as_scalar = F.array(fact(path, "scalar", F.try_variant_get(entry["value"], "$", "string")))
        return F.when(entry["key"].isin(LIST_ATTRIBUTES), as_list).otherwise(as_scalar)

    known = fill_sections(F.from_json(F.col(kb), KB_SCHEMA))
    leaves = F.concat(
        F.flatten(F.transform(F.map_entries(F.col("_kb.characters")), lambda c: F.flatten(
            F.transform(F.map_entries(c["value"]), lambda a: attribute(c["key"], a))))),
        F.transform(F.col("_kb.relationships"),
                    lambda r: fact([F.lit("relationships")], "list", F.to_json(r))),
        F.flatten(F.transform(F.map_entries(F.col("_kb.terminology")), lambda c: F.transform(
            F.map_entries(c["value"]),
            lambda t: fact([F.lit("terminology"), c["key"], t["key"]], "scalar", t["value"])))),
        F.transform(F.col("_kb.gender_fixes"), lambda g: fact([F.lit("gender_fixes")], "list", g)),
        F.when(F.col("_kb.honorifics_policy") != "", F.array(
            fact([F.lit("honorifics_policy")], "scalar", F.col("_kb.honorifics_policy"))))
        .otherwise(F.array().cast(f"array<{FACT}>")),
    )
    return (df.withColumn("_kb", known)
            .select(F.col(seq).alias("seq"), F.posexplode(leaves).alias("pos", "_f"))
            .select("seq", F.col("pos").cast("bigint").alias("pos"), "_f.path", "_f.kind", "_f.value"))


# --- merging ----------------------------------------------------------------

def with_prefixes(facts: DataFrame) -> DataFrame:
    """One row per fact and proper prefix of its path."""
    return facts.filter(F.size("path") > 1).withColumn("prefix", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.slice("path", F.lit(1), i))))


def kind_marks(facts: DataFrame) -> DataFrame:
    """Per path the last ``seq`` of a scalar, of a list item and of anything below it."""
    seen = facts.select("path", "kind", "seq").unionByName(
        with_prefixes(facts).select(F.col("prefix").alias("path"), F.lit("branch").alias("kind"), "seq"))
    last = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("seq")))
    return seen.groupBy("path").agg(last("scalar").alias("_scalar"), last("list").alias("_list"), last("branch").alias("_branch"))


def merge_marks(marks: DataFrame) -> DataFrame:
    """Marks of several sets of facts as those of all of them."""
    return marks.groupBy("path").agg(*[F.max(c).alias(c) for c in ("_scalar", "_list", "_branch")])


def drop_overwritten(facts: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Remove facts that a later partial result replaced by a value of another kind.

    A scalar replaces a list or a whole branch of the same path and the other way round;
    list items are kept from the last such change on.  Only paths seen with two kinds can
    lose facts, so only these (few as a rule) are looked up.  ``marks`` may be those of more facts than are given.
    """
    kinds = sum((F.col(c).isNotNull().cast("int") for c in ("_scalar", "_list", "_branch")), F.lit(0))
    mixed = (kind_marks(facts) if marks is None else marks).filter(kinds > 1)
    later = lambda column: F.coalesce(F.col(column) > F.col("seq"), F.lit(False))
    own = (facts.join(mixed, "path", "left")
           .filter(~later("_branch") & ~((F.col("kind") == "list") & later("_scalar"))
                   & ~((F.col("kind") == "scalar") & later("_list")))
           .select(*facts.columns))
    leaves = mixed.filter("_branch IS NOT NULL").select(
        F.col("path").alias("prefix"), F.greatest("_scalar", "_list").alias("_leaf"))
    covered = (with_prefixes(own).select("seq", "pos", "prefix").join(leaves, "prefix")
               .filter("_leaf > seq").select("seq", "pos").distinct())
    return own.join(covered, ["seq", "pos"], "left_anti")


def merge_scalars(facts: DataFrame) -> DataFrame:
    """Later value wins per path; ``first_seq``/``first_pos`` keep the place of first mention."""
    at = F.struct("seq", "pos")
    return (facts.filter("kind = 'scalar'").groupBy("path")
            .agg(F.max_by("value", at).alias("value"), F.min(at).alias("_first"),
                 F.count(F.lit(1)).alias("n_mentions"))
            .select("path", "value", F.col("_first.seq").alias("first_seq"),
                    F.col("_first.pos").alias("first_pos"), "n_mentions"))


def merge_lists(facts: DataFrame, distinct: bool = False) -> DataFrame:
    """List items in the order of first mention.

    An item already there is not added again; repeats inside the partial result
    that brings it first are kept, unless ``distinct``.  Repeats are gathered per
    partial result (which one reply bounds), and of those the first per item is kept
    by a partial aggregate, so a popular item does not end up in one task.
    """
    items = facts.filter("kind = 'list'")
    if distinct:
        return (items.groupBy("path", "value").agg(F.min(F.struct("seq", "pos")).alias("_first"))
                .select("path", "value", F.col("_first.seq").alias("seq"), F.col("_first.pos").alias("pos")))
    repeats = items.groupBy("path", "value", "seq").agg(F.sort_array(F.collect_list("pos")).alias("_pos"))
    # The second grouping needs its own shuffle: the first one spreads an item over its partial results.
    first = repeats.groupBy("path", "value").agg(F.min(F.struct("seq", "_pos")).alias("_first"))
    return first.select("path", "value", F.col("_first.seq").alias("seq"), F.explode("_first._pos").alias("pos"))


def merge_facts(facts: DataFrame, distinct: bool = False) -> DataFrame:
    """One merged knowledge base in long form (``seq``/``pos``: place of first mention)."""
    scalars = merge_scalars(facts).select(
        F.col("first_seq").alias("seq"), F.col("first_pos").alias("pos"), "path",
        F.lit("scalar").alias("kind"), "value")
    lists = merge_lists(facts, distinct).select("seq", "pos", "path", F.lit("list").alias("kind"), "value")
    return scalars.unionByName(lists)


def majority(facts: DataFrame) -> DataFrame:
    """Most frequent value per path (ties: smallest value) and the number of different values.

    Two partial aggregations and no window, so a path with many mentions is never one task.
    """
    counts = facts.groupBy("path", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("path").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"),
        F.max("n").alias("n_votes"), F.sum("n").alias("n_mentions"),
        F.count(F.lit(1)).alias("n_values"))


def discrepancies(resolved: DataFrame) -> DataFrame:
    """Notes on paths whose mentions disagree."""
    note = F.concat(F.array_join("path", "."), F.lit(": kept "), F.col("value"), F.lit(" ("),
                    F.col("n_votes").cast("string"), F.lit(" of "),
                    F.col("n_mentions").cast("string"), F.lit(")"))
    return resolved.filter("n_values > 1").select("path", note.alias("note"))


def kb_counts(merged: DataFrame) -> DataFrame:
    """Number of characters and of terminology entries."""
    section = F.col("path")[0]
    return merged.agg(
        F.count_distinct(F.when(section == "characters", F.col("path")[1])).alias("characters"),
        F.count_if((section == "terminology") & (F.size("path") == 3)).alias("terms"))


def kb_chars(merged: DataFrame) -> DataFrame:
    """Characters of the knowledge base as JSON indented by two, added up fact by fact.

    Each leaf counts its quoted value; each different path prefix counts its line: indent, quoted
    key, colon and space; a container its brackets and the line that closes it.  Commas separate
    siblings.  Objects in lists are flat.  Nothing is collected.
    """
    quoted = lambda c: F.length(F.to_json(F.struct(c.alias("v")))) - 6
    is_object = F.col("value").startswith("{") & (F.col("path")[0] == "relationships")
    depth = F.size("path") + 1  # of a list item
    fields = F.coalesce(F.size(F.json_object_keys("value")), F.lit(0))
    spread = F.length("value") + F.when(fields > 0, fields * (2 + 2 * (depth + 1)) + 1 + 2 * depth).otherwise(0)
    values = merged.select(
        (F.when(is_object, spread).otherwise(quoted(F.col("value")))
         + F.when(F.col("kind") == "list", 2 + 2 * depth).otherwise(0)).cast("bigint").alias("n"))
    nodes = (merged.select("path", "kind").distinct()
             .select("kind", F.explode(F.transform(
                 F.sequence(F.lit(1), F.size("path")),
                 lambda i: F.struct(F.slice("path", F.lit(1), i).alias("p"),
                                    (i == F.size("path")).alias("leaf")))).alias("n"))
             .groupBy("n.p").agg(F.max(F.col("n.leaf") & (F.col("kind") == "scalar")).alias("scalar")))
    # A key adds a new line, its indent, a colon and space, and a comma; a container the brackets and
    # the line of the closing one, less the comma its last item has not.
    level = F.size("p")
    keys = nodes.select((quoted(F.element_at("p", -1)) + 4 + 2 * level
                         + F.when(F.col("scalar"), 0).otherwise(2 + 2 * level)).cast("bigint").alias("n"))
    total = values.unionAll(keys).agg(F.sum("n").alias("n"))
    return total.select(F.coalesce(F.col("n") + 2, F.lit(2).cast("bigint")).alias("kb_chars"))


def synthesise(facts: DataFrame, limit: int = SYNTHESIS_CHARS) -> DataFrame:
    """Small knowledge bases resolve contradictions by majority and note them behind the gender fixes; large ones keep the plain merge."""
    merged = cut_lineage(merge_facts(facts))  # read for the size, the votes and the lists
    fits = kb_chars(merged).scalar() < limit
    resolved = majority(facts.filter("kind = 'scalar'"))
    votes = resolved.select("path", F.col("value").alias("_voted"))
    at = merged.filter("kind = 'scalar'").select("path", "seq", "pos")
    notes = discrepancies(resolved).join(at, "path").filter(fits).select(
        (F.col("seq") + NOTES_AFTER).alias("seq"), "pos", F.array(F.lit("gender_fixes")).alias("path"),
        F.lit("list").alias("kind"), F.col("note").alias("value"))
    # Scalars have one row per path here, so the join has no popular key; lists pass by.
    scalars = merged.filter("kind = 'scalar'").join(votes, "path", "left").select(
        "seq", "pos", "path", "kind", F.when(fits, F.col("_voted")).otherwise(F.col("value")).alias("value"))
    return scalars.unionByName(merged.filter("kind = 'list'")).unionByName(notes)


# --- context ----------------------------------------------------------------

def first_n(df: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """First ``n`` rows per group, without sending a large group to one task.

    Up to its threshold Spark cuts every input partition to ``n`` rows per group before the
    shuffle; for a larger ``n`` the group is cut in hashed pieces first.
    """
    def cut(rows: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order)
        return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")

    spark = df.sparkSession
    if n > int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        salt = F.pmod(F.xxhash64(*order), F.lit(slice_count(spark)))
        df = cut(df.withColumn("_salt", salt), [*group, "_salt"]).drop("_salt")
    return cut(df, group)


def context_lines(merged: DataFrame, max_chars: int) -> DataFrame:
    """Lines of the context with their order (``section``, ``ord``).

    List attributes keep their first ``max_chars`` items: the text is cut there anyway.
    """
    path, section = F.col("path"), F.col("path")[0]
    facts = first_n(merged.filter(section == "characters"), ["path"], ["seq", "pos"], max_chars)
    facts = facts.withColumn("name", path[1]).withColumn("attr", path[2])
    pick = lambda a: F.max(F.when((F.col("attr") == a) & (F.col("value") != ""), F.col("value")))
    joined = lambda a: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(
        F.col("attr") == a, F.struct("seq", "pos", "value")))), lambda x: x["value"]), ", ")
    people = facts.groupBy("name").agg(
        F.min(F.struct("seq", "pos")).alias("at"),
        F.coalesce(pick("gender"), F.lit("unknown")).alias("gender"),
        F.coalesce(pick("pronouns"), F.lit("unknown")).alias("pronouns"),
        joined("titles_held").alias("titles"), joined("aliases").alias("aliases"),
        pick("speech_style").alias("style"))
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c)).otherwise("")
    character = people.select(
        F.lit(1).alias("section"), F.struct(
            F.col("at.seq").alias("gs"), F.col("at.pos").alias("gp"), F.lit(0).alias("rn")).alias("ord"),
        F.concat("name", F.lit(": "), "gender", F.lit(" ("), "pronouns", F.lit(")"),
                 part(", titles: ", F.col("titles")), part(", aliases: ", F.col("aliases")),
                 part(", speech: ", F.col("style"))).alias("line"))

    # The other sections: the first rows of each group, in one pass over their facts.
    number = F.when(section == "relationships", 2).when(section == "terminology", 3).when(
        section == "gender_fixes", 4).when(section == "honorifics_policy", 5)
    group = F.when(section == "terminology", path[1]).otherwise("")
    listed = (merged.select("seq", "pos", "path", "value", number.alias("section"), group.alias("group"))
              .filter(F.col("section").isNotNull() & (F.col("value") != "")
                      & ((F.col("section") != 3) | (F.size("path") == 3))))
    listed = first_n(listed, ["section", "group"], ["seq", "pos"], max(LIMITS.values()))
    w = Window.partitionBy("section", "group").orderBy("seq", "pos")
    listed = listed.withColumn("rn", F.row_number().over(w)).withColumn("born", F.first(F.struct("seq", "pos")).over(w))
    limit = F.lit(1)
    for name, n in ((2, LIMITS["relationships"]), (3, LIMITS["terminology"]), (4, LIMITS["gender_fixes"])):
        limit = F.when(F.col("section") == name, n).otherwise(limit)
    rel = F.from_json("value", "MAP<STRING, STRING>")
    field = lambda k: F.coalesce(rel[k], F.lit("?"))
    line = (F.when(F.col("section") == 2, F.concat(F.lit("  "), field("from"), F.lit(" → "), field("to"), F.lit(': "'),
                                                    field("address_term"), F.lit('"')))
            .when(F.col("section") == 3, F.concat(F.lit("    "), path[2], F.lit(" → "), F.col("value")))
            .when(F.col("section") == 4, F.concat(F.lit("  • "), F.col("value")))
            .otherwise(F.concat(F.lit("\n--- HONORIFICS POLICY ---\n  "), F.col("value"))))
    # The first term of a category brings the line with its name.
    category = F.when((F.col("section") == 3) & (F.col("rn") == 1), F.concat(F.lit("  ["), F.upper("group"), F.lit("]")))
    others = listed.filter(F.col("rn") <= limit).select(
        "section", F.struct(F.col("born.seq").alias("gs"), F.col("born.pos").alias("gp"), "rn").alias("ord"),
        F.concat_ws("\n", category, line).alias("line"))
    return character.unionByName(others)


def pack_context(merged: DataFrame, max_chars: int = CONTEXT_LIMIT) -> DataFrame:
    """The knowledge base as one text of at most ``max_chars`` characters (one row).

    Every line takes at least one character, so the first ``max_chars`` lines in
    order always hold the text that is kept; only those come together.
    """
    lines = context_lines(merged, max_chars).orderBy("section", "ord", "line").limit(max_chars)
    top = lines.agg(F.sort_array(F.collect_list(F.struct("section", "ord", "line"))).alias("a"))
    empty = F.array().cast("array<string>")

    def section(number: int) -> Column:
        mine = F.transform(F.filter("a", lambda x: x["section"] == number), lambda x: x["line"])
        head = F.array(F.lit(HEADINGS[number])) if number in HEADINGS else empty
        return F.when(F.size(mine) > 0, F.concat(head, mine)).otherwise(empty)

    parts = [F.array(F.lit(CONTEXT_TITLE)), *[section(n) for n in range(1, len(SECTIONS) + 1)]]
    return top.select(F.left(F.array_join(F.concat(*parts), "\n"), F.lit(max_chars)).alias("context"))
