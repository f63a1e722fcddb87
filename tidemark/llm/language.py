"""Language of texts by Bloom filters that name, for each letter sequence, all languages that have it."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

ORDERS = (1, 2, 3, 4)
SLOTS, SEGMENT, HASHES = 1 << 22, 1 << 16, 4
LEAST_SHARE, OF_BEST = 1e-5, 0.2
FOLDS, HELD_OUT = 4, 2
KEPT_WORDS = 300_000
ROWS_A_CALL = 1_000
UNKNOWN = "und"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)

LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(words: Sequence[str], orders: Sequence[int] = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the letter sequences of all words, number of the word of each).

    A word stands between two borders.  A sequence of some order is that many neighbours inside the word and its borders,
    a border alone is none.
    """
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    points = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    border = points == 32
    owner = np.cumsum(border) - 1
    hashes, owners = [], []
    whole = np.full(len(points), GOLDEN)
    for order in range(1, max(orders) + 1):
        n = len(points) - order + 1
        if n <= 0:
            break
        whole = mix(whole[:n] * GOLDEN + points[order - 1:])
        if order in orders:
            use = ~border[:n] if order == 1 else np.ones(n, bool)
            for i in range(1, order - 1):  # a border inside would join two words
                use &= ~border[i:i + n]
            hashes.append(whole[use])
            owners.append(owner[:n][use])
    return np.concatenate(hashes), np.concatenate(owners)


def slots(grams: np.ndarray, size: int, hashes: int) -> Iterator[np.ndarray]:
    step = (grams >> np.uint64(32)) | np.uint64(1)
    for i in range(hashes):
        yield ((grams + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64)


@dataclass
class LanguageFilters:
    """Bit-sliced Bloom filters: ``planes[p][slot]`` has a bit for each of up to 64 languages."""

    languages: list[str]
    planes: list[np.ndarray]
    hashes: int

    def __post_init__(self):
        # Share of sequences outside a language that its filter still holds.
        self.false_rate = np.array([((self.planes[i // 64] >> self.planes[i // 64].dtype.type(i % 64)) & 1).mean() ** self.hashes
                                    for i in range(len(self.languages))])

    def counts(self, words: Sequence[str], orders: Sequence[int] = ORDERS) -> np.ndarray:
        """For each word: how many sequences each language has, and how many the word has."""
        grams, owner = ngrams(words, orders)
        out = np.zeros((len(words), len(self.languages) + 1), np.int64)
        out[:, -1] = np.bincount(owner, minlength=len(words))
        for p, plane in enumerate(self.planes):
            held = None
            for at in slots(grams, len(plane), self.hashes):
                held = plane[at] if held is None else held & plane[at]
            for i in range(64 * p, min(64 * (p + 1), len(self.languages))):
                has = ((held >> held.dtype.type(i % 64)) & 1).astype(bool)
                out[:, i] = np.bincount(owner[has], minlength=len(words))
        return out

    def decide(self, counts: np.ndarray) -> tuple[list[str], list[float]]:
        """The language with the largest share of a text's sequences, less the false ones (ties: the first), and that share."""
        total = counts[:, -1]
        if not self.languages:
            return [UNKNOWN] * len(counts), [0.0] * len(counts)
        shares = counts[:, :-1] / np.maximum(total, 1)[:, None]
        shares = np.clip((shares - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0.0, 1.0)
        best = shares.argmax(axis=1)
        return ([self.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), total.tolist(), strict=True)],
                np.where(total > 0, shares[np.arange(len(best)), best], 0.0).tolist())


def sequence_counts(docs: DataFrame, lang: str, text: str, orders: Sequence[int] = ORDERS, kept: int = KEPT_WORDS) -> DataFrame:
    """``gram``, ``lang``, ``n``: how often each letter sequence occurs in the texts of each language, all texts read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for name, found in seen.items():
                grams, owner = ngrams(list(found), orders)
                if len(grams):
                    times = np.fromiter(found.values(), np.int64, len(found))[owner]
                    order = np.argsort(grams, kind="stable")
                    first = np.flatnonzero(np.concatenate([[True], np.diff(grams[order]) != 0]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(grams[order][first].view(np.int64)), pa.array([name] * len(first), pa.string()),
                         pa.array(np.add.reduceat(times[order], first))], ["gram", "lang", "n"])
            seen.clear()

        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1), strict=True):
                seen.setdefault(name.as_py(), Counter()).update(words_of(value.as_py()))
            if sum(map(len, seen.values())) > kept:
                yield from out()
        yield from out()

    texts = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    return texts.mapInArrow(run, "gram bigint, lang string, n bigint").groupBy("gram", "lang").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", orders: Sequence[int] = ORDERS, size: int = SLOTS,
        hashes: int = HASHES, least_share: float = LEAST_SHARE, of_best: float = OF_BEST) -> LanguageFilters:
    """Filters learnt from all texts whose ``lang`` is not null.

    A language has a sequence when it makes up ``least_share`` of its sequences, so it has 1 / ``least_share`` at most,
    and ``of_best`` of the share it has in the language where it is most common: words quoted in other languages do
    not make it theirs.  ``size`` slots (a power of two) hold all languages; the driver gets these and one row per
    language, no more for more texts.  Without a labelled text no language is learnt.
    """
    counts = cut_lineage(sequence_counts(docs, lang, text, orders))  # used three times, read from the texts once
    names = sorted(r.lang for r in counts.select("lang").distinct().collect())
    if not names:
        return LanguageFilters([], [], hashes)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    share = counts.join(F.broadcast(totals), "lang").select("gram", "lang", (F.col("n") / F.col("total")).alias("share"))
    known = (share.filter(F.col("share") >= least_share)
             .withColumn("best", F.max("share").over(Window.partitionBy("gram"))).filter(F.col("share") >= F.col("best") * of_best))
    code = {name: i for i, name in enumerate(names)}
    width = next(w for w in (1, 2, 4, 8) if 8 * w >= min(len(names), 64))
    segment = min(SEGMENT, size)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            own = np.array([code[x] for x in batch.column(1).to_pylist()], np.int64)
            for at in slots(grams, size, hashes):
                yield pa.RecordBatch.from_arrays([pa.array(own // 64), pa.array(at), pa.array(
                    (np.uint64(1) << (own % 64).astype(np.uint64)).view(np.int64))], ["plane", "slot", "bits"])

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, table = None, None
        for batch in batches:
            planes, at, bits = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = np.flatnonzero(np.diff(planes * (size // segment) + at // segment)) + 1
            for part in np.split(np.arange(len(at)), cuts):
                if not len(part):
                    continue
                now = (int(planes[part[0]]), int(at[part[0]]) // segment)
                if now != group:
                    if group:
                        yield segment_row(group, table)
                    group, table = now, np.zeros(segment, f"<u{width}")
                table[at[part] % segment] = bits[part].view(np.uint64).astype(table.dtype)
        if group:
            yield segment_row(group, table)

    marks = (known.select("gram", "lang").mapInArrow(places, "plane bigint, slot bigint, bits bigint")
             .groupBy("plane", "slot").agg(F.bit_or("bits").alias("bits")))
    rows = (marks.repartition("plane", F.expr(f"slot div {segment}")).sortWithinPartitions("plane", "slot")
            .mapInArrow(laid, "plane bigint, segment bigint, slots binary").collect())
    planes = [np.zeros(size, f"<u{width}") for _ in range(-(-len(names) // 64))]
    for r in rows:
        planes[r.plane][r.segment * segment:(r.segment + 1) * segment] = np.frombuffer(r.slots, f"<u{width}")
    return LanguageFilters(names, planes, hashes)


def segment_row(group: tuple[int, int], table: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([group[0]]), pa.array([group[1]]), pa.array([table.tobytes()], pa.binary())],
                                      ["plane", "segment", "slots"])


def predict(docs: DataFrame, filters: LanguageFilters, text: str = "text", orders: Sequence[int] = ORDERS,
            kept: int = KEPT_WORDS) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score`` (0 to 1) last.

    Only the text is looked at, the whole of it, and each row for itself, so equal texts get equal results.  A missing
    text and one without a letter are ``und`` with score 0.  A text whose sequences no language has gets the first
    language by name, with score 0; without any learnt language all are ``und``.  Columns of ``docs`` named as the new
    ones are replaced, an empty table gives an empty one.
    """
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*[F.col(f"`{c}`") for c in rest]).schema.add("lang_pred", "string").add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    place = rest.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        codes: dict[str, int] = {}
        table = np.zeros((0, len(model.languages) + 1), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_A_CALL):
                part = batch.slice(start, ROWS_A_CALL)
                if len(codes) > kept:
                    codes, table = {}, table[:0]
                words = [words_of(t.as_py()) for t in part.column(place)]
                new = list(set().union(*words).difference(codes))
                codes.update(zip(new, range(len(codes), len(codes) + len(new)), strict=True))
                table = np.concatenate([table, model.counts(new, orders)])
                sums = np.array([table[np.fromiter(map(codes.__getitem__, w), np.int64, len(w))].sum(axis=0) for w in words], np.int64)
                names, scores = model.decide(sums.reshape(part.num_rows, -1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                                 [*rest, "lang_pred", "score"])

    return docs.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)


def fold(doc_id: str) -> Column:
    """crc32 of the id as text, modulo FOLDS; a missing id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    filters = fit(docs.filter(fold("doc_id") != HELD_OUT))
    found = predict(docs.select("doc_id", "text"), filters)
    return found.select("doc_id", (fold("doc_id") == HELD_OUT).alias("held_out"), "lang_pred", "score")
