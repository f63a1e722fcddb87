"""Near-duplicate documents by weighted-Jaccard signatures of their five-word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import add_links, components, forest_roots, gathered
from tidemark.session import cut_lineage

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 8
CHUNK_SHINGLES = 50_000
BLOCK_BYTES = 8 << 20
KEPT_WORDS = 100_000
GOLDEN = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, hashes: WordHashes, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles as sorted 64-bit hashes, how often each occurs).

    A text of fewer words has one shingle of all its words, one without words none.
    """
    words = (text or "").encode().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    n = len(words) - width + 1
    whole = np.full(n, np.uint64(width))
    for i in range(width):
        whole = mix(whole * np.uint64(GOLDEN) + codes[i:i + n])
    return np.unique(whole, return_counts=True)


def signatures(elements: np.ndarray, weights: np.ndarray, docs: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """BagMinHash of many bags at once: one row of ``size`` numbers per bag, equal at a place with
    the probability of the bags' weighted Jaccard similarity.

    The weight axis is cut into (0, 1], (1, 2], (2, 4], (4, 8] and so on.  Each element has a
    Poisson process over each interval, with a rate of its length for every place of the
    signature; a bag sees an interval whole, or, where its weight ends inside, the points whose
    position on the axis lies below the weight.  So a weight w costs log w processes and
    not w.  A place keeps the earliest point that any seen process puts there.  Points come in
    order of time, so a process is over once it is later than all places of its bag.
    """
    owners, seeds, rates, lows, ends = [docs], [mix(elements)], [np.ones(len(elements))], [np.zeros(len(elements))], [weights]
    low = 1
    left = np.flatnonzero(weights > low)
    while len(left):
        owners.append(docs[left])
        seeds.append(mix(elements[left] + np.uint64(low * GOLDEN & 0xFFFFFFFFFFFFFFFF)))
        rates.append(np.full(len(left), float(low)))
        lows.append(np.full(len(left), float(low)))
        ends.append(weights[left])
        low *= 2
        left = left[weights[left] > low]
    owner, seed, rate, begin, end = map(np.concatenate, (owners, seeds, rates, lows, ends))
    time = np.zeros(len(owner))
    best = np.full(n_docs * size, np.inf)
    first, points = 0, 1
    while len(owner):
        for at in range(0, len(owner), max(1, 4 * CHUNK_SHINGLES // points)):  # bounds the memory of a round
            part = slice(at, at + max(1, 4 * CHUNK_SHINGLES // points))
            draw = mix(seed[part, None] + (np.arange(first, first + points, dtype=np.uint64) + np.uint64(1)) * np.uint64(GOLDEN))
            steps = -np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53) / (rate[part, None] * size)
            when = time[part, None] + np.cumsum(steps, axis=1)
            other = mix(draw ^ np.uint64(GOLDEN))
            place = owner[part, None] * size + (other % np.uint64(size)).astype(np.int64)
            # Position on the weight axis inside (begin, begin + rate].
            height = begin[part, None] + np.floor((other >> np.uint64(32)).astype(float) * rate[part, None] * 2.0 ** -32) + 1
            seen = height <= end[part, None]
            np.minimum.at(best, place[seen], when[seen])
            time[part] = when[:, -1]
        last = best.reshape(n_docs, size).max(axis=1)
        go_on = time < last[owner]
        owner, seed, rate, begin, end, time = (x[go_on] for x in (owner, seed, rate, begin, end, time))
        first += points
        points = min(2 * points, 256) if first > 1 else 1
    return best.reshape(n_docs, size)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    bits = signature.view(np.uint64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), bits.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * np.uint64(GOLDEN) + bits[:, :, r])
    return key.view(np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags: the sum of lesser counts over the sum of greater ones."""
    _, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][at_a], b[1][at_b]).sum())
    most = int(a[1].sum() + b[1].sum()) - least
    return least / most if most else 0.0


def sketch(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """``node`` and ``keys`` (one per band) from ``node`` and ``text``; texts without words are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()

        def batch_of(nodes: list, bags: list) -> pa.RecordBatch:
            sizes = np.array([len(e) for e, _ in bags])
            signature = signatures(np.concatenate([e for e, _ in bags]), np.concatenate([c for _, c in bags]),
                                   np.repeat(np.arange(len(bags)), sizes), len(bags), bands * rows)
            keys = band_keys(signature, bands, rows)
            return pa.RecordBatch.from_arrays([
                pa.array(nodes, pa.binary()), pa.ListArray.from_arrays(np.arange(len(bags) + 1, dtype=np.int32) * bands, pa.array(keys.ravel()))],
                ["node", "keys"])

        for batch in batches:
            nodes, bags, held = [], [], 0
            for node, text in zip(batch.column(0), batch.column(1), strict=True):
                bag = shingles(text.as_py(), hashes, words)
                if len(bag[0]):
                    nodes.append(node.as_py())
                    bags.append(bag)
                    held += len(bag[0])
                if held >= CHUNK_SHINGLES:
                    yield batch_of(nodes, bags)
                    nodes, bags, held = [], [], 0
                if len(hashes) > KEPT_WORDS:
                    hashes.clear()
            if nodes:
                yield batch_of(nodes, bags)

    return docs.select("node", "text").mapInArrow(run, "node binary, keys array<bigint>")


def verified(pairs: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """Pairs ``u``, ``v`` whose texts' bags overlap by the threshold or more."""
    a = texts.select(F.col("node").alias("u"), F.col("text").alias("_a"))
    b = texts.select(F.col("node").alias("v"), F.col("text").alias("_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, bag = WordHashes(), None, None
        for batch in batches:
            us, vs = [], []
            for u, v, left, right in zip(*batch.columns, strict=True):
                u = u.as_py()
                if u != last:  # pairs of one hub come together
                    last, bag = u, shingles(left.as_py(), hashes, words)
                if overlap(bag, shingles(right.as_py(), hashes, words)) >= threshold:
                    us.append(u)
                    vs.append(v.as_py())
                if len(hashes) > KEPT_WORDS:
                    hashes.clear()
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], ["u", "v"])

    return pairs.join(b, "v").join(a, "u").select("u", "v", "_a", "_b").mapInArrow(run, "u binary, v binary")


def multiset_marks(bag: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A bag as a sorted set of 64-bit hashes: the n-th copy of a shingle is an element of its own."""
    elements, counts = bag
    nth = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.sort(mix(np.repeat(elements, counts) + nth.astype(np.uint64) * np.uint64(GOLDEN)))


def links_of(rows: list[tuple], marks: list[np.ndarray], i: int, j: int, threshold: float) -> Iterator[tuple[bytes, bytes]]:
    """Links between different components among the nodes of blocks ``i`` and ``j`` of one group.

    ``rows``: (block, node, root, keys).  Two nodes are compared when they share a bucket, and not once a link found here
    has joined their components, so a group gives fewer links than it has nodes.  Bags are compared whole by 64-bit
    hashes, as in ``verified``; only pairs whose sizes alone keep them below the threshold are left out.
    """
    codes: dict[bytes, int] = {}
    component = np.array([codes.setdefault(r[2], len(codes)) for r in rows])
    keys = np.array([r[3] for r in rows], np.int64)
    sizes = np.array([len(b) for b in marks])
    block = np.array([r[0] for r in rows])
    right = np.flatnonzero(block == j)
    for a in np.flatnonzero(block == i).tolist():
        others = right[(component[right] != component[a]) & ((right > a) if i == j else True)]
        others = others[np.minimum(sizes[others], sizes[a]) / np.maximum(sizes[others], sizes[a]) >= threshold]
        if len(others):
            others = others[(keys[others] == keys[a]).any(axis=1)]
        # Only so many hashes at once are laid side by side.
        for part in np.split(others, np.flatnonzero(np.diff(np.cumsum(sizes[others]) // (4 * CHUNK_SHINGLES))) + 1):
            part = part[component[part] != component[a]]
            if not len(part):
                continue
            flat = np.concatenate([marks[b] for b in part.tolist()])
            at = np.minimum(np.searchsorted(marks[a], flat), sizes[a] - 1)
            shared = np.add.reduceat((marks[a][at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[part])[:-1]]))
            for b in part[shared / (sizes[a] + sizes[part] - shared) >= threshold].tolist():
                if component[b] != component[a]:
                    component[component == component[b]] = component[a]
                    yield min(rows[a][1], rows[b][1]), max(rows[a][1], rows[b][1])


def blocked(open_: DataFrame, texts: DataFrame, block_bytes: int) -> DataFrame:
    """``group``, ``i``, ``j``, ``own``, ``node``, ``root``: which nodes meet in which task, without their texts.

    ``open_`` (``key``, ``node``, ``root``) has the buckets with several components.  Buckets that share a node are one
    group, so a node is in one group however many buckets it is in.  The largest component of a group is dealt into
    blocks of about ``block_bytes`` of text, the rest of the group into blocks of its own; the rest meets all blocks,
    those of the largest component never meet each other, as there is nothing to link.
    """
    hubs = open_.groupBy("key").agg(F.min("root").alias("u"))
    ways = open_.join(cut_lineage(hubs), "key").select("u", F.col("root").alias("v")).distinct()
    groups = components(ways).select(F.col("node").alias("root"), F.col("root").alias("group"))
    members = cut_lineage(open_.select("node", "root").distinct().join(groups, "root").join(
        texts.select("node", F.octet_length("text").alias("bytes")), "node"))
    sizes = members.groupBy("group", "root").agg(F.sum("bytes").alias("bytes"))
    whole = sizes.groupBy("group").agg(F.max(F.struct("bytes", "root")).alias("most"), F.sum("bytes").alias("bytes"))
    shares = cut_lineage(whole.select(
        "group", F.col("most.root").alias("largest"), F.ceil(F.col("most.bytes") / block_bytes).cast("int").alias("n_large"),
        F.ceil((F.col("bytes") - F.col("most.bytes")) / block_bytes).cast("int").alias("n_rest")).filter("n_rest > 0"))
    own = F.when(F.col("root") == F.col("largest"), F.pmod(F.xxhash64("node"), "n_large")).otherwise(
        F.col("n_large") + F.pmod(F.xxhash64("node"), "n_rest")).cast("int")
    n_blocks = F.col("n_large") + F.col("n_rest")
    first = F.when(F.col("own") < F.col("n_large"), F.col("n_large")).otherwise(F.lit(0))
    return (members.join(shares, "group").withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(first, n_blocks - 1)))
            .select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root"))


def residual(buckets: DataFrame, roots: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, threshold: float,
             block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links between nodes of one bucket that are not yet in one component.  ``nodes`` has ``keys``.

    Only buckets with several components are looked at.  A text is sent once for each block its own has to meet, which
    is once or twice in a group of up to ``block_bytes``, whatever the number of buckets.
    """
    labelled = cut_lineage(buckets.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))
    mixed = cut_lineage(labelled.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("key"))
    open_ = cut_lineage(labelled.join(mixed, "key"))
    dealt = blocked(open_, texts, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, marks, hashes = None, [], [], WordHashes()
        for batch in batches:
            out = []
            for at, key in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)):
                if key != group:
                    if rows:
                        out += links_of(rows, marks, *group[1:], threshold)
                    group, rows, marks = key, [], []
                rows.append(tuple(batch.column(i)[at].as_py() for i in range(3, 7)))
                marks.append(multiset_marks(shingles(batch.column(7)[at].as_py(), hashes, words)))
                if len(hashes) > KEPT_WORDS:
                    hashes.clear()
            if out:
                yield link_batch(out)
        if rows:
            yield link_batch(list(links_of(rows, marks, *group[1:], threshold)))

    # A group is one key, so its rows are side by side in one partition; blocks bound how much text that is.
    side_by_side = (dealt.join(nodes, "node").join(texts, "node").repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "node")
                    .select("group", "i", "j", "own", "node", "root", "keys", "text"))
    return side_by_side.mapInArrow(run, "u binary, v binary").distinct()


def link_batch(links: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([u for u, _ in links], pa.binary()), pa.array([v for _, v in links], pa.binary())], ["u", "v"])


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose two nodes are not yet in one component."""
    left = roots.select(F.col("node").alias("u"), F.col("root").alias("_a"))
    right = roots.select(F.col("node").alias("v"), F.col("root").alias("_b"))
    return (pairs.join(left, "u", "left").join(right, "v", "left")
            .filter(F.coalesce("_a", "u") != F.coalesce("_b", "v")).select("u", "v"))


def with_links(found: DataFrame, roots: DataFrame) -> DataFrame:
    """Roots with the links ``found`` added."""
    found = cut_lineage(found)
    rows = found.count()
    return cut_lineage(add_links(roots, gathered(found, rows))) if rows else roots


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD,
            bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id``, ``node`` (digest of the text), ``root`` (of its class) for every row.

    Documents are in a class when links lead from one to the other.  Equal texts
    (a missing text is an empty one) are one node and always linked.  Others are linked
    when the bags of their five-word shingles overlap by the threshold or more and one
    band of their signatures is equal.  In a bucket every node is first compared
    with the smallest node of one of its buckets, then with those of the others where the two
    are not yet in one component.  Then nodes of a bucket that are still apart are compared with all others
    there, and only links that join two components leave the group.  So a bucket of copies costs a row for each
    copy, and no link between different components is left out.  Joins on a bucket, hub or class read written tables on
    both sides, so Spark splits a hot key.  Texts are compared
    whole.  Extra columns are not read.
    """
    rows_in = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows_in = rows_in.withColumn("node", F.unhex(F.md5("text")))
    nodes = cut_lineage(sketch(rows_in, words, bands, rows).dropDuplicates(["node"]))
    buckets = nodes.select("node", F.explode("keys").alias("key"))
    hubs = cut_lineage(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).filter("n > 1").drop("n"))
    shared = cut_lineage(buckets.join(hubs, "key"))
    pairs = cut_lineage(shared.filter(F.col("node") != F.col("hub")).select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct())
    met = shared.select("node").distinct()
    texts = cut_lineage(rows_in.select("node", "text").join(met, "node", "left_semi").dropDuplicates(["node"]))
    # First one hub for each node, then the hubs of its other buckets where the two are still apart.
    one_hub = pairs.groupBy("v").agg(F.min("u").alias("u")).select("u", "v")
    # A hub is smaller than the others of its bucket, so these links make a forest.
    roots = cut_lineage(forest_roots(verified(one_hub, texts, words, threshold).select(F.col("v").alias("node"), F.col("u").alias("parent"))))
    roots = with_links(verified(cut_lineage(apart(pairs, roots)), texts, words, threshold), roots)
    roots = with_links(residual(shared.select("key", "node"), roots, nodes, texts, words, threshold), roots)
    return rows_in.select("doc_id", "node").join(roots, "node", "left").select(
        "doc_id", "node", F.coalesce("root", "node").alias("root"))


def class_ids(found: DataFrame) -> DataFrame:
    """``doc_id``, ``class_id`` (the smallest id in the class; null if no row of it has one), ``class_size``."""
    found = cut_lineage(found)
    sizes = cut_lineage(found.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")))
    return found.join(sizes, "root").select("doc_id", "class_id", "class_size")


def dedupe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of every class, the one with the smallest id (rows without an id last); all columns as they were.

    Which rows stay is found without texts; the texts then move once, dealt by id and digest, so a class of very many
    copies is no hot key.
    """
    found = classes(docs, doc_id, text, **options)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "node")
    node, kept = (f"{'_' * len(max(docs.columns, key=len))}{n}" for n in ("node", "kept"))  # no column is called so
    keep = found.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.node").alias("n"), F.col("k.doc_id").alias("d"))
    named = docs.withColumn(node, F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))).withColumn(kept, F.col(doc_id))
    same = named[node].eqNullSafe(keep["n"]) & named[kept].eqNullSafe(keep["d"])
    return named.join(keep, same, "left_semi").dropDuplicates([node, kept]).drop(node, kept)


def query(spark, sf_dir: str) -> DataFrame:
    return class_ids(classes(spark.read.parquet(f"{sf_dir}/documents.parquet")))
