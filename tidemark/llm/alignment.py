"""Token ids of two tokenizers matched by the bytes they share, with corpus-wide counts of matched id pairs.

The counting is external: tasks write sorted, compressed runs of pair-document records, dealt by the id of the second
tokenizer; runs are merged by a heap, which counts each pair and, as all pairs of one id come together, finds its
highest count; then the runs are read once more and give their documents what their pairs count.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import struct
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import Encoder, byte_letters, default_path, whole_units
from tidemark.session import scratch_folder

RADIX_BITS = 4
RUN_RECORDS, BLOCK_RECORDS = 2_000_000, 32_768
SHARD_BYTES = 64 << 20
KEPT_UNITS, KEPT_IDS = 400_000, 100_000
KEPT_CHARS = 16_000_000
TIMES_BITS = 16
ROWS_A_CALL = 256

COLUMNS = {"row": "long", "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string",
           "radix": "integer", "run": "long", "size": "long", "blob": "binary"}


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Grown:
    """Rows that are added to; the room for them doubles."""

    def __init__(self, shape: tuple, kind=np.int64):
        self.n, self.room = 0, np.zeros((1024, *shape), kind)

    def __len__(self) -> int:
        return self.n

    def add(self, rows: np.ndarray) -> None:
        while self.n + len(rows) > len(self.room):
            self.room = np.concatenate([self.room, np.zeros_like(self.room)])
        self.room[self.n:self.n + len(rows)] = rows
        self.n += len(rows)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.room[at]


class Units:
    """Tokens, groups and links of space-led units.

    Both tokenizers end a token before every space behind a character that is no white space, so a text may be matched
    unit by unit, and units repeat.
    """

    def __init__(self, tokenizer: str, pieces: str):
        import sentencepiece

        self.a, self.b = Encoder(tokenizer, KEPT_IDS, special=False), sentencepiece.SentencePieceProcessor(model_file=pieces)
        if self.a.plain:
            raise ValueError("the first tokenizer must be of the byte-level kind")
        letters = {c: b for b, c in byte_letters().items()}
        vocabulary = self.a.tokenizer.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, t)), np.int64) for t in (self.a_bytes, self.b_bytes))
        if any(" " in p.decode(errors="replace").lstrip(" ") for p in self.b_bytes):
            raise ValueError("pieces of the second tokenizer must not go on behind a space")
        self.clear()

    def clear(self) -> None:
        self.codes: dict[str, int | None] = {}
        self.chars = 0
        self.texts: list[str] = []
        self.numbers = Grown((5,))  # tokens of a and of b, groups, links, 1 where bytes differ
        self.pairs, self.starts = Grown((), np.uint64), Grown(())  # links of all units, and where each unit's begin
        self.starts.add(np.zeros(1, np.int64))

    def learn(self, pieces: Iterable[str]) -> None:
        new = []
        for piece in pieces:
            if piece and not piece[-1].isspace():
                new.append(piece)
            else:
                self.codes[piece] = None  # may not end a unit
        self._add(new, new)

    def _add(self, names: list, units: list[str]) -> None:
        if not units:
            return
        self.chars += sum(map(len, units))
        own_a = self.a.behind_space(units)
        # An empty text gets no space in front; a text's last space is such a unit.
        own_b = [x or [self.b.piece_to_id("▁")] for x in self.b.encode(units, num_threads=1)]
        whole = [f" {u}".encode() for u in units]
        n_a = np.fromiter(map(len, own_a), np.int64, len(units)) // 4
        n_b = np.fromiter(map(len, own_b), np.int64, len(units))
        a = np.frombuffer(b"".join(own_a), "<u4").astype(np.int64)
        b = np.fromiter(itertools.chain.from_iterable(own_b), np.int64, int(n_b.sum()))
        sizes = np.fromiter(map(len, whole), np.int64, len(units))
        same = self._same(a, n_a, self.a_bytes, self.a_sizes, whole, sizes) & self._same(b, n_b, self.b_bytes, self.b_sizes, whole, sizes)
        if not same.all():  # such units have no tokens
            a, b = a[np.repeat(same, n_a)], b[np.repeat(same, n_b)]
            n_a, n_b, sizes = n_a * same, n_b * same, sizes * same
        # Every stretch between two neighbouring ends lies in one token of each side, and each overlap is one stretch.
        a_end, b_end = np.zeros((2, int(sizes.sum()) + 1), bool)
        a_end[np.cumsum(self.a_sizes[a])] = True
        b_end[np.cumsum(self.b_sizes[b])] = True
        a_end[0] = b_end[0] = False
        ends, both = a_end | b_end, a_end & b_end
        a_before, b_before = np.cumsum(a_end) - a_end, np.cumsum(b_end) - b_end
        stops = np.cumsum(sizes)
        n_links = np.diff(np.cumsum(ends)[stops], prepend=0)
        n_groups = np.diff(np.cumsum(both)[stops], prepend=0)
        ends, both = np.flatnonzero(ends), np.flatnonzero(both)
        a_names, b_names = list(map(str, a.tolist())), list(map(str, b.tolist()))
        a_cuts, b_cuts = ([0, *(x[both] + 1).tolist()] for x in (a_before, b_before))
        groups = [f"{','.join(a_names[i:j])}|{','.join(b_names[k:m])}" for i, j, k, m in zip(
            a_cuts[:-1], a_cuts[1:], b_cuts[:-1], b_cuts[1:], strict=True)]
        at = np.cumsum(n_groups).tolist()
        first = len(self.texts)
        self.texts += [groups[i] if j == i + 1 else ";".join(groups[i:j]) for i, j in zip([0, *at[:-1]], at, strict=True)]
        self.numbers.add(np.stack([n_a, n_b, n_groups, n_links, ~same], axis=1).astype(np.int64))
        self.starts.add(len(self.pairs) + np.cumsum(n_links))
        self.pairs.add((b[b_before[ends]].astype(np.uint64) << np.uint64(32)) | a[a_before[ends]].astype(np.uint64))
        self.codes.update(zip(names, range(first, first + len(names)), strict=True))

    @staticmethod
    def _same(ids: np.ndarray, n: np.ndarray, table: list[bytes], sizes: np.ndarray, whole: list[bytes], want: np.ndarray) -> np.ndarray:
        """Whether the tokens of each unit are its bytes: all at once, and one by one only where they are not."""
        ends = np.cumsum(n)
        got = np.diff(np.concatenate([[0], np.cumsum(sizes[ids])])[ends], prepend=0)
        tokens = list(map(table.__getitem__, ids.tolist()))
        if (got == want).all() and b"".join(tokens) == b"".join(whole):
            return np.ones(len(whole), bool)
        return np.array([b"".join(tokens[e - k:e]) == w for e, k, w in zip(ends.tolist(), n.tolist(), whole, strict=True)])

    def of(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Codes of the units of each text."""
        if len(self.codes) > KEPT_UNITS or self.chars > KEPT_CHARS:
            self.clear()
        pieces = [t.split(" ") if t else [] for t in texts]
        self.learn(set().union(*pieces).difference(self.codes))
        found = []
        for own in pieces:
            codes = list(map(self.codes.__getitem__, own))
            if None in codes:
                own = whole_units(own)
                # A last unit may end in white space; it has a name of its own, as its text alone may not end a unit.
                names = [*own[:-1], own[-1] if own[-1] and not own[-1][-1].isspace() else (own[-1],)]
                new = {n: n[0] if isinstance(n, tuple) else n for n in names if n not in self.codes}
                self._add(list(new), list(new.values()))
                codes = list(map(self.codes.__getitem__, names))
            found.append(np.array(codes, np.int64))
        return found


class Layout:
    """A pair-document record in 64 bits: low bits of b, the rest of b, a, document in the run, times."""

    def __init__(self, n_a: int, n_b: int, radix_bits: int):
        self.a_bits, self.b_bits = max(1, (n_a - 1).bit_length()), max(radix_bits, (n_b - 1).bit_length())
        self.radix_bits = radix_bits
        self.doc_bits = 64 - self.a_bits - self.b_bits - TIMES_BITS
        if self.doc_bits < 8:
            raise ValueError("the vocabularies are too large for records of 64 bits")

    def records(self, pairs: np.ndarray, docs: np.ndarray, times: np.ndarray) -> np.ndarray:
        most = (1 << TIMES_BITS) - 1
        if len(times) and times.max() > most:  # a count that does not fit is several records
            copies = -(-times // most)
            last = np.cumsum(copies) - 1
            pairs, docs = np.repeat(pairs, copies), np.repeat(docs, copies)
            rest = times - (copies - 1) * most
            times = np.full(len(pairs), most, np.int64)
            times[last] = rest
        b, a = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
        high = self.b_bits - self.radix_bits
        turned = ((b & np.uint64((1 << self.radix_bits) - 1)) << np.uint64(high)) | (b >> np.uint64(self.radix_bits))
        pair = (turned << np.uint64(self.a_bits)) | a
        return (((pair << np.uint64(self.doc_bits)) | docs.astype(np.uint64)) << np.uint64(TIMES_BITS)) | times.astype(np.uint64)

    def radix(self, records: np.ndarray) -> np.ndarray:
        return (records >> np.uint64(64 - self.radix_bits)).astype(np.int64)

    def parts(self, records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, side-major; document; times)"""
        rest = records >> np.uint64(TIMES_BITS)
        return (rest >> np.uint64(self.doc_bits), (rest & np.uint64((1 << self.doc_bits) - 1)).astype(np.int64),
                (records & np.uint64((1 << TIMES_BITS) - 1)).astype(np.int64))

    def side(self, pair: np.ndarray) -> np.ndarray:
        return pair >> np.uint64(self.a_bits)


def packed_run(columns: Sequence[np.ndarray]) -> bytes:
    """Blocks of equally long columns, the first of them ascending, each block compressed for itself."""
    pack, out = zstandard.ZstdCompressor(level=1).compress, []
    for at in range(0, len(columns[0]), BLOCK_RECORDS):
        block = [c[at:at + BLOCK_RECORDS] for c in columns]
        steps = np.diff(block[0], prepend=block[0].dtype.type(0))
        frame = pack(b"".join(x.tobytes() for x in (steps, *block[1:])))
        out += [struct.pack("<II", len(block[0]), len(frame)), frame]
    return b"".join(out)


def blocks_of(run: bytes, kinds: Sequence[str]) -> Iterator[list[np.ndarray]]:
    unpack, at = zstandard.ZstdDecompressor().decompress, 0
    while at < len(run):
        n, size = struct.unpack_from("<II", run, at)
        data, place, columns = unpack(run[at + 8:at + 8 + size]), 0, []
        for kind in kinds:
            columns.append(np.frombuffer(data, kind, n, place))
            place += columns[-1].nbytes
        yield [np.cumsum(columns[0], dtype=columns[0].dtype), *columns[1:]]
        at += 8 + size


def merged(runs: Sequence[Iterator[tuple[np.ndarray, np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys ascending, sum of their weights) of many runs of (keys ascending, weights).

    The heap holds the last key of each run's block at hand; up to the least of them all runs are known, so that much
    is summed and given out, and the run it came from brings its next block.
    """
    heads: list[tuple[np.ndarray, np.ndarray] | None] = [next(r, None) for r in runs]
    heap = [(int(h[0][-1]), i) for i, h in enumerate(heads) if h]
    heapq.heapify(heap)
    while heap:
        bound = heap[0][0]
        parts = []
        for k, head in enumerate(heads):
            if head is not None:
                cut = int(np.searchsorted(head[0], np.uint64(bound), "right"))
                if cut:
                    parts.append((head[0][:cut], head[1][:cut]))
                    heads[k] = (head[0][cut:], head[1][cut:])
        keys, weights = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
        yield keys[order][first], np.add.reduceat(weights[order], first)
        spent = []
        while heap and heap[0][0] <= bound:
            spent.append(heapq.heappop(heap)[1])
        for i in spent:
            head = heads[i] = next(runs[i], None)
            if head is not None:
                heapq.heappush(heap, (int(head[0][-1]), i))


def joined(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """All of a merge; a key that a border cut in two is one again."""
    parts = list(parts)
    keys, sums = (np.concatenate(x) for x in zip(*parts, strict=True))
    first = np.flatnonzero(np.concatenate([[True], np.diff(keys) != 0]))
    return keys[first], np.add.reduceat(sums, first)


def aligned(docs: DataFrame, doc_id: str, text: str, tokenizer: str, pieces: str, layout: Layout) -> DataFrame:
    """Rows of documents (``run`` null) and rows of runs (``run`` is the row number of its document 0)."""
    schema = docs.select(F.col(doc_id).alias("doc_id")).schema
    for name, column in COLUMNS.items():
        schema = schema.add(name, column)
    kind = schema["doc_id"].dataType
    most_docs = 1 << layout.doc_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        names = [*schema.names]
        types = [to_arrow_type(kind), *[pa.int64()] * 5, pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

        def frame(n: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], names)

        row = TaskContext.get().partitionId() << 40
        units, base, held, n_held = None, row, [], 0

        def runs() -> Iterator[pa.RecordBatch]:
            records = np.sort(np.concatenate(held))
            radix = layout.radix(records)
            for cut in np.split(np.arange(len(records)), np.flatnonzero(np.diff(radix)) + 1):
                blob = packed_run([records[cut]])
                yield frame(1, radix=pa.array([int(radix[cut[0]])], pa.int32()), run=pa.array([base]),
                            size=pa.array([len(cut)]), blob=pa.array([blob], pa.binary()))

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_A_CALL):
                part = batch.slice(start, ROWS_A_CALL)
                units = units or Units(tokenizer, pieces)
                if held and (n_held > RUN_RECORDS or row + part.num_rows - base > most_docs):
                    yield from runs()
                    held, n_held, base = [], 0, row
                elif not held:
                    base = row
                codes = units.of(part.column(1).to_pylist())
                numbers = np.array([units.numbers[c].sum(axis=0) for c in codes], np.int64).reshape(-1, 5)
                good = (numbers[:, 4] == 0) & (numbers[:, 0] > 0)
                numbers[~good] = 0
                texts = [hashlib.sha256(";".join(map(units.texts.__getitem__, c.tolist())).encode()).hexdigest() if g else ""
                         for c, g in zip(codes, good.tolist(), strict=True)]
                yield frame(part.num_rows, doc_id=part.column(0), row=pa.array(np.arange(row, row + part.num_rows)),
                            **{n: pa.array(numbers[:, i]) for i, n in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
                            groups_sha256=pa.array(texts))
                # Equal units of a document are one, taken several times.
                own = np.concatenate([(np.int64(i) << 32) | c for i, c in enumerate(codes) if good[i]] or [np.zeros(0, np.int64)])
                own, times = np.unique(own, return_counts=True)
                code, doc = own & 0xFFFFFFFF, own >> 32
                n = units.starts[code + 1] - units.starts[code]
                at = np.repeat(units.starts[code] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                held.append(layout.records(units.pairs[at], np.repeat(doc + (row - base), n), np.repeat(times, n)))
                n_held += len(held[-1])
                row += part.num_rows
        if n_held:
            yield from runs()

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows by their first columns, which lie side by side; each group is to be read to its end."""
    rows = ((tuple(c[i].as_py() for c in b.columns)) for b in batches for i in range(b.num_rows))
    yield from itertools.groupby(rows, key=lambda r: r[:keys])


def align(docs: DataFrame, tokenizer: str | None = None, pieces: str | None = None, doc_id: str = "doc_id",
          text: str = "text", radix_bits: int = RADIX_BITS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links``, ``n_best``, ``count_sum``,
    ``groups_sha256``.

    Both tokenizers get a space and the whole text, special tokens count as ordinary text.  A text that is missing or
    empty, or whose tokens' bytes are not a space and the text, has no tokens: zeros and ''.  A link is an overlap of a
    token of each side; the count of an id pair is how many links of the corpus have it, each document counted.
    ``n_best`` are links whose count is the highest of their second id, ``count_sum`` the sum over links.  Rows with
    equal or missing ids are rows of their own; other columns are not read; an empty table gives no rows.

    Runs are dealt by the low bits of the second id and, where those of one part pass ``shard_bytes``, into shards, so
    an id in every document is merged in several tasks.  A task holds one shard, compressed, and the counts of its part,
    which the vocabularies bound.
    """
    spark = docs.sparkSession
    tokenizer, pieces = tokenizer or default_path(), pieces or default_pieces()
    units = Units(tokenizer, pieces)
    layout = Layout(len(units.a_bytes), len(units.b_bytes), radix_bits)
    folder = scratch_folder(spark, "alignment")
    # Written once: row numbers and runs stay what they are when executors are lost later.
    aligned(docs, doc_id, text, tokenizer, pieces, layout).write.parquet(folder)
    stored = spark.read.parquet(folder)
    documents = stored.filter("run is null").select("doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    sized = stored.filter("run is not null").select("radix", "run", F.col("blob").alias("data"))
    shards = sized.groupBy("radix").agg(F.ceil(F.sum(F.octet_length("data")) / shard_bytes).cast("int").alias("shards"))  # 2 ** radix_bits rows
    runs = (sized.join(F.broadcast(shards), "radix")
            .select("radix", F.pmod(F.xxhash64("run"), F.col("shards")).cast("int").alias("shard"), "run", "data"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records(blob: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for (block,) in blocks_of(blob, ["<u8"]):
                pair, _, times = layout.parts(block)
                yield pair, times

        for (radix, shard), rows in grouped(batches, 2):
            keys, sums = joined(merged([records(r[3]) for r in rows]))
            yield pa.RecordBatch.from_arrays([pa.array([radix], pa.int32()), pa.array([shard], pa.int32()), pa.array(
                [packed_run([keys, sums])], pa.binary())], ["radix", "shard", "data"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (radix,), rows in grouped(batches, 1):
            keys, sums = joined(merged([((k, n) for k, n in blocks_of(r[2], ["<u8", "<i8"])) for r in rows]))
            side = layout.side(keys)
            first = np.flatnonzero(np.concatenate([[True], np.diff(side) != 0]))
            most = np.repeat(np.maximum.reduceat(sums, first), np.diff(np.append(first, len(sums))))
            yield pa.RecordBatch.from_arrays([pa.array([radix], pa.int32()), pa.array(
                [packed_run([keys, sums, (sums == most).astype(np.int8)])], pa.binary())], ["radix", "data"])

    def contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, 2):
            known = None
            for row in rows:
                run, blob = row[2], row[3]
                if run is None:  # the counts come first
                    known = [np.concatenate(c) for c in zip(*blocks_of(blob, ["<u8", "<i8", "<i1"]), strict=True)]
                    continue
                found = []
                for (block,) in blocks_of(blob, ["<u8"]):
                    pair, doc, times = layout.parts(block)
                    at = np.searchsorted(known[0], pair)
                    found.append((doc, times * known[2][at], times * known[1][at]))
                doc, n_best, total = (np.concatenate(c) for c in zip(*found, strict=True))
                order = np.argsort(doc, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], np.diff(doc[order]) != 0]))
                yield pa.RecordBatch.from_arrays([pa.array(doc[order][first] + run), pa.array(np.add.reduceat(n_best[order], first)),
                                                  pa.array(np.add.reduceat(total[order], first))], ["row", "n_best", "count_sum"])

    counted = (runs.repartition("radix", "shard").sortWithinPartitions("radix", "shard", "run")
               .mapInArrow(count, "radix int, shard int, data binary"))
    counts = (counted.repartition("radix").sortWithinPartitions("radix", "shard").mapInArrow(best, "radix int, data binary")
              .join(F.broadcast(shards), "radix")
              .select("radix", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(None).cast("bigint").alias("run"), "data"))
    given = (runs.unionByName(counts).repartition("radix", "shard").sortWithinPartitions("radix", "shard", F.col("run").asc_nulls_first())
             .mapInArrow(contribute, "row bigint, n_best bigint, count_sum bigint"))
    sums = given.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return documents.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("bigint").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("bigint").alias("count_sum"), "groups_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
