"""Sum-of-squares packing of documents into token sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm.tokens import default_path, shared_encoder

LENGTH = 1_024
CUT = 6
ROWS_A_CALL = 1_000

PIECES = ("doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")


class Packer:
    """Places items as they come; ``counts[h]`` is the number of open sequences filled up to ``h``.

    An item goes to the fill level that makes the sum of squared counts least: leaving level h takes 2 counts[h] - 1
    from the sum, reaching level h' below the full length adds 2 counts[h'] + 1.  Where an item is longer than the room
    at h it may be cut: it fills the sequence up, and the rest, which stands for level h + size - length, goes on as an
    item of its own.  A cut counts CUT on top, so it is chosen where the item would otherwise begin one more sequence of
    a level that is taken.  Hence levels hold few sequences each, and the number open is bound by the number of levels,
    whatever comes.  On a tie the item stays whole, and the fuller sequence wins.
    """

    def __init__(self, length: int, first_id: int):
        self.length, self.next_id = length, first_id
        self.counts = np.zeros(length + 1, np.int64)
        self.open: list[list[tuple[int, list]]] = [[] for _ in range(length)]
        self.n_open = self.cuts = 0

    def new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def costs(self, size: int) -> np.ndarray:
        """What an item adds to the sum at each level, cuts counted; very much where no sequence is open."""
        top, counts = self.length - size, self.counts[:-1]
        costs = np.empty(self.length, np.int64)
        costs[:top + 1] = 2 * self.counts[size:] + 1
        costs[top] = 0  # a full sequence is closed
        costs[top + 1:] = 2 * counts[1:size] + 1 + CUT
        costs -= 2 * counts - 1
        costs[0] -= 1  # level 0 is no sequence yet
        costs[1:][counts[1:] == 0] = np.iinfo(np.int64).max
        return costs

    def level(self, size: int) -> int:
        costs, top = self.costs(size), self.length - size
        whole = top - int(np.argmin(costs[top::-1]))
        if size == 1:
            return whole
        cut = self.length - 1 - int(np.argmin(costs[:top:-1]))
        return cut if costs[cut] < costs[whole] else whole

    def place(self, item: tuple) -> list[tuple[int, list]]:
        """Put the item (document, start, ids, tokens) down; the sequences that became full, each with its items."""
        doc, start, ids, tokens = item
        full = []
        while len(ids):
            h = self.level(len(ids))
            if h:
                sequence, items = self.open[h].pop()
                self.counts[h] -= 1
                self.n_open -= 1
            else:
                sequence, items = self.new(), []
            n = min(len(ids), self.length - h)
            items.append((doc, start, ids[:n], tokens))
            self.cuts += n < len(ids)
            start, ids = start + n, ids[n:]
            if h + n == self.length:
                full.append((sequence, items))
            else:
                self.open[h + n].append((sequence, items))
                self.counts[h + n] += 1
                self.n_open += 1
        return full

    def finish(self) -> list[tuple[int, list]]:
        """Close what is open when nothing more comes: the fullest are filled up with the ends of the emptiest, so one
        stays short."""
        left = [s for h in range(self.length - 1, 0, -1) for s in self.open[h]]
        fills = [sum(len(i[2]) for i in items) for _, items in left]
        i, j = 0, len(left) - 1
        while i < j:
            need = self.length - fills[i]
            if not need:
                i += 1
                continue
            doc, start, ids, tokens = left[j][1].pop()
            moved = min(need, len(ids))
            cut = len(ids) - moved
            left[i][1].append((doc, start + cut, ids[cut:], tokens))
            if cut:
                left[j][1].append((doc, start, ids[:cut], tokens))
            fills[i] += moved
            fills[j] -= moved
            if not fills[j]:
                j -= 1
        self.counts[:] = 0
        self.open = [[] for _ in range(self.length)]
        self.n_open = 0
        return left[:j + 1]


def pack(docs: DataFrame, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text",
         length: int = LENGTH) -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` ids.

    Each row is one piece: ``start`` and ``length`` in its document, ``doc_tokens``
    of that document with the end id, ``sequence_id`` and the gapless ``offset``
    there, and its ``ids`` (unsigned 32-bit little-endian).  Whole sequences are cut
    off long documents; the rest of a document is one item for the packer.  Rows
    are packed where they are, nothing is shuffled: a task keeps its level array
    and the open sequences, a few per level, and leaves one sequence short.  Sequence ids
    hang on the partitions and their order, so write the frame before using it twice
    if it comes from a shuffle.
    A missing text is an empty one, so every row has at least the end id.  Rows
    with the same id, or none, are packed each for itself.  Other columns are not read.
    """
    path = tokenizer or default_path()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(length, TaskContext.get().partitionId() << 32)
        encoder = None
        out: list[tuple] = []

        def keep(closed: list[tuple[int, list]]) -> None:
            for sequence, items in closed:
                offset = 0
                for doc, start, ids, tokens in items:
                    out.append((doc, start, len(ids), tokens, sequence, offset, ids.tobytes()))
                    offset += len(ids)

        def ready() -> pa.RecordBatch:
            kinds = [pa.int64()] * 6 + [pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, [p.split()[0] for p in PIECES.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_A_CALL):
                piece = batch.slice(at, ROWS_A_CALL)
                encoder = encoder or shared_encoder(path)
                ids, bounds = encoder.encode(piece.column(1))
                for doc, a, b in zip(piece.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    n = b - a
                    rest = n % length
                    for start in range(0, n - rest, length):
                        keep([(packer.new(), [(doc, start, ids[a + start:a + start + length], n)])])
                    if rest:
                        keep(packer.place((doc, n - rest, ids[b - rest:b].copy(), n)))
                if out:
                    yield ready()
        keep(packer.finish())
        if out:
            yield ready()

    return docs.select(doc_id, text).mapInArrow(packed, PIECES)
