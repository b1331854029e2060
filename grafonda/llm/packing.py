"""Filling containers of fixed token capacity with documents that lie close together.

Each text is read once: its tokens are counted and its hashed bag of words is projected to three
pseudo-random directions. The point's Hilbert key orders documents so that neighbours on the curve
are similar; the key range-partitions the sizes (not the texts), and every partition packs its
stretch of the curve from windows of ``window`` documents, largest first, each into the open
container with the least room that still takes it. Containers with room are carried into the next
window, so only a partition's last ones stay unfilled.

A text is split only if it alone exceeds the capacity: into full containers and one rest that is
packed like a document.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafonda.llm.tokens import DEFAULT, FOLDER, Counter
from grafonda.session import materialise

_DIMS, _BITS = 3, 10


def hilbert(points: np.ndarray, bits: int = _BITS) -> np.ndarray:
    """Place along the Hilbert curve of integer points (rows) with `bits` bits a coordinate.

    The coordinates are brought to transposed Hilbert form by undoing rotations and reflections from
    the highest bit down, then Gray-decoded and interleaved.
    """
    x = points.T.astype(np.int64).copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(dims):
            flip = (x[i] & q) > 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(flip, x[i], x[i] ^ swap)
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << b), (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _measure(tokenizer: str, folder: str):
    def run(batches):
        counter = Counter(tokenizer, folder, _DIMS)
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, place = counter.count_and_place([x or "" for x in batch.column("text").to_pylist()])
            # squashed to the unit cube; common words move all documents the same way, which costs resolution, not order
            grid = np.clip(((np.tanh(place / 2) + 1) / 2 * (1 << _BITS)).astype(np.int64), 0, (1 << _BITS) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(tokens), pa.array(hilbert(grid))], names=["id", "tokens", "curve"])

    return run


class Packer:
    """Best fit into open containers, kept by room; the fullest are closed beyond `open_limit`."""

    def __init__(self, capacity: int, first: int, open_limit: int = 512):
        self.capacity, self.next, self.limit = capacity, first, open_limit
        self.open: list[tuple[int, int]] = []

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, size: int) -> int:
        at = bisect_left(self.open, (size, -1))
        if at < len(self.open):
            room, container = self.open.pop(at)
        else:
            room, container = self.capacity, self.new()
        if room > size:
            insort(self.open, (room - size, container))
            if len(self.open) > self.limit:
                self.open.pop(0)
        return container


def _pack(capacity: int, window: int):
    def run(batches):
        packer = Packer(capacity, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33)
        held: list[tuple[int, int, int, object]] = []

        def flush():
            container, ids, piece, begin, size = [], [], [], [], []

            def put(c, i, p, b, s):
                container.append(c), ids.append(i), piece.append(p), begin.append(b), size.append(s)

            rest = []
            for tokens, _, i in held:
                full = tokens // capacity if tokens > capacity else 0
                for p in range(full):
                    put(packer.new(), i, p, p * capacity, capacity)
                left = tokens - full * capacity
                if left or not tokens:
                    rest.append((left, full, i))
            rest.sort(key=lambda r: -r[0])
            for left, p, i in rest:
                put(packer.place(left), i, p, p * capacity, left)
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(container, pa.int64()), pa.array(ids, kind), pa.array(piece, pa.int32()), pa.array(begin, pa.int64()), pa.array(size, pa.int64())],
                names=["container", "id", "piece", "begin", "tokens"],
            )

        kind = None
        for batch in batches:
            kind = batch.column("id").type
            for tokens, i in zip(batch.column("tokens").to_pylist(), batch.column("id").to_pylist()):
                held.append((tokens, 0, i))
                if len(held) >= window:
                    yield flush()
        if held:
            yield flush()

    return run


def pack_documents(
    rows: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    window: int = 2048,
    tokenizer: str = DEFAULT,
    folder: str = FOLDER,
    partitions: int | None = None,
) -> DataFrame:
    """(container, id, piece, begin, tokens): the container of every document, or of every piece of one too large.

    ``begin`` and ``tokens`` give the piece's token range. Null and empty texts have no token and are
    put into some container without taking room; null ids are left out; every row counts, repeated
    ones too; equal sizes keep the order of the curve; an empty table gives no row. `partitions`
    defaults to one for every 4 million tokens, so that unfilled last containers do not matter.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    sizes = materialise(
        rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_measure(tokenizer, folder), f"id {kind}, tokens long, curve long"),
        "sizes",
    )
    if partitions is None:
        total = sizes.agg(F.sum("tokens")).first()[0] or 0
        partitions = max(1, total // 4_000_000)
    along = sizes.repartitionByRange(partitions, "curve", "id").sortWithinPartitions("curve", "id")
    return along.mapInArrow(_pack(capacity, window), f"container long, id {kind}, piece int, begin long, tokens long")


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """(containers, tokens, fill): how full the containers are over all."""
    each = packed.groupBy("container").agg(F.sum("tokens").alias("used"))
    return each.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), (F.sum("used") / (F.count("*") * capacity)).alias("fill"))
