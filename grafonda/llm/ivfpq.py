"""The k most similar vectors of every vector: an inverted file whose lists are searched exactly.

* Centroids are fitted on the driver to a bounded sample (``sample_per_list`` vectors a list, at
  most ``max_sample``); every vector is then indexed in the list of its nearest centroid.
* A query visits the lists nearest to it, and as many of them as its surroundings need: the
  true k nearest of ``asks`` sampled vectors are found among all vectors, and the lists around a
  place are visited to the rank that holds ``cover`` of them there (``probes`` at least). Where many
  vectors lie close together without being equal that is most of the lists they fill.
* All vectors of a visited list are scored by their exact cosine in one matrix product. Quantised
  codes and a bounded number of reranked candidates would lose the true ones in such places, where
  codes hardly differ, and their look-ups take longer than the product.

Lists are gathered to cells of neighbouring centroids, about ``cell_rows`` vectors each, so that a
query's lists lie in few cells: the vectors of a cell answer from where they are and only travel to
the other cells they probe, as 16-bit fixed-point numbers (cosines are off by less than 1e-5 there). A cell whose vectors or visiting queries are too many is cut into slices
of both, every slice pair being a task of its own; the partial answers are merged per query.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grafonda.session import materialise


@dataclass
class Index:
    """Bounded model data: centroids (lists x dim), cell of each list, lists that a query at home in each list visits."""

    centroids: np.ndarray
    cells: np.ndarray
    reach: np.ndarray

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]


def nearest(x: np.ndarray, centres: np.ndarray, count: int = 1) -> np.ndarray:
    """Numbers of the `count` centres nearest to each row, nearest first."""
    out = np.empty((len(x), count), np.int32)
    half = (centres**2).sum(1) / 2
    for at in range(0, len(x), 4096):
        far = half - x[at : at + 4096] @ centres.T
        if count == 1:
            out[at : at + 4096, 0] = far.argmin(1)
        else:
            some = np.argpartition(far, count - 1, axis=1)[:, :count]
            order = np.take_along_axis(far, some, 1).argsort(1)
            out[at : at + 4096] = np.take_along_axis(some, order, 1)
    return out


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = nearest(x, centres)[:, 0]
        order = np.argsort(at, kind="stable")
        count = np.bincount(at, minlength=k)
        full = np.flatnonzero(count)
        start = np.cumsum(count) - count
        centres[full] = np.add.reduceat(x[order], start[full], axis=0) / count[full, None]
        if (empty := np.flatnonzero(count == 0)).size:
            centres[empty] = x[rng.choice(len(x), len(empty))]
    return centres.astype(np.float32)


def fit(sample: np.ndarray, lists: int, cells: int, seed: int = 11) -> Index:
    rng = np.random.default_rng(seed)
    centroids = kmeans(sample, lists, 10, rng)
    of = nearest(centroids, kmeans(centroids, cells, 15, rng))[:, 0] if cells > 1 else np.zeros(lists, np.int32)
    return Index(centroids, of, np.ones(lists, np.int64))


def reach(index: Index, x: np.ndarray, ask: np.ndarray, found: np.ndarray, probes: int, cover: float) -> np.ndarray:
    """Lists to visit from each list: up to the rank that holds `cover` of the true nearest of the asking vectors around it.

    `found` is the list of one of the nearest of vector `ask`. Counts are doubled from `probes` up
    until they suffice, so that there are few different ones.
    """
    lists = len(index.centroids)
    half = (index.centroids**2).sum(1) / 2
    home, rank = np.zeros(len(ask), np.int64), np.zeros(len(ask), np.int64)
    for at in range(0, len(ask), 1024):
        far = half - x[ask[at : at + 1024]] @ index.centroids.T
        home[at : at + 1024] = far.argmin(1)
        rank[at : at + 1024] = 1 + (far < np.take_along_axis(far, found[at : at + 1024, None], 1)).sum(1)
    by = np.argsort(home, kind="stable")
    ranks = np.split(rank[by], np.cumsum(np.bincount(home, minlength=lists))[:-1])
    pool = min(lists, max(8, math.ceil(32 * lists / max(1, len(x)))))
    needed = np.full(lists, probes, np.int64)
    for i, around in enumerate(nearest(index.centroids, index.centroids, pool)):
        if len(here := np.concatenate([ranks[j] for j in around])):
            needed[i] = np.quantile(here, cover, method="higher")
    doubled = np.ceil(np.log2(np.maximum(needed / probes, 1)))
    return np.minimum(lists, probes * 2**doubled).astype(np.int64)


def _true_nearest(x: np.ndarray, n: np.ndarray, k: int):
    """(ask, ds, lists): of every asking vector the k most similar of a partition, with their lists; `n` ascends."""

    def run(batches):
        who, score, of = np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.int32)
        low = np.full(len(x), -2, np.float32)
        for batch in batches:
            vectors, lists, own = _matrix(batch.column("vector"), np.float32, x.shape[1]), batch.column("list").to_numpy(), batch.column("n").to_numpy()
            for at in range(0, len(vectors), 512):
                s = x @ vectors[at : at + 512].T
                place = np.minimum(np.searchsorted(n, own[at : at + 512]), len(n) - 1)
                itself = np.flatnonzero(n[place] == own[at : at + 512])
                s[place[itself], itself] = -2
                row, col = np.nonzero(s > low[:, None])
                who, score, of = np.r_[who, row], np.r_[score, s[row, col]], np.r_[of, lists[at + col]]
                by = _best_first(who, score)
                by = by[_place(who[by]) < k]
                who, score, of = who[by], score[by], of[by]
                count = np.bincount(who, minlength=len(x))
                full = count == k
                low[full] = score[np.cumsum(count)[full] - 1]
        if len(who):
            edge = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            offsets = pa.array(np.r_[edge, len(who)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(who[edge]), *(pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (-score, of))], names=["ask", "ds", "lists"])

    return run


def _measured_reach(vectors: DataFrame, index: Index, total: int, asks: int, k: int, probes: int, cover: float) -> np.ndarray:
    some = vectors.select("n", "vector").sample(min(1.0, asks / max(total, 1)), 23).toArrow().sort_by("n")
    n, x = some.column("n").to_numpy(), _matrix(some.column("vector"), np.float32, index.dim) if len(some) else np.zeros((0, index.dim), np.float32)
    if not len(n) or len(index.centroids) <= probes:
        return np.full(len(index.centroids), min(probes, len(index.centroids)), np.int64)
    shared = vectors.sparkSession.sparkContext.broadcast((x, n))
    each = vectors.select("n", "list", "vector").mapInArrow(lambda batches: _true_nearest(*shared.value, k)(batches), "ask long, ds array<float>, lists array<int>")
    zipped = F.arrays_zip(F.flatten(F.collect_list("ds")).alias("d"), F.flatten(F.collect_list("lists")).alias("l"))
    best = each.groupBy("ask").agg(F.slice(F.sort_array(zipped), 1, k).alias("top")).select("ask", F.explode("top.l").alias("l")).toArrow()
    return reach(index, x, best.column("ask").to_numpy(), best.column("l").to_numpy().astype(np.int64), probes, cover)


def probed(x: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(row, list): the lists that each row visits."""
    half = (index.centroids**2).sum(1) / 2
    row, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(x), 4096):
        far = half - x[at : at + 4096] @ index.centroids.T
        reach = index.reach[far.argmin(1)]
        for count in np.unique(reach):
            mine = np.flatnonzero(reach == count)
            if count < len(index.centroids):
                lists = np.argpartition(far[mine], count - 1, axis=1)[:, :count]
            else:
                lists = np.broadcast_to(np.arange(count), (len(mine), count))
            row.append(np.repeat(at + mine, count)), of.append(lists.ravel())
    return np.concatenate(row), np.concatenate(of)


def unit_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors) of the usable values: `dim` finite numbers, not all zero."""
    lengths = np.diff(column.offsets.to_numpy())
    ok = np.flatnonzero((lengths == dim) & column.is_valid().to_numpy(zero_copy_only=False))
    flat = column.values.to_numpy(zero_copy_only=False)
    x = flat[(column.offsets.to_numpy()[ok, None] + np.arange(dim))] if len(ok) else np.zeros((0, dim))
    x = x.astype(np.float64)
    norm = np.sqrt((x**2).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return ok[good], (x[good] / norm[good, None]).astype(np.float32)


def _encode(index: Index):
    def run(batches):
        for batch in batches:
            rows, x = unit_vectors(batch.column("vector"), index.dim)
            if not len(rows):
                continue
            home = nearest(x, index.centroids)[:, 0]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows)), pa.array(home), pa.array(index.cells[home]), _binary(x)],
                names=["id", "list", "cell", "vector"],
            )

    return run


def _binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    width = x.itemsize * x.shape[1]
    offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * width)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, offsets.buffers()[1], pa.py_buffer(x)])


def _narrow(x: np.ndarray) -> pa.Array:
    """Vectors as 16-bit fixed-point numbers and their scale: half the room, cosines off by less than 1e-5."""
    scale = np.maximum(np.abs(x).max(1, keepdims=True), 1e-30).astype(np.float32) / np.float32(32767)
    return _binary(np.concatenate([np.rint(x / scale).astype(np.int16).view(np.uint8), scale.view(np.uint8)], 1))


def _vectors(column, dim: int) -> np.ndarray:
    """Vectors of a column that holds wide (float32) and narrow ones."""
    column = column.combine_chunks() if not isinstance(column, pa.Array) else column
    wide = pc.equal(pc.binary_length(column), 4 * dim)
    at = wide.to_numpy(zero_copy_only=False)
    x = np.empty((len(column), dim), np.float32)
    x[at] = _matrix(column.filter(wide), np.float32, dim)
    raw = _matrix(column.filter(pc.invert(wide)), np.uint8, 2 * dim + 4)
    if len(raw):
        x[~at] = np.ascontiguousarray(raw[:, : 2 * dim]).view(np.int16) * np.ascontiguousarray(raw[:, 2 * dim :]).view(np.float32)
    return x


def _visits(index: Index):
    """One row per (vector, other cell that it probes)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vector"), np.float32, index.dim)
            home = batch.column("cell").to_numpy()
            cells = int(index.cells.max()) + 1
            row, of = probed(x, index)
            row, col = np.divmod(np.unique(row * cells + index.cells[of]), cells)
            other = col != home[row]
            row, col = row[other], col[other].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(col), batch.column("n").take(pa.array(row)), _narrow(x).take(pa.array(row))],
                names=["cell", "n", "vector"],
            )

    return run


def _matrix(column, kind, width: int) -> np.ndarray:
    if not isinstance(column, pa.Array):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros((0, width), kind)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(-1, width)


def _best_first(who: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Order by `who`, then descending score: both in one 64-bit number, which sorts far faster than two keys."""
    bits = np.ascontiguousarray(score, np.float32).view(np.int32)
    rising = np.where(bits < 0, bits ^ np.int32(0x7FFFFFFF), bits).astype(np.int64)
    return np.argsort((who.astype(np.int64) << 32) | (0x7FFFFFFF - rising))


def _place(who: np.ndarray) -> np.ndarray:
    """Place of each row within its run of equal values."""
    first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, np.int64)
    return np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)]))


def _answer(index: Index, k: int):
    """Best k of a slice of one cell for every query that visits it."""
    most = k + 1  # the query itself may be among them

    def run(table: pa.Table) -> pa.Table:
        number = table.column("n").to_numpy()
        x = _vectors(table.column("vector"), index.dim)
        indexed = np.flatnonzero(table.column("indexed").to_numpy(zero_copy_only=False))
        asks = np.flatnonzero(table.column("asks").to_numpy(zero_copy_only=False))
        base = x[indexed]
        lists = table.column("list").to_numpy(zero_copy_only=False)[indexed].astype(np.int64)
        order = np.argsort(lists, kind="stable")
        present, start = np.unique(lists[order], return_index=True)
        stop = np.r_[start[1:], len(order)]
        place = np.full(len(index.centroids), -1)
        place[present] = np.arange(len(present))
        ordered = base[order]
        asked, best_n, best_s = [], [], []
        for at in range(0, len(asks), 1024):
            rows = asks[at : at + 1024]
            q = x[rows]
            who, what, score = [], [], []
            ask, of = probed(q, index)
            of = place[of]
            ask, of = ask[of >= 0], of[of >= 0]
            by = np.argsort(of, kind="stable")
            ask, of = ask[by], of[by]
            bounds = np.searchsorted(of, np.arange(len(present) + 1))
            for p in range(len(present)):
                mine = ask[bounds[p] : bounds[p + 1]]
                if not len(mine):
                    continue
                members = order[start[p] : stop[p]]
                s = q[mine] @ ordered[start[p] : stop[p]].T
                if len(members) > most:
                    top = np.argpartition(s, len(members) - most, axis=1)[:, -most:]
                    s, chosen = np.take_along_axis(s, top, 1), members[top]
                else:
                    chosen = np.broadcast_to(members, s.shape)
                who.append(np.repeat(mine, s.shape[1]))
                what.append(chosen.ravel())
                score.append(s.ravel())
            if not who:
                continue
            who, what, score = np.concatenate(who), np.concatenate(what), np.concatenate(score)
            by = _best_first(who, score)
            who, what = who[by], what[by]
            keep = _place(who) < most
            who, what = who[keep], what[keep]
            exact = np.einsum("ij,ij->i", q[who], base[what])
            other = number[indexed[what]]
            use = other != number[rows[who]]
            who, other, exact = who[use], other[use], exact[use]
            by = _best_first(who, exact)
            who, other, exact = who[by], other[by], exact[by]
            keep = _place(who) < k
            asked.append(number[rows[who[keep]]]), best_n.append(other[keep]), best_s.append(exact[keep])
        asked = np.concatenate(asked) if asked else np.zeros(0, np.int64)
        best_n = np.concatenate(best_n) if best_n else np.zeros(0, np.int64)
        best_s = np.concatenate(best_s) if best_s else np.zeros(0, np.float32)
        edge = np.flatnonzero(np.r_[True, asked[1:] != asked[:-1]]) if len(asked) else np.zeros(0, np.int64)
        offsets = pa.array(np.r_[edge, len(asked)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (-best_s.astype(np.float32), best_n)]
        return pa.table({"n": asked[edge], "ds": lists[0], "ns": lists[1]})

    return run


SUPERSEDED_BROADCAST = 500_000


def _latest_in_files(rows: DataFrame, id_col: str, vector_col: str, at_col: str) -> DataFrame | None:
    """Latest rows of a file-based table without moving a vector: places of superseded rows are found from ids and times alone.

    They are usually few: counted, they are broadcast up to a bound and joined by exchange beyond it.
    None if the rows do not come straight from files.
    """
    try:
        placed = rows.select("*", F.xxhash64("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_p"))
        placed.schema
    except AnalysisException:
        return None
    w = Window.partitionBy(id_col).orderBy(F.desc_nulls_last(at_col), "_f", "_p")
    narrow = placed.where(F.col(id_col).isNotNull()).select(id_col, at_col, "_f", "_p")
    old = materialise(narrow.withColumn("r", F.row_number().over(w)).where("r > 1").select("_f", "_p"), "superseded")
    old = F.broadcast(old) if old.count() <= SUPERSEDED_BROADCAST else old
    return placed.where(F.col(id_col).isNotNull()).join(old, ["_f", "_p"], "left_anti").select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))


def indexed_vectors(rows: DataFrame, id_col: str, vector_col: str, at_col: str | None = None) -> DataFrame:
    """(id, vector): of each id the value with the latest time; null times come first, of equal times one row counts."""
    vector = F.col(vector_col).cast("array<float>")
    if at_col is None:
        return rows.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(vector).alias("vector"))
    latest = _latest_in_files(rows, id_col, vector_col, at_col)
    if latest is not None:
        return latest
    return rows.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.struct(F.col(at_col), vector.alias("v"))).alias("_m")).select("id", F.col("_m.v").alias("vector"))


def _sample(rows: DataFrame, vector_col: str, dim: int, wanted: int, total: int) -> np.ndarray:
    share = min(1.0, 1.2 * wanted / max(total, 1))
    some = rows.select(F.col(vector_col).cast("array<float>").alias("vector")).where(F.size("vector") == dim)
    if share < 1:
        some = some.sample(share, 17)
    table = some.limit(wanted).toArrow()
    if not table.num_rows:
        return np.zeros((0, dim), np.float32)
    return unit_vectors(table.column("vector").combine_chunks(), dim)[1]


def most_similar(
    rows: DataFrame,
    id_col: str = "chunk_id",
    vector_col: str = "embedding",
    at_col: str | None = "embedded_at",
    k: int = 10,
    dim: int = 64,
    probes: int = 8,
    asks: int = 4096,
    cover: float = 0.99,
    list_rows: int = 256,
    cell_rows: int = 12000,
    max_lists: int = 16384,
    sample_per_list: int = 32,
    max_sample: int = 1 << 19,
    slice_rows: int = 40000,
    query_rows: int = 120000,
) -> tuple[DataFrame, DataFrame]:
    """(neighbours, vectors): neighbours has (n, top) with top up to k structs (d = -cosine, n), nearest first; vectors has (id, n).

    Of an id given several times only the row with the latest time counts, and only if it holds `dim`
    finite numbers that are not all zero; ids null, vectors null, empty, of another length, zero or
    with NaN are neither asked nor found. Equal vectors under different ids are neighbours of each
    other with cosine 1; of equal cosines at the end of a list some are taken, the same ones on every run. Fewer than k other vectors give fewer
    neighbours; an empty table gives none. Other columns are ignored.
    """
    spark = rows.sparkSession
    total = rows.count()
    lists = max(1, min(max_lists, total // list_rows))
    sample = _sample(rows, vector_col, dim, min(max_sample, max(4096, lists * sample_per_list)), total)
    if not len(sample):
        sample = np.eye(1, dim, dtype=np.float32)
    index = fit(sample, lists, max(1, min(lists, math.ceil(total / cell_rows))))
    shared = spark.sparkContext.broadcast(index)
    lazy = lambda make, *a: (lambda batches: make(shared.value, *a)(batches))
    vectors = materialise(
        indexed_vectors(rows, id_col, vector_col, at_col)
        .mapInArrow(lazy(_encode), "id string, list int, cell int, vector binary")
        .withColumn("n", F.monotonically_increasing_id()),
        "vectors",
    )
    index = Index(index.centroids, index.cells, _measured_reach(vectors, index, total, asks, k, probes, cover))
    shared_reach = spark.sparkContext.broadcast(index)
    lazy = lambda make, *a: (lambda batches: make(shared_reach.value, *a)(batches))
    visits = vectors.select("cell", "n", "vector").mapInArrow(lazy(_visits), "cell int, n long, vector binary")
    counts = lambda df: {r["cell"]: r["rows"] for r in df.groupBy("cell").agg(F.count("*").alias("rows")).collect()}  # noqa: E731  one row a cell
    held, visiting = counts(vectors), counts(visits)
    cut = {c: (math.ceil(n / slice_rows), math.ceil((n + visiting.get(c, 0)) / query_rows)) for c, n in held.items()}
    cut = {c: parts for c, parts in cut.items() if parts != (1, 1)}
    both = vectors.select("cell", "n", "list", "vector", F.lit(True).alias("indexed"), F.lit(True).alias("asks")).unionByName(
        visits.withColumns({"list": F.lit(None).cast("int"), "indexed": F.lit(False), "asks": F.lit(True)})
    )
    both = _cut(both, cut)
    run = _answer
    answered = (
        both.groupBy("cell", "v", "q")
        .applyInArrow(lambda table: run(shared_reach.value, k)(table), "n long, ds array<float>, ns array<long>")
    )
    # two flat arrays travel in a third of the room of an array of structs
    zipped = F.arrays_zip(F.flatten(F.collect_list("ds")).alias("d"), F.flatten(F.collect_list("ns")).alias("n"))
    merged = answered.groupBy("n").agg(F.slice(F.sort_array(zipped), 1, k).cast("array<struct<d:float,n:long>>").alias("top"))
    return merged, vectors.select("id", "n")


def _cut(both: DataFrame, cut: dict[int, tuple[int, int]]) -> DataFrame:
    """Adds v (slice of indexed vectors) and q (slice of queries); rows of cut cells are repeated once per slice of the other side."""
    whole = both.withColumns({"v": F.lit(0), "q": F.lit(0)})
    if not cut:
        return whole
    cells = F.create_map(*[x for c, (v, q) in cut.items() for x in (F.lit(c), F.struct(F.lit(v).alias("v"), F.lit(q).alias("q")))])
    parts = both.withColumn("parts", F.try_element_at(cells, F.col("cell"))).where(F.col("parts").isNotNull())
    salt = lambda n: F.pmod(F.xxhash64("n"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asking = parts.where("asks").withColumns({"q": salt(F.col("parts.q")), "indexed": F.lit(False)}).withColumn("v", every(F.col("parts.v")))
    held = parts.where("indexed").withColumns({"v": salt(F.col("parts.v")), "asks": F.lit(False)}).withColumn("q", every(F.col("parts.q")))
    return whole.where(F.try_element_at(cells, F.col("cell")).isNull()).unionByName(asking.drop("parts")).unionByName(held.drop("parts"))


def neighbour_pairs(neighbours: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id_a, id_b, cosine): pairs of which one is among the nearest of the other, id_a < id_b in plain string order."""
    edges = (
        neighbours.select("n", F.explode("top").alias("t"))
        .select(F.least("n", "t.n").alias("a"), F.greatest("n", "t.n").alias("b"), (-F.col("t.d")).alias("cosine"))
        .repartition("a")  # pairs are grouped and the first name is joined where they then are
        .groupBy("a", "b")
        .agg(F.max("cosine").alias("cosine"))
    )
    named = edges.join(vectors.select(F.col("n").alias("a"), F.col("id").alias("x")), "a").join(vectors.select(F.col("n").alias("b"), F.col("id").alias("y")), "b")
    return named.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "cosine")
