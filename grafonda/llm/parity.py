"""Near-duplicate texts by minima of hashes, parity sketches and an exact check.

A text is the set of distinct three-character sequences of its plain form. Two sets A, B with a
Jaccard similarity of t or more differ in at most ``d = (1-t)/(1+t) * (|A|+|B|)`` elements.

* *Columns.* The element of least hash is the same in both sets with a probability equal to their
  similarity. A column is the minima of `ROWS` (7) hashes together; at similarity s two texts are
  equal in it with probability s^7. There are as many columns as it takes (`columns_for`, 184 at
  0.65) for all of them to miss a pair at the very limit with probability below ``MISS`` (1e-4); the
  loss falls fast above it (1.4e-7 at 0.7, 1.6e-19 at 0.8). Columns and hashes depend on the texts
  compared alone, never on the collection.
* *Chance meetings* grow with the square of the texts, so what counts is how many a pair of unlike
  texts has: texts of one template, at a similarity of 0.3, are equal in 0.04 columns.
* *Sketch.* Every element toggles one bit of a 192-bit vector (XOR of one-hot hashes). An element
  that both sets hold toggles the same bit in both, so the Hamming distance of two sketches never
  exceeds the symmetric difference: a pair farther apart than d is rejected without a loss.
* *Verify.* Candidates pass the sketch bound where they meet and then an exact comparison.

A text's number and sketch travel once for a *column group*: rows are packed by group, each with four
bytes a column, and a group sorts its columns in turn. The number of groups, of key ranges within a
column, and of passes over the texts (each pass's exchange is removed when its pairs are written)
follows the number of texts; it settles where and when texts meet, not which. Groups of one key larger
than ``tile`` rows are cut into tiles and compared tile by tile in separate tasks, so no key is a
bottleneck and none is dropped.
"""

from __future__ import annotations

import math
from contextlib import contextmanager
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafonda.functions.plainform import plain_udf
from grafonda.session import materialise

_SYMBOLS = 37
UNIVERSE = _SYMBOLS**3
ROWS = 7
MISS = 1e-4
_ENTRIES, _LEAST_GROUPS = 8_000_000, 12  # keys a task sorts; column groups of even the smallest collection
_HELD = 750_000  # texts whose heads a task holds
_TRAVEL = 800  # bytes of a text exchanged at once, beyond which its columns are met in several passes
_HEAD = 40  # bytes of a row's number, sketch and size


# The two functions below give the loss of partitions into blocks, which texts met in before columns; only a test uses them.
@cache
def _empty_block_fails(d: int, k: int) -> float:
    """Probability that d elements thrown into k blocks leave none of them untouched."""
    if d < k:
        return 0.0
    return max(0.0, float(sum((-1) ** j * math.comb(k, j) * (k - j) ** d for j in range(k + 1)) / k**d))


@cache
def blocks_for(d: int, partitions: int, miss: float = MISS) -> int:
    """Fewest blocks for which `partitions` independent partitions lose a pair of difference d with less than `miss`."""
    low, high = 1, d + 1
    while low < high:
        mid = (low + high) // 2
        if _empty_block_fails(d, mid) ** partitions < miss:
            high = mid
        else:
            low = mid + 1
    return low


@cache
def columns_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Fewest columns of `rows` minima for which all miss a pair at the threshold with less than `miss`."""
    each = threshold**rows
    return 1 if each >= 1 else math.floor(math.log(miss) / math.log1p(-each)) + 1


def layout(columns: int, forms: int) -> tuple[int, int]:
    """(column groups, key ranges a column) so that a task sorts about `_ENTRIES` keys and holds at most about `_HELD` texts."""
    tasks = max(_LEAST_GROUPS, -(-columns * forms // _ENTRIES))
    ranges = max(-(-tasks // columns), -(-forms // _HELD))
    return (columns, ranges) if ranges > 1 else (tasks, 1)


def passes(columns: int, forms: int) -> list[range]:
    """The column groups of each pass: about `_TRAVEL` bytes of a text are exchanged at once."""
    groups = layout(columns, forms)[0]
    number = min(groups, -(-(groups * _HEAD + 4 * columns) // _TRAVEL))
    return [range(i * groups // number, (i + 1) * groups // number) for i in range(number)]


def _codes(text: bytes) -> np.ndarray:
    """Distinct trigram codes of a plain form, ascending."""
    raw = np.frombuffer(text, np.uint8).astype(np.int32)
    c = np.where(raw == 32, 0, np.where(raw < 58, raw - 47, raw - 86))
    return np.unique((c[:-2] * _SYMBOLS + c[1:-1]) * _SYMBOLS + c[2:])


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, code) of the distinct trigrams of plain forms, ascending, and their number in each form."""
    raw = np.frombuffer("\n".join([*texts, ""]).encode(), np.uint8)  # no plain form holds a line feed
    c = np.where(raw == 32, 0, np.where(raw < 58, raw.astype(np.int64) - 47, raw.astype(np.int64) - 86))
    end = raw == 10
    owner = np.cumsum(end) - end
    inside = ~(end[:-2] | end[1:-1] | end[2:])
    key = np.sort((owner[:-2] << 16 | (c[:-2] * _SYMBOLS + c[1:-1]) * _SYMBOLS + c[2:])[inside])
    key = key[np.r_[True, key[1:] != key[:-1]][: len(key)]]
    owner, code = key >> 16, key & 0xFFFF
    return owner, code, np.bincount(owner, minlength=len(texts))


@cache
def _bits() -> np.ndarray:
    """The fixed pseudo-random bit of the sketch of every trigram."""
    return np.random.Generator(np.random.PCG64(20240229)).integers(0, 192, UNIVERSE)


def _sketches(owner: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    bit = _bits()[codes]
    odd = (np.bincount(owner * 192 + bit, minlength=n * 192) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, 192), axis=1, bitorder="little").view(np.uint64)


def _mixed(key: np.ndarray) -> np.ndarray:
    key = key ^ (key >> np.uint64(30))
    key *= np.uint64(0xBF58476D1CE4E5B9)
    key ^= key >> np.uint64(27)
    key *= np.uint64(0x94D049BB133111EB)
    return key ^ (key >> np.uint64(31))


def _ranks(codes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """(code, hash): the 16-bit rank of every trigram in every hash. Equal ranks let texts meet more often, not less."""
    return (_mixed((hashes.astype(np.uint64) << np.uint64(16) | codes.astype(np.uint64)[:, None]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)


_STRETCH = 256  # texts, alike in size, whose minima are taken together


def _minima(sizes: np.ndarray, place: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """(text, hash): least rank of the trigrams of every text; `place` is the row of `ranks` of each of them."""
    out = np.empty((len(sizes), ranks.shape[1]), np.uint16)
    start, order = np.cumsum(sizes) - sizes, np.argsort(sizes, kind="stable")
    for first in range(0, len(order), _STRETCH):
        some = order[first : first + _STRETCH]
        least = np.full((len(some), ranks.shape[1]), 0xFFFF, np.uint16)
        row = np.empty_like(least)
        for step in range(int(sizes[some[-1]])):  # a shorter text repeats its last trigram
            np.take(ranks, place[start[some] + np.minimum(step, sizes[some] - 1)], axis=0, out=row, mode="clip")
            np.minimum(least, row, out=least)
        out[some] = least
    return out


def _signatures(columns: int, rows: int, forms: int, chosen: range):
    """Heads and keys of the `chosen` column groups."""
    groups, ranges = layout(columns, forms)
    weights = _mixed(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)

    def emit(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("form").to_numpy()
            owner, codes, sizes = _trigrams(batch.column("plain").to_pylist())
            head = np.stack([ids.view(np.uint64), *_sketches(owner, codes, len(ids)).T, sizes.astype(np.uint64)])
            held = np.bincount(codes, minlength=UNIVERSE) > 0
            place, held = (np.cumsum(held) - 1)[codes], np.flatnonzero(held)
            hashes = [(own[:, None] * rows + np.arange(rows)).ravel() for own in (np.arange(g, columns, groups) for g in chosen)]
            ranks = np.empty((len(held), sum(map(len, hashes))), np.uint16)
            until = np.cumsum([len(own) for own in hashes])
            for own, end in zip(hashes, until):
                ranks[:, end - len(own) : end] = _ranks(held, own)
            minima = _minima(sizes, place, ranks)
            bucket, width, packed = [], [], []
            for g, own, end in zip(chosen, hashes, until):
                least = minima[:, end - len(own) : end].reshape(len(ids), -1, rows)
                keys = np.zeros((least.shape[1], len(ids)), np.uint64)
                for r in range(rows):
                    keys += least[:, :, r].T * weights[r]
                keys = _mixed(keys)
                for part in range(ranges):  # more than one range only where a group is one column
                    some = slice(None) if ranges == 1 else np.flatnonzero(keys[0] % np.uint64(ranges) == part)
                    bucket.append(g * 100_000 + part)
                    width.append(len(keys))
                    packed.append(head[:, some].tobytes() + (keys[:, some] >> np.uint64(32)).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(width, pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "columns", "packed"])

    return emit


SIGNATURE = "bucket long, columns int, packed binary"


_SMALL, _CHUNK = 64, 256


def _kept(i, j, far, form, n, threshold):
    """Of row pairs (i, j) with sketch distance `far`, those that may be similar: each pair's own bound."""
    ok = (far <= np.floor((1 - threshold) / (1 + threshold) * (n[i] + n[j]) + 1e-9)) & (form[i] != form[j])
    i, j = i[ok], j[ok]
    return np.minimum(form[i], form[j]), np.maximum(form[i], form[j])


def _block(left: slice, right: slice, form, n, s, threshold):
    """Row pairs of two stretches, each ascending in size, by whole matrices of sketch distances; one bound for all first, then each pair's own."""
    if min(n[left.stop - 1], n[right.stop - 1]) < threshold * max(n[left.start], n[right.start]):  # sizes too unlike
        return form[:0], form[:0]
    far = np.bitwise_count(s[0][left, None] ^ s[0][None, right])
    far += np.bitwise_count(s[1][left, None] ^ s[1][None, right])
    far += np.bitwise_count(s[2][left, None] ^ s[2][None, right])
    most = int((1 - threshold) / (1 + threshold) * (int(n[left.stop - 1]) + int(n[right.stop - 1])) + 1e-9)
    i, j = np.nonzero(far <= min(most, 255))
    near = far[i, j]
    i, j = i + left.start, j + right.start
    later = j > i
    return _kept(i[later], j[later], near[later], form, n, threshold)


def _unpacked(group: pa.Table):
    """(head rows, keys) of a bucket, ascending in size."""
    heads, keys = [], []
    for columns, packed in zip(group.column("columns").to_pylist(), (p.as_buffer() for p in group.column("packed"))):
        rows = packed.size // (_HEAD + 4 * columns)
        heads.append(np.frombuffer(packed, np.uint64, 5 * rows).reshape(5, rows))
        keys.append(np.frombuffer(packed, np.uint32, columns * rows, _HEAD * rows).reshape(columns, rows))
    order = np.argsort(np.concatenate([h[4] for h in heads]), kind="stable")
    return [np.concatenate([h[w] for h in heads])[order] for w in range(5)], order, keys


def _join(threshold: float, tile: int):
    """Meets the rows of one bucket column by column: pairs of small groups come out as (a, b), rows of a group over `tile` deferred."""

    def meet(group: pa.Table) -> pa.Table:
        head, order, keys = _unpacked(group)
        bucket = group.column("bucket")[0].as_py()
        ids, sizes = head[0].view(np.int64), head[4].astype(np.int32)
        # no partner that fits is larger than n / threshold
        limit = np.minimum((1 - threshold) / (1 + threshold) * (sizes + sizes / threshold) + 1e-9, 255).astype(np.uint8)
        found, deferred = [], []
        for at in range(len(keys[0])):
            key = np.concatenate([k[at] for k in keys])[order]
            # one word holds key and place, so that equal keys come in ascending size
            both = np.sort(key.astype(np.uint64) << np.uint64(32) | np.arange(len(key), dtype=np.uint64))
            key, place = both >> np.uint64(32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
            same = key[1:] == key[:-1]
            some = np.r_[False, same] | np.r_[same, False]
            if not some.any():
                continue
            key, place = key[some], place[some]
            form, n, most, s = ids[place], sizes[place], limit[place], [w[place] for w in head[1:4]]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            length = np.diff(np.r_[start, len(key)])
            # small groups: all rows against the rows a step behind that have the same key, step after step
            i, last = np.flatnonzero(np.repeat(length <= _SMALL, length)), np.repeat(start + length, length)
            for lag in range(1, _SMALL):
                i = i[i + lag < last[i]]
                if not len(i):
                    break
                far = np.bitwise_count(s[0][i] ^ s[0][i + lag])
                far += np.bitwise_count(s[1][i] ^ s[1][i + lag])
                far += np.bitwise_count(s[2][i] ^ s[2][i + lag])
                near = far <= most[i]
                found.append(_kept(i[near], i[near] + lag, far[near], form, n, threshold))
            for first, size in zip(start[length > _SMALL].tolist(), length[length > _SMALL].tolist()):
                if size > tile:
                    rows = slice(first, first + size)
                    name = hash((bucket, at, int(key[first])))
                    deferred.append((form[rows], np.full(size, name), (np.arange(size) // tile).astype(np.int32), n[rows], *(w[rows].view(np.int64) for w in s)))
                    continue
                for x in range(first, first + size, _CHUNK):
                    for y in range(x, first + size, _CHUNK):
                        found.append(_block(slice(x, min(x + _CHUNK, first + size)), slice(y, min(y + _CHUNK, first + size)), form, n, s, threshold))
        a, b = (np.concatenate([p[side] for p in found] or [np.zeros(0, np.int64)]) for side in (0, 1))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
        rest = [np.concatenate(x) for x in zip(*deferred)] or [np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32, np.int64, np.int64, np.int64)]
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        pairs = [pa.array(a[new]), pa.array(b[new]), *(pa.nulls(int(new.sum()), t) for t in types)]
        rows = [pa.array(rest[0]), pa.nulls(len(rest[0]), pa.int64()), *(pa.array(x) for x in rest[1:])]
        names = ["a", "b", "key", "part", "n", "s0", "s1", "s2"]
        return pa.concat_tables([pa.Table.from_arrays(pairs, names=names), pa.Table.from_arrays(rows, names=names)])

    return meet


DEFERRED = "a long, b long, key long, part int, n int, s0 long, s1 long, s2 long"


def _tiles(threshold: float):
    """Compares two tiles of one large group."""
    import pandas as pd

    def compare(both: pd.DataFrame) -> pd.DataFrame:
        both = both.sort_values(["right", "n"], kind="stable")
        split, size = int((~both["right"]).sum()), len(both)
        form, n = (both[c].to_numpy() for c in ("form", "n"))
        s = [np.ascontiguousarray(both[f"s{w}"].to_numpy(np.int64)).view(np.uint64) for w in range(3)]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for x in range(0, split, _CHUNK):
            for y in range(split, size, _CHUNK):
                out.append(_block(slice(x, min(x + _CHUNK, split)), slice(y, min(y + _CHUNK, size)), form, n, s, threshold))
        return pd.DataFrame({"a": np.concatenate([a for a, _ in out]), "b": np.concatenate([b for _, b in out])})

    return compare


def _deferred_pairs(deferred: DataFrame, threshold: float) -> DataFrame:
    rows = deferred.select("key", F.col("a").alias("form"), "part", "n", "s0", "s1", "s2")
    parts = rows.groupBy("key").agg(F.max("part").alias("last"))
    spread = rows.join(parts, "key")
    cols = ["key", "form", "n", "s0", "s1", "s2", "lo", "hi", "right"]
    left = spread.withColumns({"hi": F.explode(F.sequence("part", "last")), "lo": F.col("part"), "right": F.lit(False)})
    right = spread.withColumns({"lo": F.explode(F.sequence(F.lit(0), "part")), "hi": F.col("part"), "right": F.lit(True)})
    both = left.select(cols).union(right.select(cols))
    return both.groupBy("key", "lo", "hi").applyInPandas(_tiles(threshold), "a long, b long")


def _verify(threshold: float):
    def check(batches):
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            (owner_a, code_a, size_a), (owner_b, code_b, size_b) = (_trigrams(batch.column(c).to_pylist()) for c in ("plain_a", "plain_b"))
            keys = np.sort(np.concatenate([owner_a * UNIVERSE + code_a, owner_b * UNIVERSE + code_b]))
            shared = np.bincount(keys[1:][keys[1:] == keys[:-1]] // UNIVERSE, minlength=rows)
            union = size_a + size_b - shared
            similarity = shared / np.maximum(union, 1)
            # compared in whole numbers: 100 shared >= 65 union, without rounding
            ok = shared * 10**6 >= round(threshold * 10**6) * union
            yield pa.RecordBatch.from_arrays(
                [batch.column("form_a").filter(pa.array(ok)), batch.column("form_b").filter(pa.array(ok)), pa.array(similarity[ok])],
                names=["form_a", "form_b", "similarity"],
            )

    return check


def plain_forms(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, plain, form): every distinct id with its plain form of three or more characters and that form's number."""
    return (
        rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
        .where(F.col("id").isNotNull())
        .dropDuplicates(["id", "_text"])
        .select("id", plain_udf("_text").alias("plain"))
        .where(F.length("plain") >= 3)
        .select("id", "plain", F.xxhash64("plain").alias("form"))
        .distinct()
    )


@contextmanager
def _exchange_removed(spark: SparkSession):
    """Exchanged rows of a query run within are removed as soon as it ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def similar_forms(members: DataFrame, threshold: float = 0.65, tile: int = 8192, rows: int = ROWS) -> DataFrame:
    """(form_a, form_b, similarity) of different plain forms at or above the threshold, form_a < form_b.

    ``members`` as from `plain_forms`. Form numbers are 64-bit hashes; should two forms share one,
    both are compared as that number's texts, so a collision can add a pair but not lose one.
    """
    forms = materialise(members.select("form", "plain").distinct(), "forms")
    count, columns = forms.count(), columns_for(threshold, rows)
    ranges, parts = layout(columns, count)[1], []
    for chosen in passes(columns, count):
        with _exchange_removed(forms.sparkSession):
            signatures = forms.select("form", "plain").mapInArrow(_signatures(columns, rows, count, chosen), SIGNATURE)
            found = signatures.repartition(2 * len(chosen) * ranges, "bucket").groupBy("bucket").applyInArrow(_join(threshold, tile), DEFERRED)
            parts.append(materialise(found.distinct(), "parity"))  # much alike texts meet in many groups
    met = reduce(DataFrame.unionAll, parts)
    near = met.where(F.col("b").isNotNull()).select("a", "b").union(_deferred_pairs(met.where(F.col("b").isNull()), threshold)).distinct()
    return (
        near.join(forms.select(F.col("form").alias("a"), F.col("plain").alias("plain_a")), "a")
        .join(forms.select(F.col("form").alias("b"), F.col("plain").alias("plain_b")), "b")
        .select(F.col("a").alias("form_a"), F.col("b").alias("form_b"), "plain_a", "plain_b")
        .mapInArrow(_verify(threshold), "form_a long, form_b long, similarity double")
    )


def _copies(who: DataFrame, tile: int = 4096) -> DataFrame:
    """(x, y, similarity): all pairs x < y of ids with one form; a form of more than `tile` ids is met part by part in separate tasks."""
    large = who.groupBy("form").agg(F.ceil(F.count("*") / tile).alias("parts")).where("parts > 1")
    salted = who.join(large, "form", "left").select("id", "form", F.coalesce("parts", F.lit(1)).alias("parts"))
    mine, every = F.pmod(F.xxhash64("id"), "parts"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    a = salted.select(F.col("id").alias("x"), "form", mine.alias("s"), every.alias("t"))
    b = salted.select(F.col("id").alias("y"), "form", mine.alias("t"), every.alias("s"))
    return a.join(b, ["form", "s", "t"]).where("x < y").select("x", "y", F.lit(1.0).alias("similarity"))


def near_duplicate_pairs(rows: DataFrame, id_col: str, text_col: str, threshold: float = 0.65) -> DataFrame:
    """(id_a, id_b, similarity): every pair of different ids whose texts are similar, id_a < id_b in plain string order.

    Null ids and forms under three characters (null and empty texts too) are in no pair; repeated
    rows of an id count once; an id given with several texts pairs by any of them; texts of any
    length are compared whole; other columns are ignored; an empty table gives no pair.
    """
    members = materialise(plain_forms(rows, id_col, text_col), "forms")
    links = similar_forms(members, threshold)
    who = members.select("id", "form")
    a = who.select(F.col("id").alias("x"), F.col("form").alias("form_a"))
    b = who.select(F.col("id").alias("y"), F.col("form").alias("form_b"))
    across = links.join(a, "form_a").join(b, "form_b").select("x", "y", "similarity")
    copies = _copies(who)
    return (
        across.where("x <> y")
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")
        .union(copies)
        .groupBy("id_a", "id_b")
        .agg(F.max("similarity").alias("similarity"))
    )
