"""Graph patterns as joins and aggregations over edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafonda.session import materialise, tasks_for


def cooccurrence(mentions: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, weight): pairs a < b of entities and the chunks that mention both; `mentions(chunk_id, entity)` distinct."""
    left, right = mentions.select("chunk_id", F.col("entity").alias("a")), mentions.select("chunk_id", F.col("entity").alias("b"))
    return left.join(right, "chunk_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def bridges(page_entity: DataFrame) -> DataFrame:
    """(page1, entity, page2): ordered pairs of different pages with a common entity; pages and entities met once each."""
    pe = page_entity.select("page_id", "entity").distinct()
    return pe.select(F.col("page_id").alias("page1"), "entity").join(pe.select(F.col("page_id").alias("page2"), "entity"), "entity").where("page1 <> page2")


def link_candidates(page_entity: DataFrame, links: DataFrame, least: int = 2, undirected: bool = False) -> DataFrame:
    """(page1, page2, shared): pairs page1 < page2 with `least` common entities or more and no link yet from the first to the second."""
    shared = bridges(page_entity).where("page1 < page2").groupBy("page1", "page2").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    known = links.select(F.col("src").alias("page1"), F.col("dst").alias("page2"))
    if undirected:
        known = known.union(links.select(F.col("dst").alias("page1"), F.col("src").alias("page2")))
    return shared.join(known, ["page1", "page2"], "left_anti")


def accepted_links(links: DataFrame, candidates: DataFrame, accept: Column) -> DataFrame:
    """(src, dst, rel_type, predicted): the links, and the candidates (page1, page2, ...) that `accept` holds for."""
    new = candidates.where(accept).select(F.col("page1").alias("src"), F.col("page2").alias("dst"), F.lit(True).alias("predicted"))
    return links.select("src", "dst", F.lit(False).alias("predicted")).unionByName(new).select("src", "dst", F.lit("LINKS_TO").alias("rel_type"), "predicted")


def temporal_neighbour(events: DataFrame, op: str, year: int) -> DataFrame:
    """(centre, node, year): of a centre's events (centre, node, year) that compare with `year` as asked, the nearest one, ties by node."""
    tests = {">": F.col("year") > year, ">=": F.col("year") >= year, "<": F.col("year") < year, "<=": F.col("year") <= year, "=": F.col("year") == year}
    near = F.col("year") if op.startswith(">") else -F.col("year")
    return events.where(tests[op]).groupBy("centre").agg(F.min_by(F.struct("node", "year"), F.struct(near.alias("y"), "node")).alias("s")).select("centre", "s.node", "s.year")


def gold_answers(relations: DataFrame, bridges: dict[str, tuple[str, ...]], shared: dict[str, str]) -> DataFrame:
    """(reasoning, entity, answer): ends of relation paths by reasoning type, and common sources of two targets ("x & y")."""
    out = None
    for reasoning, path in bridges.items():
        step = lambda rel: relations.where(F.col("rel_type") == rel)
        rows = step(path[0]).select(F.col("src").alias("entity"), F.col("dst").alias("answer"))
        for rel in path[1:]:
            rows = rows.join(step(rel).select(F.col("src").alias("answer"), F.col("dst").alias("_next")), "answer").select("entity", F.col("_next").alias("answer"))
        rows = rows.select(F.lit(reasoning).alias("reasoning"), "entity", "answer").distinct()
        out = rows if out is None else out.unionAll(rows)
    for reasoning, rel in shared.items():
        one = relations.where(F.col("rel_type") == rel).select("src", "dst").distinct()
        rows = one.select("src", F.col("dst").alias("x")).join(one.select("src", F.col("dst").alias("y")), "src").where("x < y").select(F.lit(reasoning).alias("reasoning"), F.concat_ws(" & ", "x", "y").alias("entity"), F.col("src").alias("answer"))
        out = rows if out is None else out.unionAll(rows)
    return out


def neighbourhood(centres: DataFrame, mentions: DataFrame, hops: int = 1) -> DataFrame:
    """(centre, hop, entity): entities met in a chunk with the centre (hop 1) or with one of those (hop 2), nearest hop only.

    Starts from the centres: their chunks, then the names in those, distinct at every step, so that
    only what the centres reach is joined.
    """
    if hops > 1:
        return _two_hops(centres, mentions)
    places = mentions.select(F.col("entity").alias("x"), "chunk_id")

    def onward(rows: DataFrame) -> DataFrame:
        chunks = rows.join(places, "x").select("centre", "chunk_id").distinct()
        return chunks.join(mentions.select("chunk_id", "entity"), "chunk_id").select("centre", "entity").distinct().where("entity <> centre")

    first = onward(centres.select(F.col("entity").alias("centre"), F.col("entity").alias("x")).distinct())
    return first.select("centre", F.lit(1).alias("hop"), "entity")


#: centres up to which their names travel to all tasks
_NAMED = 50_000


def _two_hops(centres: DataFrame, mentions: DataFrame) -> DataFrame:
    """`neighbourhood` of two hops with 64 centres to a word of bits: a row is what a chunk or name has of a word, not of a centre.

    Most pairs of a centre and a name two hops away are met in many chunks; as bits they are united
    where they meet and become rows only at the end.
    """
    named = materialise(numbered(centres.where("entity is not null").select(F.col("entity").alias("centre")).distinct(), "centre").select("centre", F.shiftright("place", 6).alias("w"), F.col("place").bitwiseAND(63).cast("int").alias("bit")), "centres")
    met = materialise(mentions.select("chunk_id", "entity"), "met")
    own = named.select(F.col("centre").alias("entity"), "w", F.expr("shiftleft(1L, bit)").alias("bits"))

    def onward(rows: DataFrame) -> DataFrame:
        chunks = rows.join(met, "entity").groupBy("chunk_id", "w").agg(F.bit_or("bits").alias("bits"))
        return chunks.join(met, "chunk_id").groupBy("entity", "w").agg(F.bit_or("bits").alias("bits"))

    def without(rows: DataFrame, known: DataFrame) -> DataFrame:
        left = rows.join(known.withColumnRenamed("bits", "_known"), ["entity", "w"], "left")
        return left.select("entity", "w", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_known", F.lit(0).cast("long")))).alias("bits")).where("bits <> 0")

    first = materialise(without(onward(own), own), "hop")
    # a neighbour alone in all its chunks but those of the centre leads back to names already met
    second = without(without(onward(first), first), own)
    reached = first.withColumn("hop", F.lit(1)).unionByName(second.withColumn("hop", F.lit(2)))
    names = named.groupBy("w").agg(F.transform(F.array_sort(F.collect_list(F.struct("bit", "centre"))), lambda x: x["centre"]).alias("names"))
    names = F.broadcast(names) if named.limit(_NAMED + 1).count() <= _NAMED else names
    return reached.join(names, "w").select(F.explode(F.expr("filter(names, (c, i) -> getbit(bits, i) = 1)")).alias("centre"), "hop", "entity")


def neighbourhood_chunks(reached: DataFrame, mentions: DataFrame, k: int = 10) -> DataFrame:
    """(centre, chunk_id, n, rank): the k chunks with the most names of a centre's neighbourhood."""
    counted = reached.select("centre", "entity").distinct().join(mentions, "entity").groupBy("centre", "chunk_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("centre").orderBy(F.desc("n"), "chunk_id")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def any_relation(centres: DataFrame, relations: DataFrame) -> DataFrame:
    """(centre, rel_type, neighbour, forward): relations of the centres in either direction."""
    forward = relations.select(F.col("src").alias("centre"), "rel_type", F.col("dst").alias("neighbour"), F.lit(True).alias("forward"))
    backward = relations.select(F.col("dst").alias("centre"), "rel_type", F.col("src").alias("neighbour"), F.lit(False).alias("forward"))
    return forward.unionByName(backward).join(centres.select(F.col("entity").alias("centre")).distinct(), "centre", "left_semi")


def shortest_paths(sources: DataFrame, edges: DataFrame, most: int, target: str | None = None) -> DataFrame:
    """(source, node, length, path): least number of undirected edges from every source, within `most`, with the smallest such path as text.

    Breadth first, a join a level, from the frontier alone: a node next to the frontier that was met
    before was met in this level's neighbours, the frontier's own level or the one before, so new
    nodes are told from the last two levels without looking at all nodes seen. Levels are written
    tables; they stop when nothing is new or `target` has been met.
    """
    both = materialise(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    frontier = materialise(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("length"), F.col("node").cast("string").alias("path")).distinct(), "level")
    levels = [frontier]
    for level in range(1, most + 1):
        onward = frontier.join(both, frontier.node == both.src).select("source", F.col("dst").alias("node"), "path")
        recent = levels[-1].select("source", "node") if len(levels) == 1 else levels[-1].select("source", "node").union(levels[-2].select("source", "node"))
        fresh = onward.groupBy("source", "node").agg(F.min(F.concat("path", F.lit(" > "), F.col("node").cast("string"))).alias("path")).join(recent, ["source", "node"], "left_anti")
        frontier = materialise(fresh.select("source", "node", F.lit(level).alias("length"), "path"), "level")
        if frontier.isEmpty():
            break
        levels.append(frontier)
        if target is not None and not frontier.where(F.col("node") == target).isEmpty():
            break
    out = levels[0]
    for frontier in levels[1:]:
        out = out.unionByName(frontier)
    return out


def label_propagation(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(node, label): communities of a weighted undirected graph (a, b, weight).

    Each round a node takes the label with the greatest weight among its neighbours and itself
    (itself weighing as its strongest edge), ties going to the smallest label; synchronous and so
    the same on every plan. It stops when no label changes; graphs in which labels keep changing
    places are left as they are after `rounds`. Each round is a written table.
    """
    both = materialise(edges.select("a", "b", "weight").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")), "graph")
    own = materialise(both.groupBy(F.col("a").alias("node")).agg(F.max("weight").alias("weight")), "own")
    labels = own.select("node", F.col("node").alias("label"))
    for _ in range(rounds):
        votes = both.join(labels, both.b == labels.node).select(F.col("a").alias("node"), "label", "weight").union(labels.join(own, "node").select("node", "label", "weight"))
        best = votes.groupBy("node", "label").agg(F.sum("weight").alias("weight")).groupBy("node").agg(F.min(F.struct((-F.col("weight")).alias("w"), "label")).alias("s"))
        following = materialise(best.select("node", F.col("s.label").alias("label")), "labels")
        settled = _digest(following) == _digest(labels)
        labels = following
        if settled:
            break
    return labels


def _digest(rows: DataFrame):
    """One number of all rows, whatever their order."""
    return rows.agg(F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()[0]


def numbered_communities(labels: DataFrame, least: int = 3) -> DataFrame:
    """(entity, community): communities of `least` members or more, numbered from the largest, ties by smallest label."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    numbers = numbered(sizes.select("label", (-F.col("size")).alias("size")), "size", "label").select("label", F.col("place").alias("community"))
    return labels.join(numbers, "label").select(F.col("node").alias("entity"), "community")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` with `place`, their number from 0 in the order: sorted by ranges, counted per range, numbered within. No task holds all rows."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the low 33 bits count within a partition, the others name it
    ranged = materialise(ranged.withColumn("_m", F.monotonically_increasing_id()), "sorted").withColumn("_p", F.shiftright("_m", 33))
    before, parts = 0, {}
    for r in sorted(ranged.groupBy("_p").agg(F.count("*").alias("n")).collect()):  # one row a range
        parts[r["_p"]], before = before, before + r["n"]
    starts = ranged.sparkSession.createDataFrame(list(parts.items()), "_p long, _b long")
    return ranged.join(F.broadcast(starts), "_p").withColumn("place", F.col("_b") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_p", "_m", "_b")


def sampled(rows: DataFrame, n: int, *key: str) -> DataFrame:
    """n rows drawn by the digest of their key: the same rows on every plan."""
    return rows.withColumn("_d", F.md5(F.concat_ws("|", *key))).orderBy("_d", *key).limit(n).drop("_d")


def shuffled(rows: DataFrame, *key: str) -> DataFrame:
    """All rows in the order of the digest of their key."""
    return rows.orderBy(F.md5(F.concat_ws("|", *key)), *key)


#: rows on either side that meet in one task, and pairs a task gives
_TILE, _PAIRS = 2048, 2_000_000


def crossed(left: DataFrame, right: DataFrame, by: str, tile: int = _TILE) -> DataFrame:
    """`left` joined with `right` on `by`: all pairs of a value that many rows have on either side, part by part in separate tasks.

    The rows of a value are dealt into parts and travel once for every part of the other side, so what
    is exchanged grows with the rows and not with the pairs. Both sides are read twice.
    """
    count = lambda df, name: df.groupBy(by).agg(F.count("*").alias(name))
    sizes = materialise(count(left, "_l").join(count(right, "_r"), by), "sizes")
    pairs = sizes.agg(F.sum(F.col("_l") * F.col("_r"))).first()[0] or 0
    tasks = tasks_for(left.sparkSession, pairs, _PAIRS)
    large = sizes.select(by, F.ceil(F.col("_l") / tile).alias("_ls"), F.ceil(F.col("_r") / tile).alias("_rs")).where("_ls > 1 or _rs > 1")

    def dealt(df: DataFrame, own: str, other: str, mine: str, every: str) -> DataFrame:
        placed = df.join(large, by, "left").fillna(1, ["_ls", "_rs"])
        part = F.pmod(F.xxhash64(*(c for c in df.columns if c != by)), F.col(own)).cast("long")
        return placed.select(*df.columns, part.alias(mine), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(every)).repartition(tasks, by, "_i", "_j")

    return dealt(left, "_ls", "_rs", "_i", "_j").join(dealt(right, "_rs", "_ls", "_j", "_i"), [by, "_i", "_j"]).drop("_i", "_j")


#: rows of either side whose pairs come out next to each other: what they share is then within reach of a file's compression
_BLOCK = 8


def paired(rows: DataFrame, names: DataFrame, once: dict[str, Column], left: Column, right: Column, tile: int = _TILE) -> DataFrame:
    """All pairs of what `left` (page1, low1, ...) and `right` (page2, low2, ...) make of two pages of a name.

    `rows` (entity, page_id, ...) become one a page by the aggregates `once`; left and right are arrays
    made of them, `at` (page_id, low, ...), and of `names`, whose other columns than (entity, n, pairs)
    left may use too. n and pairs are about how many rows and pairs a name has; names it lacks have none.
    A name on many pages is dealt into parts that meet two by two in separate tasks; low tells the part _i
    from _j. A row travels once, or once for every part of its name, as both ends of pairs: no further
    exchange makes rows distinct or pairs them.
    """
    sized = names.withColumn("_ps", F.ceil(F.col("n") / tile).cast("int"))
    tasks = tasks_for(rows.sparkSession, int(names.agg(F.sum("pairs")).first()[0] or 0), _PAIRS)
    # a table of its own, as its size tells whether it can be sent to all tasks before rows are exchanged for it
    large = materialise(sized.where("_ps > 1").select("entity", "_ps"), "large")
    placed = rows.join(large, "entity", "left").withColumn("_ps", F.coalesce("_ps", F.lit(1))).withColumn("_p", F.pmod(F.xxhash64("page_id"), F.col("_ps")).cast("int"))
    dealt = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_ps") - 1))).select(*rows.columns, F.least("_p", "_o").alias("_i"), F.greatest("_p", "_o").alias("_j"), (F.col("_p") <= F.col("_o")).alias("low"))
    one = dealt.repartition(tasks, "entity", "_i", "_j").groupBy("entity", "_i", "_j", "page_id").agg(F.min("low").alias("low"), *(c.alias(k) for k, c in once.items()))
    at = one.groupBy("entity", "_i", "_j").agg(F.collect_list(F.struct("page_id", "low", *once)).alias("at"))
    tiles = sized.drop("n", "pairs").withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_ps") - 1))).withColumn("_j", F.explode(F.sequence(F.col("_i"), F.col("_ps") - 1))).drop("_ps")

    def blocks(met: DataFrame, side: Column, name: str) -> DataFrame:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("_a") - 1) / _BLOCK).cast("int")), lambda k: F.slice("_a", k * _BLOCK + 1, F.lit(_BLOCK)))
        return met.select("entity", "_i", "_j", side.alias("_a")).select("entity", "_i", "_j", F.explode(F.when(F.size("_a") > 0, cut)).alias(name))

    # rows that come out of one row wait in memory together, so blocks are joined and only their pairs made there
    both = blocks(at.join(tiles.repartition(tasks, "entity", "_i", "_j"), ["entity", "_i", "_j"]), left, "_l").join(blocks(at, right, "_r").hint("merge"), ["entity", "_i", "_j"])
    out = both.select((F.col("_i") == F.col("_j")).alias("_same"), F.inline("_l"), "_r").select("*", F.inline("_r"))
    return out.where("page1 <> page2 and (_same or low1 <> low2)").drop("_same", "low1", "low2", "_r")


def two_hop_walks(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(page1, entity, page2, chunk1, chunk2): ordered page pairs bridged by an entity, with the smallest chunk on either side."""
    pe = materialise(mentions.join(chunks.select("chunk_id", "page_id"), "chunk_id").groupBy("page_id", "entity").agg(F.min("chunk_id").alias("chunk")), "page_entity")
    side = lambda n: pe.select("entity", F.col("page_id").alias(f"page{n}"), F.col("chunk").alias(f"chunk{n}"))
    return crossed(side(1), side(2), "entity").where("page1 <> page2").select("page1", "entity", "page2", "chunk1", "chunk2")


def three_hop_walks(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(page1, entity1, entity2, page2, chunk1, chunk3): a chunk of page1 mentions both entities, a chunk of page2 the second, as a third chunk does.

    One walk for every page1, entity1, entity2, page2 with page1 <> page2, through its smallest chunks.
    The middle chunk only has to exist, so it is a filter on the entity's degree instead of a join, and
    both ends are reduced to one chunk a page before they meet.
    """
    placed = mentions.join(chunks.select("chunk_id", "page_id"), "chunk_id")
    degree = mentions.groupBy("entity").agg(F.count("*").alias("deg")).where("deg >= 3").select(F.col("entity").alias("entity2"))
    first = placed.select("chunk_id", F.col("page_id").alias("page1"), F.col("entity").alias("entity1"))
    second = mentions.select("chunk_id", F.col("entity").alias("entity2")).join(degree, "entity2", "left_semi")
    begin = materialise(first.join(second, "chunk_id").where("entity1 <> entity2").groupBy("page1", "entity1", "entity2").agg(F.min("chunk_id").alias("chunk1")), "begin")
    end = materialise(placed.groupBy(F.col("entity").alias("entity2"), F.col("page_id").alias("page2")).agg(F.min("chunk_id").alias("chunk3")), "end")
    return crossed(begin, end, "entity2").where("page1 <> page2").select("page1", "entity1", "entity2", "page2", "chunk1", "chunk3")


def broken_walks(mentions: DataFrame) -> DataFrame:
    """(entity, chunk_id): entities that one chunk alone mentions."""
    return mentions.groupBy("entity").agg(F.count("*").alias("n"), F.min("chunk_id").alias("chunk_id")).where("n = 1").select("entity", "chunk_id")
