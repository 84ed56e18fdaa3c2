"""Approximate nearest neighbours by inner product: a graph by NN-descent, searched greedily.

Equal vectors are one node. Nodes get one more dimension that gives all the same norm, in which the largest inner product
is the nearest point. The graph starts from brute force within cells of random centres, in chunks of bounded size. Each
round joins every node's neighbours, and those it is a neighbour of, with their vectors, and offers each pair of them to
each other; a node keeps its ``k`` best. Nodes that learnt of none since the last round sit out; the rounds end when few
neighbours are new, or after a number that grows with the logarithm of the nodes. A search starts at a node's own neighbours and at a few common nodes, and goes to the neighbours of
the best nodes found, until none of those is unvisited. Scores of the result are computed anew in double precision.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import materialize


@dataclass(frozen=True)
class Descent:
    k: int = 28  # neighbours that a node keeps
    sample: int = 40  # neighbours and reverse neighbours that a node introduces to each other in a round
    rounds: int = 7  # at most, and one more for each doubling of the nodes beyond 8192; the settled share may end them before
    cells: int = 4  # times that the nodes are dealt to cells for the start
    cell_nodes: int = 200  # nodes of a cell on average
    centres: int = 2048  # at most
    chunk: int = 512  # nodes that are held against each other in a cell
    pool: int = 192  # nodes that a search keeps
    step: int = 24  # nodes that it visits at a time
    entries: int = 12  # longest vectors, and others, that every search also begins at
    settled: float = 0.002  # share of new neighbours below which the rounds end


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part: no nulls, only finite numbers, not zero. Shorter vectors end in zeros."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("embedding", lambda x: x != 0)
    v = v.where(F.coalesce(fine, F.lit(False)))
    width = v.agg(F.max(F.size("embedding")).alias("n")).first()["n"] or 0
    long = F.when(F.size("embedding") < width, F.concat("embedding", F.array_repeat(F.lit(0.0), (F.lit(width) - F.size("embedding")).cast("int")))).otherwise(F.col("embedding"))
    # A vec_id that has several vectors has the lowest, number by number.
    return v.groupBy("vec_id").agg(F.min(long).alias("embedding"))


def _matrix(column, width: int) -> np.ndarray:
    """Rows of a binary or a list column of numbers."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, width).astype(np.float32)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def nodes(v: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Distinct vectors (node, vec: float16 with one more dimension; embedding), members (node, vec_id), and the width."""
    members = v.select("vec_id", "embedding")
    first = members.groupBy("embedding").agg(F.min("vec_id").alias("node"))
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    top = first.select(squares.alias("s"), F.size("embedding").alias("n")).agg(F.max("s").alias("s"), F.first("n").alias("n")).first()
    width, most = (top["n"] or 0) + 1, top["s"] or 0.0

    def widen(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1), width - 1)
                more = np.sqrt(np.maximum(0.0, most - (x * x).sum(1)))[:, None]
                y = (np.concatenate([x, more], 1) / math.sqrt(most)).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in y], pa.binary()), b.column(1)], ["node", "vec", "embedding"])

    return materialize(first.select("node", "embedding").mapInArrow(widen, "node long, vec binary, embedding array<double>"), "nodes"), members.join(first, "embedding").select("node", "vec_id"), width


def release(spark) -> None:
    """Let Spark drop the shuffle files of rounds that are written and done with."""
    gc.collect()
    spark._jvm.System.gc()


PAIRS = "a long, b long, s float"


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest b of each a; new tells those that were not there before."""
    one = pairs.groupBy("a", "b").agg(F.max("s").alias("s"), F.min("new").alias("new"))
    ranked = one.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b")))
    return ranked.where(F.col("_r") <= k).drop("_r")


def start(points: DataFrame, width: int, count: int, how: Descent) -> DataFrame:
    """First neighbours: brute force within chunks of the cells of random centres."""
    cells = max(1, min(how.centres, count // how.cell_nodes))
    found = None
    for t in range(how.cells):
        some = points.orderBy(F.xxhash64("node", F.lit(t))).limit(cells).select("vec").toPandas()["vec"]  # how.centres rows at most
        centres = np.stack([np.frombuffer(x, np.float16).astype(np.float32) for x in some])
        share = float(cells) * how.chunk / max(1, count)

        def deal(batches, centres=centres) -> Iterator:
            import pyarrow as pa

            for b in batches:
                if b.num_rows:
                    cell = (_matrix(b.column(1), width) @ centres.T).argmax(1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell)], ["node", "vec", "cell"])

        dealt = points.select("node", "vec").mapInArrow(deal, "node long, vec binary, cell int")
        sizes = dealt.groupBy("cell").count()
        chunked = dealt.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("node", F.lit(100 + t)), F.ceil(F.col("count") / how.chunk)))

        def brute(table):
            import pyarrow as pa

            ids, x = table.column("node").to_numpy(), _matrix(table.column("vec"), width)
            s = x @ x.T
            np.fill_diagonal(s, -np.inf)
            k = min(how.k, len(ids) - 1)
            near = np.argpartition(-s, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(ids), 0), np.int64)
            rows = np.repeat(np.arange(len(ids)), near.shape[1])
            return pa.table({"a": ids[rows], "b": ids[near.reshape(-1)], "s": s[rows, near.reshape(-1)].astype(np.float32)})

        part = chunked.select("cell", "part", "node", "vec").groupBy("cell", "part").applyInArrow(brute, PAIRS)
        found = part if found is None else found.union(part)
    return materialize(_best(found.withColumn("new", F.lit(1)), how.k), "graph")


def graph(points: DataFrame, width: int, how: Descent = Descent()) -> DataFrame:
    """Neighbour graph of the nodes: a, b, s."""
    count = points.count()
    g = start(points, width, count, how)

    def introduce(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            lists = b.column(0)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            ids, new, worst = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
            x = _matrix(flat.field(1), width)
            at, out = 0, []
            for n in sizes.tolist():
                i, j = np.triu_indices(n, 1)
                ok = (new[at + i] + new[at + j]) > 0
                i, j = at + i[ok], at + j[ok]
                s = (x[at : at + n] @ x[at : at + n].T)[i - at, j - at]
                for p, q in ((i, j), (j, i)):
                    better = s > worst[p]
                    out.append((ids[p[better]], ids[q[better]], s[better]))
                at += n
            if out:
                a, c, s = (np.concatenate([o[k] for o in out]) for k in range(3))
                keep = a != c
                a, c, s = a[keep], c[keep], s[keep]
                # A pair found by several nodes of the batch goes once.
                by = np.lexsort((c, a))
                a, c, s = a[by], c[by], s[by]
                once = np.ones(len(a), bool)
                once[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(a[once]), pa.array(c[once]), pa.array(s[once].astype(np.float32))], ["a", "b", "s"])

    for t in range(how.rounds + max(0, math.ceil(math.log2(max(1, count) / 8192)))):
        worst = g.groupBy("a").agg(F.when(F.count("*") >= how.k, F.min("s")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
        held = points.select(F.col("node").alias("b"), "vec").join(worst.withColumnRenamed("a", "b"), "b")
        both = g.select("a", "b", "new").union(g.select(F.col("b").alias("a"), F.col("a").alias("b"), "new")).groupBy("a", "b").agg(F.max("new").alias("new"))
        of_a = Window.partitionBy("a")
        fresh = both.withColumn("_any", F.max("new").over(of_a)).where("_any = 1").drop("_any")
        drawn = fresh.withColumn("_r", F.row_number().over(of_a.orderBy(F.desc("new"), F.xxhash64("a", "b", F.lit(t))))).where(F.col("_r") <= how.sample)
        lists = drawn.join(held, "b").groupBy("a").agg(F.collect_list(F.struct("b", "vec", "new", "worst")).alias("list")).select("list")
        offers = lists.mapInArrow(introduce, PAIRS)
        # All of the present neighbours have now met, but for those that were not drawn.
        met = g.join(drawn.select("a", "b", F.lit(0).alias("_met")), ["a", "b"], "left").select("a", "b", "s", F.coalesce("_met", "new").alias("new"))
        g = materialize(_best(met.unionByName(offers.withColumn("new", F.lit(1))), how.k), "graph")
        del worst, held, both, fresh, drawn, lists, offers, met
        release(points.sparkSession)
        if g.where("new = 1").count() < how.settled * how.k * count:
            break
    return g.select("a", "b", "s")


def search(queries: DataFrame, g: DataFrame, points: DataFrame, width: int, how: Descent = Descent()) -> DataFrame:
    """Greedy search from each query's own node: q, b of the pool of each node in queries (q)."""
    vec = points.select(F.col("node").alias("b"), "vec")
    asked = materialize(queries.select("q").distinct().join(points.select(F.col("node").alias("q"), F.col("vec").alias("qvec")), "q"), "asked")

    def score(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                x, y = _matrix(b.column(2), width)[:, :-1], _matrix(b.column(3), width)[:, :-1]  # without the dimension that was added
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.einsum("ij,ij->i", x, y).astype(np.float32))], ["q", "b", "s"])

    def scores(pairs: DataFrame) -> DataFrame:
        return pairs.join(vec, "b").join(asked, "q").select("q", "b", "vec", "qvec").mapInArrow(score, "q long, b long, s float").withColumn("seen", F.lit(0))

    # Every search also begins at the longest vectors and at some others, how.entries of each.
    length = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x * x)
    common = points.orderBy(F.desc(length), "node").limit(how.entries).select("node").union(points.orderBy(F.xxhash64("node")).limit(how.entries).select("node")).collect()
    own = asked.select("q", F.col("q").alias("b")).union(g.join(asked.select(F.col("q").alias("a")), "a").select(F.col("a").alias("q"), "b"))
    first = own.union(asked.select("q", F.explode(F.array(*(F.lit(r["node"]).cast("long") for r in common))).alias("b"))).distinct()
    pool = materialize(scores(first), "pool")

    while True:  # each round visits nodes that it has not seen, so this ends
        near = pool.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "b")))
        ahead = near.where(F.col("_r") <= how.pool // 2).where("seen = 0").withColumn("_e", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "b"))).where(F.col("_e") <= how.step)
        ahead = materialize(ahead.select("q", F.col("b").alias("a")), "ahead")
        if not ahead.limit(1).count():
            return pool.select("q", "b")
        offered = ahead.join(g, "a").select("q", "b").distinct().join(pool.select("q", "b"), ["q", "b"], "left_anti")
        scored = scores(offered)
        old = pool.join(ahead.select("q", F.col("a").alias("b"), F.lit(1).alias("_now")), ["q", "b"], "left").select("q", "b", "s", F.coalesce("_now", "seen").alias("seen"))
        every = old.unionByName(scored).withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "b")))
        pool = materialize(every.where(F.col("_r") <= how.pool).drop("_r"), "pool")


def nearest(vectors: DataFrame, is_query, top: int = 20, how: Descent = Descent()) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is_query (a condition on vec_id) names, its top nearest other rows.

    Rows with null, zero or not finite vectors take no part. Vectors of several lengths count as if the shorter ones ended
    in zeros. Equal scores go to the smaller vec_id. Repeated rows of one vec_id are one row; if their vectors differ, the
    lowest counts. A table of one usable row, or none, gives none; other columns are ignored.
    """
    v = materialize(usable(vectors), "vectors")
    if v.limit(2).count() < 2:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    points, members, width = nodes(v)
    # Of equal vectors the smallest ids come first, so no more than top + 1 of a node can be in a result.
    members = members.withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id")))
    few = materialize(members.where(F.col("_r") <= top + 1).drop("_r"), "members")
    asked = materialize(members.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("node").alias("q")), "queries")
    g = graph(points, width, how)
    pool = search(asked, g, points, width, how)

    def exact(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                x, y = (_matrix(b.column(k), width - 1) for k in (2, 3))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((x * y).sum(1))], ["q", "b", "score"])

    raw = points.select("node", "embedding")
    scored = pool.join(raw.withColumnRenamed("node", "b").withColumnRenamed("embedding", "x"), "b").join(raw.withColumnRenamed("node", "q").withColumnRenamed("embedding", "y"), "q")
    scored = scored.select("q", "b", "x", "y").mapInArrow(exact, "q long, b long, score double")
    # Among a node's results the best nodes that hold enough members are enough; then each query drops itself.
    listed = scored.join(few.select(F.col("node").alias("b"), "vec_id"), "b").withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("_r") <= top + 1).drop("_r")
    out = asked.join(listed, "q").where("vec_id <> query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return out.where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
