"""Jaccard self-join of documents over word shingles by vertical partitioning.

1. Exact copies are one text. The number of texts that hold each shingle gives the global n-gram order: rarest first, ties
   by name. The order is cut into fragments, intervals of it; a text's set falls into segments, one a fragment. Shingles
   that no other text holds can be in no overlap and go.
2. The overlap of a pair is counted in each fragment separately, where the pair's two segments meet, and summed per pair.
3. Which pairs are counted: a text of n shingles can only reach the threshold with one that shares one of its
   n - ceil(t n) + 1 first shingles in the order, and with a text at least as large only one of a shorter prefix; what lies
   behind the shared shingle bounds the overlap. Each text is counted against one leader first, the text that shares most
   among those of its rare shingles. Texts that links put in one component need no further count. Two texts of one leader
   overlap in no more than what both share with it and what both have and it lacks: only pairs whose sum can reach the
   threshold are made, by shared prefixes of the set or of what the leader lacks. So a group of near copies, or of texts
   that stay just below the threshold, costs about a count a text and not one a pair, and no link between two
   components is lost.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import names as N
from brindle.llm.common import materialize
from brindle.llm.components import components
from brindle.llm.spans import LOWER, Powers, joined, mix, range_names, words

# The fragments: intervals of the order that begin at texts' numbers of 2, 4, 8 and so on; the last has no end.
FRAGMENTS = 8
WHITE = np.ones(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = False


def shingles(column, powers: Powers, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct names of its shingles."""
    data, texts = joined(column)
    data = LOWER[data]
    starts, ends, first = words(data, texts, WHITE)
    w = range_names(data, starts, ends, powers)
    runs = np.zeros(max(0, len(w) - width + 1), np.uint64)
    for k in range(width):
        runs = runs * np.uint64(0x9FB21C651E98DF25) + w[k : k + len(runs)]
    runs = mix(runs)
    out = []
    for at, to in zip(first[:-1].tolist(), first[1:].tolist()):
        n = to - at
        if n >= width:
            out.append(np.unique(runs[at : to - width + 1]))
        elif n:
            h = np.uint64(n)
            for x in w[at:to]:
                h = h * np.uint64(0x9FB21C651E98DF25) + x
            out.append(mix(np.array([h], np.uint64) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix(n, percent: int, of_larger: bool):
    """Shingles of a set of n that a partner has one of, if it reaches the threshold; the partner of a larger set is smaller, else at least as large."""
    least = -(-percent * n // 100) if of_larger else -(-2 * percent * n // (100 + percent))
    return n - least + 1


def features(docs: DataFrame, width: int, percent: int) -> tuple[N.Blocks, DataFrame]:
    """Blocks, and texts: node, n, rare (s, pos: shared shingles of the prefix with their places in the order), parts (f, seg: the segments)."""
    blocks = N.Blocks(docs)
    n, bits = blocks.n, blocks.bits

    def sets(table) -> list[tuple[int, np.ndarray]]:
        powers = Powers()
        with np.errstate(over="ignore"):
            return [x for b in N.batches_of(table) for x in zip(b.column(2).to_pylist(), shingles(b.column(1), powers, width))]

    def short(names: np.ndarray) -> np.ndarray:
        return names >> np.uint64(64 - bits)

    def ask(number, table, _):
        found = [short(s) for _, s in sets(table)]
        distinct, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        return N.send(number, distinct, counts, bits, n)

    def choose(number, table, notes):
        import pyarrow as pa

        found = sets(table)
        distinct = np.unique(np.concatenate([short(s) for _, s in found]) if found else np.zeros(0, np.uint64))
        held = N.frequencies(distinct, notes.get(1, {}), bits, n)
        none = np.zeros(0, np.int64)
        rare, places, cuts, segments, kinds, ends, parts = [none], [none], [0], [none], [none], [0], [0]
        for _, s in found:
            f = held[np.searchsorted(distinct, short(s))]
            few = np.lexsort((s, f))[: prefix(len(s), percent, True)] if len(s) else none
            pos = np.flatnonzero(f[few] > 1)
            rare.append(s[few[pos]].view(np.int64))
            places.append(pos)
            cuts.append(cuts[-1] + len(pos))
            if len(pos):
                some = np.flatnonzero(f > 1)
                fragment = np.minimum(FRAGMENTS - 1, np.log2(f[some]).astype(np.int64) - 1)
                by = np.argsort(fragment, kind="stable")
                kind, sizes = np.unique(fragment[by], return_counts=True)
                segments.append(s[some[by]].view(np.int64))
                kinds.append(kind)
                ends += (ends[-1] + np.cumsum(sizes)).tolist()
            parts.append(len(ends) - 1)
        flat = [np.concatenate(x) for x in (rare, places, segments, kinds)]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[2]))
        rare_ = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[0]), pa.array(flat[1].astype(np.int32))], ["s", "pos"]))
        parts_ = pa.ListArray.from_arrays(pa.array(parts, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[3].astype(np.int32)), lists], ["f", "seg"]))
        return pa.table({"node": pa.array([d for d, _ in found], pa.int64()), "n": pa.array([len(s) for _, s in found], pa.int64()), "rare": rare_, "parts": parts_})

    told = N.shared(blocks.run(None, ask, N.NOTE))
    return blocks, materialize(blocks.run(told, choose, "node long, n long, rare array<struct<s: long, pos: int>>, parts array<struct<f: int, seg: array<long>>>"), "texts")


def measured(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b with sizes na, nb, the overlap o, counted by fragment and summed, and more: what a shares with some text but not with b, by fragment."""
    size = texts.select("node", "n")
    segments = texts.select("node", F.explode("parts").alias("p")).select("node", "p.f", "p.seg")
    left = pairs.join(segments.select(F.col("node").alias("a"), "f", F.col("seg").alias("sa")), "a")
    # Only the segments of the texts that pairs have on this side are dealt out.
    some = materialize(pairs.select(F.col("b").alias("node")).distinct(), "right")
    right = segments.join(some, "node").select(F.col("node").alias("b"), "f", F.col("seg").alias("sb"))
    nothing = F.array().cast("array<bigint>")
    partial = left.join(right, ["b", "f"], "left").withColumn("sb", F.coalesce("sb", nothing)).select("a", "b", "f", F.size(F.array_intersect("sa", "sb")).alias("o"), F.array_except("sa", "sb").alias("rest"))
    of_f = F.transform("rest", lambda s: F.struct(F.col("f"), s.alias("s")))
    summed = partial.select("a", "b", "o", of_f.alias("rest")).groupBy("a", "b").agg(F.sum("o").cast("int").alias("o"), F.array_sort(F.flatten(F.collect_list("rest"))).alias("more"))
    return summed.join(size.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(size.join(some, "node").select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")


def reaches(o: str, na: str, nb: str, percent: int) -> str:
    """The threshold, for an overlap or a bound of it."""
    return f"100 * ({o}) >= {percent} * ({na} + {nb} - ({o}))"


def linked(texts: DataFrame, percent: int) -> DataFrame:
    """node, component of each text that is linked with another."""
    held = texts.where("size(rare) > 0")
    rare = held.select("node", "n", (F.size("rare") / (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).alias("share"), F.explode("rare").alias("r")).select("node", "n", "share", "r.s", "r.pos")
    # The text that others were copied from shares all that it has; so of a shingle's texts the one that shares the most leads.
    # What is aggregated by a key that may be hot is written before it is joined by that key, so that the join can split it.
    heads = materialize(rare.groupBy("s").agg(F.max(F.struct("share", -F.col("node"))).alias("head")).where("head.share is not null"), "heads")
    votes = rare.join(heads, "s").groupBy("node", "head").agg(F.count("*").alias("votes"))
    leaders = materialize(votes.groupBy("node").agg((-F.max_by("head", F.struct("head.share", "votes", "head"))["col2"]).alias("leader")), "leaders")
    told = materialize(measured(leaders.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")), texts), "told")
    links = told.where(reaches("o", "na", "nb", percent)).select("a", "b")
    labels = components(links)
    place = (
        leaders.join(held.select("node", "n"), "node")
        .join(told.select(F.col("a").alias("node"), F.col("o").alias("x"), "more"), "node", "left")
        .join(labels, "node", "left")
        .select("node", "leader", "n", F.coalesce("x", F.col("n").cast("int")).alias("x"), F.coalesce("component", "node").alias("component"), F.coalesce("more", F.array().cast("array<struct<f: int, s: bigint>>")).alias("more"))
    )
    place = materialize(place, "place")
    # Leaders whose texts are all in one component have nothing left to join.
    open_ = materialize(place.groupBy("leader").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("leader"), "open")
    group = materialize(place.join(open_, "leader"), "group")
    side = lambda t, k: t.select(*(F.col(c).alias(c + k) if c not in ("leader", "s") else F.col(c) for c in t.columns))
    # 1 is the smaller of the two (or the lower of equals) and shares one of its shorter prefix.
    apart = f"component1 <> component2 and (n1 < n2 or n1 = n2 and node1 < node2) and 100 * n1 >= {percent} * n2"
    behind = reaches("least(n1 - pos1, n2 - pos2)", "n1", "n2", percent)
    short = f"pos < n - ceil({2 * percent} * n / {100 + percent}) + 1"
    # Two texts of one leader overlap in what both share with it, and in what both have and it lacks. Enough in the first ..
    near = rare.select("node", "s", "pos").join(group.select("node", "leader", "n", "x", "component"), "node")
    able = near.where(reaches("x", "n", "n", percent)).where(short)
    near = side(able, "1").join(side(near, "2"), ["leader", "s"]).where(apart).where(behind).where(reaches("least(x1, x2)", "n1", "n2", percent)).select("node1", "node2")
    # .. or else some of the second: then they share one of the prefix of that.
    lacks = lambda need: F.explode(F.slice("more", 1, F.greatest(F.lit(0), (F.size("more") - F.greatest(F.lit(1), F.expr(need) - F.col("x")) + 1).cast("int"))))
    extra = lambda need: group.select("leader", "node", "n", "x", "component", F.size("more").alias("e"), lacks(need).alias("r")).select("leader", "r.s", "node", "n", "x", "component", "e")
    both = side(extra(f"ceil({2 * percent} * n / {100 + percent})"), "1").join(side(extra(f"ceil({percent} * n / 100)"), "2"), ["leader", "s"])
    both = both.where(apart).where(reaches("least(x1, x2) + least(e1, e2)", "n1", "n2", percent)).select("node1", "node2")
    # Texts of different leaders: all that share a rare shingle of their prefixes.
    other = rare.select("node", "s", "pos").join(place.select("node", "leader", "n", "component"), "node")
    mixed = materialize(other.groupBy("s").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("leader").alias("l1"), F.max("leader").alias("l2")).where("lo < hi and l1 < l2").select("s"), "mixed")
    other = materialize(other.join(mixed, "s").withColumnRenamed("leader", "lead"), "other")
    cross = side(other.where(short), "1").join(side(other, "2"), "s").where(apart).where("lead1 <> lead2").where(behind).select("node1", "node2")
    pairs = materialize(near.union(both).union(cross).select(F.col("node1").alias("a"), F.col("node2").alias("b")).distinct(), "pairs")
    found = materialize(measured(pairs, texts).where(reaches("o", "na", "nb", percent)).select("a", "b"), "more")
    return components(links.union(found)) if found.limit(1).count() else labels


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs.

    component_id is the smallest doc_id reachable by links. A null or blank text has no shingles and is linked with
    nothing; a text of fewer than ``width`` words is one shingle. Repeated rows each have theirs. A doc_id that has
    several texts has a row for each, linked by that text's links. A very long text is in a block of its own and must fit
    a task. Rows without a doc_id are left out; other columns are ignored; an empty table gives an empty one.
    """
    blocks, texts = features(docs, width, percent)
    labels = linked(texts, percent)
    known = materialize(blocks.texts.select("node", "rep").join(labels, "node"), "known")
    lowest = known.groupBy("component").agg(F.min("rep").alias("lowest"))
    found = materialize(texts.select("node", "n").join(known.join(lowest, "component").select("node", "lowest"), "node", "left"), "found")
    component = F.when(F.col("n") > 0, F.coalesce("lowest", "rep")).otherwise(F.col("doc_id"))
    return blocks.classes().join(found, "node").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def representatives(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of linked texts, that with the lowest doc_id (of several texts of it, the lowest by SHA-256).

    Repeated rows of that doc_id and text count once, the first by their other columns written as JSON. Rows without words
    or without a doc_id are linked with nothing and all stay. Columns are those of docs, whatever their names.
    """
    blocks, texts = features(docs, width, percent)
    group = blocks.texts.join(texts.where("n > 0").select("node"), "node").join(linked(texts, percent), "node", "left")
    first = group.groupBy(F.coalesce("component", "node").alias("g")).agg(F.min(F.struct("rep", "_digest")).alias("x")).select(F.col("x.rep").alias("_id"), "x._digest")
    rows = blocks.rows.groupBy(F.col("doc_id").alias("_id"), "_digest").agg((F.count("*") > 1).alias("_repeated"))
    first = materialize(first.join(rows, ["_id", "_digest"]), "representatives")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    counts = F.col("_id").isNotNull() & F.coalesce(F.col("_text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = whole.where(counts).withColumn("_digest", F.unhex(F.sha2("_text", 256))).join(first, ["_id", "_digest"])
    once = kept.where("_repeated").groupBy("_id", "_digest").agg(F.min_by("_doc", F.to_json("_doc")).alias("_doc"))
    return whole.where(~counts).select("_doc").union(kept.where("not _repeated").select("_doc")).union(once.select("_doc")).select(*(F.col(f"_doc.`{c}`") for c in docs.columns))
