"""Benchmark decontamination with suffix arrays of the training texts.

A shard is a slice of the training texts. Its words become the ids that they have in the benchmark's vocabulary (0: not
in it), and the suffixes that begin with ``window`` benchmark words, or with as many as the shortest item has, are sorted
into a suffix array. Suffixes left out cannot match any window. Every suffix of every item is binary-searched in it; the
matches are extended to the longest verbatim run and located by document and word. Shards are independent, so nothing is
shuffled; the benchmark is read in parts of bounded size, each of which passes over the shards once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import lean, materialize, slices
from brindle.llm.spans import LOWER, Powers, joined, range_names, words

WINDOW = 10
PART_BYTES = 32 << 20  # of benchmark text that is broadcast at a time
SHARD_BYTES = 512 << 10  # of training text that a worker holds words of at a time
# Digits, letters and every byte of a character beyond ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True

MATCHES = "doc_id long, n_words long, matches array<struct<item: long, item_word: int, word: int, length: int>>"


# Benchmark words by vocabulary id, in a plain tuple, which reads in a process that lacks this package: item ids; sorted
# names; vocabulary place + 1 of each word, all items in one; where each item begins; windows (place, length, item index).
Items = tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _names(column, powers: Powers):
    data, texts = joined(column)
    data = LOWER[data]
    starts, ends, first = words(data, texts, WORD)
    return range_names(data, starts, ends, powers), first


def prepare(ids: list[int], texts: list[str], window: int) -> Items:
    import pyarrow as pa

    with np.errstate(over="ignore"):
        w, first = _names(pa.array(texts, pa.string()), Powers())
    vocabulary, place = np.unique(w, return_inverse=True)
    out = []
    for k in range(len(ids)):
        n = int(first[k + 1] - first[k])
        out += [(int(first[k]) + i, min(n, window), k) for i in range(max(1, n - window + 1))] if n else []
    return ids, vocabulary, place.astype(np.int64) + 1, first, np.array(out, np.int64).reshape(-1, 3)


def _keys(words_: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The next depth words at each place as byte strings that sort like the words; past the end come zeros."""
    padded = np.append(words_, np.zeros(depth, words_.dtype)).astype(">u4")
    return np.ascontiguousarray(padded[at[:, None] + np.arange(depth)]).view(f"S{4 * depth}").reshape(-1)


def search(w: np.ndarray, first: np.ndarray, items: Items) -> list[list[tuple[int, int, int, int]]]:
    """For each text (words w as vocabulary places, 0 for others) the longest matches: item, item word, word, length."""
    ids, _, item_words, begins, windows = items
    out: list[list] = [[] for _ in range(len(first) - 1)]
    depths = np.unique(windows[:, 1]) if len(windows) else np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for depth in depths.tolist():
        # Places from which depth words of the same text are all in the vocabulary.
        n = len(w) - depth + 1
        if n <= 0:
            continue
        known = np.concatenate([[0], np.cumsum(w > 0)])
        at = np.flatnonzero((known[depth:] - known[:-depth] == depth) & (text[depth - 1 :] == text[:n]))
        keys = _keys(w, at, depth)
        order = np.argsort(keys, kind="stable")  # the shard's suffix array, to this depth
        array = keys[order]
        tests = windows[windows[:, 1] == depth]
        wanted = _keys(item_words, tests[:, 0], depth)
        low, high = np.searchsorted(array, wanted, "left"), np.searchsorted(array, wanted, "right")
        count = high - low
        hit = np.repeat(np.arange(len(tests)), count)
        if not len(hit):
            continue
        places = at[order[np.repeat(low, count) + np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count)]]
        item = tests[hit, 2]
        offset = tests[hit, 0] - begins[item]
        # Windows of one item that follow each other on both sides are one longer match.
        diagonal = places - offset
        by = np.lexsort((places, diagonal, item, text[places]))
        item, offset, places, diagonal, own = item[by], offset[by], places[by], diagonal[by], text[places[by]]
        new = np.ones(len(by), bool)
        new[1:] = (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (places[1:] != places[:-1] + 1) | (own[1:] != own[:-1])
        begin = np.flatnonzero(new)
        length = np.diff(begin, append=len(by)) - 1 + depth
        for i, n_ in zip(begin.tolist(), length.tolist()):
            t = int(own[i])
            out[t].append((ids[item[i]], int(offset[i]), int(places[i] - first[t]), n_))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES, marks: tuple[str, ...] = ()) -> DataFrame:
    """Longest verbatim matches of each document: doc_id, n_words, matches (array of item, item_word, word, length in words).

    A match has at least ``window`` words, or is a whole shorter item. Null texts have no words; items without words or
    id match nothing. Repeated documents and items are each found; equal items give a match each. A very long text is
    searched alone, in the memory of one task. No documents give no rows, no items no matches. Other columns are ignored,
    but for marks (longs), which each row keeps.
    """
    benchmark = benchmark.where("item_id is not null").select("item_id", "text")
    size = benchmark.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    parts = -(-size // part_bytes) or 1
    docs, schema = docs.select("doc_id", "text", *marks), MATCHES + "".join(f", {m} long" for m in marks)
    if parts > 1:  # numbered once and written, so that a row has the same number in each pass
        docs, schema = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered"), f"{schema}, _row long"
    found = None
    for k in range(parts):
        some = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else benchmark
        rows = some.collect()  # part_bytes bound it
        items = docs.sparkSession.sparkContext.broadcast(prepare([r[0] for r in rows], [r[1] or "" for r in rows], window))

        def scan(batches, items=items) -> Iterator:
            import pyarrow as pa

            powers, it = Powers(), items.value
            for batch in slices(batches, "text", SHARD_BYTES):
                with np.errstate(over="ignore"):
                    names, first = _names(batch.column(1), powers)
                place = np.searchsorted(it[1], names)
                if len(it[1]):
                    ok = it[1][np.minimum(place, len(it[1]) - 1)] == names
                    w = np.where(ok, place + 1, 0)
                else:
                    w = np.zeros(len(names), np.int64)
                hits = search(w, first, it)
                rows = [[{"item": a, "item_word": b, "word": c, "length": d} for a, b, c, d in h] for h in hits]
                kind = pa.list_(pa.struct([("item", pa.int64()), ("item_word", pa.int32()), ("word", pa.int32()), ("length", pa.int32())]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first).astype(np.int64)), pa.array(rows, kind), *batch.columns[2:]], ["doc_id", "n_words", "matches", *batch.schema.names[2:]])

        part = docs.mapInArrow(lambda batches, scan=scan: lean(scan(batches)), schema)
        found = part if found is None else found.unionByName(part)
    if parts > 1:  # the parts' matches of a row meet again; each part gives each row once
        found = found.groupBy("_row", "doc_id", "n_words", *marks).agg(F.flatten(F.collect_list("matches")).alias("matches")).drop("_row")
    return found


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"].cast("string"))))
    # Words hit: the lengths of the matches in order of place, less what lies before the furthest end so far.
    runs = F.array_sort(F.transform("matches", lambda m: F.struct(m["word"].alias("word"), (m["word"] + m["length"]).alias("end"))))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit"))
    hit = F.aggregate(runs, start, lambda s, r: F.struct(F.greatest(s["end"], r["end"]).alias("end"), (s["hit"] + F.greatest(F.lit(0), r["end"] - F.greatest(s["end"], r["word"]))).alias("hit")), lambda s: s["hit"].cast("long"))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("matches") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the rows whose text holds a window of any item, whatever their doc_id; a null text stays."""
    marks = {"_mark1": F.xxhash64("text"), "_mark2": F.xxhash64(F.lit(1), "text")}  # of the text: equal texts match alike
    bad = matches(docs.withColumns(marks), benchmark, window, marks=tuple(marks)).where("size(matches) > 0").select(*marks).distinct()
    # Written first, so that its size decides whether it is broadcast.
    bad = materialize(bad, "contaminated")
    return docs.withColumns(marks).join(bad, [*marks], "left_anti").select(*docs.columns)
