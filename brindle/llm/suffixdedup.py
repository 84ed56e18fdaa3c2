"""Suffix-array dedup: bytes covered by long strings that an earlier document has too, by distributed prefix doubling.

Ranks of positions are 64-bit names, doubled at growing offsets: the name of 2k bytes at a position comes from the names
of k bytes at it and k bytes further on. Only positions that can still be shared go on:

1. Up to ``ANCHOR`` bytes the doubling stays in a block. Of the positions in each window of ``length`` bytes, the one with
   the lowest rank stands for the window; equal windows have equal ones. Ranks of standing positions that one document
   alone has are unique and leave; the block's notes to the buckets of ranks tell (names.py).
2. For the others the doubling goes on to ``length`` in the bucket of the standing rank: there the windows around it are
   ranked by sorting names of ``length`` bytes, and each learns the lowest doc_id that has it. That is past the threshold.
3. Each block marks the bytes of its windows that a lower doc_id has.

Exact copies of an earlier text are one text for 1 and 2. A rank is sent once a block, so a passage that very many
documents share makes no hot bucket, and no pair of documents is ever made.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import names as N
from brindle.llm.common import materialize
from brindle.llm.spans import BYTE, joined, mix

LENGTH = 50
ANCHOR = 20
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)


def doubled(data: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Names of the strings of each length at every position, by doubling; a position near the end has none."""
    out: dict[int, np.ndarray] = {}
    needed = {1 << (length.bit_length() - 1) for length in lengths}
    name, k = BYTE[data], 1
    powers = {1: name} if 1 in needed else {}
    while 2 * k <= max(needed) and len(name) > k:
        name = name[:-k] * (_ODD + np.uint64(2 * k)) + (name[k:] ^ (name[k:] >> np.uint64(29)))
        k *= 2
        if k in needed:
            powers[k] = name
    for length in lengths:
        k = 1 << (length.bit_length() - 1)
        n = len(data) - length + 1
        if n <= 0:
            out[length] = np.zeros(0, np.uint64)
        else:
            out[length] = mix(powers[k][:n] * (_ODD + np.uint64(length)) + powers[k][length - k : length - k + n] * np.uint64(0x165667B19E3779F9))
    return out


def anchors(data: np.ndarray, texts: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one standing position: text number, its name, first and last window start. Windows stay in a text."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, np.zeros(0, np.uint64), none, none
    rank = doubled(data, (anchor,))[anchor]
    width = length - anchor + 1
    n = len(data) - length + 1
    low, k = rank, 1
    while 2 * k <= width:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    low = np.minimum(low[:n], low[width - k : width - k + n])
    # Windows that cross into the next text do not count.
    number = np.repeat(np.arange(len(texts) - 1), np.diff(texts))[:n]
    inside = np.arange(n) + length <= texts[1:][number]
    change = np.flatnonzero((low[1:] != low[:-1]) | (inside[1:] != inside[:-1]) | (number[1:] != number[:-1])) + 1
    first = np.concatenate([[0], change])
    last = np.concatenate([change, [n]]) - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    # A run of equal windows may go on beyond what one position can stand for; cut it so that pieces stay short.
    long = np.flatnonzero(last - first >= width)
    if len(long):
        f, l = [first], [last.copy()]
        for i in long.tolist():
            starts = np.arange(first[i] + width, last[i] + 1, width)
            l[0][i] = first[i] + width - 1
            f.append(starts)
            l.append(np.minimum(starts + width - 1, last[i]))
        first, last = np.concatenate(f), np.concatenate(l)
        order = np.argsort(first, kind="stable")
        first, last = first[order], last[order]
    # A least value is a small one; mixed again, the ranks spread evenly over the buckets.
    return number[first], mix(low[first]), first, last


def _pieces(table, length: int, anchor: int):
    """Slices of a block with their anchors: doc_ids and nodes, bytes, text starts, and what anchors() gives."""
    for b in N.batches_of(table, 1 << 20):
        data, texts = joined(b.column(1))
        yield (b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)), data, texts, *anchors(data, texts, length, anchor)


def repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_bytes, spans (array of start, end in bytes: the maximal runs to remove), kept (binary) of each row of docs.

    A byte is removed if a string of ``length`` bytes that covers it also starts in a document with a lower doc_id.
    Null texts are empty. Rows with one doc_id take nothing from each other, whether their texts agree or not, and each
    has its own result. A very long text is in a block of its own and must fit a task. Rows without a doc_id are left
    out, other columns ignored; an empty table gives an empty one.
    """
    blocks = N.Blocks(docs, short_bytes=length)
    n, bits = blocks.n, blocks.bits
    shift = np.uint64(64 - bits)

    def ask(number, table, _):
        seen = []
        for ids, _d, _t, text, rank, _f, _l in _pieces(table, length, anchor):
            seen.append(_distinct(rank >> shift, text))
        distinct, counts = np.unique(np.concatenate(seen) if seen else np.zeros(0, np.uint64), return_counts=True)
        return N.send(number, distinct, counts, bits, n)

    def _distinct(rank, text):
        order = np.lexsort((rank, text))
        rank, text = rank[order], text[order]
        new = np.ones(len(rank), bool)
        new[1:] = (rank[1:] != rank[:-1]) | (text[1:] != text[:-1])
        return rank[new]

    def entries(table, notes):
        """The block's distinct strings around shared standing positions, in a fixed order, and each slice's runs."""
        slices_, ranks = [], []
        for x in _pieces(table, length, anchor):
            slices_.append(x)
            ranks.append(x[4] >> shift)
        distinct = np.unique(np.concatenate(ranks) if ranks else np.zeros(0, np.uint64))
        held = N.frequencies(distinct, notes.get(1, {}), bits, n)
        found: dict[bytes, list] = {}
        runs = []
        for ((ids, _), data, texts, text, rank, first, last), short in zip(slices_, ranks):
            raw = data.tobytes()
            some = np.flatnonzero(held[np.searchsorted(distinct, short)] > 1)
            for i, s, doc, f, l in zip(some.tolist(), short[some].tolist(), ids[text[some]].tolist(), first[some].tolist(), last[some].tolist()):
                string = raw[f : l + length]
                e = found.get(string)
                if e is None:
                    found[string] = e = [s, doc]
                elif doc < e[1]:
                    e[1] = doc
            runs.append(some)
        order = sorted(found, key=lambda s: (found[s][0], s))
        return slices_, runs, found, order

    def spread(number, table, notes):
        import pyarrow as pa

        _, _, found, order = entries(table, notes)
        cut = N.split_names(np.array([found[s][0] for s in order], np.uint64), bits, n)
        full = [k for k in range(n) if cut[k + 1] > cut[k]]
        blobs = []
        for k in full:
            some = order[cut[k] : cut[k + 1]]
            head = np.array([len(some)], "<u4").tobytes() + np.array([len(s) for s in some], "<u4").tobytes() + np.array([found[s][1] for s in some], "<i8").tobytes()
            blobs.append(zlib.compress(head + b"".join(some), 1))
        return pa.table({"_block": pa.array([number] * len(full), pa.int32()), "_kind": pa.array([2] * len(full), pa.int32()), "_bucket": pa.array(full, pa.int32()), "_blob": pa.array(blobs, pa.binary())})

    def rank_windows(table):
        import pyarrow as pa

        order = np.argsort(table.column("_block").to_numpy(), kind="stable")
        blobs = table.column("_blob").to_pylist()
        sizes, docs_, raws = [], [], []
        for i in order:
            raw = zlib.decompress(blobs[i])
            m = int(np.frombuffer(raw, "<u4", 1)[0])
            sizes.append(np.frombuffer(raw, "<u4", m, 4).astype(np.int64))
            docs_.append(np.frombuffer(raw, "<i8", m, 4 + 4 * m))
            raws.append(raw[4 + 12 * m :])
        size, doc = np.concatenate(sizes), np.concatenate(docs_)
        windows = size - length + 1
        ends = np.cumsum(windows)
        name = np.zeros(int(ends[-1]), np.uint64)
        at = done = 0
        for s, raw in zip(sizes, raws):  # names of one block's strings at a time
            data = np.frombuffer(raw, np.uint8)
            h = doubled(data, (length,))[length]
            w = s - length + 1
            begin = np.cumsum(s) - s
            own = np.repeat(begin - (np.cumsum(w) - w), w) + np.arange(int(w.sum()))
            name[done : done + len(own)] = h[own]
            done += len(own)
        lowest = np.repeat(doc, windows)
        by = np.argsort(name, kind="stable")
        sorted_names = name[by]
        new = np.ones(len(by), bool)
        new[1:] = sorted_names[1:] != sorted_names[:-1]
        group = np.cumsum(new) - 1
        least = np.minimum.reduceat(lowest[by], np.flatnonzero(new))
        lowest[by] = least[group]
        out, at = [], 0
        for s in sizes:
            w = s - length + 1
            own = lowest[at : at + int(w.sum())]
            at += len(own)
            step = np.ones(len(own), bool)
            step[1:] = own[1:] != own[:-1]
            where = np.flatnonzero(step)
            out.append(zlib.compress(np.array([len(own), len(where)], "<u4").tobytes() + np.diff(where, prepend=0).astype("<u4").tobytes() + own[where].astype("<i8").tobytes(), 1))
        return pa.table({"_block": table.column("_block").take(pa.array(order)), "_kind": pa.array([2] * len(out), pa.int32()), "_bucket": table.column("_bucket"), "_blob": pa.array(out, pa.binary())})

    def mark(number, table, notes):
        import pyarrow as pa

        slices_, runs, found, order = entries(table, notes)
        lowest = []
        for k in sorted(notes.get(2, {})):
            raw = zlib.decompress(notes[2][k])
            m, r = np.frombuffer(raw, "<u4", 2).tolist()
            where = np.cumsum(np.frombuffer(raw, "<u4", r, 8), dtype=np.int64)
            lowest.append(np.repeat(np.frombuffer(raw, "<i8", r, 8 + 4 * r), np.diff(where, append=m)))
        low = np.concatenate(lowest) if lowest else np.zeros(0, np.int64)
        place, at = {}, 0
        for s in order:
            place[s] = at
            at += len(s) - length + 1
        columns: list[list] = [[], [], [], [], []]
        for ((ids, nodes), data, texts, text, _r, first, last), some in zip(slices_, runs):
            raw = data.tobytes()
            edge = np.zeros(len(data) + 1, np.int32)
            if len(some):
                f, l = first[some], last[some]
                w = l - f + 1
                begin = np.array([place[raw[a : b + length]] for a, b in zip(f.tolist(), l.tolist())], np.int64)
                within = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
                window = np.repeat(f, w) + within
                gone = window[low[np.repeat(begin, w) + within] < np.repeat(ids[text[some]], w)]
                np.add.at(edge, gone, 1)
                np.add.at(edge, gone + length, -1)
            removed = np.cumsum(edge[:-1]) > 0
            for i, doc in enumerate(ids.tolist()):
                own = removed[texts[i] : texts[i + 1]]
                turn = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
                columns[0].append(doc)
                columns[1].append(len(own))
                columns[2].append([{"start": a, "end": b} for a, b in turn.reshape(-1, 2).tolist()])
                columns[3].append(data[texts[i] : texts[i + 1]][~own].tobytes())
            columns[4] += nodes.tolist()
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": pa.array(columns[0], pa.int64()), "n_bytes": pa.array(columns[1], pa.int64()), "spans": pa.array(columns[2], span), "kept": pa.array(columns[3], pa.binary()), "node": pa.array(columns[4], pa.int64())})

    told = N.shared(blocks.run(None, ask, N.NOTE))
    ranked = blocks.run(told, spread, N.NOTE).groupBy("_bucket").applyInArrow(rank_windows, N.NOTE)
    first = blocks.run(told.unionByName(ranked), mark, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary, node long")
    classes = blocks.classes()
    # Rows that repeat the first one of a text with its doc_id have its result; written, so that its size is known.
    again = materialize(classes.where("doc_id = rep").groupBy("node").agg(F.count("*").cast("int").alias("_rows")).where("_rows > 1"), "again")
    repeated = F.explode(F.sequence(F.lit(1), F.coalesce("_rows", F.lit(1)))).alias("_k")
    first = first.join(again, "node", "left").select("doc_id", "n_bytes", "spans", "kept", repeated).drop("_k")
    # A later copy of a text goes as a whole if it is long enough, and else stays.
    kind = "array<struct<start: bigint, end: bigint>>"
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    later = classes.where("doc_id > rep").select(
        "doc_id", "n_bytes", F.when(F.col("n_bytes") >= length, whole).otherwise(F.array().cast(kind)).cast(kind).alias("spans"), F.coalesce("short", F.lit(b"")).alias("kept")
    )
    return first.unionByName(later)


def summary(found: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
