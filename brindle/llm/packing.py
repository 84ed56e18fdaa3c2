"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

The plan is made over the histogram of piece lengths (at most ``capacity`` entries, whatever the corpus): fill a bin
greedily, longest piece first; then replace the bin's smallest piece by the two unpacked pieces that fit its expanded
gap most tightly; and repeat the same bin as often as the histogram allows. Pieces then take the places of their length
by rank, so no task holds more than its share of the pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brindle.llm.common import lean, materialize, partitions, slices
from brindle.llm.tok import SLICE, encode, ended

CAPACITY = 4096


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bins as (lengths, times) for counts[length] pieces of each length from 1 to capacity."""
    counts = counts.astype(np.int64).copy()
    out: list[tuple[list[int], int]] = []
    while True:
        there = np.flatnonzero(counts)
        if not len(there):
            return out
        bin_: list[int] = []
        gap = capacity
        while gap and (k := int(np.searchsorted(there, gap, side="right"))):
            length = int(there[k - 1])
            free = int(counts[length]) - bin_.count(length)
            if not free:
                there = np.delete(there, k - 1)
                continue
            times = min(free, gap // length)
            bin_ += [length] * times
            gap -= length * times
        if gap and len(bin_) > 1:
            bin_ = _two_for_smallest(bin_, gap, counts)
        used = np.bincount(bin_, minlength=capacity + 1)
        kinds = np.flatnonzero(used)
        times = int((counts[kinds] // used[kinds]).min())
        counts[kinds] -= used[kinds] * times
        out.append((sorted(bin_, reverse=True), times))


def _two_for_smallest(bin_: list[int], gap: int, counts: np.ndarray) -> list[int]:
    """Replace the smallest piece by the pair of unpacked ones with the largest sum that its expanded gap holds."""
    left = counts.copy()
    np.subtract.at(left, bin_, 1)
    smallest = min(bin_)
    room = gap + smallest
    free = np.flatnonzero(left > 0)
    free = free[free < room]
    if not len(free):
        return bin_
    # For each first piece the largest second one that still fits; a pair of equals needs two of them.
    second = np.searchsorted(free, room - free, side="right") - 1
    same = (second >= 0) & (free[second] == free) & (left[free] < 2)
    second = np.where(same, second - 1, second)
    total = np.where(second >= 0, free + free[second], 0)
    best = int(total.argmax())
    if total[best] <= smallest:
        return bin_
    rest = bin_.copy()
    rest.remove(smallest)
    return [*rest, int(free[best]), int(free[second[best]])]


def cut(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32. A null text is the end id alone; only longer documents are cut.

    Each row is a document, repeated ones too; a null doc_id stays null. A very long text is encoded alone, in the memory
    of one task. No rows give no pieces; other columns are left out.
    """

    def tokens(batches) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, "text", SLICE):
            ids, begins = ended(*encode(batch.column(1), tokenizer), end_id)
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            n = np.diff(begins)
            pieces = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, n[row] - start)
            at = begins[:-1][row] + start
            crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(lambda batches: lean(tokens(batches), ("tokenizers", "ids")), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece (any table with a length from 1 to capacity) its sequence_id and offset.

    Other columns are kept, nulls in them too; a sequence_id or offset that is there already gives way. Pieces of one
    length are alike, so ties take any order; repeated rows are packed each for itself. No pieces give no rows. A piece
    beyond the capacity, or without a length, is an error of the caller.
    """
    spark = pieces.sparkSession
    salts = partitions(spark)
    order = pieces.columns
    others = [c for c in order if c not in ("length", "sequence_id", "offset")]
    # The other columns go in one, so that no name of theirs can clash with ours.
    pieces = pieces.select(F.col("length").cast("long").alias("length"), F.struct(*(F.col(f"`{c}`") for c in others) if others else (F.lit(0).alias("none"),)).alias("_piece"))
    pieces = materialize(pieces.withColumn("_salt", F.pmod(F.xxhash64("_piece"), F.lit(salts))), "pieces")
    groups = pieces.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in groups.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row per length: capacity bounds them
        counts[row["length"]] = row["n"]
    bins = plan(counts, capacity)
    slots: dict[int, list[tuple[int, int, int, list[int]]]] = {}
    taken = np.zeros(capacity + 1, np.int64)
    sequence = 0
    for lengths, times in bins:
        places: dict[int, list[int]] = {}
        at = 0
        for length in lengths:
            places.setdefault(length, []).append(at)
            at += length
        for length, offsets in places.items():
            slots.setdefault(length, []).append((int(taken[length]), sequence, len(offsets), offsets))
            taken[length] += times * len(offsets)
        sequence += times
    # All slots in order of length and first rank: their first sequence, pieces a sequence, and where their offsets begin.
    most = int(counts.max()) + 1
    listed = [(k, *x) for k in sorted(slots) for x in slots[k]]
    slot_key = np.array([k * most + x for k, x, *_ in listed], np.int64)
    slot_base, slot_per = (np.array([x[i] for x in listed], np.int64) for i in (2, 3))
    slot_offsets = np.cumsum(slot_per) - slot_per
    offsets_flat = np.array([o for x in listed for o in x[4]], np.int64)

    def place(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at = {c: batch.schema.get_field_index(c) for c in ("length", "_rank")}
            length, rank = (batch.column(at[c]).to_numpy(zero_copy_only=False) for c in at)
            # One slot is the first of its length's slots whose ranks reach so far.
            slot = np.searchsorted(slot_key, length * most + rank, side="right") - 1
            r = rank - slot_key[slot] % most
            sequence_id = slot_base[slot] + r // slot_per[slot]
            offset = offsets_flat[slot_offsets[slot] + r % slot_per[slot]]
            kept = [i for i, c in enumerate(batch.schema.names) if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(sequence_id), pa.array(offset)], [*(batch.schema.names[i] for i in kept), "sequence_id", "offset"])

    # Rank within a length: the ranks of the salted groups before, and the rank in the group.
    before = groups.withColumn("_before", F.sum("n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    ranked = pieces.withColumn("_in", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_piece")) - 1)
    ranked = ranked.join(before, ["length", "_salt"]).withColumn("_rank", F.coalesce("_before", F.lit(0)) + F.col("_in")).select(*pieces.drop("_salt").columns, "_rank")
    schema = StructType([*pieces.drop("_salt").schema.fields]).add("sequence_id", "long").add("offset", "long")
    placed = ranked.mapInArrow(place, schema)
    return placed.select(*(F.col("length" if c == "length" else f"_piece.`{c}`") for c in order if c not in ("sequence_id", "offset")), "sequence_id", "offset")
