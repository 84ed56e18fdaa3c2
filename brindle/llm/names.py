"""How many documents of the whole corpus share each of many names, found without sending a name twice from a block.

Documents are dealt to blocks of bounded size by a hash of doc_id. A block sends each bucket of names its sorted
distinct ones, truncated and difference-coded, with the number of its documents that hold each. The bucket adds them up
and sends each block back which of its names more than one document has. What a bucket reads of a name is one entry a
block, however many documents hold it, so no hot name makes a hot task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import materialize
from brindle.llm.tokenbin import get, put

# Text in a block: as many blocks as a block sends names to a bucket, within bounds; a longer text is a block's only large one.
LEAST_BYTES, MOST_BYTES = 4 << 20, 64 << 20
NOTE = "_block int, _kind int, _bucket int, _blob binary"


class Blocks:
    """The distinct texts of docs by block.

    ``rows`` has one row for each of docs (doc_id, _digest, n_bytes, short: texts below short_bytes), ``texts`` one for each
    distinct text (_digest, rep: the lowest doc_id that has it, node: its number). A doc_id that has several texts has a
    row for each, and each text is its own node.
    """

    def __init__(self, docs: DataFrame, block_bytes: int | None = None, short_bytes: int = 0) -> None:
        docs = docs.select("doc_id", "text").where("doc_id is not null")
        size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
        self.n = max(1, math.ceil(size / (block_bytes or min(MOST_BYTES, max(LEAST_BYTES, 140 * math.isqrt(size))))))
        # Wide enough for names to be told apart as well at any size of the corpus.
        self.bits = min(56, max(36, math.ceil(math.log2(size + 2)) + 10))
        text = F.coalesce("text", F.lit(""))
        size_of = F.octet_length(text).cast("long")
        short = F.when(size_of < short_bytes, text.cast("binary")).alias("short")
        self.rows = materialize(docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("_digest"), F.xxhash64(text).alias("_mark"), size_of.alias("n_bytes"), short), "rows")
        first = self.rows.groupBy("_digest").agg(F.min("doc_id").alias("rep"), F.first("_mark").alias("_mark"))
        # Written before it is joined, so that its size is known and a text that very many rows have can be split.
        self.texts = materialize(first.withColumn("node", F.monotonically_increasing_id()), "texts")
        self.docs = docs.withColumn("_mark", F.xxhash64(text)).withColumn("_block", self.block("doc_id"))
        word = lambda c: F.to_binary(F.lpad(F.hex(c), 16, "0"), F.lit("hex"))
        self.reps = self.texts.select(self.block("rep").alias("_block"), F.lit(0).alias("_kind"), F.lit(0).alias("_bucket"), F.concat(word("rep"), word("_mark"), word("node")).alias("_blob"))

    def block(self, column: str):
        return F.pmod(F.xxhash64(column), F.lit(self.n)).cast("int")

    def classes(self) -> DataFrame:
        """The rows with the rep and node of their text."""
        return self.rows.join(self.texts.select("_digest", "rep", "node"), "_digest").drop("_digest", "_mark")

    def run(self, notes: DataFrame | None, f: Callable, schema: str) -> DataFrame:
        """f(block number, Arrow table of doc_id, text and node sorted by doc_id, notes by kind and bucket) -> Arrow table."""
        side = self.reps if notes is None else self.reps.unionByName(notes)

        def call(docs, side):
            import pyarrow as pa

            noted: dict[int, dict[int, bytes]] = {}
            reps = []
            for kind, bucket, blob in zip(*(side.column(c).to_pylist() for c in ("_kind", "_bucket", "_blob"))):
                if kind == 0:
                    reps.append(blob)
                else:
                    noted.setdefault(kind, {})[bucket] = blob
            number = docs.column("_block")[0].as_py() if docs.num_rows else -1
            rep, mark, node = np.frombuffer(b"".join(reps), ">i8").reshape(-1, 3).T
            held = dict(zip(zip(rep.tolist(), mark.tolist()), node.tolist()))
            # The first row of each text; a row that was found is not looked for again.
            found = [(i, x) for i, key in enumerate(zip(docs.column("doc_id").to_pylist(), docs.column("_mark").to_pylist())) if (x := held.pop(key, None)) is not None]
            docs = docs.select(["doc_id", "text"]).take(pa.array([i for i, _ in found], pa.int64())).append_column("node", pa.array([x for _, x in found], pa.int64()))
            return f(number, docs.sort_by([("doc_id", "ascending"), ("node", "ascending")]), noted)

        return self.docs.groupBy("_block").cogroup(side.groupBy("_block")).applyInArrow(call, schema)


def pack_names(names: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct names below 2 to the power 56 and how many documents hold each."""
    steps = np.diff(names, prepend=np.uint64(0))
    high, low = (steps >> np.uint64(24)).astype("<u4"), (steps & np.uint64(0xFFFFFF)).astype("<u4")
    more = np.flatnonzero(counts > 1)
    parts = [*put(low), *(put(high) if high.any() else (b"", b"")), more.astype("<u4").tobytes(), counts[more].astype("<u4").tobytes()]
    return np.array([len(names), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def unpack_names(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    head = np.frombuffer(blob, "<u4", 7)
    n, at, parts = int(head[0]), 28, []
    for size in head[1:]:
        parts.append(blob[at : at + int(size)])
        at += int(size)
    steps = get(parts[0], parts[1], n).astype(np.uint64)
    if parts[2]:
        steps += get(parts[2], parts[3], n).astype(np.uint64) << np.uint64(24)
    counts = np.ones(n, np.int64)
    counts[np.frombuffer(parts[4], "<u4")] = np.frombuffer(parts[5], "<u4")
    return np.cumsum(steps, dtype=np.uint64), counts


def split_names(names: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted names of so many bits, and the end."""
    edges = np.array([(k << bits) // buckets for k in range(buckets)], np.uint64)
    return np.append(np.searchsorted(names, edges), len(names))


def send(number: int, names: np.ndarray, counts: np.ndarray, bits: int, buckets: int, kind: int = 1):
    """Notes from a block to the buckets of its sorted names."""
    import pyarrow as pa

    cut = split_names(names, bits, buckets)
    full = [k for k in range(buckets) if cut[k + 1] > cut[k]]
    return pa.table({"_block": pa.array([number] * len(full), pa.int32()), "_kind": pa.array([kind] * len(full), pa.int32()), "_bucket": pa.array(full, pa.int32()), "_blob": pa.array([pack_names(names[cut[k] : cut[k + 1]], counts[cut[k] : cut[k + 1]]) for k in full], pa.binary())})


def shared(notes: DataFrame) -> DataFrame:
    """Answer the notes of send(): for each block and bucket the places of the names that several documents hold, and by how many."""

    def answer(table):
        import pyarrow as pa

        order = np.argsort(table.column("_block").to_numpy(), kind="stable")
        blobs = table.column("_blob").to_pylist()
        held = [unpack_names(blobs[i]) for i in order]
        names = np.concatenate([x[0] for x in held])
        counts = np.concatenate([x[1] for x in held])
        distinct, inverse = np.unique(names, return_inverse=True)
        total = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.int64)[inverse]
        out, at = [], 0
        for x, _ in held:
            own = total[at : at + len(x)]
            at += len(x)
            places = np.flatnonzero(own > 1)
            parts = [*put(np.diff(places, prepend=0).astype("<u4")), *put(np.minimum(own[places], (1 << 32) - 1).astype("<u4"))]
            out.append(np.array([len(places), *map(len, parts)], "<u4").tobytes() + b"".join(parts))
        return pa.table({"_block": table.column("_block").take(pa.array(order)), "_kind": pa.array([1] * len(out), pa.int32()), "_bucket": table.column("_bucket"), "_blob": pa.array(out, pa.binary())})

    return notes.groupBy("_bucket").applyInArrow(answer, NOTE)


def frequencies(names: np.ndarray, notes: dict[int, bytes], bits: int, buckets: int) -> np.ndarray:
    """For a block's sorted names: in how many documents of the corpus each is, 1 where no note says more."""
    out = np.ones(len(names), np.int64)
    cut = split_names(names, bits, buckets)
    for bucket, blob in notes.items():
        head = np.frombuffer(blob, "<u4", 5)
        n, at, parts = int(head[0]), 20, []
        for size in head[1:]:
            parts.append(blob[at : at + int(size)])
            at += int(size)
        places = np.cumsum(get(parts[0], parts[1], n), dtype=np.int64) + cut[bucket]
        out[places] = get(parts[2], parts[3], n)
    return out


def batches_of(table, limit: int = 2 << 20) -> Iterable:
    """Slices of an Arrow table of documents with at most limit bytes of text; a longer text comes alone."""
    from brindle.llm.common import slices

    return slices(table.combine_chunks().to_batches(), "text", limit)
