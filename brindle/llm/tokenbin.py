"""Token-id output: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

File format, three Parquet tables in one folder:

- ``blocks``: one row per block of about ``block_ids`` ids, whole documents only, in ascending order of doc_id within a
  ``part``: ``part``, ``start`` (ids of the part's blocks before), ``doc_ids`` (int64), ``lengths`` (uint32), ``control``
  (two bits per id, four ids a byte, low bits first: bytes of the id's rank less one) and ``data`` (the ranks' bytes,
  little-endian, one after the other).
- ``parts``: the parts in order of doc_id, with ``first``, the ids of all parts before.
- ``dictionary``: the id of each rank, the most frequent first.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import delete_at_exit, materialize, partitions, shared_folder, slices
from brindle.llm.tok import SLICE, encode, ended, load

BLOCK_IDS = 1 << 18
PART_IDS = 1 << 24  # ids of a part on average, unless the cluster has more tasks than that gives
BLOCK_SCHEMA = "part int, start long, n long, doc_ids binary, lengths binary, control binary, data binary"


def put(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of the ranks."""
    ranks = ranks.astype("<u4", copy=False)
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = size - 1
    control = padded[0::4] | padded[1::4] << 2 | padded[2::4] << 4 | padded[3::4] << 6
    used = np.arange(4, dtype=np.uint8)[None, :] < size[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


# The four sizes that a control byte stands for, by table lookup.
SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])[None, :] & 3).astype(np.uint8) + 1


def get(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks again."""
    size = SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4, dtype=np.uint8)[None, :] < size[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


def _binaries(flat: np.ndarray, begins: np.ndarray):
    """An Arrow binary array of the runs of a numpy array that begin there."""
    import pyarrow as pa

    offsets = (begins * flat.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(begins) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def write(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 0, block_ids: int = BLOCK_IDS) -> str:
    """Encode every whole text and write the ids to files in ascending order of doc_id; the folder they are in.

    Null texts give the end id alone. Rows of one doc_id follow each other, each for itself. A null doc_id is an error of
    the caller: such rows have no place in the order and are left out. A very long text is one block. An empty table
    gives files without blocks. Other columns are ignored. Without a path the files go to the shared folder until exit.
    """
    spark = docs.sparkSession
    if path is None:
        path = f"{shared_folder(spark)}/brindle-{uuid.uuid4().hex[:12]}"
        delete_at_exit(spark, path)
    vocabulary = load(tokenizer).get_vocab_size(with_added_tokens=True)
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def tokens(batches) -> Iterator:
        import pyarrow as pa

        total = np.zeros(vocabulary, np.int64)
        names = ["doc_id", "n", "ids", "_row", "counts"]
        for batch in slices(batches, "text", SLICE):
            ids, begins = ended(*encode(batch.column(1), tokenizer), end_id)
            total += np.bincount(ids, minlength=vocabulary)
            yield pa.record_batch([batch.column(0), pa.array(np.diff(begins)), _binaries(ids.astype(kind), begins), batch.column(2), pa.nulls(len(batch), pa.binary())], names)
        seen = np.flatnonzero(total)
        if len(seen):  # the task's ids and how often each came
            yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([np.stack([seen, total[seen]]).astype("<i8").tobytes()], pa.binary())], names)

    # The row numbers are written with the ids, so that the order of the rows of one doc_id is the same in every attempt.
    numbered = docs.select("doc_id", "text").where("doc_id is not null").withColumn("_row", F.monotonically_increasing_id())
    encoded = materialize(numbered.mapInArrow(tokens, "doc_id long, n long, ids binary, _row long, counts binary"), "ids")

    def count(batches) -> Iterator:
        import pyarrow as pa

        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for x in batch.column(0):
                ids, n = np.frombuffer(x.as_buffer(), "<i8").reshape(2, -1)
                total[ids] += n
        yield pa.record_batch([pa.array(np.flatnonzero(total).astype(np.int64)), pa.array(total[total > 0])], ["id", "n"])

    # The vocabulary bounds what reaches the driver.
    seen = encoded.where("counts is not null").select("counts").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").toPandas()
    ids_of_ranks = seen["id"].to_numpy(np.int64)
    rank_of_id = np.zeros(vocabulary, np.uint32)
    rank_of_id[ids_of_ranks] = np.arange(len(ids_of_ranks), dtype=np.uint32)
    parts = max(partitions(spark), int(seen["n"].sum()) // PART_IDS)

    def blocks(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            doc_ids = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            column = batch.column(2)
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            ranks = rank_of_id[np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind)]
            ends = np.cumsum(n)
            begin = np.flatnonzero(np.diff((ends - n) // block_ids, prepend=-1))  # a block begins with the first document in it
            rows = []
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(n)]):
                low, high = int(ends[a] - n[a]), int(ends[b - 1])
                rows.append((part, at, high - low, doc_ids[a:b].tobytes(), n[a:b].astype("<u4").tobytes(), *put(ranks[low:high])))
                at += high - low
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4))], ["part", "start", "n", "doc_ids", "lengths", "control", "data"])

    dealt = encoded.where("n is not null").select("doc_id", "n", "ids", "_row").repartitionByRange(parts, "doc_id", "_row").sortWithinPartitions("doc_id", "_row")
    dealt.mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(f"{path}/blocks")
    written = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    # One row a part.
    first = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    written.groupBy("part").agg(F.sum("n").alias("n")).select("part", first.alias("first")).write.parquet(f"{path}/parts")
    spark.createDataFrame([(r, int(i)) for r, i in enumerate(ids_of_ranks)], "rank long, id long").coalesce(1).write.parquet(f"{path}/dictionary")
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document out of the files: doc_id, start, n_tokens, ids (binary, little-endian uint32)."""
    # The vocabulary bounds the dictionary.
    ids_of_ranks = spark.read.schema("rank long, id long").parquet(f"{path}/dictionary").orderBy("rank").toPandas()["id"].to_numpy("<u4")

    def decode(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                at, doc_ids, lengths, control, data = (c[k].as_py() for c in batch.columns)
                lengths = np.frombuffer(lengths, "<u4").astype(np.int64)
                begins = np.concatenate([[0], np.cumsum(lengths)])
                ids = ids_of_ranks[get(control, data, int(begins[-1]))]
                yield pa.record_batch([pa.array(np.frombuffer(doc_ids, "<i8")), pa.array(at + begins[:-1]), pa.array(lengths), _binaries(ids, begins)], ["doc_id", "start", "n_tokens", "ids"])

    parts = spark.read.schema("part int, first long").parquet(f"{path}/parts")
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").join(parts, "part")
    return blocks.select((F.col("first") + F.col("start")).alias("at"), "doc_ids", "lengths", "control", "data").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def summary(found: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document that was read."""
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
