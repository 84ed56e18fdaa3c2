"""Language ID: nearest centroid among several per language, over normalised TF-IDF vectors of character n-grams.

Texts are lower-cased; letters and marks are kept and everything else is one blank. The n-grams are one to three
UTF-8 bytes long, hashed to ``DIMENSIONS``. Document frequencies are counted over all training rows; the centroids come
from k-means over at most ``SAMPLE_PER_LANGUAGE`` training rows of each language, those with the lowest hash.
A document is rejected if its cosine distance to the nearest centroid is beyond that centroid language's limit for
texts of its length, or of the nearest length that its sample has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brindle.llm.common import lean, slices

DIMENSIONS = 4096
CENTROIDS = 4
SAMPLE_PER_LANGUAGE = 600  # bound of the labelled rows that centroids are fitted on
CUTS = (2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 4096)  # text lengths in letters between which limits differ
SLACK = 0.5  # a text is rejected below this share of the lowest similarity that training rows of its length have
UNKNOWN = "und"

OTHER = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")


def ngrams(text: str) -> np.ndarray:
    """Hashed n-grams of a text without its non-letters."""
    b = np.frombuffer(f" {text} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(263) + b[2:] + np.uint32(70_000_000)
    ids = np.concatenate([b, two + np.uint32(1_000_000), three]) * np.uint32(2654435761)
    return (ids >> np.uint32(20)).astype(np.int64)  # the high 12 bits: DIMENSIONS


def clean(text: str | None) -> str:
    """Letters and marks; nothing of a text without any letter."""
    kept = OTHER.sub(" ", text.lower()).strip() if text else ""
    return kept if kept.isascii() or LETTER.search(kept) else ""


def vector(text: str, idf: np.ndarray) -> np.ndarray:
    tf = np.bincount(ngrams(text), minlength=DIMENSIONS)
    v = np.log1p(tf) * idf
    return (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32)


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means with farthest-first starts."""
    k = min(k, len(x))
    start = [int((x @ x.mean(0)).argmax())]
    while len(start) < k:
        start.append(int((x @ x[start].T).max(1).argmin()))
    c = x[start]
    for _ in range(rounds):
        nearest = (x @ c.T).argmax(1)
        c = np.stack([x[nearest == j].mean(0) if (nearest == j).any() else c[j] for j in range(k)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def filled(limits: np.ndarray) -> np.ndarray:
    """Limits that do not fall with length; a class without texts (inf) takes the nearest one's, the shorter's if two are as near."""
    there = np.flatnonzero(np.isfinite(limits))
    low = np.minimum.accumulate(limits[there][::-1])[::-1]
    return low[np.abs(there - np.arange(len(limits))[:, None]).argmin(1)]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row each
    owner: np.ndarray  # index of each centroid's language
    limits: np.ndarray  # lowest similarity by language and length class


def held_out() -> Column:
    """Every fourth document by checksum is kept from training."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(rows: DataFrame) -> Model | None:
    """Fit on rows of doc_id, text, lang; those without letters or language are passed over. None without any.

    Every language that a row has can be predicted, however rare; each takes 64 KB of the model. A very long text is one
    vector like others.
    """
    spark = rows.sparkSession
    rows = rows.where("lang is not null and text is not null").select("doc_id", "text", "lang")

    def frequencies(batches) -> Iterator:
        import pyarrow as pa

        seen, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in slices(batches, "text"):
            for text in batch.column(0).to_pylist():
                if text := clean(text):
                    seen += np.bincount(ngrams(text), minlength=DIMENSIONS) > 0
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS)), pa.array([n, *seen.tolist()])], ["dimension", "n"])

    counts = np.zeros(DIMENSIONS + 1, np.int64)
    for r in rows.select("text").mapInArrow(lambda batches: lean(frequencies(batches)), "dimension long, n long").groupBy("dimension").agg(F.sum("n").alias("n")).collect():
        counts[r["dimension"] + 1] = r["n"]
    if not counts[0]:
        return None
    idf = np.log((1 + counts[0]) / (1 + counts[1:])) + 1.0
    languages = [(r["lang"], r["count"]) for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    # About twice the sample by hash, so that ranking the rest takes no more rows of a frequent language than of another.
    # A row that is repeated very often has one hash; then the ranks in each partition bound what is shuffled.
    # One row a language, made from a list that the driver holds; the model has 64 KB for each.
    shares = spark.createDataFrame([(x, 2.0 * SAMPLE_PER_LANGUAGE / n) for x, n in languages], "lang string, _share double")
    hashed = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("_h")).join(F.broadcast(shares), "lang")
    few = hashed.where(F.pmod(F.shiftrightunsigned("_h", 11), F.lit(1 << 40)) < F.col("_share") * float(1 << 40))
    sample = few.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).where(F.col("_r") <= SAMPLE_PER_LANGUAGE).select("lang", "text")

    schema = "lang string, centroids binary, limits binary"

    def fit(table):
        import pyarrow as pa

        texts = [t for t in map(clean, sorted(table.column("text").to_pylist(), key=lambda t: (len(t), t))) if t]
        if not texts:
            return pa.table({"lang": pa.array([], pa.string()), "centroids": pa.array([], pa.binary()), "limits": pa.array([], pa.binary())})
        c = kmeans(np.stack([vector(t, idf) for t in texts]), CENTROIDS)
        # Own similarity of whole texts and of their beginnings, by length.
        lows: list[list[float]] = [[] for _ in range(len(CUTS) + 1)]
        for t in texts:
            for cut in (3, 6, 12, 24, 48, 96, 192, 384, 768, len(t)):
                if 0 < cut <= len(t) and (part := t[:cut].strip()):
                    lows[int(np.searchsorted(CUTS, len(part)))].append(float((c @ vector(part, idf)).max()))
        limits = filled(np.array([min(x) * SLACK if x else np.inf for x in lows]))
        return pa.table({"lang": [table.column("lang")[0].as_py()], "centroids": pa.array([c.tobytes()], pa.binary()), "limits": pa.array([limits.astype("f8").tobytes()], pa.binary())})

    fitted = {r["lang"]: r for r in sample.groupBy("lang").applyInArrow(fit, schema).collect()}
    languages = [x for x, _ in languages if x in fitted]
    if not languages:
        return None
    parts = [np.frombuffer(fitted[x]["centroids"], np.float32).reshape(-1, DIMENSIONS) for x in languages]
    return Model(languages, idf, np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.stack([np.frombuffer(fitted[x]["limits"], "f8") for x in languages]))


def predict(docs: DataFrame, model: Model | None, keep_text: bool = True) -> DataFrame:
    """docs with lang_pred, score (cosine with the nearest centroid, 0 to 1) and rejected.

    A null text or one without letters is ``und``, score 0, rejected; so is every text if there is no model. Equal
    scores go to the more frequent language. All columns of docs are kept but for those three names, and for the text
    where it is not wanted back; repeated rows each have their result, no rows give none.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    at = docs.columns.index("text")
    kept = [i for i, c in enumerate(docs.columns) if keep_text or i != at]
    schema = StructType([docs.schema.fields[i] for i in kept]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, "text"):
            texts = [clean(t) for t in batch.column(at).to_pylist()]
            names, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
            full = [i for i, t in enumerate(texts) if t] if model else []
            for k in range(0, len(full), 256):
                some = full[k : k + 256]
                near = np.stack([vector(texts[i], model.idf) for i in some]) @ model.centroids.T
                best = near.argmax(1)
                for i, b, s in zip(some, best.tolist(), near.max(1).tolist()):
                    owner = int(model.owner[b])
                    names[i], scores[i] = model.languages[owner], min(1.0, max(0.0, s))
                    rejected[i] = s < model.limits[owner, int(np.searchsorted(CUTS, len(texts[i])))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(names), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], [*(batch.schema.names[i] for i in kept), "lang_pred", "score", "rejected"])

    return docs.mapInArrow(lambda batches: lean(run(batches)), schema)
