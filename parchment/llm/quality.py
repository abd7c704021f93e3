"""Document quality by nearest-neighbour voting among labelled latent-semantic vectors.

The model is fitted on a bounded sample of labelled documents: hashed counts of lower-cased words and of word shapes
(runs of letters, capitals, digits and each other character) are weighted by rarity within each family; with shares of
repeated words they are projected on the leading right singular vectors of the sample. Its size is fixed by its parameters, so it is broadcast. Every
document is then compared with every labelled vector in blocks of exact cosines, and the nearest vote, weighted by
similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import pieces, word_hashes

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[[9, 10, 11, 12, 13]] = 0x20
_CLASS[97:123] = _CLASS[128:] = ord("a")
_CLASS[65:91] = ord("A")
_CLASS[48:58] = ord("0")


#: The third family: words like the one before and unlike it, words seen before in the text and new ones.
FORMS = 4


@dataclass
class Model:
    """words, shapes: hashed dimensions of the families, then FORMS; idf, basis: of all dimensions; vectors, labels: the voters."""

    words: int
    shapes: int
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int
    sharpness: float
    doubt: float


def features(text, words: int, shapes: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and counts of one text's UTF-8 bytes."""
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.float32)
    kinds = _CLASS[raw]
    edge = np.empty(len(kinds), bool)
    edge[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=edge[1:])
    hashes = word_hashes(text)
    at = (hashes % np.uint64(words)).astype(np.int64)
    shape = (word_hashes(kinds[edge].tobytes(), lower=False) % np.uint64(shapes)).astype(np.int64)
    # one bincount beats sorting on the long texts, and its size is fixed
    n = np.bincount(np.concatenate((at, shape + words)), minlength=words + shapes + FORMS)
    same, new = int((hashes[1:] == hashes[:-1]).sum()), len(np.unique(hashes))
    n[-FORMS:] = same, max(0, len(hashes) - 1 - same), len(hashes) - new, new
    dims = np.flatnonzero(n)
    return dims, n[dims].astype(np.float32)


def _weighted(dims: np.ndarray, counts: np.ndarray, words: int, idf: np.ndarray) -> np.ndarray:
    """Logarithmic counts times rarity (of forms the counts); each family has the same length, so that shapes and forms
    count as much as words."""
    last = len(idf) - FORMS
    v = np.where(dims < last, (1 + np.log(counts)) * idf[dims], counts)
    for part in (dims < words, (dims >= words) & (dims < last), dims >= last):
        if norm := float(np.sqrt((v[part] ** 2).sum())):
            v[part] /= norm
    return v


def _features_of(words: int, shapes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [features(v.as_buffer() if v.is_valid else b"", words, shapes) for v in batch.column("text").cast(pa.large_binary())]
            cols = [pa.array([x[0].astype(np.int32) for x in found], pa.list_(pa.int32())), pa.array([x[1] for x in found], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *cols], ["id", "label", "dims", "counts"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = 4096, words: int = 4096, shapes: int = 512, rank: int = 48, neighbours: int = 15, sharpness: float = 8.0, doubt: float = 0.5) -> Model | None:
    """Fit on at most fit_rows labelled documents, those with the smallest hashes of their ids. None without any.

    Rows of labels with a null id or label take no part; of an id labelled more than once, the smallest label counts; of
    rows that repeat an id, one counts.
    """
    spark = docs.sparkSession
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    # labels of documents that are there; ids alone are put in order, not texts
    known = docs.select(F.col(id_col).alias("id")).distinct()
    chosen = usable.join(known, "id", "left_semi").orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(fit_rows).collect()
    if not chosen:
        return None
    picked = spark.createDataFrame([(r["id"], r["label"]) for r in chosen], "id long, label int")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")  # fit_rows rows at most
    rows = texts.mapInArrow(_features_of(words, shapes), "id long, label int, dims array<int>, counts array<float>")
    # of rows that repeat an id one teaches, the same one in every run, so that at most fit_rows reach the driver
    rows = rows.groupBy("id").agg(F.min(F.struct("dims", "counts", "label")).alias("r")).orderBy("id").select("r.*").collect()
    found = [(np.array(r["dims"], np.int64), np.array(r["counts"], np.float32), r["label"]) for r in rows]
    seen = np.zeros(words + shapes + FORMS, np.int64)
    for dims, _, _ in found:
        seen[dims] += 1
    idf = np.log((1 + len(found)) / (1 + seen)).astype(np.float32) + np.float32(0.1)
    table = np.zeros((len(found), words + shapes + FORMS), np.float32)
    for row, (dims, counts, _) in zip(table, found):
        row[dims] = _weighted(dims, counts, words, idf)
    # randomised range finder with power iterations (Halko et al., 2011)
    width = min(rank + 16, *table.shape)
    span = np.random.default_rng(3).standard_normal((table.shape[1], width), np.float32)
    for _ in range(4):
        span = np.linalg.qr(table.T @ (table @ span))[0]
    _, _, turn = np.linalg.svd(table @ span, full_matrices=False)
    basis = (span @ turn.T)[:, :rank].astype(np.float32)
    y = np.array([x[2] for x in found], np.float32)
    return Model(words, shapes, idf, basis, _unit(table @ basis), y, float(y.mean()), min(neighbours, len(found)), sharpness, doubt)


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def vote(model: Model, vectors: np.ndarray) -> np.ndarray:
    """Scores of unit vectors, in blocks: the labels of the nearest voters, weighted by a power of their similarity,
    and the share of label 1 in the sample with the weight of doubt: it decides where no voter is near."""
    out = np.empty(len(vectors))
    for a in range(0, len(vectors), 256):
        near = vectors[a : a + 256] @ model.vectors.T
        k = model.neighbours
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, best, axis=1), 0).astype(np.float64) ** model.sharpness
        out[a : a + 256] = ((weight * model.labels[best]).sum(axis=1) + model.doubt * model.prior) / (weight.sum(axis=1) + model.doubt)
    return out.clip(0, 1)


def _scores(model: Model, texts: pa.Array) -> np.ndarray:
    vectors = np.zeros((len(texts), model.basis.shape[1]), np.float32)
    for row, v in zip(vectors, texts.cast(pa.large_binary())):
        dims, counts = features(v.as_buffer() if v.is_valid else b"", model.words, model.shapes)
        if len(dims):
            row[:] = _weighted(dims, counts, model.words, model.idf) @ model.basis[dims]
    return vote(model, _unit(vectors))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_scores(shared.value, batch.column("text")))], ["id", "score"])

    return run


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) per row. Null and empty texts get the share of label 1 in the sample, as does every row where
    nothing was labelled (then 1.0: nothing speaks against it). Other columns are ignored."""
    kind = docs.schema[id_col].dataType.simpleString()
    if model is None:
        return docs.select(id_col, F.lit(1.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_score(shared), f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, model: Model | None, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of docs that score at least threshold, whole; scored and filtered in one pass. Null and empty texts score
    the share of label 1 in the sample; rows that repeat others, and null ids, are judged each on its own; without a
    model all rows stay."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield batch.filter(pa.array(_scores(shared.value, batch.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


THRESHOLD = 0.7


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
