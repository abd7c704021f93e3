"""Maximum inner product search: score-aware anisotropic product quantisation, four-bit table scans, exact reranking.

A bounded sample fits coarse centroids and, for each pair of dimensions, sixteen codewords. Codes minimise a loss that
weighs the part of the residual parallel to the vector more than the rest, since that part changes the products with
the queries that matter (Guo et al., 2020). All rows are indexed: dealt to shards of neighbouring lists, of bounded
size, large lists split by hash. A query visits the shards that hold its nearest lists, sums four-bit table entries
there (two codes to a byte), and what scores best is ranked by exact double-precision products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialize


@dataclass
class Index:
    """dim: of the vectors; lists: coarse centroids; books: (subspaces, 16, width) codewords; weight: of the parallel residual."""

    dim: int
    lists: np.ndarray
    books: np.ndarray
    weight: float
    shard_of: dict[int, tuple[int, int]] | None = None


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
        n = np.bincount(near, minlength=len(centres))
        for d in range(x.shape[1]):
            s = np.bincount(near, x[:, d], minlength=len(centres))
            centres[n > 0, d] = s[n > 0] / n[n > 0]
    return centres


def encode(index: Index, x: np.ndarray, rounds: int = 2) -> np.ndarray:
    """(rows, subspaces) codes, by coordinate descent on the anisotropic loss."""
    m, _, width = index.books.shape
    x = np.pad(x, ((0, 0), (0, m * width - x.shape[1])))
    parts = x.reshape(len(x), m, width)
    unit = parts / np.sqrt((x**2).sum(axis=1))[:, None, None]
    # for each subspace and codeword: squared residual, and its share of the parallel residual
    square, along = np.empty((len(x), m, 16)), np.empty((len(x), m, 16))
    for j in range(m):
        gap = parts[:, j, None, :] - index.books[j]
        square[:, j], along[:, j] = (gap**2).sum(axis=2), (gap * unit[:, j, None, :]).sum(axis=2)
    codes = square.argmin(axis=2)
    rows = np.arange(len(x))
    total = np.take_along_axis(along, codes[:, :, None], axis=2)[:, :, 0].sum(axis=1)
    for _ in range(rounds):
        for j in range(m):
            rest = total - along[rows, j, codes[:, j]]
            loss = square[:, j] + (index.weight - 1) * (rest[:, None] + along[:, j]) ** 2
            codes[:, j] = loss.argmin(axis=1)
            total = rest + along[rows, j, codes[:, j]]
    return codes


def fit(sample: np.ndarray, lists: int, width: int = 2, threshold: float = 0.2, rounds: int = 4, seed: int = 11) -> Index:
    """threshold: the cosine from which products matter; it sets how much the parallel residual weighs."""
    rng, dim = np.random.default_rng(seed), sample.shape[1]
    coarse = _kmeans(sample, lists, rng, 8)
    m = -(-dim // width)
    parts = np.pad(sample, ((0, 0), (0, m * width - dim))).reshape(len(sample), m, width)
    books = np.zeros((m, 16, width))
    for j in range(m):
        found = _kmeans(parts[:, j], 16, rng, 8)
        books[j, : len(found)] = found
    weight = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
    index = Index(dim, coarse, books, weight)
    if len(sample) >= 64:
        unit = parts / np.sqrt((parts**2).sum(axis=(1, 2)))[:, None, None]
        for _ in range(rounds):
            codes = encode(index, sample, 1)
            rest = ((parts - books[np.arange(m), codes]) * unit).sum(axis=(1, 2))
            for j in range(m):
                own = ((parts[:, j] - books[j, codes[:, j]]) * unit[:, j]).sum(axis=1)
                for c in range(16):
                    at = codes[:, j] == c
                    if not at.any():
                        continue
                    u, x = unit[at, j], parts[at, j]
                    # the codeword that minimises the loss over its rows, the other subspaces held
                    left = at.sum() * np.eye(width) + (weight - 1) * u.T @ u
                    right = x.sum(axis=0) + (weight - 1) * (u * ((rest - own)[at] + (u * x).sum(axis=1))[:, None]).sum(axis=0)
                    books[j, c] = np.linalg.solve(left, right)
                rest += ((parts[:, j] - books[j, codes[:, j]]) * unit[:, j]).sum(axis=1) - own
    return index


def _packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes to a byte."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return (codes[:, ::2] << 4 | codes[:, 1::2]).astype(np.uint8)


def scan(index: Index, packed: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Approximate products of query with all packed rows: a sum of table entries, one per byte. packed: (bytes, rows)."""
    m, _, width = index.books.shape
    q = np.pad(query, (0, m * width - len(query))).reshape(m, width)
    table = np.einsum("mcw,mw->mc", index.books, q)
    if m % 2:
        table = np.vstack((table, np.zeros(16)))
    both = (table[::2, :, None] + table[1::2, None, :]).reshape(-1, 256).astype(np.float32)
    out = both[0][packed[0]]
    for t, p in zip(both[1:], packed[1:]):
        out += t[p]
    return out


def _best(scores: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n largest; among equal scores the first."""
    if len(scores) <= n:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - n)[len(scores) - n]
    above = np.flatnonzero(scores > least)
    return np.concatenate((above, np.flatnonzero(scores == least)[: n - len(above)]))


def _usable(col: str, dim: int):
    fine = F.forall(col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce((F.size(col) == dim) & fine & F.exists(col, lambda v: v != 0), F.lit(False))


def search(vectors: DataFrame, queries, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, sample_rows: int = 16_384, lists: int | None = None, probe: float = 0.35, rerank: int = 250, shard_rows: int = 16_384, ask_rows: int = 65_536) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that the condition queries selects, its k nearest among all others.

    Vectors that are null, zero, hold a null or non-finite component, or have not the commonest dimension take no part.
    Fewer candidates than k give fewer rows; equal scores rank by smaller id. Of rows that repeat an id with the same
    vector one takes part; with different vectors each does, but none is a candidate of its own id. The fit uses at
    most sample_rows rows, those with the smallest hashes; the index holds every row. A query visits the shards of the
    nearest share probe of all lists and reranks the rows of rerank codes in each. One task holds about shard_rows rows
    and ask_rows queries at most: more queries go in as many blocks, each to its own copy of the shards.
    """
    spark = vectors.sparkSession
    v = F.transform(vector_col, lambda x: x.cast("double")).alias("v")
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v, queries.alias("asks"))
    dims = rows.where("size(v) > 0").groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    shape = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], shape)
    dim = dims["d"]
    rows = materialize(rows.where(_usable("v", dim)).dropDuplicates(["id", "v"]), "vectors")
    total = rows.count()
    if not total:
        return spark.createDataFrame([], shape)
    drawn = rows.select("v").orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(sample_rows).toArrow()["v"].combine_chunks()
    lists = lists or max(1, min(1024, int(total**0.5) // 2))
    index = fit(np.unique(drawn.flatten().to_numpy().reshape(-1, dim), axis=0), lists)
    shared = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(-1, index.dim)
            near = x @ index.lists.T - 0.5 * (index.lists**2).sum(axis=1)
            codes = _packed(encode(index, x))
            cols = [batch.column("id"), pa.array(near.argmax(axis=1), pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column("v"), batch.column("asks")]
            yield pa.RecordBatch.from_arrays(cols, ["id", "list", "code", "v", "asks"])

    placed = materialize(rows.mapInArrow(place, "id long, list int, code binary, v array<double>, asks boolean"), "index")
    filled = dict(sorted((r["list"], r["n"]) for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect()))  # at most lists rows
    # neighbouring lists share shards: walk from each centroid to the nearest one left
    left, chain = dict(filled), [next(iter(filled))]
    while left.pop(chain[-1]) and left:
        ids = list(left)
        chain.append(ids[int(np.argmin(((index.lists[ids] - index.lists[chain[-1]]) ** 2).sum(axis=1)))])
    shard_of, shard, room = {}, 0, shard_rows
    for c in chain:
        n = filled[c]
        if n > room and room < shard_rows:
            shard, room = shard + 1, shard_rows
        parts = -(-n // shard_rows)
        shard_of[c] = (shard, parts)
        if parts > 1:
            shard, room = shard + parts, shard_rows
        else:
            room -= n
    index.shard_of = shard_of
    routed = spark.sparkContext.broadcast(index)
    table = F.create_map(*[F.lit(x) for c, (a, p) in shard_of.items() for x in (c, a)])
    splits = F.create_map(*[F.lit(x) for c, (a, p) in shard_of.items() for x in (c, p)])
    # hashing deals queries evenly, a shard gets those of a block that visit it
    blocks = -(-placed.where("asks").count() // ask_rows)
    base = placed.withColumn("shard", table[F.col("list")] + F.pmod(F.xxhash64("id"), splits[F.col("list")]).cast("int")).select("shard", "id", "code", "v")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = routed.value
        known = np.array(sorted(index.shard_of))
        n = max(1, round(len(known) * probe))
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(-1, index.dim)
            near = x @ index.lists[known].T
            out, at = [], []
            for i, row in enumerate(near):
                hit = set()
                for c in known[np.argsort(-row, kind="stable")[:n]].tolist():
                    a, p = index.shard_of[c]
                    hit.update(range(a, a + p))
                out += sorted(hit)
                at += [i] * len(hit)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32()), *(batch.column(c).take(pa.array(at, pa.int64())) for c in ("id", "v"))], ["shard", "id", "v"])

    asked = placed.where("asks").select("id", "v").mapInArrow(route, "shard int, id long, v array<double>")

    def answer(base: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        index, found = routed.value, []
        if len(base) and len(asked):
            base = base.sort_values("id", kind="stable")
            ids, x = base["id"].to_numpy(), np.stack(base["v"].to_numpy())
            # equal codes are scanned once, and all their rows reranked: copies and near copies that no code tells
            # apart neither push out others nor each other; rerank counts codes, and a shard bounds the rows
            codes = np.ascontiguousarray(np.frombuffer(b"".join(base["code"]), np.uint8).reshape(len(ids), -1))
            _, one, of = np.unique(codes.view(f"V{codes.shape[1]}").ravel(), return_index=True, return_inverse=True)
            by, n = np.argsort(of, kind="stable"), np.bincount(of)
            start = np.cumsum(n) - n
            packed = np.ascontiguousarray(codes[one].T)
            for q, v in zip(asked["id"].to_numpy(), asked["v"].to_numpy()):
                at = _best(scan(index, packed, v), rerank)
                rows = by[np.repeat(start[at] - (np.cumsum(n[at]) - n[at]), n[at]) + np.arange(n[at].sum())]
                rows = rows[ids[rows] != q]
                exact = (x[rows] * v).sum(axis=1)  # row by row, so that equal vectors have equal scores
                top = np.lexsort((ids[rows], -exact))[:k]
                found.append(pd.DataFrame({"query_id": q, "vec_id": ids[rows][top], "score": exact[top]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})

    if blocks > 1:
        asked = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(13), "id"), F.lit(blocks)).cast("int"))
        base = base.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    by = ["shard", "block"] if blocks > 1 else ["shard"]
    near = asked.groupBy(*by).cogroup(base.groupBy(*by)).applyInPandas(lambda a, b: answer(b, a), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_ann(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
