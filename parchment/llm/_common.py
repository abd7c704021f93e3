"""Helpers shared by the operators: joins with hot keys, hashing of words, connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, release, shared_dir  # noqa: F401  the operators take them from here

#: Rows of one key that a join leaves together, and how many keys at most have more (some 100 bytes each are broadcast).
TOGETHER, HOT_KEYS = 250, 50_000


def join_hot(rows: DataFrame, key: Column, by: Column, one: DataFrame) -> DataFrame:
    """rows, each with the columns of one (a row per "key") or nulls: a left join by digest that splits hot keys.

    Rows of a key that has over TOGETHER of them (over 1/HOT_KEYS of all, in large tables) are dealt to parts by the hash
    by, and its row in one is repeated for each part. So fewer than HOT_KEYS keys are hot, whatever the tables hold.
    """
    dealt = rows.select(F.struct(*rows.columns).alias("row"), key.alias("key"), by.alias("by"))
    run = max(TOGETHER, -(-rows.count() // HOT_KEYS))
    hot = dealt.where("key is not null").groupBy("key").agg(F.ceil(F.count("*") / run).alias("parts")).where("parts > 1")
    hot = F.broadcast(hot)
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    # null keys meet nothing, and stay apart
    dealt = dealt.join(hot, "key", "left").withColumn("part", F.when(F.col("key").isNull(), F.col("by")).otherwise(F.pmod("by", parts)))
    many = one.join(hot, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return dealt.select("row", "key", "part").join(many.drop("parts"), ["key", "part"], "left").select("row.*", *(c for c in one.columns if c != "key"))


def pieces(batches, rows: int = 2000):
    """The batches in slices of rows at most: what a function makes of a slice stays small, since one text may hold megabytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


# ---- words and shingles as 64-bit hashes, computed over whole byte arrays -------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_PIECE = 1 << 22


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def _word_hashes(b: np.ndarray) -> np.ndarray:
    inside = np.empty(len(b) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(_SPACE[b], out=inside[1:-1].view(bool))
    edge = np.flatnonzero(np.diff(inside))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text, lower: bool = True) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes, in order. Long texts go piece by piece, cut at spaces."""
    b = np.frombuffer(text, np.uint8)
    if lower:
        b = _LOWER[b]
    if len(b) <= _PIECE:
        return _word_hashes(b) if len(b) else np.empty(0, np.uint64)
    out, at = [], 0
    while at < len(b):
        end = min(len(b), at + _PIECE)
        while end < len(b) and not _SPACE[b[end]]:
            end += 1
        out.append(_word_hashes(b[at:end]))
        at = end
    return np.concatenate(out)


def shingles(text, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and, in order, of the k-word shingles; with fewer words the whole sequence is one."""
    words = word_hashes(text)
    n = len(words)
    if n == 0:
        return words, words
    width = min(k, n)
    total = np.full(n - width + 1, np.uint64((width * 0xD6E8FEB86659FD93) & (2**64 - 1)), np.uint64)
    for i in range(width):
        total += words[i : n - width + 1 + i] * np.uint64(((2 * i + 3) * 0xA24BAED4963EE407 | 1) & (2**64 - 1))
    return words, mix(total)


def shingle_set(text, k: int) -> np.ndarray:
    """The sorted distinct hashes of shingles()."""
    return np.unique(shingles(text, k)[1])


# ---- connected components ---------------------------------------------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the undirected edges.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edges are stars around their
    smallest node. Every round is written to the shared folder, so that lost executors cost one round.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = written = materialize(now, "edges")
    while True:
        state = now.agg(F.count("*").alias("n"), F.countDistinct("u").alias("children")).first()
        if state["n"] == state["children"] and now.select("u").join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
        # large star: every larger neighbour of a node goes to the smallest node around it
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        now = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        moved = now.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = written, materialize(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        release(before)
        written = now
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
