"""Mixing sources to target weights: exact block quotas, split over the output shards by a hypergeometric tree.

The documents of a source lie on a line of words in an order drawn by hash, cut into equal blocks. A source's target
becomes an exact quota of block draws: whole passes over its blocks, then a part of one more pass in a permuted
order. A tree splits the vector of quotas over the output shards: at each node the draws of the left half are
multivariate-hypergeometric, so every shard holds a random mixture while the quotas hold exactly; the draws of a
source, numbered in permuted order, are dealt to shards as consecutive ranges, so shards are disjoint.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import let
from ._common import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: The largest blocks, in words, and the blocks that a source has at least (with as many words).
BLOCK_WORDS, BLOCKS_LEAST = 1024, 256
#: The tree holds less than 2**29 draws: beyond, blocks get larger.
BLOCKS_MOST = 1 << 28
#: Shards times sources in the table that is broadcast, 8 bytes each: beyond, shards get larger.
RANGES_MOST = 1 << 21
#: Sources whose figures (some 100 bytes each) are broadcast; more are joined by a shuffle.
CATALOGUE_MOST = 100_000
#: Documents of a source that are put in order at once.
ORDERED = 4096


def targets(sizes: dict, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict:
    """Words to take of each source. Sources by code point, null last, take the weights in turn; a target stops at
    most times its source's size and what it cannot take is shared again by weight, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, rest, out = share * sum(sizes.values()), set(order), {}
    while rest:
        unit = left / sum(weight[s] for s in rest)
        full = [s for s in order if s in rest and unit * weight[s] >= most * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in rest}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
            rest.discard(s)
    return out


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """(shards, sources) draws: each shard's sum is equal but for rounding, each source's is its quota."""
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, np.array(quotas, np.int64))]
    while todo:
        a, b, q = todo.pop()
        if b - a == 1:
            out[a] = q
            continue
        half = (a + b) // 2
        n = int(q.sum()) * (half - a) // (b - a)
        left = np.random.default_rng([seed, a, b]).multivariate_hypergeometric(q, n, method="marginals")
        todo += [(a, half, left), (half, b, q - left)]
    return out


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))


def range_ends(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """The ends of the shards' ranges of draws, source by source, when all sources' draws are numbered in one sequence."""
    ends = split_quotas(quotas, shards, seed).cumsum(axis=0).T
    return (ends + (np.cumsum(quotas) - quotas)[:, None]).ravel()


def plan(rows: DataFrame, shard_words: int, seed: int, **shares) -> tuple[DataFrame, np.ndarray, int]:
    """To rows (id, source, size) each one's place on its source's line, with its source's quota and first draw; the
    ends of the shards' ranges (see range_ends); and how many shards there are.

    The driver holds one row per source (not per document): its size, target, quota and ranges per shard.
    """
    spark = rows.sparkSession
    rows = materialize(rows.withColumn("u", F.xxhash64(F.lit(seed), "id")), "mix-sizes")
    found = {r["source"]: r for r in rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).collect()}
    sizes = {s: r["words"] for s, r in found.items()}
    wanted = targets(sizes, **shares)
    least = math.ceil(sum(sizes.values()) / BLOCKS_MOST)
    info = []
    for s in sorted(found, key=lambda s: (s is None, (s or "").encode())):
        block = max(1, min(BLOCK_WORDS, sizes[s] // BLOCKS_LEAST), least)
        blocks = -(-sizes[s] // block)
        quota = round(wanted[s] * blocks / sizes[s]) if sizes[s] else 0
        step = max(1, round(blocks * 0.6180339887))
        while math.gcd(step, max(blocks, 1)) != 1:
            step += 1
        info.append((s, sizes[s], float(wanted[s]), block, blocks, quota, step, -(-found[s]["docs"] // ORDERED)))
    quotas = [x[5] for x in info]
    shards = max(1, min(round(sum(x[2] for x in info) / shard_words), RANGES_MOST // max(1, len(info))))
    kinds = "source string, source_size long, target double, block long, blocks long, quota long, step long, buckets long, nth int, first long"
    catalogue = spark.createDataFrame([(*x, i, a) for i, (x, a) in enumerate(zip(info, accumulate(quotas, initial=0)))], kinds)
    # two levels of prefix sums give each document its place: buckets of a source by hash, then documents of a bucket
    known = rows.withColumnRenamed("source", "s").join(F.broadcast(catalogue) if len(info) <= CATALOGUE_MOST else catalogue, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    unit = F.shiftrightunsigned(F.col("u"), 33)
    known = known.withColumn("bucket", F.shiftright(unit * F.col("buckets"), 31))
    of = ["source", "bucket"]
    sums = known.groupBy(*of).agg(F.sum("size").alias("in_bucket"))
    before = F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.sum("size").over(Window.partitionBy(*of).orderBy("u", "id", "size").rowsBetween(Window.unboundedPreceding, -1))
    placed = known.withColumn("inside", F.coalesce(inside, F.lit(0))).join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    placed = placed.withColumn("at", F.col("base") + F.col("inside")).drop("s", "b", "base", "inside", "buckets", "bucket")
    return placed, range_ends(quotas, shards, seed) if info else np.empty(0, np.int64), shards


_DRAWS = "array<struct<from:bigint,words:bigint,pass:bigint,shard:bigint>>"


def _draws(passes: Column, part: Column) -> Column:
    """Structs (from, words, pass, shard) of a document's draws: word ranges, by block and pass. For shard they hold the
    draw's number among the draws of all sources."""
    first, last = F.expr("at div block"), F.expr("(at + size - 1) div block")
    number = lambda k: F.pmod(k * F.col("step"), F.col("blocks"))  # noqa: E731  the block's place in the permuted order

    def piece(k: Column, nth: Column) -> Column:
        start = F.greatest(k * F.col("block"), F.col("at"))
        stop = F.least((k + 1) * F.col("block"), F.col("at") + F.col("size"))
        index = F.col("first") + nth * F.col("blocks") + number(k)
        return F.struct((start - F.col("at")).alias("from"), (stop - start).alias("words"), nth.alias("pass"), index.alias("shard"))

    ks = F.sequence(first, last)
    whole = F.flatten(F.transform(F.sequence(F.lit(1), passes), lambda nth: F.transform(ks, lambda k: piece(k, (nth - 1).cast("long")))))
    more = F.transform(F.filter(ks, lambda k: number(k) < part), lambda k: piece(k, passes.cast("long")))
    empty = F.filter(more, lambda _: F.lit(False))
    return F.when(F.col("size") > 0, F.concat(F.when(passes > 0, whole).otherwise(empty), more)).otherwise(F.array().cast(_DRAWS))


def mix_quotas(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_words: int = 1_000_000, seed: int = 17, **shares) -> DataFrame:
    """Per row: id_col, size (words), source_size, target, taken and draws (word ranges with their pass and shard).

    Null texts have size 0; null sources are one source, the last. A document without words takes nothing, rows that
    repeat an id are documents of their own, an empty table gives an empty result, other columns are ignored. Reruns
    give the same rows: all draws follow from hashes and the seed.
    """
    return _quotas(_sized(docs, id_col, text_col, source_col), shard_words, seed, **shares).withColumnRenamed("id", id_col)


def _quotas(rows: DataFrame, shard_words: int, seed: int, **shares) -> DataFrame:
    spark = rows.sparkSession
    passes, part = F.expr("cast(if(blocks = 0, 0, quota div blocks) as int)"), F.expr("if(blocks = 0, 0, quota % blocks)")
    placed, ends, shards = plan(rows, shard_words, seed, **shares)
    drawn = placed.withColumn("draws", _draws(passes, part))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    drawn = drawn.select("id", "size", "source_size", "target", taken.alias("taken"), "draws", "nth")
    kind = drawn.schema["id"].dataType.simpleString()
    found = drawn.mapInArrow(_to_shards(spark.sparkContext.broadcast(ends), shards), f"id {kind}, size long, source_size long, target double, taken long, draws {_DRAWS}")
    return found.withColumn("draws", F.col("draws").cast(_DRAWS.replace("shard:bigint", "shard:int")))


def _to_shards(ends, shards: int):
    """In draws, the shard whose range holds a draw in place of the draw's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = batch.column("draws")
            each = draws.flatten()
            parts = dict(zip((f.name for f in each.type), each.flatten()))
            n = pc.list_value_length(draws).to_numpy()
            number = parts["shard"].to_numpy()
            parts["shard"] = pa.array(np.searchsorted(ends.value, number, "right") - np.repeat(batch.column("nth").to_numpy().astype(np.int64), n) * shards, pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.StructArray.from_arrays(list(parts.values()), list(parts)))
            names = ["id", "size", "source_size", "target", "taken"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists], [*names, "draws"])

    return run


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_words: int = 1_000_000, seed: int = 17, **shares) -> DataFrame:
    """The mixture: a row for each pass over a document, with the columns of docs. A pass that takes all words keeps the
    text as it is; a partial one has the words it draws, joined by spaces. n_chars, if there, is computed again. Rows
    are dealt by shard and shuffled within it. A pass over a document stays whole: it goes to the shard of one of its
    draws, chosen by hash, so the quotas of shards hold for draws, not for the rows of long documents. Rows that repeat
    an id and its text count once here; a null source is one source, and documents without words take nothing."""
    parts = F.coalesce(F.col(id_col).cast("string"), F.lit("\u0002")), F.coalesce(F.col(text_col), F.lit(""))
    # the columns of docs travel as one, so that no name of theirs can clash
    whole = docs.select(F.sha2(F.concat_ws("\u0001", *parts), 256).alias("key"), F.struct(*docs.columns).alias("row"))
    sized = _sized(whole.select("key", F.col("row")[text_col].alias("text"), F.col("row")[source_col].alias("source")), "key", "text", "source")
    quotas = _quotas(sized.groupBy("id").agg(F.min("source").alias("source"), F.min("size").alias("size")), shard_words, seed, **shares)
    drawn = quotas.select(F.col("id").alias("key"), "size", F.explode("draws").alias("d"))
    runs = drawn.groupBy("key", F.col("d.pass").alias("pass")).agg(
        F.sum("d.words").alias("words"), F.first("size").alias("size"), F.min_by("d.shard", F.xxhash64(F.lit(31), "key", "d.pass", "d.from")).alias("shard"),
        F.sort_array(F.collect_list(F.struct(F.col("d.from").alias("from"), F.col("d.words").alias("words")))).alias("ranges"),
    )
    # one shuffle of the texts serves the join and what finds repeated rows
    nth = F.row_number().over(Window.partitionBy("key", "pass").orderBy("shard"))
    out = runs.join(whole, "key").withColumn("nth", nth).where("nth = 1")
    words = F.regexp_extract_all(F.col("row")[text_col], F.lit(WORD), F.lit(0))
    cut = let(words, lambda ws: F.array_join(F.flatten(F.transform("ranges", lambda r: F.slice(ws, (r["from"] + 1).cast("int"), r["words"].cast("int")))), " "))
    out = out.withColumn("made", F.when(F.col("words") < F.col("size"), cut).otherwise(F.col("row")[text_col]))
    out = out.repartition("shard").sortWithinPartitions("shard", F.xxhash64(F.lit(29), "key", "pass"))
    return out.select(*[F.col("made").alias(c) if c == text_col else F.length("made").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns])


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_quotas(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "size", "source_size", "target", "taken", F.array_sort(F.array_distinct(F.col("draws.shard"))).alias("shards")
    )
