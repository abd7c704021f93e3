"""Conversations in reply order, from quotations: passages under ``>`` marks are linked to the messages they quote.

Each line's quote level is its number of leading marks. Lines of one level in a row make a passage; its text, folded,
is hashed and joined to what earlier messages of the conversation wrote themselves: whole texts, and runs of whole lines
or whole paragraphs, of as many as the conversation's quotations have. A message replies to
the message of its first outermost quotation that is found, and else continues the one before it. All of it is
DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import let
from ._common import materialize, release

#: Turns whose neighbours one task looks up at a time: a conversation of any length is dealt to many tasks.
BUCKET = 1024
_MARKS = r"^((?:[ \t]{0,3}>)+)[ \t]?"
_LINE, _PARAGRAPH = "\n", r"\n[ \t]*\n"
_ATTRIBUTION = r"(?i)^\s*(on\s.{0,120}\swrote|.{0,80}\s(wrote|said|writes))\s*:\s*$"


def passages(text: Column) -> Column:
    """array<struct<level,body>>: runs of lines of one quote level, in order. Lines that only say who wrote what follows
    count as part of the quotation when one follows."""
    lines = F.transform(
        F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n", -1),
        lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 1), "[^>]", "")).alias("level"), F.regexp_replace(x, _MARKS, "").alias("body")),
    )

    def runs(ls: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: (i == 0) | (F.get(ls, i)["level"] != F.get(ls, i - 1)["level"]))
        passage = lambda hs, at, k: F.struct(F.get(ls, at)["level"].alias("level"), F.array_join(F.slice(ls["body"], at + 1, F.coalesce(F.get(hs, k + 1), F.size(ls)) - at), "\n").alias("body"))
        return let(heads, lambda hs: F.transform(hs, lambda at, k: passage(hs, at, k)))

    return let(lines, runs)


def folded(body: Column) -> Column:
    """What two copies of a passage share: lower case, letters and digits, single spaces."""
    return F.trim(F.regexp_replace(F.lower(body), r"[^\p{L}\p{N}]+", " "))


def _units(body: Column, end: str) -> Column:
    """The folded lines or paragraphs of a text that hold letters or digits."""
    return F.filter(F.transform(F.split(body, end), folded), lambda x: x != "")


def _runs(units: Column, lengths: Column) -> Column:
    """Hashes of all runs of consecutive units that have one of the lengths."""
    run = lambda us, n: F.transform(F.sequence(F.lit(1), F.size(us) - n + 1), lambda i: F.sha2(F.array_join(F.slice(us, i, n), " "), 256))
    # bound as a lambda's variable, the units are computed once
    return F.flatten(F.transform(F.array(units), lambda us: F.flatten(F.transform(F.filter(lengths, lambda n: n <= F.size(us)), lambda n: run(us, n)))))


def reply_order(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per turn: conv, turn, role, quote_depth (deepest level), n_quotes (quoted passages), n_linked (those found),
    parent_turn, reply_path and text without quotations.

    parent_turn: the first message of the conversation that wrote what the turn quotes first at level 1, or else the
    turn before; null for the first. Sorted by (conv, reply_path), a conversation reads in reply order: each message
    stands behind what it answers, ahead of what answers it. A quotation that nobody wrote, or only the turn itself or
    a later one, links nothing; nor does a part of a line that is quoted without the rest of its line. Null texts are empty, null roles stay; rows whose conversation or turn is null come
    back with a null parent and path. Rows that repeat a turn are that turn's, each with its own quotations; the
    smallest parent counts for all. An empty table gives an empty result.
    """
    own = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    plain = F.array(F.struct(F.lit(0).alias("level"), F.col("text").alias("body")))
    parsed = own.withColumn("ps", F.when(F.col("text").contains(">"), passages(F.col("text"))).otherwise(plain))
    kept = F.transform(F.filter("ps", lambda p: p["level"] == 0), lambda p: p["body"])
    clean = F.when(F.size("ps") == 1, F.when(F.col("ps")[0]["level"] == 0, F.col("text")).otherwise("")).otherwise(
        F.btrim(F.array_join(F.filter(F.split(F.array_join(kept, "\n"), "\n", -1), lambda x: ~x.rlike(_ATTRIBUTION)), "\n"), F.lit(" \t\n"))
    )
    quotes = F.filter("ps", lambda p: (p["level"] > 0) & (folded(p["body"]) != ""))
    rows = parsed.select(
        "conv", "turn", "role", clean.alias("clean"), F.array_max(F.transform("ps", lambda p: p["level"])).alias("depth"),
        F.transform(quotes, lambda p: F.struct(p["level"].alias("level"), F.sha2(folded(p["body"]), 256).alias("hash"), F.size(_units(p["body"], _LINE)).alias("lines"), F.size(_units(p["body"], _PARAGRAPH)).alias("paragraphs"))).alias("quotes"),
    )
    rows = materialize(rows, "turns")
    there = rows.where("conv is not null and turn is not null")
    asked = there.where("size(quotes) > 0").select("conv", "turn", F.posexplode("quotes").alias("nth", "q")).select("conv", "turn", "nth", "q.*")
    # what a message wrote can be quoted whole, or by lines or paragraphs in a row; the first to write it is its author
    lengths = asked.groupBy("conv").agg(F.collect_set("lines").alias("lines"), F.collect_set("paragraphs").alias("paragraphs"))
    whole = F.array(F.sha2(folded(F.col("clean")), 256))
    runs = F.concat(whole, _runs(_units(F.col("clean"), _PARAGRAPH), F.array_union("paragraphs", F.array(F.lit(1)))), _runs(_units(F.col("clean"), _LINE), F.array_union("lines", F.array(F.lit(1)))))
    written = there.join(lengths, "conv").select("conv", "turn", F.explode(F.array_distinct(runs)).alias("hash")).groupBy("conv", "hash").agg(F.min("turn").alias("author"))
    links = asked.join(written, ["conv", "hash"]).where("author < turn")
    answers = links.groupBy("conv", "turn").agg(F.countDistinct("nth").alias("n_linked"), F.min(F.when(F.col("level") == 1, F.struct("nth", "author"))).alias("outer"))
    answers = answers.select("conv", "turn", "n_linked", F.col("outer.author").alias("quoted"))
    # the turn before, by buckets of turns, so that one long conversation is many groups
    ids = there.groupBy("conv", "turn").agg(F.count("*").alias("n")).withColumn("bucket", F.floor(F.col("turn") / BUCKET))
    heads = ids.groupBy("conv", "bucket").agg(F.max("turn").alias("last"))
    before = heads.select("conv", "bucket", F.lag("last").over(Window.partitionBy("conv").orderBy("bucket")).alias("carried"))
    near = ids.withColumn("near", F.lag("turn").over(Window.partitionBy("conv", "bucket").orderBy("turn")))
    chain = near.join(before, ["conv", "bucket"]).select("conv", "turn", F.coalesce("near", "carried").alias("previous"))
    nodes = materialize(chain.join(answers, ["conv", "turn"], "left"), "replies")
    # a quotation starts a branch; turns that quote nothing found continue the branch of the turn before them
    branch = nodes.where("quoted is not null").select("conv", F.col("turn").alias("head"), F.col("quoted").alias("at"))
    paths = _paths(nodes, branch)
    both = rows.join(paths.select(F.col("conv").alias("c"), F.col("turn").alias("t"), "n_linked", "parent", "path"), (F.col("conv") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    return both.select(
        F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), F.col("depth").alias("quote_depth"), F.size("quotes").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("int").alias("n_linked"), F.col("parent").alias("parent_turn"), F.col("path").alias("reply_path"), F.col("clean").alias("text"),
    )


def _paths(nodes: DataFrame, branch: DataFrame) -> DataFrame:
    """nodes with parent and path. A branch's path is its parent branch's and the turn it answers; each
    round, written to the shared folder, doubles the depth of nested branches that is known."""
    # the branch of a turn is the last head up to it, by buckets again
    heads = branch.withColumn("bucket", F.floor(F.col("head") / BUCKET))
    heads = heads.groupBy("conv", "bucket").agg(F.max("head").alias("last"))
    spread = nodes.withColumn("bucket", F.floor(F.col("turn") / BUCKET))
    own = F.max(F.when(F.col("quoted").isNotNull(), F.col("turn"))).over(Window.partitionBy("conv", "bucket").orderBy("turn"))
    all_buckets = spread.select("conv", "bucket").distinct().join(heads, ["conv", "bucket"], "left")
    carried = all_buckets.select("conv", "bucket", F.max("last").over(Window.partitionBy("conv").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    placed = materialize(spread.withColumn("own", own).join(carried, ["conv", "bucket"]).withColumn("head", F.coalesce("own", "carried")).drop("own", "carried", "bucket"), "branches")
    at = branch.join(placed.select("conv", F.col("turn").alias("at"), F.col("head").alias("up")), ["conv", "at"])
    # each round doubles how far up a branch's path is known
    done = materialize(at.select("conv", "head", "up", F.array("at").alias("base")), "paths")
    while not done.where("up is not null").isEmpty():
        above = done.select("conv", F.col("head").alias("up"), F.col("up").alias("far"), F.col("base").alias("front"))
        both = done.join(above, ["conv", "up"], "left")
        front = F.coalesce("front", F.array().cast("array<bigint>"))
        before, done = done, materialize(both.select("conv", "head", F.col("far").alias("up"), F.concat(front, "base").alias("base")), "paths")
        release(before)
    done = done.drop("up")
    out = placed.join(done, ["conv", "head"], "left")
    path = F.concat(F.coalesce("base", F.array().cast("array<bigint>")), F.array("turn"))
    return out.select("conv", "turn", "n_linked", F.coalesce("quoted", "previous").alias("parent"), path.alias("path"))


def op9_quotes(spark, sf_dir: str) -> DataFrame:
    return reply_order(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
