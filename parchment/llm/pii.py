"""Personal data: patterns, and terms that corpus co-occurrence shows to disclose what the patterns protect.

A term t near a protected entity c discloses it as far as pointwise mutual information comes up to the information of
c itself: PMI(c; t) / IC(c), which is 1 where t occurs with c only (Sanchez and Batet, 2016). Entities are each value
itself and what it shares with others: the account and the host of an address, the network of an ip, the issuer of a
card, the number before the last four digits of a phone. Counts are over all different texts. A term that different texts
show with an entity is a span wherever it occurs in any text: removed at the upper threshold, generalised from the
lower one. Of a value that is in one text only, a term beside it counts if it occurs in no other text either: then it
reveals all of it. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, place_of
from ._common import join_hot, materialize
from ._spans import TERM, located, marked, replaced, unmarked, words

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns. Possessive, and started only where a run of their characters starts or a match ended: the matches are
#: those of the plain patterns, in time linear in the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Terms, and pairs of text and term, that are broadcast (some 100 bytes each); more are joined by a shuffle.
BROADCAST_TERMS = 200_000
_PAIR = "\u0001"


def _luhn(digits: Column) -> Column:
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda a, i: a + (lambda d: F.when((F.length(digits) - i) % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))(F.substr(digits, i, F.lit(1)).cast("int")),
    )
    return total % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array of spans (kind, start, end, value), by KINDS, then start; none for null."""
    maybe = {"email": text.contains("@"), "ip": text.contains("."), "card": F.lit(True), "phone": text.contains("+")}
    plain = unmarked(text)
    found = F.transform(F.array(*[marked(plain, PATTERNS[k], maybe[k]) for k in KINDS]), lambda t: located(t))
    return let(found, lambda fs: F.concat(*[_checked(kind, fs[i]) for i, kind in enumerate(KINDS)]))


def _checked(kind: str, spans: Column) -> Column:
    kept = F.filter(spans, lambda s: _holds(kind, s["value"]))
    return F.transform(kept, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, base: Column) -> Column:
    """text with the characters of its base spans as spaces, so that places stay."""
    spans = F.sort_array(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return replaced(text, spans, lambda _, n: F.repeat(F.lit(" "), n))


def near(base: Column, held: Column, window: int, most: int) -> Column:
    """For each of base its kind, value and terms: the nearest most words on either side, whole within window characters."""

    def around(s: Column, at: Column) -> Column:
        some = F.slice(held, F.greatest(at - most + 2, F.lit(1)), F.lit(2 * most + 1))
        left = F.filter(some, lambda w: (w["end"] <= s["start"]) & (w["start"] >= s["start"] - window))
        right = F.filter(some, lambda w: (w["start"] >= s["end"]) & (w["end"] <= s["end"] + window))
        return F.concat(F.slice(right, 1, most), left)["term"]

    def told(starts: Column) -> Column:
        return F.transform(base, lambda s: F.struct(s["kind"].alias("kind"), F.lower(s["value"]).alias("value"), around(s, place_of(starts, s["start"])).alias("terms")))

    return F.when(F.size(held) > 0, let(F.transform(held, lambda w: w["start"]), told)).otherwise(F.transform(base, lambda s: F.struct(s["kind"].alias("kind"), F.lower(s["value"]).alias("value"), F.array().cast("array<string>").alias("terms"))))


def entities(kind: Column, value: Column) -> Column:
    """What is protected: the value itself first, then what it shares with others."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    wider = F.when(kind == "email", F.array(F.concat(F.lit("account:"), F.substring_index(value, "@", 1)), F.concat(F.lit("host:"), F.substring_index(value, "@", -1))))
    wider = wider.when(kind == "ip", F.array(F.concat(F.lit("net:"), F.substring_index(value, ".", 3)))).when(kind == "card", F.array(F.concat(F.lit("issuer:"), F.left(digits, F.lit(6)))))
    wider = wider.otherwise(F.array(F.concat(F.lit("number:"), F.left(digits, F.length(digits) - 4))))
    return F.concat(F.array(F.concat_ws(":", kind, value)), wider)


def _few(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if their counted number allows it."""
    return F.broadcast(rows) if rows.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else rows


def telling_terms(docs: DataFrame, texts: DataFrame, support: int, generalise_at: float, remove_at: float, least: int) -> DataFrame:
    """(digest, term, disclosure): which texts hold which disclosing terms. docs: (digest, text), all; texts: (digest, near,
    words), the different ones with base spans; least: how many different texts there are."""
    beside = texts.select("digest", F.explode("near").alias("n")).select("digest", entities(F.col("n.kind"), F.col("n.value")).alias("cs"), "n.terms")
    holders = beside.select("digest", F.explode("cs").alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("n"))
    pairs = beside.select("digest", F.posexplode("cs").alias("wider", "entity"), "terms").select("digest", (F.col("wider") > 0).alias("wider"), "entity", F.explode("terms").alias("term"))
    both = pairs.distinct().groupBy("entity", "term", "wider").agg(F.count("*").alias("texts")).where((F.col("texts") >= support) | ~F.col("wider"))
    own = texts.select("digest", F.explode(F.array_distinct(F.col("words.term"))).alias("term"))
    n, c, ct = F.lit(float(max(least, 2))), F.col("n"), F.col("texts")

    def disclosing(rows: DataFrame) -> DataFrame:
        share = F.when(c >= n, F.lit(0.0)).otherwise(F.log2(n / c * (ct / F.col("df"))) / F.log2(n / c))
        enough = F.when(ct >= support, F.col("disclosure") >= generalise_at).otherwise((c == 1) & (F.col("df") == 1) & (F.col("disclosure") >= remove_at))
        return rows.withColumn("disclosure", share).where(enough)

    # texts with base spans alone already rule out what is common among them
    seen = own.groupBy("term").agg(F.count("*").alias("df"))
    maybe = materialize(disclosing(both.join(seen, "term").join(holders, "entity")).drop("df", "disclosure"), "pii-pairs")  # with n
    terms = _few(maybe.select("term").distinct())
    # each text's different words meet the terms before anything moves
    every = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(f"({TERM})"), F.lit(1)), F.lower))
    others = docs.select("digest", F.explode(every).alias("term")).join(terms, "term", "left_semi").join(_few(texts.select("digest")), "digest", "left_anti").distinct()
    held = materialize(own.join(terms, "term", "left_semi").select("digest", "term").unionByName(others.select("digest", "term")), "pii-held")
    known = disclosing(maybe.join(held.groupBy("term").agg(F.count("*").alias("df")), "term")).groupBy("term").agg(F.max("disclosure").alias("disclosure"))
    return materialize(held.join(known, "term").select("digest", "term", "disclosure"), "pii-telling")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 120, most: int = 8, support: int = 2, generalise_at: float = 0.9, remove_at: float = 1.0) -> DataFrame:
    """Per row: id_col, digest (of the text), base and terms: arrays of spans. terms also say whether they are removed.

    The context of a value is the nearest most terms within window characters on either side. support: different texts
    that must show a term with an entity, or else both must occur in no other text; copies of one text count once. What
    is learned there holds for all texts: a telling term is a span at each of its occurrences outside base spans. Null
    texts are empty. Rows that repeat an id are looked at each on its own; rows equal in text get equal spans. Other
    columns are ignored; an empty table gives an empty result. Any number of matches in one text takes linear time.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    digest = F.sha2("text", 256).alias("digest")
    rows = own.withColumn("base", base_spans(F.col("text"))).withColumn("words", F.when(F.size("base") > 0, words(masked(F.col("text"), F.col("base")))))
    rows = materialize(rows.select("id", digest, "base", "words", near(F.col("base"), F.col("words"), window, most).alias("near"), F.monotonically_increasing_id().alias("nth")), "pii")
    # one row of each text, chosen by its number alone: the words, many times the size of all else here, stay where they are
    held = rows.where("size(base) > 0")
    firsts = held.groupBy("digest").agg(F.min("nth").alias("nth")).select("nth")
    texts = materialize(held.join(_few(firsts), "nth", "left_semi").select("digest", "words", "near"), "pii-texts")
    least = rows.agg(F.countDistinct("digest")).first()[0]
    telling = telling_terms(own.select(digest, "text"), texts, support, generalise_at, remove_at, least)
    with_base = texts.select("digest", F.explode("words").alias("w")).select("digest", "w.*").join(_few(telling), ["digest", "term"])
    # texts without base spans that hold a term which other texts give away
    rest = telling.join(texts.select("digest"), "digest", "left_anti")
    plain = own.select("text", digest).join(_few(rest.select(F.col("digest").alias("d")).distinct()), F.col("digest") == F.col("d"), "left_semi").dropDuplicates(["digest"])
    without = plain.select("digest", F.explode(words(F.col("text"))).alias("w")).select("digest", "w.*").join(rest, ["digest", "term"])
    terms = with_base.unionByName(without) if not rest.isEmpty() else with_base
    span = F.struct("start", "end", F.col("term").alias("value"), (F.col("disclosure") >= remove_at).alias("removed"))
    kind = "array<struct<kind:string,start:int,end:int,value:string,removed:boolean>>"
    told = F.transform(F.sort_array(F.collect_list(span)), lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["removed"].alias("removed")))
    terms = terms.groupBy(F.col("digest").alias("key")).agg(told.alias("terms"))
    out = join_hot(rows.select("id", "digest", "base"), F.col("digest"), F.xxhash64("id"), terms)
    return out.select(F.col("id").alias(id_col), "digest", "base", F.coalesce("terms", F.array().cast(kind)).alias("terms"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with every span replaced: values by [EMAIL], [IP], [CARD] or [PHONE], generalised terms by [TERM], removed
    terms by nothing. Overlapping spans are replaced as one, by the first. Texts without spans stay as they are, null
    too; n_chars, if there, is computed again. Rows that repeat others stay, equal ones equal; other columns pass
    through under any name."""
    hits = find(docs, id_col, text_col, **options).where("size(base) + size(terms) > 0")
    plain = "array<struct<start:int,end:int,mark:string>>"
    marks = F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("mark"))).cast(plain),
        F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["removed"], "").otherwise("[TERM]").alias("mark"))).cast(plain),
    )
    # the columns of docs travel as one, so that no name of theirs can clash
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest"))
    hits = hits.groupBy(F.col(id_col).alias("i"), F.col("digest").alias("d")).agg(F.first(F.sort_array(marks)).alias("marks"))
    both = whole.join(hits, F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")), "left")
    text = F.col("row")[text_col]
    clean = F.when(F.col("marks").isNotNull(), replaced(text, F.col("marks"), lambda m, _: F.lit("") if m is None else m["mark"])).otherwise(text)
    out = both.select("row", clean.alias("clean"))
    kept = [F.col("clean").alias(c) if c == text_col else F.length("clean").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns]
    return out.select(*kept)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    rows = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.concat("base", F.transform("terms", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))))
    return rows.select("doc_id", *(count(k) for k in KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"), F.size("terms").cast("long").alias("n_term"))
