"""Uploaded files: what is accepted, under which name, and which of them were seen before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of the files under path; content is read only where it is used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def mime_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in dims.MIME.items() for x in pair])
    return F.coalesce(F.element_at(table, F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))), F.lit("application/octet-stream"))


def safe_name(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), "[^a-zA-Z0-9._-]", "_")


def is_pdf(content: Column) -> Column:
    return F.coalesce(F.substring(content, 1, 5) == F.lit(b"%PDF-"), F.lit(False))


def language_argument(lang: Column) -> Column:
    """The language asked for, folded; auto if none; null if it is not well formed."""
    t = F.lower(F.trim(F.coalesce(F.nullif(lang, F.lit("")), F.lit("auto"))))
    return F.when(t.rlike("^[a-z0-9_+,]{2,60}$"), t)


def check_uploads(uploads: DataFrame) -> DataFrame:
    """uploads (path, mime, lang_arg, length, content) with status and error (null: accepted), pdf, name, lang and sha256."""
    lang = language_argument(F.col("lang_arg"))
    known = F.col("mime").isin(dims.ACCEPTED) & (mime_of(F.col("path")) != "application/octet-stream")
    cases = [
        (~known, 500, "Only PDF and image files (JPEG, PNG, TIFF) are accepted."),
        (F.col("length") > dims.MOST_BYTES, 500, "File too large"),
        (F.col("length") == 0, 400, "Uploaded file is empty."),
        (lang.isNull(), 400, "Invalid lang"),
    ]
    status, error = F, F
    for when, code, text in cases:
        status, error = status.when(when, code), error.when(when, text)
    return uploads.select("*", status.alias("status"), error.alias("error"), is_pdf(F.col("content")).alias("pdf"), safe_name(F.col("path")).alias("name"), lang.alias("lang"), F.sha2("content", 256).alias("sha256"))


def first_of_equal(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """rows with first, the smallest order among rows of equal key: work is done for it and joined back by key."""
    return rows.join(rows.groupBy(*key).agg(F.min(order).alias("first"), F.count("*").alias("copies")), key)


def once_per_content(rows: DataFrame, key: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work, which keeps key, done once for each distinct key and joined back to every row."""
    return rows.join(work(rows.dropDuplicates(key)), key)


def unseen(rows: DataFrame, results: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows whose result is there already, with it, and those that are new."""
    return rows.join(results, key), rows.join(results.select(*key).distinct(), key, "left_anti")


def capped_size(w: Column, h: Column, most: int = 1200) -> tuple[Column, Column]:
    """An image's size scaled so that its longer side is most at most."""
    scale = F.least(F.lit(1.0), most / F.greatest(w, h))
    return (w * scale).cast("int"), (h * scale).cast("int")
