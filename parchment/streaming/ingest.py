"""Documents as they arrive: the batch analysis on each micro-batch, each content once a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.analyze import Providers, analyze

PAGES = "doc_id long, page_no int, raw_text string, arrived timestamp"


def arriving(spark: SparkSession, path: str, keep: str = "24 hours") -> DataFrame:
    """Pages under path as a stream; a page equal to one of the last keep hours is dropped, by state bounded to them."""
    pages = spark.readStream.schema(PAGES).parquet(path)
    keyed = pages.withColumn("sha256", F.sha2("raw_text", 256)).withWatermark("arrived", keep)
    return keyed.dropDuplicatesWithinWatermark(["doc_id", "page_no", "sha256"]).drop("sha256")


def analyze_stream(pages: DataFrame, out: str, checkpoint: str, providers: Providers, available_now: bool = True):
    """Writes the decisions of each micro-batch under out; a batch that is run again replaces its own folder."""

    def batch(df: DataFrame, number: int) -> None:
        analyze(df.drop("arrived"), providers)["decisions"].write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def health(spark: SparkSession, providers: Providers | None = None, recogniser: object | None = None) -> dict[str, bool]:
    """Whether the session answers, and which models were given."""
    return {"success": not spark.sparkContext._jsc.sc().isStopped(), "recogniser_ready": recogniser is not None, "translator_ready": bool(providers and providers.translate)}
