"""Models as providers: plain Python functions run over columns of bytes, a failure being a row's own.

None is bundled. A reader gives the pages of a file, a painter its page images, a recogniser the lines of an image, a
detector its marks. Each runs in Arrow batches on the executors; what it raises becomes that row's error and leaves
other rows alone."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .uploads import once_per_content

PAGE = "page_no int, raw_text string"
IMAGE = "page_no int, image binary"
LINE = "line_no int, bbox array<double>, raw_text string"
MARK = "kind string, x int, y int, w int, h int, area double, perimeter double, page_w int, page_h int, data string"


def run_each(rows: DataFrame, col: str, work: Callable[[bytes], Iterable[tuple]], shape: str) -> DataFrame:
    """rows without col, with found (an array of shape, empty where work failed or col is null) and error (null: none)."""
    kept = rows.select(*[c for c in rows.columns if c != col], col)
    kind = ArrayType(StructType.fromDDL(shape))
    out = StructType([*kept.drop(col).schema.fields, StructField("found", kind), StructField("error", StringType())])
    names = [f.name for f in kind.elementType]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, errors = [], []
            for v in batch.column(batch.num_columns - 1).to_pylist():
                try:
                    found.append([dict(zip(names, x)) for x in work(v)] if v is not None else [])
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  whatever a model raises is that row's error
                    found.append([])
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, to_arrow_type(kind)), pa.array(errors, pa.string())], out.names)

    return kept.mapInArrow(run, out)


def read_pages(files: DataFrame, read: Callable[[bytes], Iterable[tuple]]) -> DataFrame:
    """files (doc_id, content) to pages (doc_id, page_no, raw_text): read gives (page_no, text) of each page."""
    return run_each(files.select("doc_id", "content"), "content", read, PAGE).select("doc_id", F.inline("found"))


def paint_pages(files: DataFrame, paint: Callable[[bytes], Iterable[tuple]]) -> DataFrame:
    """files (doc_id, content) to images (doc_id, page_no, image): paint gives (page_no, bytes) of each page."""
    return run_each(files.select("doc_id", "content"), "content", paint, IMAGE).select("doc_id", F.inline("found"))


def fingerprint(image: Column) -> Column:
    """The key of an image: equal bytes are one image. A caller with thumbnails may key by those instead."""
    return F.sha2(image, 256)


def recognise(images: DataFrame, read: Callable[[bytes], Iterable[tuple]], key: Callable[[Column], Column] = fingerprint) -> DataFrame:
    """images (doc_id, page_no, image) to raw lines (doc_id, page_no, line_no, bbox, raw_text): read gives (line_no, bbox,
    text) of each line and runs once for each distinct image. Blank lines go."""
    keyed = images.withColumn("key", key(F.col("image")))
    found = once_per_content(keyed.select("doc_id", "page_no", "key"), ["key"], lambda _: run_each(keyed.dropDuplicates(["key"]).select("key", "image"), "image", read, LINE).select("key", "found"))
    return found.select("doc_id", "page_no", F.inline("found")).where("trim(raw_text) <> ''")


def detect_marks(images: DataFrame, look: Callable[[bytes], Iterable[tuple]]) -> DataFrame:
    """images (doc_id, page_no, image) to contours (doc_id, page, MARK): look gives what it sees on a page."""
    return run_each(images.select("doc_id", F.col("page_no").alias("page"), "image"), "image", look, MARK).select("doc_id", "page", F.inline("found"))
