"""Small helpers that several operators of this package share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.session import drop_folder, scratch_path

# Fixed value: a word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    What is read no longer depends on earlier tasks, so a lost executor costs
    only the tasks it was running, and later passes do not repeat the work.
    """
    return _written(df, scratch_path(df.sparkSession, name))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A ``stored`` whose tables are deleted at the end of the block; what is used later has to be stored by then."""
    paths = []

    def held(df: DataFrame, name: str) -> DataFrame:
        paths.append(scratch_path(spark, name))
        return _written(df, paths[-1])

    try:
        yield held
    finally:
        for path in paths:
            drop_folder(spark, path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver was started; once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    target = os.path.join(os.path.realpath(tempfile.mkdtemp()), f"{package.name}-{context.applicationId}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def fence(column: Column) -> Column:
    """The same value, marked so that a filter above is not pushed below it, where it would repeat costly expressions."""
    return F.when(F.monotonically_increasing_id() >= 0, column)


def text_of(column: str | Column = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """All words of a text, in order."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def need_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")


def pieces(batches: Iterable[pa.RecordBatch], text_column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of each piece hold about ``limit`` bytes or are one row.

    Workers turn a piece into Python objects at once; this bounds their memory.
    """
    for batch in batches:
        column = batch.column(text_column)
        start, held = 0, 0
        for i, size in enumerate(pc.binary_length(column).to_pylist()):
            if held and held + (size or 0) > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def map_texts(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text_column: str = "text", limit: int = 8 << 20
) -> DataFrame:
    """Apply ``fn`` to Arrow pieces of ``df`` of bounded text size."""
    at = df.columns.index(text_column)
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, at, limit):
            out = fn(piece)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)
