"""Small helpers that the training-data operators share."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; a null text has none.

    ``bytes.split`` cuts at space and 0x09-0x0D, which is the complement of WORD.
    """
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has the name."""
    taken = {name.lower() for name in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, unless they find it where the driver does."""
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    context = spark.sparkContext
    if root in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(":")) or context in _SHIPPED:
        return
    made = os.path.join(tempfile.mkdtemp(), os.path.basename(package))
    context.addPyFile(shutil.make_archive(made, "zip", root, os.path.basename(package)))
    _SHIPPED.append(context)


_SHIPPED: list = []


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 2**22) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about ``most`` bytes of a text column; a longer text is one part."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // most
    cuts = [0, *(np.nonzero(np.diff(part))[0] + 1).tolist(), batch.num_rows]
    for start, stop in zip(cuts, cuts[1:]):
        if stop > start:
            yield batch.slice(start, stop - start)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """What runs inside sends at most ``most`` rows to Python at a time, for rows that hold long lists."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def in_parts(rows: Callable[[pa.RecordBatch], dict], most: int) -> Callable[[pa.RecordBatch], Iterator[dict]]:
    """``rows`` for at most ``most`` rows of a batch at a time, for rows that hold long lists."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for start in range(0, batch.num_rows, most):
            yield rows(batch.slice(start, most))

    return run


def map_rows(
    df: DataFrame, rows: Callable[[pa.RecordBatch], dict[str, list] | Iterator[dict[str, list]]], schema: str | StructType
) -> DataFrame:
    """``mapInArrow`` for a function that gives the columns of a batch's result, or of each of its parts."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    made = to_arrow_schema(schema)
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = rows(batch)
            for columns in [results] if isinstance(results, dict) else results:
                arrays = [
                    column if isinstance(column := columns[field.name], pa.Array) else pa.array(column, type=field.type)
                    for field in made
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=made)

    return df.mapInArrow(run, schema)


def typed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast to their types; ``typed(df, text="string")``."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns.items()])
