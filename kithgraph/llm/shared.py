"""What the operators share: staged tables in the cluster's shared folder, ranks
inside hot groups, and Arrow batches cut into pieces of bounded size."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kithgraph.plans.staging import shared_dir

#: Bytes of text that are worked on at once; one longer text is a piece of its own.
PIECE_BYTES = 1 << 20
#: Files of a small staged table, and rows of a file of a larger one.
LEAST_FILES, FILE_ROWS = 8, 250_000


_OPEN = threading.local()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Delete on exit what this thread stages inside; results must be written by then."""
    outer, _OPEN.paths = getattr(_OPEN, "paths", None), []
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for p in _OPEN.paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
        _OPEN.paths = outer


def staged(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts the lineage, so a lost executor costs no recomputation of what is above,
    and whatever was non-deterministic in df is fixed from here on. A table that is known
    to have `rows` rows at most is written in files of that many, not in one for each
    shuffle partition.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, -(-rows // FILE_ROWS)))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if getattr(_OPEN, "paths", None) is not None:
        _OPEN.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def thinned(df: DataFrame, key: str, want: int) -> DataFrame:
    """About twice `want` rows of df, chosen by a hash of their key; all rows where there are no more.

    What a bounded sample is taken from: a top-k of the whole table would send k rows of
    every partition to the driver.
    """
    n = df.count()
    if n <= 2 * want:
        return df
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(2 * want / n * (1 << 30)) + 1)


def own_column(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def set_aside(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """docs with text alone under its own name and all others under names that clash with none, and the way back."""
    inner = [c if c == "text" else f"_doc{k}" for k, c in enumerate(docs.columns)]
    rows = docs.select(*(own_column(c).alias(n) for c, n in zip(docs.columns, inner, strict=True)))
    return rows, [F.col(n).alias(c) for c, n in zip(docs.columns, inner, strict=True)]


def salts(spark: SparkSession, most: int = 512) -> int:
    """Parts into which a hot group is dealt."""
    return max(1, min(most, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def salted(df: DataFrame, keys: list[str], order: list[Column | str], salt: Column) -> DataFrame:
    """Add _salt and _nth: the row's place (from 0) among those of its keys and salt."""
    w = Window.partitionBy(*keys, "_salt").orderBy(*order)
    return df.withColumn("_salt", salt).withColumn("_nth", F.row_number().over(w).cast("long") - 1)


def salt_offsets(counts: DataFrame, keys: list[str]) -> DataFrame:
    """For counts (keys, _salt, n): _off, the rows of the keys in smaller salts."""
    w = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_off", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    body = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return body[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, size: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about `size` bytes of text, their bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = utf8(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end


def crc_of(key: str = "doc_id") -> Column:
    """crc32 of an id as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
