"""What the text operators share: Arrow batches in small slices, staged tables, grouped streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footmark.session import scratch_path

SLICE_BYTES = 2 << 20
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``most`` bytes of text, so that numpy's working memory is bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(lengths, dtype=np.int64) // most
        starts = np.concatenate([[0], np.flatnonzero(np.diff(piece)) + 1, [batch.num_rows]])
        for a, b in zip(starts[:-1], starts[1:]):
            yield batch.slice(int(a), int(b - a))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh table in the shared folder and read it back: lineage is cut, executors may be lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(*tables: DataFrame) -> None:
    """Remove the files of staged tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of a stream sorted by ``keys``, each as one table; only the open group is held."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[k] for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        for column in columns:
            new[1:] |= pa.compute.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        first = tuple(c[0].as_py() for c in columns)
        new[0] = last is not None and first != last
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a or new[0]:
                if held:
                    yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
        last = tuple(c[-1].as_py() for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def fits(df: DataFrame, most_rows: int) -> bool:
    """Whether a table has at most so many rows, without counting beyond that."""
    return df.limit(most_rows + 1).count() <= most_rows


def small_side(df: DataFrame, most: int, size: Column | None = None) -> DataFrame:
    """A broadcast hint behind a checked bound; a larger table is left to shuffle joins.

    The bound is on rows of fixed width, or on the sum of ``size`` where rows hold arrays.
    """
    if size is None:
        return df.hint("broadcast") if fits(df, most) else df
    total = df.agg(F.sum(size + F.lit(1))).first()[0] or 0
    return df.hint("broadcast") if total <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_text(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and the text, a null text being empty.

    Rows of texts are far larger than Spark's own batch size has in mind: a worker and the JVM beside it each hold
    whole batches, so from here on the session sends at most ``BATCH_ROWS`` rows at once.
    """
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(BATCH_CONF)) <= BATCH_ROWS:
        conf.set(BATCH_CONF, str(BATCH_ROWS))
    return docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).alias("text"))
