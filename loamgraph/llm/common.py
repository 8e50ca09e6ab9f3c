"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.plans.storage import forget, new_path, shared_dir, store, table

__all__ = ["bounded_batches", "forget", "new_path", "row_hash", "shared_dir", "store", "table", "unused"]

BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session sends rows to Python in batches of at most ``BATCH_ROWS`` rows and about ``BATCH_BYTES``.

    Spark reads these settings when a job is planned, which for a returned frame is after its operator is done, so they
    stay. Smaller settings of the user's hold.
    """
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)) > BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of a whole row, nulls included, columns of kinds that cannot be hashed aside."""
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    return F.xxhash64(F.lit(len(plain)), *plain, *[c.isNull() for c in plain])


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
