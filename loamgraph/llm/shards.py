"""Two-pass external shuffle into equal shards, with DataFrame and SQL functions only.

Pass one scatters rows uniformly into memory-sized buckets by a seeded hash; there are so many buckets that one holds
``BUCKET_ROWS`` rows and ``BUCKET_BYTES`` bytes at most on average. Pass two shuffles each bucket with Fisher-Yates: for
i from the last place down to 1, place i swaps with place ``hash(seed, bucket, i) mod (i + 1)``. The buckets, laid end to
end, are one random order of all rows, which is cut into ``shards`` runs whose lengths differ by one row at most; a row's
slot is its place in its run.

The hash takes the whole row and, to part repeated rows, its file and its number there, so a hot key, source or copied
row cannot fill a bucket. Files of the same names, the same seed and shard count give the same order, however a cluster
splits them. A frame that is not read from files directly is written once, with the row's number in its partition.

Defined results: null texts have no bytes; null ids and repeated rows are rows like any other; ties do not arise; one
very long text is a bucket's excess, never cut; an empty table gives an empty table; extra columns travel along unchanged
(working columns carry a reserved prefix).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamgraph.llm.common import forget, new_path, row_hash, store, table

BUCKET_ROWS = 256
BUCKET_BYTES = 1 << 20
GROUP = 1024  # buckets whose counts are summed in one window partition


def keyed(df: DataFrame, seed: int) -> DataFrame:
    """``df`` with ``_ls_key``, a seeded hash of each row and its place, the same whenever it is computed."""
    try:
        places = df.select(*[f"`{c}`" for c in df.columns], F.xxhash64("_metadata.file_name", "_metadata.row_index").alias("_ls_key"))
    except AnalysisException:  # not read from files directly
        places = store(df.withColumn("_ls_key", F.monotonically_increasing_id()), "keyed")
    return places.withColumn("_ls_key", F.xxhash64(F.lit(seed), row_hash(places)))


def scatter(rows: DataFrame, seed: int, buckets: int) -> DataFrame:
    """Pass one: ``_ls_bucket`` of each row by its ``_ls_key``."""
    return rows.withColumn("_ls_bucket", F.pmod(F.xxhash64(F.lit(seed), "_ls_key"), F.lit(buckets)))


def row_bytes(df: DataFrame):
    """About how many bytes a row has: those of its texts, and 8 for every other column."""
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    return sum((F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) for c in texts), F.lit(8 * (len(df.columns) - len(texts)))).cast("long")


def _fisher_yates(bucket: str, length, seed: int):
    """The array of places 0..length-1, shuffled: step i swaps place i and a seeded place from 0 to i."""
    length = F.col(length) if isinstance(length, str) else length
    start = F.sequence(F.lit(0), length - 1)

    def swap(acc, i):
        j = F.pmod(F.xxhash64(F.lit(seed), F.col(bucket), i), i + 1).cast("int")
        at = lambda k: F.get(acc, k)
        cut = lambda a, n: F.slice(acc, a + 1, F.greatest(n, F.lit(0)))
        swapped = F.concat(cut(F.lit(0), j), F.array(at(i)), cut(j + 1, i - j - 1), F.array(at(j)), cut(i + 1, F.size(acc) - i - 1))
        return F.when(i == j, acc).otherwise(swapped)

    steps = F.when(length > 1, F.sequence(length - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, swap)


def order_rows(df: DataFrame, seed: int = 11, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, int]:
    """``df`` with ``_ls_place``, each row's place in one seeded random order of all rows, gapless from 0; and how many
    rows there are."""
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()
    scattered = scatter(keyed(df, seed), seed, max(1, -(-rows // bucket_rows), -(-size // BUCKET_BYTES)))

    group = F.floor(F.col("_ls_bucket") / GROUP)
    counts = store(scattered.groupBy("_ls_bucket").agg(F.count("*").alias("_ls_n")).withColumn("_ls_group", group), "counts")
    groups = counts.groupBy("_ls_group").agg(F.sum("_ls_n").alias("_ls_sum"))
    before = Window.orderBy("_ls_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("_ls_group", F.coalesce(F.sum("_ls_sum").over(before), F.lit(0)).alias("_ls_base"))
    within = Window.partitionBy("_ls_group").orderBy("_ls_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_ls_in", F.coalesce(F.sum("_ls_n").over(within), F.lit(0))).join(groups, "_ls_group")
    starts = store(starts.select("_ls_bucket", (F.col("_ls_base") + F.col("_ls_in")).alias("_ls_first")), "starts")
    # a bucket's rows in the order of their keys, and the places that Fisher-Yates gives to them
    places = starts.join(counts, "_ls_bucket").select("_ls_bucket", "_ls_first", _fisher_yates("_ls_bucket", F.col("_ls_n").cast("int"), seed).alias("_ls_order"))
    places = store(places, "places")
    forget(counts, starts)
    rank = F.row_number().over(Window.partitionBy("_ls_bucket").orderBy("_ls_key", *[f"`{c}`" for c in df.columns if _orderable(df, c)])) - 1
    place = F.col("_ls_first") + F.array_position("_ls_order", F.col("_ls_rank")) - 1
    placed = scattered.withColumn("_ls_rank", rank.cast("int")).join(places, "_ls_bucket")
    return placed.select(*[f"`{c}`" for c in df.columns], place.alias("_ls_place")), rows


def _orderable(df: DataFrame, name: str) -> bool:
    return not any(k in df.schema[name].dataType.simpleString() for k in ("map<", "variant"))


def shard(df: DataFrame, shards: int = 24, seed: int = 11, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``_ls_shard`` and ``_ls_slot``; shard sizes differ by one row at most."""
    ordered, rows = order_rows(df, seed, bucket_rows)
    number = F.expr(f"int(((_ls_place + 1) * {shards}L - 1) div {max(rows, 1)}L)")  # s where floor(s n / shards) <= place < floor((s + 1) n / shards)
    first = F.expr(f"(_ls_shard * {rows}L) div {shards}L")
    return ordered.withColumn("_ls_shard", number).withColumn("_ls_slot", F.col("_ls_place") - first).drop("_ls_place")


def write_shards(df: DataFrame, path: str, shards: int = 24, seed: int = 11, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Write every shard as a folder of Parquet files under ``path`` and return a scan of them."""
    done = shard(df, shards, seed, bucket_rows)
    done.sortWithinPartitions("_ls_shard", "_ls_slot").write.partitionBy("_ls_shard").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(done.schema).parquet(path)


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 under the law ``rows``, digested from the written shards."""
    documents = table(spark, sf_dir, "documents")
    written = write_shards(documents, new_path(spark, "shards"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return written.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("_ls_shard").cast("int").alias("shard"),
        F.col("_ls_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
