"""Index of known keys beside a stored table: a bucketed table of key hashes, of which a batch reads only the buckets it touches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.session import scratch_path

BUCKETS = 64
BUCKET = "b"
# Files of a bucket from which on `compact` writes it anew.
MANY_FILES = 32
INDEX_SCHEMA = "h1 bigint, h2 bigint, writer string, b int"


def key_hashes(key: str | Column, buckets: int = BUCKETS) -> list[Column]:
    """128 bits that stand for a key, and its bucket."""
    col = F.col(key) if isinstance(key, str) else key
    h1 = F.xxhash64(col)
    return [h1.alias("h1"), F.xxhash64(F.lit(1), col).alias("h2"), F.pmod(h1, F.lit(buckets)).cast("int").alias(BUCKET)]


def touched(keys: DataFrame) -> list[int]:
    """Buckets of the keys: at most their number."""
    return sorted(r[BUCKET] for r in keys.select(BUCKET).distinct().collect())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_index(spark: SparkSession, path: str, buckets: Sequence[int] | None = None) -> DataFrame:
    """Entries (h1, h2, writer, b); with `buckets` only their folders are listed and read. Empty before the first write."""
    folders = [path] if buckets is None else [f"{path}/{BUCKET}={k}" for k in buckets]
    folders = [f for f in folders if exists(spark, f)]
    if not folders:
        return spark.createDataFrame([], INDEX_SCHEMA)
    return spark.read.schema(INDEX_SCHEMA).option("basePath", path).parquet(*folders)


def unknown(batch: DataFrame, key: str, path: str, writer: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows of `batch`, which has one row per key, whose key no other writer has recorded; h1, h2 and b are added.

    Entries of `writer` itself do not count: they are those of an attempt that may not have come to its end.
    """
    hashed = batch.select("*", *key_hashes(key, buckets))
    entries = read_index(batch.sparkSession, path, touched(hashed)).where(F.col("writer") != writer).select("h1", "h2")
    return hashed.join(entries, ["h1", "h2"], "left_anti").select(*batch.columns, "h1", "h2", BUCKET)


def record(hashed: DataFrame, path: str, writer: str) -> None:
    """Append entries for keys with h1, h2 and b: one file for each bucket. Entries may come again; they are a set."""
    rows = hashed.select("h1", "h2", F.lit(writer).alias("writer"), BUCKET)
    rows.repartition(F.col(BUCKET)).write.mode("append").partitionBy(BUCKET).parquet(path)


def compact(spark: SparkSession, path: str, many_files: int = MANY_FILES) -> list[int]:
    """Write buckets of `many_files` files or more as one file each, without repeats, and return their numbers.

    The new files are complete before they take the place of the old ones. Writers of the index must rest.
    """
    counts = read_index(spark, path).select(BUCKET, F.input_file_name().alias("f")).distinct().groupBy(BUCKET).count()
    worn = sorted(r[BUCKET] for r in counts.where(F.col("count") >= many_files).collect())
    if worn:
        staged = scratch_path(spark, "index")
        read_index(spark, path, worn).distinct().repartition(F.col(BUCKET)).write.partitionBy(BUCKET).parquet(staged)
        replace_partitions(spark.read.schema(INDEX_SCHEMA).parquet(staged), path, [BUCKET])
    return worn


def replace_partitions(rows: DataFrame, path: str, by: Sequence[str]) -> None:
    """Put rows in place of the partitions they belong to; other partitions keep their files."""
    (rows.repartition(*[F.col(c) for c in by]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*by).parquet(path))
