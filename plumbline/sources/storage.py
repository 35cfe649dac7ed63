"""Cutting lineage, and tables keyed by content or written once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the cluster's ``spark.checkpoint.dir``.  Where that is unset, a local session takes a folder below the
    warehouse; on a cluster, whose executors may not share that, it is an error."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(given or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return df.checkpoint(eager=True)


def put_content(df: DataFrame, content: str, path: str) -> DataFrame:
    """Add the contents that ``path`` lacks, keyed by their sha256, and return every row's key.

    Rows that are there already are left alone, so a repeated run adds nothing.
    """
    keyed = df.withColumn("digest", F.sha2(F.col(content).cast("binary"), 256))
    spark = df.sparkSession
    new = keyed.select("digest", F.col(content).alias("content")).where(F.col("digest").isNotNull()).dropDuplicates(["digest"])
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        new = new.join(spark.read.parquet(path).select("digest"), "digest", "left_anti")
    cut(new).write.mode("append").parquet(path)
    return keyed


def get_content(refs: DataFrame, path: str) -> DataFrame:
    """``refs`` (``digest``) with their content and ``intact``, whether it still has that digest; a miss is null."""
    stored = refs.sparkSession.read.parquet(path)
    out = refs.join(stored, "digest", "left")
    return out.withColumn("intact", F.sha2(F.col("content").cast("binary"), 256) == F.col("digest"))


def create_only(df: DataFrame, key: list[str], path: str) -> None:
    """Write ``df`` to a new table; duplicate keys or a table that exists are an error, and nothing is written."""
    twice = df.groupBy(*key).count().where(F.col("count") > 1)
    if not twice.isEmpty():
        raise ValueError(f"keys {key} are not unique")
    df.write.mode("errorifexists").parquet(path)


def create_unless_colliding(df: DataFrame, keys: list[list[str]], stored: DataFrame, path: str) -> None:
    """Write new records to a new table unless any of them agrees with another new one or a ``stored`` one in any of several
    composite keys; a collision is an error, and nothing is written.  A key with a null part does not collide."""
    for key in keys:
        whole = df.dropna(subset=key)
        if not whole.groupBy(*key).count().where(F.col("count") > 1).isEmpty() or not whole.join(stored.select(*key), key, "left_semi").isEmpty():
            raise ValueError(f"records collide in {key}")
    df.write.mode("errorifexists").parquet(path)


def partition_snapshots(df: DataFrame, parts: list[str]) -> DataFrame:
    """``parts, rows, snapshot``: a digest of the rows of each partition that does not depend on their order.

    The sum of 60 bits of each row's digest, so it is combined before the shuffle; repeated rows count as often as they are there.
    """
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    bits = F.conv(F.substring(F.sha2(row.cast("binary"), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.groupBy(*parts).agg(F.count("*").alias("rows"), F.sum(bits).cast("string").alias("snapshot"))


def replace_partitions(df: DataFrame, parts: list[str], expected: DataFrame, path: str) -> None:
    """Replace the partitions of a table that ``df`` has rows of, if each still is what the writer has read.

    ``expected`` are the ``partition_snapshots`` of the table as it was read.  If a partition of ``df`` is not the expected one now, was
    not there then and is now, or is gone, that is an error, and nothing is written.  Other partitions keep their files.  Plain Parquet
    has no locks, so a writer that comes between the comparison and the write is not seen: one writer at a time for a table.
    """
    fresh = cut(df)
    touched = fresh.select(*parts).distinct()
    stored = fresh.sparkSession.read.parquet(path)
    now = partition_snapshots(stored.join(touched, parts, "left_semi"), parts)
    before = expected.join(touched, parts, "left_semi").select(*parts, F.col("snapshot").alias("_before"))
    stale = now.join(before, parts, "full").where(~F.col("snapshot").eqNullSafe(F.col("_before")))
    if not stale.isEmpty():
        raise ValueError("partitions have changed since they were read")
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
