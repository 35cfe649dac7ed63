"""Reading and writing tables with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_json_records(spark: SparkSession, path: str, schema: str, whole_file: bool = True) -> DataFrame:
    """Records with a declared schema; what does not fit is kept in ``_corrupt_record`` instead of failing."""
    return (
        spark.read.schema(f"{schema}, _corrupt_record string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path, multiLine=whole_file)
    )


def read_csv_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path, header=True)


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, length, content`` of all files below a directory that match a glob."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length", "content")
    )


def reviewed_only(profiles: DataFrame, state: str = "state") -> DataFrame:
    return profiles.where(F.col(state) == "reviewed")


def json_facts(df: DataFrame, source: Column, mappings: dict[str, str]) -> DataFrame:
    """``df`` in long form with a row per mapped JSON path that is there: ``label, raw_value``."""
    found = F.array(
        *[F.struct(F.lit(label).alias("label"), F.get_json_object(source, path).alias("raw_value")) for path, label in mappings.items()]
    )
    out = df.withColumn("_fact", F.explode(found))
    return out.where(F.col("_fact.raw_value").isNotNull()).select(*df.columns, "_fact.label", "_fact.raw_value")


def issues(checks: list[tuple[Column, str, str]]) -> Column:
    """Validation issues of a row: structs of code and path for the checks that fail; a null check has failed."""
    found = [
        F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(path).alias("path")))
        for ok, code, path in checks
    ]
    return F.array_compact(F.array(*found))


def tree_issues(collections: list[tuple[str, DataFrame, Column, list[tuple[Column, str, str]]]]) -> DataFrame:
    """``collection, record, code, path`` of every violation in several collections, each (name, rows, record id, checks) with
    checks of its own, as ``issues`` has them."""
    found = None
    for name, rows, record, checks in collections:
        one = rows.select(F.lit(name).alias("collection"), record.cast("string").alias("record"), F.explode(issues(checks)).alias("i"))
        one = one.select("collection", "record", "i.code", "i.path")
        found = one if found is None else found.unionByName(one)
    return found
