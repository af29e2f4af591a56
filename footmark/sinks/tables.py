"""Writers. A new version is written beside the old one and published by a last small row."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def publish(df: DataFrame, root: str, metadata: Column, partition_by: Sequence[str] = ()) -> str:
    """Payload first, registry row last: readers never see half a version."""
    version = uuid.uuid4().hex
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{root}/versions/{version}")
    df.sparkSession.range(1).select(
        F.lit(version).alias("version"), F.current_timestamp().alias("published_at"),
        metadata.cast("string").alias("metadata"),
    ).coalesce(1).write.mode("append").json(f"{root}/registry")
    return version


def published(spark: SparkSession, root: str) -> DataFrame:
    """The latest published version."""
    registry = spark.read.schema(
        "version string, published_at timestamp, metadata string").json(f"{root}/registry")
    newest = registry.agg(F.max_by("version", "published_at").alias("version")).first()
    if newest is None or newest["version"] is None:
        raise ValueError("Nothing has been published here.")
    return spark.read.parquet(f"{root}/versions/{newest['version']}")


def replace_partitions(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Replace only the partitions present in ``df``; the others stay."""
    df.write.mode("overwrite").partitionBy(*keys).option(
        "partitionOverwriteMode", "dynamic").parquet(path)


def refuse_foreign(df: DataFrame, existing: DataFrame, keys: Sequence[str], owner: str) -> DataFrame:
    """Rows whose key another owner already holds: a conflict for the caller to raise."""
    foreign = existing.where(F.col("owner") != owner).select(*keys).distinct()
    return df.join(foreign, list(keys), "left_semi")


def merge_areas(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming values win, areas only in the current table stay."""
    values = [c for c in incoming.columns if c not in keys]
    a = current.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in values], F.lit(1).alias("_o"))
    b = incoming.withColumn("_n", F.lit(1))
    taken = F.col("_n").isNotNull()
    return a.join(b, list(keys), "full_outer").select(
        *keys, *[F.when(taken, F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c) for c in values],
        F.when(~taken, "kept").when(F.col("_o").isNull(), "inserted").otherwise("updated")
        .alias("action"))


def drop_orphans(areas: DataFrame, businesses: DataFrame) -> DataFrame:
    return areas.join(
        businesses.where(F.col("area_id").isNotNull()).select("area_id").distinct(),
        "area_id", "left_anti")


def relink_stations(businesses: DataFrame, mapping: DataFrame) -> DataFrame:
    """Old links are dropped; only mapped rows set a new one."""
    link = mapping.where(F.col("status") == "mapped").select("business_id", "station_id")
    return businesses.drop("station_id").join(link, "business_id", "left")


def reconciled(staged: DataFrame, source: DataFrame) -> DataFrame:
    """Stage and source totals side by side; publish only when equal."""
    both = staged.select(
        F.col("star_sum").alias("stars"), F.col("review_count").alias("n"), F.lit(True).alias("s")
    ).unionByName(source.select(
        F.col("stars").cast("long").alias("stars"), F.lit(1).cast("long").alias("n"),
        F.lit(False).alias("s")))
    side = lambda c, s: F.sum(F.when(F.col("s") == s, F.col(c)))
    return both.agg(
        side("stars", True).alias("staged_stars"), side("n", True).alias("staged_reviews"),
        side("stars", False).alias("source_stars"), side("n", False).alias("source_reviews"),
    ).withColumn("equal", (F.col("staged_stars") == F.col("source_stars"))
                 & (F.col("staged_reviews") == F.col("source_reviews")))


def publish_reconciled(staged: DataFrame, source: DataFrame, root: str, metadata: Column) -> str:
    """Publish daily review totals only if they add up to the source."""
    verdict = reconciled(staged, source).first()
    if verdict is None or not verdict["equal"]:
        raise ValueError("Staged review totals differ from the source; nothing was published.")
    return publish(staged, root, metadata)


def formula_guard(text: Column) -> Column:
    """Cells a spreadsheet would run as a formula get a leading apostrophe."""
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def export_csv(df: DataFrame, path: str, stamps: dict[str, Column]) -> None:
    """CSV with the scope stamped on every row and guarded text cells."""
    guarded = {f.name: formula_guard(F.col(f.name)) for f in df.schema.fields
               if f.dataType.simpleString() == "string"}
    df.withColumns({**guarded, **stamps}).write.mode("errorifexists").option(
        "header", True).option("quoteAll", False).csv(path)
