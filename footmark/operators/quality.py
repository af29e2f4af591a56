"""Checks over whole tables: keys, profiles, violations, set differences, reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footmark.functions.dates import Span


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys occurring more than once; counts combine before the shuffle."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def violation_counts(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row per check with the number of offending rows, from a single pass."""
    counted = rows.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(checks.values())])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("check"), F.col(f"c{i}").alias("violations"))
        for i, name in enumerate(checks)])))


def column_profile(rows: DataFrame) -> DataFrame:
    """Type, missing rows and missing percentage of every column, from a single pass."""
    fields = [(f.name, f.dataType.simpleString()) for f in rows.schema.fields]
    counted = rows.agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(F.col(name).isNull()).alias(f"m{i}") for i, (name, _) in enumerate(fields)])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("column"), F.lit(kind).alias("dtype"),
                 F.col(f"m{i}").alias("missing_rows"),
                 F.round(F.try_divide(F.col(f"m{i}") * 100.0, F.col("n")), 2)
                 .alias("missing_percent"))
        for i, (name, kind) in enumerate(fields)])))


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows present on one side only; empty when the sets are equal."""
    return left.subtract(right).withColumn("side", F.lit("left only")).unionByName(
        right.subtract(left).withColumn("side", F.lit("right only")))


def keys_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """Multiset difference in both directions."""
    return left.exceptAll(right).withColumn("side", F.lit("left only")).unionByName(
        right.exceptAll(left).withColumn("side", F.lit("right only")))


def ownership_conflicts(*claims: DataFrame) -> DataFrame:
    """Distinct union of keys claimed by other owners."""
    out = claims[0]
    for claim in claims[1:]:
        out = out.union(claim)
    return out.distinct()


def activity_checks(totals: DataFrame, span: Span) -> DataFrame:
    return violation_counts(totals, {
        "negative count": F.col("checkins") < 0,
        "active days beyond period": ~F.col("active_days").between(0, span.days),
        "weekend beyond total": ~F.col("weekend_checkins").between(0, F.col("checkins")),
    })


def training_checks(daily: DataFrame, businesses: DataFrame) -> DataFrame:
    """Unknown ids, negative counts and repeated business-days."""
    unknown = daily.join(businesses.select("business_id"), "business_id", "left_anti").agg(
        F.count(F.lit(1)).alias("violations")).select(F.lit("unknown id").alias("check"), "violations")
    negative = violation_counts(daily, {"negative count": F.col("checkins") < 0})
    repeated = duplicate_keys(daily, ["business_id", "day"]).agg(
        F.count(F.lit(1)).alias("violations")).select(
            F.lit("repeated business-day").alias("check"), "violations")
    return unknown.unionByName(negative).unionByName(repeated)


def reconcile(totals: dict[str, DataFrame], value: str) -> DataFrame:
    """Grand total of ``value`` per named table, and whether it equals the first one."""
    rows = None
    for name, df in totals.items():
        one = df.agg(F.sum(value).alias("total")).select(F.lit(name).alias("source"), "total")
        rows = one if rows is None else rows.unionByName(one)
    first = F.max(F.when(F.col("source") == next(iter(totals)), F.col("total"))).over(
        Window.partitionBy(F.lit(0)))  # one row per named table
    return rows.withColumn("matches", F.col("total").eqNullSafe(first))


def same_population(metrics: DataFrame, keys: Sequence[str], models: int) -> DataFrame:
    """Saved scores must be finite, non-negative and share one population for all models."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) >= 0)
    return metrics.groupBy(*keys).agg(
        F.countDistinct("model").alias("models"),
        F.countDistinct("observations").alias("populations"),
        F.bool_and(finite("poisson_deviance") & finite("mae")).alias("finite"),
    ).withColumn("valid", (F.col("models") == models) & (F.col("populations") == 1) & F.col("finite"))


def latest_complete(registry: DataFrame) -> DataFrame:
    """Newest complete registry row per import key (``max`` combines map-side)."""
    get = lambda p: F.get_json_object("metadata", p)
    rows = registry.where(get("$.status") == "complete").groupBy(
        get("$.import_key").alias("import_key")).agg(
        F.max(F.struct("id", "metadata")).alias("latest"))
    return rows.select("import_key", "latest.id", "latest.metadata")


def ready(latest: DataFrame, policy: str) -> DataFrame:
    """Latest imports whose policy matches and whose coverage is ordered."""
    get = lambda p: F.get_json_object("metadata", p)
    return latest.select(
        "import_key", "id", get("$.import_revision").alias("import_revision"),
        get("$.business_import_revision").alias("business_import_revision"),
        get("$.coverage.start_date").try_cast("date").alias("start_date"),
        get("$.coverage.end_date").try_cast("date").alias("end_date"),
        get("$.timestamp_policy").alias("timestamp_policy"),
    ).withColumn("ready", F.coalesce(
        (F.col("timestamp_policy") == policy) & (F.col("end_date") >= F.col("start_date"))
        & (F.col("import_revision") != ""), F.lit(False)))


def bound_imports(latest: DataFrame, policy: str) -> DataFrame:
    """(import_key, bound_to): ready newest imports and the import key whose newest revision they name.

    An import counts only while the revision it was made for is the newest complete one.
    """
    current = ready(latest, policy)
    newest = current.select(F.col("import_key").alias("bound_to"), F.col("import_revision").alias("its_revision"))
    return current.where("ready").join(
        newest, F.col("business_import_revision") == F.col("its_revision")).select("import_key", "bound_to")


def row_digest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Order-free digest per key: row count and the sums of four parts of the rows' SHA-256 (no group is collected).

    A row's text is its columns in their order, cast to text and joined by the unit separator; a null
    is shown as the empty-set sign.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u2205")) for c in rows.columns])
    part = lambda i: F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")
    return rows.withColumn("_h", F.sha2(text, 256)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.concat_ws("-", *[F.sum(part(i)).cast("string") for i in range(4)]).alias("digest"))
