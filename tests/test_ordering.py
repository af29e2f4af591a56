import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from footmark.operators.ordering import (
    average_percentiles, exact_quantiles, rank_rows, running_totals, value_positions,
)


def skewed(spark, n=600):
    """Two thirds of the rows share one group and a third one value."""
    rng = np.random.default_rng(7)
    rows = [("hot" if i % 3 else f"g{i % 7}", int(rng.integers(0, 40)) if i % 2 else 5, i)
            for i in range(n)]
    return spark.createDataFrame(rows, "g string, v long, id long").repartition(5), pd.DataFrame(
        rows, columns=["g", "v", "id"])


def test_rank_rows_equals_sorted_order(spark):
    df, pdf = skewed(spark)
    got = rank_rows(df, ["g"], [F.col("v").desc(), F.col("id")]).toPandas()
    want = pdf.sort_values(["g", "v", "id"], ascending=[True, False, True])
    want["rank"] = want.groupby("g").cumcount() + 1
    merged = got.merge(want, on=["g", "v", "id"], suffixes=("", "_want"))
    assert len(merged) == len(pdf) and (merged["rank"] == merged["rank_want"]).all()


def test_rank_rows_spans_several_slices_and_keeps_null_groups(spark):
    rows = [(None if i < 50 else "a", i) for i in range(400)]
    got = rank_rows(spark.createDataFrame(rows, "g string, id long").repartition(4), ["g"], ["id"])
    pdf = got.toPandas()
    assert sorted(pdf[pdf.g.isna()]["rank"]) == list(range(1, 51))
    assert sorted(pdf[pdf.g == "a"]["rank"]) == list(range(1, 351))


def test_global_rank_without_group(spark):
    got = rank_rows(spark.range(100).repartition(4), [], [F.col("id").desc()]).toPandas()
    assert (got["rank"] == 100 - got["id"]).all()


def test_running_totals_and_group_total(spark):
    df, pdf = skewed(spark)
    got = running_totals(df, ["g"], ["v", "id"], "v", "run", "all").toPandas().sort_values(
        ["g", "v", "id"])
    want = pdf.sort_values(["g", "v", "id"])
    assert (got["run"].to_numpy() == want.groupby("g")["v"].cumsum().to_numpy()).all()
    assert (got["all"].to_numpy() == want.groupby("g")["v"].transform("sum").to_numpy()).all()


def test_value_positions_ignore_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    rows = {r["v"]: (r["n_equal"], r["n_before"], r["n_total"])
            for r in value_positions(df, [], "v").collect()}
    assert rows == {1.0: (2, 0, 3), 3.0: (1, 2, 3)}


def test_exact_quantiles_equal_numpy(spark):
    df, pdf = skewed(spark)
    got = exact_quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.9}).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        np.testing.assert_allclose(got.loc[g].to_numpy(float), np.percentile(part.v, [25, 50, 90]))


def test_average_percentiles_ties_single_and_missing(spark):
    df = spark.createDataFrame(
        [("a", 1, 2.0), ("a", 2, 2.0), ("a", 3, 5.0), ("a", 4, None), ("b", 5, 9.0)],
        "g string, id int, v double")
    got = {r["id"]: r["p"] for r in average_percentiles(df, ["g"], "v", "p").collect()}
    assert got == {1: 0.25, 2: 0.25, 3: 1.0, 4: None, 5: 0.5}
