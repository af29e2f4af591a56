import re
from pathlib import Path

import __spark_entry__ as contract

ROOT = Path(__file__).resolve().parents[1]


# Iterative fits, random draws and what is made of them; their tests check invariants or brute force.
WITHOUT_ORACLE = {
    "model_scores", "model_scope_comparison", "model_scenario", "model_scenario_and_calendar", "model_observed",
    "model_scenario_custom", "model_observed_weather", "model_recommend", "model_run",
}


def test_every_oracle_has_a_query_and_every_query_an_oracle_but_a_named_few():
    oracles, queries = set(contract.oracle_sql()), set(contract.queries())
    assert oracles <= queries
    own = {q for q in queries if not q.startswith("op") and q != "pipeline"}
    assert own - oracles == WITHOUT_ORACLE


def test_entry_runs(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "rank" in df.columns


def test_no_hidden_row_caps_or_local_checkpoints():
    for path in (ROOT / "footmark").rglob("*.py"):
        text = path.read_text()
        assert "localCheckpoint" not in text and "crossJoin" not in text, path
        assert not re.search(r"\bbroadcast\(", text), path
        assert ".rdd" not in text and ".toPandas(" not in text and ".collect(" not in text, path
