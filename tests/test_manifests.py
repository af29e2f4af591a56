from datetime import date, timedelta

import pytest

from footmark.sources import manifests as mf

START = date(1900, 1, 1)


def test_day_differences_equal_sets(spark):
    days = lambda *n: [START + timedelta(i) for i in n]
    listed = {("a", "x"): days(0, 1, 5, 40_000), ("a", "y"): days(3), ("b", "x"): days(2, 70_000), ("d", "x"): []}
    found = {("a", "x"): days(0, 0, 5, 39_999), ("a", "y"): days(3), ("b", "x"): [], ("c", "x"): days(7, 7, 7)}
    table = lambda m: spark.createDataFrame([(*k, d) for k, v in m.items() for d in v], "s string, v string, day date")
    bits = lambda m: mf.day_bitmaps(table(m), ["s", "v"], START)
    got = {(r["s"], r["v"]): tuple(r)[2:] for r in mf.day_differences(bits(listed), bits(found), ["s", "v"]).collect()}
    want = {}
    for k in {*listed, *found}:
        a, b = set(listed.get(k, [])), found.get(k, [])
        if a or b:
            want[k] = (len(a), len(set(b)), len(a - set(b)), len(set(b) - a), len(b) - len(set(b)))
    assert got == want
    assert bits({("a", "x"): [START - timedelta(1)]}).count() == 0
    assert mf.day_differences(bits({}), bits({}), ["s", "v"]).count() == 0


def document():
    coverage = {v: {"requested_days": 10, "observed_days": 8, "missing_days": 2, "trace_days": 0} for v in mf.UNITS}
    station = lambda i: {"station_id": f"USW0000000{i}", "name": f"Station {i}", "latitude": 40.0, "longitude": -75.0, "rows": 30,
                         "coverage": coverage, "sids": ["x", f"USW0000000{i} 6"]}
    return {"schema_version": 1, "status": "complete", "rows": 60, "scope": {
        "start": "2020-01-01", "end": "2020-01-10", "frequency": "daily", "days": 10, "geographic_support": "station",
        "station_ids": ["USW00000001", "USW00000002"]}, "stations": [station(1), station(2)],
        "variables": [{"variable": v, "unit": u} for v, u in mf.UNITS.items()],
        "observations_digest": "o", "mapping_digest": "m", "scope_stations": 2}


def change(path, value):
    def run(doc):
        for key in path[:-1]:
            doc = doc[key]
        doc[path[-1]] = value
    return run


BREAKS = {
    "version or status": [change(["schema_version"], 2), change(["status"], "pending"), change(["status"], None)],
    "observations digest": [change(["observations_digest"], "p"), change(["observations_digest"], None)],
    "mapping digest": [change(["mapping_digest"], "p")],
    "days": [change(["scope", "days"], 9)],
    "frequency": [change(["scope", "frequency"], "hourly")],
    "support": [change(["scope", "geographic_support"], "county")],
    "units": [change(["variables", 0, "unit"], "degreeC"), change(["variables"], None)],
    "id form": [lambda d: (change(["scope", "station_ids", 0], "short")(d), change(["stations", 0, "station_id"], "short")(d),
                           change(["stations", 0, "sids"], ["short 6"])(d))],
    "station rows": [change(["stations", 1, "rows"], 29)],
    "station name": [change(["stations", 1, "name"], " "), change(["stations", 0, "name"], None)],
    "native id": [change(["stations", 0, "sids"], ["USW00000002 6"])],
    "coordinates": [change(["stations", 0, "latitude"], 91.0)],
    "day counts": [change(["stations", 0, "coverage", "tmax", "missing_days"], 3)],
    "rows": [change(["rows"], 61)],
    "scope stations": [change(["scope_stations"], 3)],
}


@pytest.mark.parametrize("rule", ["none", *BREAKS])
def test_each_rule_finds_its_own_fault_alone(spark, tmp_path, rule):
    import copy
    import json
    docs = []
    for broken in BREAKS.get(rule, [lambda d: None]):
        doc = copy.deepcopy(document())
        broken(doc)
        docs.append(json.dumps(doc))
    (tmp_path / "m.json").write_text("\n".join(docs))
    got = mf.problems(mf.manifests(spark, str(tmp_path / "m.json")), "o", "m").select("problems").collect()
    assert [r[0] for r in got] == [[] if rule == "none" else [rule]] * len(docs)


def test_faults_of_station_lists(spark, tmp_path):
    import copy
    import json
    docs = {name: copy.deepcopy(document()) for name in ("repeated", "absent", "empty", "variable")}
    docs["repeated"]["stations"][1] = copy.deepcopy(docs["repeated"]["stations"][0])
    docs["absent"]["scope"]["station_ids"].append("USW00000003")
    docs["empty"]["scope"]["station_ids"] = []
    del docs["variable"]["stations"][0]["coverage"]["pcpn"]
    (tmp_path / "m.json").write_text("\n".join(json.dumps(d) for d in docs.values()))
    got = [r[0] for r in mf.problems(mf.manifests(spark, str(tmp_path / "m.json")), "o", "m").select("problems").collect()]
    assert got == [["repeated or unlisted station", "absent station"], ["absent station"],
                   ["station ids", "repeated or unlisted station"], ["variables"]]
