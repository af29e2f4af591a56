from pyspark.sql import functions as F

import __spark_entry__ as contract
from footmark.plans.domain import COVERAGE, WEATHER_COVERAGE, businesses, station_reports

SF = "/root/testdata/sf0.001"


def test_every_business_has_every_covered_day(spark):
    days = contract.queries()["weather_business_days_covered"](spark, SF)
    n = (COVERAGE.end - COVERAGE.start).days + 1
    per = days.groupBy("business_id").agg(F.count("day"), F.countDistinct("day"), F.min("day"), F.max("day")).collect()
    assert len(per) == businesses(spark, SF).count()
    assert {tuple(r[1:]) for r in per} == {(n, n, COVERAGE.start, COVERAGE.end)}


def test_samples_and_readings_of_the_whole_weather_span(spark):
    queries = contract.queries()
    samples = queries["weather_pooled_samples_covered"](spark, SF)
    days = {(r.station_id, r.day) for r in queries["weather_station_days"](spark, SF).collect()}
    linked = {r[0] for r in businesses(spark, SF).select("station_id").distinct().collect()}
    assert {(r.station_id, r.day) for r in samples.collect()} == {d for d in days if d[0] in linked}
    got = {r.metro: r.readings for r in queries["weather_temperature_source_covered"](spark, SF).where(
        "frequency = 'Daily summaries'").collect()}
    tmax = samples.where("series = 'tmax' and metro not in ('ASIA', 'EUROPE')").groupBy("metro").count()
    assert got == dict(tmax.collect()) and got
    first, last = station_reports(spark, SF).agg(F.min("day"), F.max("day")).first()
    assert WEATHER_COVERAGE.start <= first and last <= WEATHER_COVERAGE.end
