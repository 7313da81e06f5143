import datetime as dt

import pytest
from pyspark.sql import functions as F

from rows import RAW_DDL, at
from stationflow.functions.clock import instant, utc_day
from stationflow.operators import contract, lookup, newest
from stationflow.session import require_utc


def test_instants_must_be_utc(spark):
    for bad in ("2026-01-01T00:00:00", "2026-01-01T00:00:00+02:00", dt.datetime(2026, 1, 1)):
        with pytest.raises(ValueError, match="UTC"):
            instant(bad)
    got = spark.range(1).select(instant("2026-01-01T00:00:00+00:00").alias("t")).first().t
    assert got == dt.datetime(2026, 1, 1)
    naive = spark.range(1).select(F.lit(dt.datetime(2026, 1, 1)).cast("timestamp_ntz").alias("observed_at"))
    with pytest.raises(ValueError, match="zone"):
        contract.require_instants(naive)


def test_utc_day_ignores_the_session_zone(spark):
    rows = spark.range(1).select(instant("2026-01-01T23:30:00+00:00").alias("t"))
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert rows.select(utc_day("t").alias("d")).first().d == dt.date(2026, 1, 1)
        with pytest.raises(ValueError, match="UTC"):
            require_utc(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_union_is_strict(spark):
    one, other = spark.range(1), spark.range(1).withColumn("id", F.lit("x"))
    with pytest.raises(ValueError, match="differ"):
        contract.union_strict(one, other)


def test_conform_rejects_what_does_not_fit(spark):
    from pyspark.errors import PySparkException

    rows = spark.createDataFrame([("s", "a", at(2026, 1, 1), "many", 1, True, True, True)],
                                 RAW_DDL.replace("num_vehicles_available bigint", "num_vehicles_available string"))
    for missing in ("num_vehicles_disabled", "num_docks_disabled", "num_vehicles_electric", "num_vehicles_human"):
        rows = rows.withColumn(missing, F.lit(None))
    with pytest.raises(PySparkException):
        contract.conform(rows, "station_status").collect()


def test_one_system(spark):
    two = spark.createDataFrame([("a",), ("b",), ("a",)], "system_id string")
    assert contract.resolve_system_id(two.where("system_id = 'a'")) == "a"
    assert contract.resolve_system_id(two, "b") == "b"
    with pytest.raises(ValueError, match="exactly one"):
        contract.resolve_system_id(two)


def test_unique_identity(make_raw):
    rows = make_raw([(0, 1), (5, 2)])
    contract.require_unique(rows)
    with pytest.raises(ValueError, match="identity"):
        contract.require_unique(rows.union(rows.limit(1)))


def test_hot_identity_and_null_newest(spark, make_raw):
    """A third of all rows are copies of one identity."""
    copies = make_raw([(0, 1)]).select("*", F.explode(F.sequence(F.lit(1), F.lit(500))).alias("n"))
    others = make_raw([(i, 2) for i in range(1, 1000)]).withColumn("n", F.lit(0))
    kept = newest.keep_last(copies.union(others), ["n"])
    assert kept.count() == 1000 and kept.where("n = 500").count() == 1
    history = spark.createDataFrame(
        [("s", "a", 10, at(2026, 1, 1)), ("s", "a", None, at(2026, 1, 2))],
        "system_id string, station_id string, capacity bigint, observed_at timestamp",
    )
    assert newest.current_capacity(history).first().capacity is None
    assert newest.newest_rows(history).first().capacity is None


def test_preview_keeps_repeats_unless_distinct(spark):
    rows = spark.createDataFrame([("g", v) for v in "zbbacdef"], "g string, v string")
    assert lookup.preview(rows, "v").first().preview == ["a", "b", "b", "c", "d"]
    assert lookup.preview(rows, "v", by=["g"], distinct=True).first().preview == list("abcde")


def test_salted_lookup_equals_plain(spark):
    fact = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)], "k int, i int")
    dimension = spark.createDataFrame([(i, f"n{i}") for i in range(0, 300, 2)], "k int, name string")
    plain = lookup.attach(fact, dimension, ["k"])
    salted = lookup.attach_salted(fact, dimension, ["k"], spread_by="i", salts=5)
    assert plain.exceptAll(salted.select(plain.columns)).count() == 0 and salted.count() == 300
