"""Column expressions on literal cases."""

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from marquee.functions import dates, geo, ids, stats, text


def one(spark, values, make):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(make(F.col("v")).alias("x")).collect()]


def test_source_text(spark):
    assert one(spark, ["  a \t b\n", " x　y ", "", " ", None], text.source_text) == ["a b", "x y", None, None, None]


def test_loose_number(spark):
    got = one(spark, ["1,200", " 12 % ", "-", "—", "abc", "1e3", "-4.5", "0x1f", "Infinity", None, "3."], text.loose_number)
    assert got == [1200.0, 12.0, None, None, None, 1000.0, -4.5, None, None, None, 3.0]
    assert one(spark, ["7", "7.5", "7.0"], text.loose_integer) == [7, None, 7]


def test_source_period(spark):
    got = one(spark, ["March", " january / february ", "Q1", None, "", "march/Q2"], text.source_period)
    assert got[0] == Row(raw_month="March", months=[3], kind="month")
    assert got[1].kind == "combined" and got[1].months == [1, 2]
    assert [g.kind for g in got[2:]] == ["unparsed", "quarter_only", "quarter_only", "unparsed"]


def test_keys(spark):
    df = spark.createDataFrame([("A  b", None, "C")], "a string, b string, c string")
    assert df.select(text.natural_key(F.col("a"), F.col("b"), F.col("c"))).first()[0] == "a b||c"
    assert one(spark, ["ACME LTD.", " acme ltd ", "!!"], text.entity_literal) == ["acme ltd", "acme ltd", None]
    assert one(spark, ["ﬁne №１"], lambda c: text.nfkc(c)) == ["fine No1"]
    assert one(spark, ["Hello, World! "], text.slug) == ["hello_world"]


def test_ids(spark):
    import hashlib

    df = spark.createDataFrame([("x", None)], "a string, b string")
    got = df.select(ids.content_id("rate", F.col("a"), F.col("b")), ids.stable_id("site", F.col("a"), F.col("b"))).first()
    assert got[0] == "rate:" + hashlib.md5(b"x|-").hexdigest()
    assert got[1] == "site:" + hashlib.sha256(b'["x",null]').hexdigest()[:32]
    assert ids.fnv1a("") == "811c9dc5" and ids.fnv1a("a") == "e40c292c"
    assert ids.canonical_json({"b": 1, "a": [None, "é"]}) == '{"a":[null,"é"],"b":1}'
    with pytest.raises(ValueError):
        ids.canonical_json(float("nan"))


def test_round_half_up(spark):
    df = spark.createDataFrame([(-0.5,), (0.5,), (1.5,)], "v double")
    assert [r[0] for r in df.select(stats.round_half_up(F.col("v"), 0)).collect()] == [0.0, 1.0, 2.0]


def test_midrank_and_direction(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "v double")
    assert sorted(r[0] for r in df.select(stats.midrank(F.col("v"))).collect()) == [12.5, 50.0, 50.0, 87.5]
    pairs = spark.createDataFrame([(100.0, 96.0), (100.0, 90.0), (1.0, 2.0), (0.0, 0.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in pairs.select(stats.relative_direction(F.col("a"), F.col("b"))).collect()] == ["similar", "higher", "lower", "similar", None]


def test_geo(spark):
    df = spark.range(1).select(geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)), geo.destination(F.lit(3.3), F.lit(6.5), F.lit(90.0), F.lit(1000.0)))
    metres, there = df.first()
    assert metres == pytest.approx(math.pi * geo.RADIUS / 180)
    back = spark.range(1).select(geo.haversine(F.lit(3.3), F.lit(6.5), F.lit(there.lon), F.lit(there.lat))).first()[0]
    assert back == pytest.approx(1000.0, abs=1e-6)


def test_dates(spark):
    df = spark.createDataFrame([("2026-09-01", "2026-09-03", "all_day"), ("2026-09-01", "2026-09-01", "pm")], "s string, e string, d string").select(F.col("s").cast("date").alias("s"), F.col("e").cast("date").alias("e"), "d")
    assert [r[0] for r in df.select(dates.flight_days(F.col("s"), F.col("e"))).collect()] == [3, 1]
    assert dates.exposure_blocks(df, "s", "e", "d").count() == 13
    with pytest.raises(Exception, match="INVALID_FLIGHT_DATES"):
        df.select(dates.flight_days(F.col("e"), F.date_sub("s", 5))).collect()
