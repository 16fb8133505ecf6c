"""Queries by distance where many sites and places share a position: results as the SQL states them, from as many pairs as positions make."""

import duckdb
import pytest
from pyspark.sql import functions as F

from marquee.operators import polygons, spatial
from marquee.plans import catalog

COPIES = 6
QUERIES = ["nearest_class", "nearest_planar", "category_entropy", "points_in_polygons", "population_radius", "radius_counts", "proximity_250m"]


@pytest.fixture(scope="module")
def shared(spark, tmp_path_factory):
    """A hundred positions, each with several suppliers and customers."""
    folder = tmp_path_factory.mktemp("shared")
    at = lambda key: (F.col("id") % 100 + F.floor(F.col("id") / 100) * 1000).alias(key)
    spark.range(100 * COPIES).select(at("s_suppkey")).write.parquet(f"{folder}/supplier.parquet")
    segment = F.element_at(F.array(F.lit("BUILDING"), F.lit("MACHINERY"), F.lit("FURNITURE")), (F.col("id") % 3 + 1).cast("int"))
    spark.range(100 * COPIES).select(at("c_custkey"), segment.alias("c_mktsegment"), (F.col("id") % 7 - 2.25).alias("c_acctbal")).write.parquet(f"{folder}/customer.parquet")
    spark.range(100 * COPIES).select(at("p_partkey")).write.parquet(f"{folder}/part.parquet")
    return str(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_shared_positions(spark, shared, monkeypatch, name):
    met = []
    within, containing = spatial.within, polygons.containing
    monkeypatch.setattr(spatial, "within", lambda *a, **k: met.append(within(*a, **k)) or met[-1])
    monkeypatch.setattr(polygons, "containing", lambda *a, **k: met.append(containing(*a, **k)) or met[-1])
    got = catalog.queries()[name](spark, shared)
    columns = sorted(got.columns)
    con = duckdb.connect()
    for t in ("supplier", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{shared}/{t}.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.select(columns).collect()), key=key) == sorted(want, key=key)
    # Sites of one position are one side of a pair, whatever their number; only the ranking keeps places apart.
    assert 0 < met[0].count() <= 100 * 100 * (COPIES if name == "proximity_250m" else 3) / 4
    assert not {"s_suppkey", "polygon_id"} & set(met[0].columns)


def test_network_measures_positions(spark, shared, monkeypatch):
    from marquee.plans import context

    met, measure = [], spatial.segment_measures
    monkeypatch.setattr(spatial, "segment_measures", lambda pairs: met.append(pairs) or measure(pairs))
    got = {(r.site_id, r.radius): r for r in context.network_context(spark, shared).collect()}
    assert len(got) == 100 * COPIES * 2
    # Two segments and two radii for each position and course at most.
    assert not {"site_id", "road_id"} & set(met[0].columns) and 0 < met[0].count() <= 100 * 100 * 4
    assert all(got[f"{k}", r].n_roads == got[f"{k + 1000}", r].n_roads and got[f"{k}", r].n_roads % COPIES == 0 for k in range(100) for r in (500, 1000))


def test_segments_are_steps(spark):
    """The text is made once: no later expression holds its own copy of the patterns."""
    from marquee.operators import briefs

    df = briefs.with_segment(spark.createDataFrame([("Campus students",), (None,)], "t string"), [F.col("t")], F.array(F.lit("ageBand=18-25")))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 2
    got = df.collect()
    assert (got[0].segment.mode, got[0].segment.selected, sorted(got[0].segment.terms)) == ("matched_after_suppression", "ageBand=18-25", ["campus", "students"])
    assert got[1].segment.mode == "fallback_no_match"


def test_cells_are_parsed_once(spark):
    """Filters and flags read the parsed columns; none holds its own copy of the patterns."""
    from marquee.operators import parse

    cells = ["1", "A", "r", "S", " C ", None, "b", "Beer", "Billboard", "O", "c", "1,200.5", "n/a", "1999", "Q2", "May"]
    good, bad = parse.placement_rows(spark.createDataFrame([("s", "t", 1, cells), ("s", "t", 2, [None, " "]), ("s", "t", 3, cells[:5])], "source string, sheet string, row long, cells array<string>"))
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in "".join(x for x in plan.splitlines() if "Filter" in x)
    (row,) = good.collect()
    assert (row.annual_rate, row.monthly_rate, row.year, row.quarter, row.city, list(row.flags)) == (1200.5, None, 1999, 2, "C", ["monthly_rate_unparsed"])
    assert [(r.row, r.reason) for r in bad.collect()] == [(3, "invalid_year")]


def test_spellings_come_before_keys(spark):
    from marquee.operators import parse

    rows = spark.createDataFrame([("S", " c", "1 Road", "A", "x", 7), ("S", " c", "1 Road", "A", "x", 3), ("s", "C.", "1 road", "a", "X", 5), ("S", ".", "1", "A", "x", 1)], "state string, city string, address string, board_type string, format string, k int")
    spelled = parse.first_spellings(rows, ["k"])
    assert spelled.count() == 3
    good, review = parse.site_entities(spelled)
    (one,) = parse.representative_sites(good, [F.col("k")], "n_seen").collect()
    assert (one.k, one.city, one.n_rows) == (3, " c", 3)
    assert [(r.k, r.n_seen) for r in review.collect()] == [(1, 1)]


def test_settlement_measures_positions_and_shapes(spark, monkeypatch):
    """Sites of a position and extents of a shape are measured once; an extent of two shapes is one extent, and its rows contain a site each."""
    from marquee.operators import overlay, settlement

    def square(x, h):
        return [[{"lon": 3.0 + x + a * h, "lat": 6.0 + b * h} for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]]

    rings = "polygon_id string, rings array<array<struct<lon:double,lat:double>>>"
    extents = spark.createDataFrame([(f"e{k}", square(0, 0.002)) for k in range(6)] + [("e0", square(0.006, 0.001)), ("f", square(0.006, 0.001)), (None, square(0, 0.001))], rings)
    sites = spark.createDataFrame([(f"s{k}", 3.0 + k % 2 * 0.001, 6.0) for k in range(10)], "site_id string, lon double, lat double")
    met, union = [], overlay.union_within
    monkeypatch.setattr(overlay, "union_within", lambda near, *a: met.append(near) or union(near, *a))
    got = {r.site_id: r for r in settlement.context(sites, extents, spark.createDataFrame([("w", square(0, 0.5))], rings), [1500], 1500.0).collect()}
    assert met[0].count() == 2 * 2 and len(got) == 10
    one = got["s0"]
    assert (one.n_extents, one.n_parts, one.n_containing, one.primary_id, one.inside, one.nearest_m) == (7, 2, 6, "e0", True, 0.0)
    assert got["s8"][1:] == one[1:] and got["s9"][1:] == got["s1"][1:] and got["s1"].n_extents == 7


def test_rates_are_counted_once(spark, monkeypatch):
    """Placements of a city with the same rates are one row with their number, before bases and levels are made of them."""
    from marquee.operators import relational

    met, counted = [], relational.counted_percentiles
    monkeypatch.setattr(relational, "counted_percentiles", lambda rows, *a: met.append(rows) or counted(rows, *a))
    rows = spark.range(90).selectExpr("2024 AS year", "1 AS quarter", "'c' AS category", "'f' AS format", "'s' AS state", "IF(id % 3 = 0, 'x', 'y') AS city", "IF(id % 9 = 0, NULL, CAST(id % 3 AS double)) AS a", "CAST(NULL AS double) AS b")
    got = {(r.level, r.city, r.rate_basis): r for r in relational.rate_benchmarks(rows, {"line": "a", "retail": "b"}).collect()}
    assert [m.count() for m in met] == [8, 8, 8] and len(got) == 8
    r = got["national", None, "line"]
    assert (r.n_rows, r.n_rated, r.n_missing, r.min_rate, r.p25_rate, r.p50_rate, r.p75_rate, r.max_rate, r.avg_rate) == (90, 80, 10, 0.0, 0.75, 1.0, 2.0, 2.0, 1.125)
    assert got["city", "x", "line"].n_rated == 20 and got["city", "y", "retail"][-7:] == (60, None, None, None, None, None, None)
