"""Every query with SQL against that SQL, and the planner against its goldens."""

import math

import pytest

import __spark_entry__ as entry
from marquee.plans import catalog, planner

SQL = catalog.oracle_sql()


def rows(table, columns):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        if hasattr(v, "item"):
            v = v.item()
        return round(v, 6) + 0.0 if isinstance(v, float) else v

    return sorted((tuple(plain(v) for v in r) for r in table[columns].astype(object).itertuples(index=False, name=None)), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, sf, name):
    got, want = catalog.queries()[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


#: Goldens from an independent plain version of the formulas: style -> (package, cost, fit).
GOLDEN = {
    "fmcg": {"best_overall": ("ikeja-face-1|oshodi-face-2|vi-face-1|vi-face-2", 15_520_000, 81.063889), "maximum_delivery": ("ikeja-face-1|lekki-face-1|vi-face-1|vi-face-2", 15_760_000, 79.554630), "budget_smart": ("ikeja-face-1|ikeja-face-2|oshodi-face-2|vi-face-1", 15_040_000, 78.131019)},
    "real_estate": {"best_overall": ("ikeja-face-1|ikeja-face-2|lekki-face-1|vi-face-1", 15_280_000, 84.593917), "maximum_delivery": ("ikeja-face-1|ikeja-face-2|vi-face-1|yaba-face-1|yaba-face-2", 16_400_000, 81.419251), "budget_smart": ("ikeja-face-1|vi-face-1|yaba-face-2", 10_080_000, 79.659091)},
    "bank_fintech": {"best_overall": ("lekki-face-1|oshodi-face-1|oshodi-face-2|vi-face-2", 17_440_000, 76.662500), "maximum_delivery": ("lekki-face-1|oshodi-face-2|vi-face-1|vi-face-2", 16_960_000, 75.537500), "budget_smart": ("ikeja-face-1|oshodi-face-2|yaba-face-2", 10_800_000, 72.266667)},
}


@pytest.mark.parametrize("brief", planner.BRIEFS, ids=lambda b: b.sector)
def test_plan_goldens(spark, brief):
    bundle = planner.demo_bundle(spark)
    ranked = planner.candidates(bundle, brief).cache()
    assert ranked.count() == 270
    assert ranked.where("delivery IS NOT NULL").count() == (187 if brief.sector == "real_estate" else 270)
    got = {r.style: (r.package_id, r.cost, round(r.fit, 6)) for r in planner.options(ranked).collect()}
    assert got == GOLDEN[brief.sector]
    best = ranked.where("rank = 1").first()
    assert best.package_id == GOLDEN[brief.sector]["best_overall"][0] and best.valid
    ranked.unpersist()


def test_unflyable_inventory_still_gives_a_candidate(spark):
    bundle = planner.demo_bundle(spark)
    brief = planner.Brief("fmcg", "broad_reach", flight_start="2028-01-01", flight_end="2028-01-02")
    got = planner.candidates(bundle, brief).where("rank = 1").first()
    assert not got.valid and "SITE_UNAVAILABLE_FOR_FLIGHT" in got.reasons


def test_request_lines_keep_suppliers_apart(spark):
    bundle, brief = planner.demo_bundle(spark), planner.BRIEFS[0]
    packages = planner.candidate_sets(bundle, brief)
    one = packages.orderBy("package_id").first()
    lines = planner.request_lines(bundle, brief, one.package_id, packages).collect()
    assert sorted(x.site_id for r in lines for x in r.lines) == sorted(one.sites)
    assert len({r.supplier_id for r in lines}) == len(lines)


def test_network_takes_all_rows(spark, duck, sf, monkeypatch):
    from marquee.operators import spatial
    from marquee.plans import context

    sites = {r[0] for r in duck.execute("SELECT s_suppkey::VARCHAR FROM supplier").fetchall()}
    given, found = [], spatial.network_context
    monkeypatch.setattr(spatial, "network_context", lambda sites, roads, radii: given.append(roads) or found(sites, roads, radii))
    assert {r.site_id for r in context.network_context(spark, sf).collect()} == sites
    assert {r.road_id for r in given[0].collect()} == {f"road:{r[0]}" for r in duck.execute("SELECT p_partkey FROM part").fetchall()}
