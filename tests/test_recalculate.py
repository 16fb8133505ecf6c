"""Plans after a change equal plans from scratch, and measure no more than the change asks for."""

from dataclasses import replace

import pytest

from marquee.plans import planner


def rows(df):
    cells = lambda r: tuple(round(v, 6) if isinstance(v, float) else str(v) if isinstance(v, list) else v for v in r)
    return sorted((cells(r) for r in df.select(sorted(df.columns)).collect()), key=str)


BRIEF = planner.Brief("fmcg", "broad_reach")


@pytest.fixture(scope="module")
def bundle(spark):
    return planner.demo_bundle(spark)


@pytest.fixture(scope="module")
def plan(bundle):
    basis = planner.recalculate(bundle, replace(BRIEF, normalization_budget=18_000_000.0))
    yield basis
    basis.release()


@pytest.mark.parametrize(
    "change, measured",
    [
        ({"budget": 15_000_000.0, "objective": "near_conversion", "normalization_budget": 18_000_000.0}, 0), ({"normalization_budget": 19_000_000.0}, None), ({"flight_end": "2026-09-14", "normalization_budget": 16_000_000.0}, "all"),
    ],
    ids=str,
)
def test_changed_briefs(bundle, plan, change, measured):
    brief = replace(BRIEF, **change)
    after = planner.recalculate(bundle, brief, plan)
    want = planner.candidates(bundle, brief)
    assert rows(after.ranked) == rows(want)
    n, known = after.fresh.count(), plan.measured.select("package_id").distinct().count()
    assert n == (0 if measured == 0 else want.count() if measured == "all" else want.count() - known)
    assert measured != 0 or after.sums.select("site_id").distinct().count() == plan.sums.select("site_id").distinct().count()
    after.release()


def test_selections(bundle, plan):
    brief = plan.brief
    for sites in (["yaba-face-1", "yaba-face-2", "vi-face-1", "lekki-face-2", "lekki-face-1", "oshodi-face-1"],):
        after = planner.recalculate(bundle, brief, plan, sites)
        assert rows(after.ranked) == rows(planner.candidates(bundle, brief, planner.selected_package(bundle.sites.sparkSession, sites)))
        assert after.fresh.count() <= 1 and after.ranked.where("extra").count() == 1
        after.release()
