"""Aggregates of the governed warehouse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions import ids, stats, text
from marquee.operators.heads import first_per, top_per
from marquee.operators.spatial import tasks

_PLACE = ["state", "city"]


def _by_place(df: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """``keys`` at the national, state and city level in one pass."""
    sets = [[*keys], [*keys, "state"], [*keys, *_PLACE]]
    columns = [[F.col(c) for c in s] for s in sets]
    out = df.groupingSets(columns, *[F.col(c) for c in (*keys, *_PLACE)]).agg(*aggregates, (F.grouping("state") * 2 + F.grouping("city")).alias("__g"))
    level = F.when(F.col("__g") == 3, "national").when(F.col("__g") == 1, "state").otherwise("city")
    return out.withColumn("level", level).drop("__g")


def percentile_summary(rows: DataFrame, keys: list[str], value: str, parts: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Counts, exact interpolated percentiles, extremes and decimal total of a value per key.

    Values are ranked by one sort within keys, which spills where a key is large;
    the aggregate that follows needs no further shuffle.
    """
    v = F.col(value)
    whole = Window.partitionBy(*keys)
    ranked = rows.withColumns({"__rn": F.row_number().over(whole.orderBy(v.asc_nulls_last())) - 1, "__n": F.count(v).over(whole)})

    def at(rank: Column) -> Column:
        return F.max(F.when(F.col("__rn") == rank, v))

    found = []
    for p in parts:
        place = (F.col("__n") - 1) * p
        low, high = at(F.floor(place)), at(F.ceil(place))
        found.append((low + (high - low) * F.max(place - F.floor(place))).alias(f"p{round(100 * p)}"))
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count(v).alias("n_rated"), F.min(v).alias("lo"), *found, F.max(v).alias("hi"), F.sum(v.cast("decimal(28,4)")).cast("double").alias("total"))


def split_percentiles(rows: DataFrame, keys: list[str], value: str, parts: tuple[float, ...] = (0.25, 0.5, 0.75), splits: int = 32) -> DataFrame:
    """``percentile_summary`` for few large keys: no task sorts or holds a whole key.

    Approximate percentiles cut each key's values into ``splits`` ranges.  Counts of
    the ranges tell in which of them the wanted ranks lie, and only these are counted
    by value and ranked.
    """
    v = F.col(value)
    cuts = F.percentile_approx(v, [i / splits for i in range(1, splits)], 20 * splits)
    bounds = rows.groupBy(*keys).agg(
        cuts.alias("__cuts"), F.count(F.lit(1)).alias("n_rows"), F.count(v).alias("n_rated"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.sum(v.cast("decimal(28,4)")).cast("double").alias("total")
    )
    same = [F.col(f"__k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    named = bounds.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__cuts", "n_rated")
    # As many rows as keys: Spark broadcasts them if they are few.
    tagged = rows.where(v.isNotNull()).join(named, reduce(Column.__and__, same)).withColumn("__part", F.size(F.filter("__cuts", lambda x: x < v))).drop("__cuts", *[f"__k{i}" for i in range(len(keys))])
    upto = Window.partitionBy(*keys).orderBy("__part")
    sizes = tagged.groupBy(*keys, "__part", "n_rated").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.sum("__n").over(upto) - F.col("__n"))
    ranks = F.array(*[f((F.col("n_rated") - 1) * p) for p in parts for f in (F.floor, F.ceil)])
    here = F.filter(ranks, lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__n")))
    wanted = sizes.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), "__before", here.alias("__ranks")).where(F.size("__ranks") > 0)
    few = tagged.join(wanted, reduce(Column.__and__, [*same, F.col("__part") == F.col("__p")])).groupBy(*keys, "__part", "__before", "__ranks", value).agg(F.count(F.lit(1)).alias("__n"))
    last = F.col("__before") + F.sum("__n").over(Window.partitionBy(*keys, "__part").orderBy(v))
    ranked = few.withColumn("__last", last)
    found = ranked.select(*keys, v.alias("__v"), F.explode(F.filter("__ranks", lambda r: (r < F.col("__last")) & (r >= F.col("__last") - F.col("__n")))).alias("__r"))
    picks = found.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.map_from_entries(F.collect_set(F.struct("__r", "__v"))).alias("__at"))
    joined = bounds.join(picks, reduce(Column.__and__, same), "left")
    out = []
    for p in parts:
        place = (F.col("n_rated") - 1) * p
        low, high = (F.try_element_at("__at", f(place)) for f in (F.floor, F.ceil))
        out.append((low + (high - low) * (place - F.floor(place))).alias(f"p{round(100 * p)}"))
    return joined.select(*keys, "n_rows", "n_rated", "lo", *out, "hi", "total")


def counted_percentiles(counted: DataFrame, within: list[str], keys: list[str], value: str, parts: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``percentile_summary`` of values with how often they occur (``n``), from running counts.

    Rows that are dealt by ``within``, some of the keys, are not shuffled again.
    """
    v = F.col(value)
    counts = counted.groupBy(*within, *[k for k in keys if k not in within], value).agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*within, *[k for k in keys if k not in within])
    rated = F.when(v.isNotNull(), F.col("n")).otherwise(0)
    ranked = counts.withColumns({"__last": F.sum("n").over(whole.orderBy(v.asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)), "__n": F.sum(rated).over(whole)})

    def at(rank: Column) -> Column:
        return F.max(F.when((rank < F.col("__last")) & (rank >= F.col("__last") - F.col("n")), v))

    found = []
    for p in parts:
        place = (F.col("__n") - 1) * p
        low, high = at(F.floor(place)), at(F.ceil(place))
        found.append((low + (high - low) * F.max(place - F.floor(place))).alias(f"p{round(100 * p)}"))
    total = F.sum(v.cast("decimal(28,4)") * F.col("n").cast("decimal(18,0)")).cast("double").alias("total")
    return ranked.groupBy(*within, *[k for k in keys if k not in within]).agg(F.sum("n").alias("n_rows"), F.sum(rated).alias("n_rated"), F.min(v).alias("lo"), *found, F.max(v).alias("hi"), total)


def rate_benchmarks(placements: DataFrame, bases: dict[str, str]) -> DataFrame:
    """Exact quartiles of each rate basis by period, category and format, at three levels of place.

    ``bases`` names the column of each basis.  Placements of a city with the same rates are one row with their number, dealt
    once by period, category and format; bases and levels are counted from these where they lie.  A basis name and a place
    level are part of the id.  Sums are decimal, so a mean does not depend on the order of the rows.
    """
    own = ["year", "quarter", "category", "format"]
    columns = [*[F.col(c).cast("long").alias(c) for c in own[:2]], *own[2:], *_PLACE, *[F.col(c).cast("double").alias(f"__{n}") for n, c in bases.items()]]
    dealt = placements.select(*columns).repartition(tasks(placements.sparkSession), *own)
    counted = dealt.groupBy(*own, *_PLACE, *[f"__{n}" for n in bases]).agg(F.count(F.lit(1)).alias("n"))
    rows = counted.select(*own, *_PLACE, "n", F.inline(F.array(*[F.struct(F.lit(n).alias("rate_basis"), F.col(f"__{n}").alias("rate")) for n in bases])))
    found = []
    for level, places in (("national", 0), ("state", 1), ("city", 2)):
        of_level = counted_percentiles(rows, own, [*own, "rate_basis", *_PLACE[:places]], "rate")
        found.append(of_level.withColumns({"level": F.lit(level), **{c: F.lit(None).cast("string") for c in _PLACE[places:]}}))
    keys = ["level", "rate_basis", *own, *_PLACE]
    return reduce(DataFrame.unionByName, found).select(
        ids.content_id("rate", *[F.col(k) for k in keys]).alias("rate_id"), *keys, "n_rows", "n_rated", (F.col("n_rows") - F.col("n_rated")).alias("n_missing"), F.round("lo", 4).alias("min_rate"),
        *[F.round(f"p{p}", 4).alias(f"p{p}_rate") for p in (25, 50, 75)], F.round("hi", 4).alias("max_rate"), stats.round_half_up(F.col("total") / F.nullif(F.col("n_rated"), F.lit(0)), 4).alias("avg_rate"),
    )


def entity_activity(rows: DataFrame, types: list[str]) -> DataFrame:
    """Row counts of each entity by quarter, and by month where one is known, at three levels of place.

    Rows are counted once, by entity, month and city; levels and periods are sums of these counts.
    """
    entities = F.inline(F.array(*[F.struct(F.lit(t).alias("entity_type"), F.col(t).alias("entity")) for t in types]))
    cells = rows.select("year", "quarter", "month", *_PLACE, entities).where(F.col("entity").isNotNull())
    cells = cells.groupBy("year", "quarter", "month", "entity_type", "entity", *_PLACE).agg(F.count(F.lit(1)).alias("n"))
    n = [F.sum("n").alias("n_rows")]
    quarter = _by_place(cells, ["year", "quarter", "entity_type", "entity"], n).withColumns({"period": F.lit("quarter"), "month": F.lit(None).cast("int")})
    month = _by_place(cells.where(F.col("month").isNotNull()), ["year", "quarter", "month", "entity_type", "entity"], n).withColumn("period", F.lit("month"))
    whole = [F.col(c).cast("long").alias(c) for c in ("year", "quarter", "month")]
    return quarter.unionByName(month).select("period", *whole, "entity_type", "entity", "level", *_PLACE, "n_rows")


def unpivot_traffic(wide: DataFrame, keys: list[str], months: list[tuple[int, str, str, str]]) -> DataFrame:
    """One row per month from columns of arrivals, departures and totals at any place of a wide row."""
    parts = F.array(*[F.struct(F.lit(m).cast("long").alias("month"), F.col(f"`{a}`").alias("arrivals"), F.col(f"`{d}`").alias("departures"), F.col(f"`{t}`").alias("reported_total")) for m, a, d, t in months])
    rows = wide.select(*keys, F.inline(parts))
    derived = F.col("arrivals") + F.col("departures")
    flags = F.concat_ws(
        ",",
        F.when(F.col("arrivals").isNull(), "arrival_missing"),
        F.when(F.col("departures").isNull(), "departure_missing"),
        F.when(F.col("reported_total").isNull(), "total_missing"),
        F.when(total_mismatch(F.col("arrivals"), F.col("departures"), F.col("reported_total")), "total_mismatch"),
    )
    return rows.select("*", derived.alias("derived_total"), flags.alias("flags"))


def total_mismatch(left: Column, right: Column, reported: Column, tolerance: float = 0.5) -> Column:
    return F.coalesce(F.abs(left + right - reported) > tolerance, F.lit(False))


def vocabulary(rows: DataFrame) -> DataFrame:
    """Counts and years of each literal by type, with the key and id of the entity it names."""
    counted = rows.groupBy("entity_type", "literal").agg(F.count(F.lit(1)).alias("n_rows"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    keyed = counted.withColumn("entity_key", text.entity_literal(text.nfkc(F.col("literal"))))
    return keyed.select("entity_type", "literal", "entity_key", "n_rows", "first_year", "last_year", ids.stable_id("entity", F.col("entity_type"), F.col("entity_key")).alias("entity_id"))


def representative_literal(rows: DataFrame) -> DataFrame:
    """Per entity_key its most frequent literal, the smallest of equals."""
    counted = rows.groupBy("entity_key", "literal").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("entity_key").agg(F.min_by("literal", F.struct((-F.col("n")).alias("a"), F.col("literal"))).alias("literal"), F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_literals"))


def unique_anchor(rows: DataFrame, key: str, value: str) -> DataFrame:
    """A key's value if it has just one; otherwise the key goes to review.  Only the least and the largest are kept."""
    ends = rows.groupBy(key).agg(F.min(value).alias("a"), F.max(value).alias("b"))
    one = F.col("a") == F.col("b")
    return ends.select(key, F.when(one, F.col("a")).alias(value), F.when(one, "anchored").otherwise("review").alias("status"))


def zone_packages(sites: DataFrame, budget: float, zones: int = 8) -> DataFrame:
    """Ranked packages of three zones, with the best or the two best sites of each.

    Zones are limited to ``zones`` beforehand, so the joins by unequal zone see at most sixteen rows.
    """
    top = top_per(sites, ["zone"], [F.desc("score"), F.col("rate"), F.col("s_suppkey")], 2)
    best = top.groupBy("zone").agg(F.avg("score").alias("zs")).orderBy(F.desc("zs"), "zone").limit(zones)
    own = top.join(best, "zone").groupBy("zone").agg(F.array_sort(F.collect_list(F.struct("rank", "s_suppkey", "rate", "score"))).alias("a"))
    sizes = own.select("zone", "a", F.explode(F.sequence(F.lit(1), F.size("a"))).alias("n")).withColumn("a", F.slice("a", 1, F.col("n")))
    total = lambda f: F.aggregate("a", F.lit(0.0), lambda x, y: x + y[f])
    v = sizes.select("zone", "n", F.array_join(F.transform("a", lambda x: x["s_suppkey"].cast("string")), "|").alias("ids"), total("rate").alias("cost"), total("score").alias("s"))
    a, b, c = (v.select(*[F.col(x).alias(f"{k}_{x}") for x in v.columns]) for k in "abc")
    joined = a.join(b, F.col("a_zone") < F.col("b_zone")).join(c, F.col("b_zone") < F.col("c_zone"))
    add = lambda x: F.col(f"a_{x}") + F.col(f"b_{x}") + F.col(f"c_{x}")
    packages = joined.select(F.concat_ws("|", "a_ids", "b_ids", "c_ids").alias("package_id"), F.round(add("cost"), 2).alias("cost"), F.round(add("s") / add("n"), 6).alias("fit"), add("n").cast("long").alias("n_sites")).where(F.col("cost") <= budget)
    return packages.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("fit"), "cost", "package_id")).cast("long"))


def package_options(packages: DataFrame) -> DataFrame:
    """Best overall, then largest, then cheapest within five points of the best; none is chosen twice."""
    order = [F.desc("fit"), F.col("cost"), F.col("package_id")]
    best = packages.orderBy(*order).limit(1)
    largest = packages.join(best.select("package_id"), "package_id", "left_anti").orderBy(F.desc("n_sites"), *order).limit(1)
    rest = packages.join(best.select("package_id").union(largest.select("package_id")), "package_id", "left_anti")
    near = rest.crossJoin(best.select(F.col("fit").alias("best_fit"))).withColumn("near", F.col("fit") >= F.col("best_fit") - 5)
    cheap = near.orderBy(F.desc("near"), F.when(F.col("near"), F.col("cost")), *order).limit(1)
    named = lambda df, style: df.select(F.lit(style).alias("style"), "package_id", "cost", "fit")
    return named(best, "best_overall").union(named(largest, "maximum_delivery")).union(named(cheap, "budget_smart"))
