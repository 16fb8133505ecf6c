"""The chained job from raw rows to derived tables, and imports of reviewed aliases, over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import text
from marquee.operators import parse, rebuild, spatial, store
from marquee.plans.warehouse import table
from marquee.sources.runstore import RunStore, run_id, scratch_root

FACT_KEY = ["source", "sheet", "row"]


def drive_steps(rows: DataFrame, earlier: Callable[[], DataFrame | None]) -> list[tuple[str, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]]]:
    """Seed, persist, resolve and derive for rows (source, sheet, row, cells); ``earlier`` gives the facts of the last committed run.

    A fact that is held already with other contents is an error; one with equal contents is not written again.
    """

    def seed(_: dict[str, DataFrame]) -> dict[str, DataFrame]:
        # Sheets are small files whose cells take long to read; rows are dealt to tasks first.
        records, quarantine = parse.placement_rows(rows.repartition(spatial.tasks(rows.sparkSession)))
        return {"records": records, "quarantine": quarantine}

    def persist(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
        held = earlier()
        if held is None:
            return {"facts": t["records"]}
        store.ensure_empty(store.drift(held, t["records"], FACT_KEY), "REPLAY_DRIFT")
        return {"facts": held.unionByName(store.append_new(t["records"], held, FACT_KEY).select(*held.columns))}

    def resolve(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
        sites, review = parse.site_entities(parse.active(t["facts"]))
        return {"sites": parse.representative_sites(sites.select("site_id", "state", "city", "address", "board_type", "format", *FACT_KEY), [F.col(c) for c in FACT_KEY]), "site_rows": sites.select(*FACT_KEY, "site_id"), "review": review}

    def derive(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
        rows_ = t["facts"].join(t["site_rows"], FACT_KEY)
        activity = rows_.groupBy("year", "quarter", "state").agg(
            F.count(F.lit(1)).alias("n_rows"), F.countDistinct("site_id").alias("n_sites"), F.count("annual_rate").alias("n_rated"), F.sum(F.col("annual_rate").cast("decimal(28,4)")).cast("double").alias("total_rate")
        )
        return {"activity": activity}

    return [("seed", seed), ("persist", persist), ("resolve", resolve), ("derive", derive)]


def drive(runs: RunStore, rows: DataFrame, name: str) -> str:
    """Run the job for rows that are called ``name`` on top of what is committed; returns the run's id."""
    before = runs.latest()
    run = run_id(name=name, after=before if before != run_id(name=name, after=None) else None)
    earlier = lambda: None if before is None else runs.read(before, "persist", "facts")
    runs.run(run, drive_steps(rows, earlier))
    return run


def order_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as rows of a placement sheet; some years are cut short, some rows have no address."""
    k = F.col("o_orderkey")
    place = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"))
    date = F.col("o_orderdate")
    cells = F.array(
        k.cast("string"), F.col("c_mktsegment"), F.col("r_name"), F.col("r_name"), F.concat(F.lit(" "), F.col("n_name")), F.when(k % 53 != 0, F.concat(F.lit("Road  "), (F.col("o_custkey") % 40).cast("string"))), F.col("o_orderpriority"),
        F.lit("Beer"), F.lit("Billboard"), F.col("o_orderstatus"), F.lit("A"), F.when(k % 7 != 0, F.format_number("o_totalprice", 2)).otherwise("n/a"), F.lit("-"),
        F.when(k % 97 == 0, F.substring(F.year(date).cast("string"), 3, 2)).otherwise(F.year(date).cast("string")), F.concat(F.lit("Q"), F.quarter(date).cast("string")), F.date_format(date, "MMMM"),
    )
    return o.select(F.lit("orders").alias("source"), F.lit("all").alias("sheet"), k.alias("row"), cells.alias("cells"))


def drive_job(spark: SparkSession, sf: str) -> DataFrame:
    """The job over half of the orders, then over all of them: the second run adds what the first lacks."""
    runs = RunStore(spark, scratch_root(spark, f"drive-{uuid.uuid4().hex}"))
    rows = order_rows(spark, sf)
    drive(runs, rows.where("row % 2 = 0"), "even")
    run = drive(runs, rows, "all")
    found = runs.read(run, "derive", "activity")
    return found.select(F.col("year").cast("long").alias("year"), F.col("quarter").cast("long").alias("quarter"), "state", "n_rows", "n_sites", "n_rated", F.round("total_rate", 2).alias("total_rate"))


DRIVE_JOB = """
WITH o AS (SELECT *, o_orderkey AS k FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE o_orderkey % 97 <> 0 AND o_orderkey % 53 <> 0)
SELECT year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, r_name AS state, count(*) AS n_rows, count(DISTINCT n_name || '|' || (o_custkey % 40) || '|' || o_orderstatus) AS n_sites, count(*) FILTER (WHERE k % 7 <> 0) AS n_rated,
  round(sum(round(o_totalprice, 2)::DECIMAL(28, 4)) FILTER (WHERE k % 7 <> 0)::DOUBLE, 2) AS total_rate FROM o GROUP BY ALL
"""

LABELS = 700


def alias_import(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of customers and their nations, linked to airports, after manual aliases come in; ``again`` marks what the import reached."""
    customers = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    label = F.col("c_custkey") % LABELS
    names = customers.select(F.concat(F.lit("Port "), label.cast("string"), F.lit(".")).alias("label"), F.col("n_name").alias("state")).distinct()
    j = F.col("id")
    aliases = spark.range(LABELS).where("id % 3 = 0").select(text.entity_literal(F.concat(F.lit("port "), j.cast("string"))).alias("key"), F.concat(F.lit("ap:"), (j % 41).cast("string")).alias("airport"), (j % 2).cast("int").alias("rank"))
    anchors = table(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("state"), F.concat(F.lit("ap:state:"), F.col("n_nationkey").cast("string")).alias("airport"))
    manual = table(spark, sf, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("alias_id"), F.concat(F.lit(" PORT  "), (F.col("s_suppkey") * 7 % LABELS).cast("string")).alias("literal"), F.concat(F.lit("ap:manual:"), (F.col("s_suppkey") % 13).cast("string")).alias("airport"))
    before = parse.airport_links(names, aliases, anchors)
    _, after, affected = rebuild.import_airport_aliases(before, names, aliases, manual, anchors)
    marked = affected.select("label", "state", F.lit(True).alias("again"))
    return after.join(marked, ["label", "state"], "left").select("label", "state", "airport", "method", F.coalesce("again", F.lit(False)).alias("again"))


ALIAS_IMPORT = f"""
WITH n AS (SELECT DISTINCT c_custkey % {LABELS} AS j, n_name, n_nationkey FROM customer JOIN nation ON n_nationkey = c_nationkey),
m AS (SELECT s_suppkey * 7 % {LABELS} AS j, arg_min(s_suppkey % 13, s_suppkey) AS a FROM supplier WHERE s_suppkey % 5 = 0 GROUP BY 1)
SELECT 'Port ' || n.j || '.' AS label, n_name AS state,
  CASE WHEN m.j IS NOT NULL THEN 'ap:manual:' || m.a WHEN n.j % 3 = 0 THEN 'ap:' || n.j % 41 WHEN n_nationkey % 2 = 0 THEN 'ap:state:' || n_nationkey END AS airport,
  CASE WHEN m.j IS NOT NULL THEN 'exact_name' WHEN n.j % 3 = 0 THEN CASE WHEN n.j % 2 = 0 THEN 'exact_name' ELSE 'alias' END WHEN n_nationkey % 2 = 0 THEN 'state_anchor' ELSE 'review' END AS method, m.j IS NOT NULL AS again
FROM n LEFT JOIN m USING (j)
"""

ENTRIES = {"drive_job": (drive_job, DRIVE_JOB), "alias_import": (alias_import, ALIAS_IMPORT)}
