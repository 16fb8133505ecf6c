"""Survey, storage, validation and screening queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import dates, text
from marquee.operators import store, survey
from marquee.plans.warehouse import table


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_acctbal") >= 0, "positive").otherwise("negative").alias("balance"))
    return events.join(people, "user_id")


RESPONSES = "r AS (SELECT event_id, user_id, event_type, value, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS segment, CASE WHEN c_acctbal >= 0 THEN 'positive' ELSE 'negative' END AS balance FROM events JOIN customer ON user_id = c_custkey)"


def survey_cube(spark: SparkSession, sf: str) -> DataFrame:
    buys = F.col("event_type") == "purchase"
    metrics = {"purchase_share": (F.lit(True), buys.cast("int")), "purchase_value": (buys, F.col("value")), "error_value": ((F.col("event_type") == "error") & (F.col("value") > 50), F.col("value"))}
    return survey.cube(_responses(spark, sf), [[], ["segment"], ["balance"], ["segment", "balance"]], metrics)


SURVEY_CUBE = f"""
WITH {RESPONSES}, g AS (SELECT segment, balance, grouping(segment) AS gs, grouping(balance) AS gb, count(*) AS n,
  count(*) AS n1, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::DOUBLE AS s1, count(value) FILTER (WHERE event_type = 'purchase') AS n2, sum(value::DECIMAL(28, 6)) FILTER (WHERE event_type = 'purchase')::DOUBLE AS s2,
  count(value) FILTER (WHERE event_type = 'error' AND value > 50) AS n3, sum(value::DECIMAL(28, 6)) FILTER (WHERE event_type = 'error' AND value > 50)::DOUBLE AS s3
  FROM r GROUP BY GROUPING SETS ((), (segment), (balance), (segment, balance))),
k AS (SELECT *, coalesce(nullif(concat_ws('|', 'balance=' || balance, 'segment=' || segment), ''), 'overall') AS scope FROM g WHERE n >= 30 AND (gs = 1 OR segment IS NOT NULL) AND (gb = 1 OR balance IS NOT NULL)),
l AS (SELECT scope, n, 'purchase_share' AS metric, n1 AS d, s1 AS s FROM k UNION ALL SELECT scope, n, 'purchase_value', n2, s2 FROM k UNION ALL SELECT scope, n, 'error_value', n3, s3 FROM k)
SELECT scope, n::BIGINT AS n, metric, d::BIGINT AS denominator, CASE WHEN d >= 30 THEN floor(s / d * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE END AS value, d < 30 AS suppressed FROM l
"""


def survey_multiselect(spark: SparkSession, sf: str) -> DataFrame:
    people = _responses(spark, sf).groupBy("user_id", "balance").agg(F.collect_list("event_type").alias("kinds"))
    return survey.multiselect(people, "user_id", "balance", "kinds")


SURVEY_MULTISELECT = f"""
WITH {RESPONSES}, p AS (SELECT DISTINCT user_id, balance, event_type AS category FROM r), t AS (SELECT balance, count(DISTINCT user_id) AS d FROM p GROUP BY 1), c AS (SELECT balance, category, count(*) AS n FROM p GROUP BY ALL)
SELECT balance, category, n::BIGINT AS numerator, d::BIGINT AS denominator, CASE WHEN d >= 30 THEN floor(n::DOUBLE / d * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE END AS share FROM c JOIN t USING (balance)
"""


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")


def append_new(spark: SparkSession, sf: str) -> DataFrame:
    orders = _orders(spark, sf).select("o_orderkey", "o_custkey", "o_orderdate")
    return store.append_new(orders.where("o_orderkey % 3 <> 0").select("o_orderkey", "o_custkey"), orders.where("o_orderdate < timestamp_ntz '1998-01-01'"), ["o_orderkey"])


APPEND_NEW = "SELECT o_orderkey, o_custkey FROM orders n WHERE o_orderkey % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = n.o_orderkey AND o.o_orderdate < TIMESTAMP '1998-01-01')"


def upsert_first_last(spark: SparkSession, sf: str) -> DataFrame:
    rows = _orders(spark, sf)
    half = lambda cond: rows.where(cond).groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"), F.max("o_orderkey").alias("last_order"))
    return store.upsert(half("o_orderdate < timestamp_ntz '1998-01-01'"), half("o_orderdate >= timestamp_ntz '1998-01-01'"), ["o_custkey"], ["first_order"], ["last_order"])


UPSERT_FIRST_LAST = """
WITH a AS (SELECT o_custkey, min(o_orderkey) AS f, max(o_orderkey) AS l FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1), b AS (SELECT o_custkey, min(o_orderkey) AS f, max(o_orderkey) AS l FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT o_custkey, coalesce(a.f, b.f) AS first_order, coalesce(b.l, a.l) AS last_order FROM a FULL JOIN b USING (o_custkey)
"""


def drift_check(spark: SparkSession, sf: str) -> DataFrame:
    old = _orders(spark, sf)
    changed = old.withColumns({"o_totalprice": F.when(F.col("o_orderkey") % 101 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")), "o_orderstatus": F.when(F.col("o_orderkey") % 103 != 0, F.col("o_orderstatus"))})
    return store.drift(old, changed, ["o_orderkey"], ignore=("o_orderdate",))


DRIFT_CHECK = "SELECT o_orderkey FROM orders WHERE o_orderkey % 101 = 0 OR (o_orderkey % 103 = 0 AND o_orderstatus IS DISTINCT FROM NULL)"


def calibration_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Which thresholds of a made-up calibration report per nation fail."""
    k = F.col("n_nationkey")
    rules = {"SAMPLE_TOO_SMALL": (k * 37) % 100 >= 20, "ERROR_TOO_HIGH": (k * 53) % 100 <= 70, "COVERAGE_TOO_LOW": (k * 71) % 100 >= 30, "BIAS_TOO_HIGH": (k * 13) % 25 <= 20, "STALE": k % 11 != 0}
    found = store.violations(table(spark, sf, "nation"), ["n_name"], rules)
    return table(spark, sf, "nation").select("n_name").join(found, "n_name", "left").select("n_name", F.coalesce(F.array_join("violations", ","), F.lit("")).alias("failures"), F.when(F.col("violations").isNull(), "promote").otherwise("hold").alias("decision"))


CALIBRATION_GATE = """
WITH f AS (SELECT n_name, concat_ws(',', CASE WHEN (n_nationkey * 37) % 100 < 20 THEN 'SAMPLE_TOO_SMALL' END, CASE WHEN (n_nationkey * 53) % 100 > 70 THEN 'ERROR_TOO_HIGH' END, CASE WHEN (n_nationkey * 71) % 100 < 30 THEN 'COVERAGE_TOO_LOW' END,
  CASE WHEN (n_nationkey * 13) % 25 > 20 THEN 'BIAS_TOO_HIGH' END, CASE WHEN n_nationkey % 11 = 0 THEN 'STALE' END) AS failures FROM nation)
SELECT n_name, failures, CASE WHEN failures = '' THEN 'promote' ELSE 'hold' END AS decision FROM f
"""


def pii_screen(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("part"), "text")
    turns = table(spark, sf, "conversations").select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").cast("long").alias("part"), "text")
    found = docs.union(turns).select("kind", "id", "part", F.array_join(text.pii_kinds(F.col("text")), ",").alias("found"))
    return found.where("found <> ''")


PII_SCREEN = f"""
WITH u AS (SELECT 'document' AS kind, doc_id AS id, 0::BIGINT AS part, text FROM documents UNION ALL SELECT 'turn', conv_id, turn::BIGINT, text FROM conversations),
f AS (SELECT kind, id, part, concat_ws(',', CASE WHEN regexp_matches(text, '{text.EMAIL}') THEN 'email' END, CASE WHEN regexp_matches(text, '{text.PHONE}') THEN 'phone' END, CASE WHEN regexp_matches(text, '{text.LONG_DIGITS}') THEN 'long_digits' END) AS found FROM u)
SELECT * FROM f WHERE found <> ''
"""


def header_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "part").select("p_name").distinct()
    best = F.lit("large red widget")
    return names.select("p_name", F.round(text.jaccard(F.col("p_name"), best), 6).alias("similarity"), (text.jaccard(F.col("p_name"), best) >= 0.6).alias("matches"))


HEADER_JACCARD = """
WITH n AS (SELECT DISTINCT p_name, list_distinct(string_split(lower(p_name), ' ')) AS t, ['large', 'red', 'widget'] AS b FROM part), j AS (SELECT p_name, len(list_intersect(t, b))::DOUBLE / len(list_distinct(list_concat(t, b))) AS s FROM n)
SELECT p_name, round(s, 6) AS similarity, s >= 0.6 AS matches FROM j
"""


def exposure_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of a flight per nation with their chances to see: movement x share, the share at most one."""
    k = F.col("n_nationkey")
    flights = table(spark, sf, "nation").select("n_name", F.date_add(F.lit("2026-09-01").cast("date"), k).alias("start"), F.date_add(F.lit("2026-09-05").cast("date"), k + k % 7).alias("end"), F.when(k % 2 == 0, "all_day").otherwise("pm").alias("daypart"), (1000.0 + 10 * k).alias("movement"), (0.5 + 0.03 * k).alias("visibility"))
    rows = dates.exposure_blocks(flights, "start", "end", "daypart").withColumn("days", dates.flight_days(F.col("start"), F.col("end")))
    return rows.groupBy("n_name", "block_daypart").agg(F.max("days").cast("long").alias("days"), F.count(F.lit(1)).alias("n_blocks"), F.round(F.sum("duration_hours"), 4).alias("hours"), F.round(F.sum(F.col("movement") * F.least(F.lit(1.0), F.col("visibility"))), 4).alias("chances"))


EXPOSURE_BLOCKS = """
WITH f AS (SELECT n_name, n_nationkey AS k, 5 + n_nationkey % 7 AS days FROM nation), p AS (SELECT unnest([{'d': 'am', 'h': 4.0}, {'d': 'midday', 'h': 5.0}, {'d': 'pm', 'h': 4.0}, {'d': 'evening', 'h': 4.0}], recursive := true)),
b AS (SELECT n_name, k, days, d, h FROM f, p, generate_series(1, days) WHERE k % 2 = 0 OR d = 'pm')
SELECT n_name, d AS block_daypart, max(days)::BIGINT AS days, count(*)::BIGINT AS n_blocks, round(sum(h)::DOUBLE, 4) AS hours, round(count(*) * (1000.0::DOUBLE + 10 * k) * least(1.0::DOUBLE, 0.5::DOUBLE + 0.03::DOUBLE * k), 4) AS chances FROM b GROUP BY n_name, k, d
"""


def attribution_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("source", "lang").distinct()


ATTRIBUTION = "SELECT DISTINCT source, lang FROM documents"


def changed_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that a supplier gained or lost between line items of even and odd orders."""
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_orderkey") % 2).alias("side"))
    pairs = rows.groupBy("l_suppkey", "l_partkey").agg(F.min("side").alias("a"), F.max("side").alias("b"))
    # Only what changed is gathered; it is the result.
    changed = F.array_sort(F.collect_list(F.when(F.col("a") == F.col("b"), F.col("l_partkey"))))
    return pairs.groupBy("l_suppkey").agg(changed.alias("parts")).select("l_suppkey", F.array_join(F.transform("parts", lambda x: x.cast("string")), ",").alias("changed"))


CHANGED_SETS = """
WITH s AS (SELECT l_suppkey, l_partkey, min(l_orderkey % 2) AS a, max(l_orderkey % 2) AS b FROM lineitem GROUP BY ALL)
SELECT l_suppkey, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) FILTER (WHERE a = b), '') AS changed FROM s GROUP BY 1
"""

ENTRIES = {
    "survey_cube": (survey_cube, SURVEY_CUBE),
    "survey_multiselect": (survey_multiselect, SURVEY_MULTISELECT),
    "append_new": (append_new, APPEND_NEW),
    "upsert_first_last": (upsert_first_last, UPSERT_FIRST_LAST),
    "drift_check": (drift_check, DRIFT_CHECK),
    "calibration_gate": (calibration_gate, CALIBRATION_GATE),
    "pii_screen": (pii_screen, PII_SCREEN),
    "header_jaccard": (header_jaccard, HEADER_JACCARD),
    "exposure_blocks": (exposure_blocks, EXPOSURE_BLOCKS),
    "attribution_distinct": (attribution_distinct, ATTRIBUTION),
    "changed_sets": (changed_sets, CHANGED_SETS),
}
