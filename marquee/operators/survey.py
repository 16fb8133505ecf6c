"""Survey cube with suppression of small samples."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.stats import round_half_up

MIN_SAMPLE = 30


def scope_key(dimensions: list[str]) -> Column:
    """``dim=value`` parts in order, joined by bars; ``overall`` if there is none."""
    parts = F.array_sort(F.array_compact(F.array(*[F.when(F.col(d).isNotNull(), F.concat_ws("=", F.lit(d), F.col(d))) for d in dimensions])))
    return F.when(F.size(parts) == 0, "overall").otherwise(F.array_join(parts, "|"))


def cube(responses: DataFrame, groupings: list[list[str]], metrics: dict[str, tuple[Column, Column]], minimum: int = MIN_SAMPLE) -> DataFrame:
    """One row per facet and metric.

    A response without a value in a grouped dimension does not count for that
    grouping.  A facet stays if it has ``minimum`` responses; a metric is null if
    fewer than ``minimum`` of them are in its denominator.  ``metrics`` names
    (eligible, value): shares average 0 and 1, means average values.
    """
    dims = sorted({d for g in groupings for d in g})
    cells = []
    for name, (eligible, value) in metrics.items():
        ok = eligible & value.isNotNull()
        cells += [F.count_if(ok).alias(f"n_{name}"), F.sum(F.when(ok, value.cast("decimal(28,6)"))).cast("double").alias(f"s_{name}")]
    rows = responses.groupingSets([[F.col(c) for c in g] for g in groupings], *[F.col(d) for d in dims]).agg(F.count(F.lit(1)).alias("n"), *cells, *[F.grouping(d).alias(f"g_{d}") for d in dims])
    for d in dims:
        rows = rows.where((F.col(f"g_{d}") == 1) | F.col(d).isNotNull())
    kept = rows.where(F.col("n") >= minimum)
    long = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"n_{m}").alias("denominator"), F.col(f"s_{m}").alias("total")) for m in metrics]))
    out = kept.select(scope_key(dims).alias("scope"), "n", long)
    enough = F.col("denominator") >= minimum
    return out.select("scope", "n", "metric", "denominator", F.when(enough, round_half_up(F.col("total") / F.nullif("denominator", F.lit(0)))).alias("value"), (~enough).alias("suppressed"))


def multiselect(responses: DataFrame, respondent: str, facet: str, choices: str, minimum: int = MIN_SAMPLE) -> DataFrame:
    """Share of a facet's respondents that chose each category; ``choices`` is an array, repeats count once."""
    eligible = responses.where(F.col(choices).isNotNull())
    totals = eligible.groupBy(facet).agg(F.countDistinct(respondent).alias("denominator"))
    chosen = eligible.select(respondent, facet, F.explode(F.array_distinct(choices)).alias("category")).distinct().groupBy(facet, "category").agg(F.count(F.lit(1)).alias("numerator"))
    enough = F.col("denominator") >= minimum
    return chosen.join(totals, facet).select(facet, "category", "numerator", "denominator", F.when(enough, round_half_up(F.col("numerator") / F.col("denominator"))).alias("share"))


def rating_matrix(responses: DataFrame, ratings: str, minimum: int = MIN_SAMPLE) -> DataFrame:
    """Means of an array of (row, column, rating) structs, and the mean over respondents that rated all cells as row ``all``."""
    each = responses.select(F.explode(ratings).alias("r")).select(F.col("r.row").alias("row"), F.col("r.column").alias("column"), F.col("r.rating").alias("rating"))
    cells = each.groupBy("row", "column").agg(F.count("rating").alias("n"), F.avg("rating").alias("m"))
    whole = responses.where(F.forall(ratings, lambda x: x["rating"].isNotNull()) & (F.size(ratings) > 0)).select(F.aggregate(ratings, F.lit(0.0), lambda a, x: a + x["rating"]).alias("s"), F.size(ratings).alias("k"))
    overall = whole.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("s") / F.col("k")).alias("m")).select(F.lit("all").alias("row"), F.lit("all").alias("column"), "n", "m")
    return cells.unionByName(overall).select("row", "column", "n", F.when(F.col("n") >= minimum, round_half_up(F.col("m"))).alias("mean"))


def most_specific(facets: DataFrame) -> DataFrame:
    """Facets in the order of preference: more dimensions, more responses, key."""
    size = F.when(F.col("scope") == "overall", 0).otherwise(F.size(F.split("scope", r"\|")))
    return facets.withColumn("n_dimensions", size).orderBy(F.desc("n_dimensions"), F.desc("n"), "scope")


#: The metrics of each objective's signals: an exact id, a prefix (``x.*``) or a pattern.
SIGNALS = {
    "broad_reach": (("Format affinity", "^format\\.overall\\."), ("Environment pattern", "^environment\\."), ("Creative cue", "^memorability\\.")),
    "influential_core": (("Trust affinity", "^format\\.[^.]+\\.trust$"), ("Recall context", "^recall\\.four_week$"), ("Creative cue", "^memorability\\.")),
    "near_conversion": (("Search response", "^action\\.searched_online$"), ("Visit response", "^action\\.visited_store_or_location$"), ("Purchase response", "^action\\.purchased_product_or_service$")),
}


def distribution(responses: DataFrame, facet: list[str], category: str, minimum: int = MIN_SAMPLE) -> DataFrame:
    """One share per category that a facet's responses name, of all its responses with a category.

    One aggregate by facet and category; the denominators are sums of its counts.
    """
    counted = responses.where(F.col(category).isNotNull()).groupBy(*facet, category).agg(F.count(F.lit(1)).alias("numerator"))
    whole = counted.groupBy(*[F.col(f).alias(f"__{f}") for f in facet]).agg(F.sum("numerator").alias("denominator"))
    same = F.lit(True)
    for f in facet:
        same = same & F.col(f).eqNullSafe(F.col(f"__{f}"))
    enough = F.col("denominator") >= minimum
    return counted.join(whole, same).select(*facet, F.col(category).alias("category"), "numerator", "denominator", F.when(enough, round_half_up(F.col("numerator") / F.col("denominator"))).alias("share"))


def top_metric(metrics: DataFrame, keys: list[str], pattern: str) -> DataFrame:
    """Per key the metric id of the largest unsuppressed value whose id matches, ties by the smaller id."""
    rows = metrics.where(F.col("metric").rlike(pattern) & F.col("value").isNotNull() & ~F.col("suppressed"))
    return rows.groupBy(*keys).agg(F.min_by(F.struct("metric", "value", "denominator"), F.struct((-F.col("value")).alias("v"), F.col("metric"))).alias("m")).select(*keys, "m.metric", "m.value", "m.denominator")


def signals(metrics: DataFrame, keys: list[str], objective: str) -> DataFrame:
    """Up to three signals per key (a facet of ``metrics``): place, label, metric, value and its text."""
    found = None
    for place, (label, pattern) in enumerate(SIGNALS[objective], 1):
        part = top_metric(metrics, keys, pattern).select(*keys, F.lit(place).alias("place"), F.lit(label).alias("label"), "metric", "value", "denominator")
        found = part if found is None else found.unionByName(part)
    share = F.concat(F.floor(F.col("value") * 100 + 0.5).cast("string"), F.lit("%"))
    mean = F.concat(F.format_number("value", 2), F.lit(" / 5"))
    return found.withColumn("text", F.when(F.col("metric").startswith("format."), mean).otherwise(share))


def select_facet(facets: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The most specific facet (scope, n) all of whose dimensions are as wanted; one row, or none."""
    pairs = F.array(*[F.lit(f"{d}={v}") for d, v in wanted.items()]) if wanted else F.array().cast("array<string>")
    fits = (F.col("scope") == "overall") | (F.size(F.array_except(F.split("scope", r"\|"), pairs)) == 0)
    return most_specific(facets.where(fits)).limit(1)


def segment_catalogue(responses: DataFrame, city: str, dimensions: list[str], minimum: int = MIN_SAMPLE) -> DataFrame:
    """Profiles of one city: each value of each dimension with enough respondents, by dimension and value."""
    pairs = F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]))
    counted = responses.where(F.col("city") == city).select(pairs).where(F.col("value").isNotNull()).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("sample_size"))
    return counted.where(F.col("sample_size") >= minimum).select("dimension", "value", "sample_size", F.concat_ws("=", "dimension", "value").alias("profile"))


def yes_no(c: Column) -> Column:
    """True, false or null from answers such as ``Yes``, ``yes → go on`` or ``No``."""
    bare = F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.when(bare.rlike("^yes($| |→)"), True).when(bare.rlike("^no($| |→)"), False)


def selected(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes"), F.lit(False))


def commute_pattern(c: Column) -> Column:
    bare = F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    return F.when(F.lower(bare) == "daily commuter", "Daily commuter").when(F.lower(bare) == "hybrid", "Hybrid").when(F.lower(bare) == "remote", "Remote").otherwise(bare)


def moment(c: Column) -> Column:
    """ISO text of a readable moment, else the text as it stands."""
    bare = F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(F.date_format(F.try_to_timestamp(bare), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), bare)


def in_country(lat: Column, lon: Column) -> Column:
    """Within the bounds that answers are expected in (fixed values); true if either is missing."""
    return F.coalesce(lat.between(4, 14.5) & lon.between(2, 15), F.lit(True))


def canonical_responses(rows: DataFrame, multi: dict[str, tuple[tuple[str, str], ...]], exact: dict[str, tuple[int, str]], ratings: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """One canonical row per sheet row: screened, recoded, multi-selects as label arrays, ratings as structs, with diagnostics.

    ``multi`` names (column, label) pairs per question, ``exact`` how many choices a question should have and the diagnostic
    otherwise, ``ratings`` (row, column, source column).
    """
    c = F.col
    clean = lambda x: F.nullif(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit(""))
    city, age = clean(c("city")), clean(c("age_band"))
    eligible = F.coalesce(yes_no(c("consent")), F.lit(False)) & F.coalesce(yes_no(c("residence")), F.lit(False)) & city.isNotNull() & age.isNotNull() & (age != "56+")
    eligible = F.coalesce(eligible, F.lit(False))
    lat, lon, precision = (c(x).try_cast("double") for x in ("latitude", "longitude", "gps_precision"))
    started, ended = F.try_to_timestamp(c("started")), F.try_to_timestamp(c("ended"))
    chosen = {q: F.array_compact(F.array(*[F.when(selected(c(col)), label) for col, label in pairs])) for q, pairs in multi.items()}
    diagnostics = F.array_compact(
        F.array(
            F.when(~eligible, "CONTEXT_SCREEN_NOT_ELIGIBLE"), F.when(~in_country(lat, lon), "GPS_OUTSIDE_NIGERIA_BOUNDS"), F.when(precision <= 0, "GPS_PRECISION_NONPOSITIVE"), F.when(ended < started, "INTERVIEW_DURATION_NEGATIVE"),
            *[F.when(F.size(chosen[q]) != n, code) for q, (n, code) in exact.items()],
        )
    )
    matrix = F.array(*[F.struct(F.lit(a).alias("row"), F.lit(b).alias("column"), c(col).try_cast("double").alias("rating")) for a, b, col in ratings])
    return rows.select("source_row", eligible.alias("eligible"), city.alias("city"), age.alias("age_band"), commute_pattern(c("commute")).alias("commute_pattern"), moment(c("started")).alias("started"), moment(c("ended")).alias("ended"), *[v.alias(q) for q, v in chosen.items()], matrix.alias("ratings"), diagnostics.alias("diagnostics"))


@dataclass(frozen=True)
class Workbook:
    """What a survey's workbook must be; ``header_sha256`` is the digest of its column names as a JSON list."""

    source_id: str
    sha256: str
    sheet: str
    rows: int
    columns: int
    header_sha256: str


#: Fixed values of the survey of 2026.
SURVEY_2026 = Workbook(
    "rbl-loma-nigeria-ooh-consumer-penetration-2026-r1", "780a9fbaa2b4e736c4a4236fae751cb8c314aabaf6cad8206e553870bc5032e2", "Nigeria OOH 3", 1_844, 302, "8ef2dc4ede086ba1e7b28e78f9c413eeea4463ee658b9f394dfbc7b955d12acc"
)


def header_digest(headers: list[str]) -> str:
    return hashlib.sha256(json.dumps(headers, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def structure_failures(rows: DataFrame, sha256: str, wanted: Workbook = SURVEY_2026) -> list[str]:
    """What in a workbook's rows (sheet, row from 1, cells) and checksum is not as wanted, in order; empty if all is.

    The first row of the wanted sheet holds the column names; rows after it that have a filled cell are data.
    """
    sheet = rows.where(F.col("sheet") == wanted.sheet)
    head = sheet.where("row = 1").select("cells").first()
    headers = list(head.cells) if head else []
    filled = F.exists("cells", lambda x: F.length(F.trim(F.coalesce(x, F.lit("")))) > 0)
    checks = {
        "SOURCE_SHA256_MISMATCH": sha256 == wanted.sha256, "SHEET_NAME_MISMATCH": head is not None, "COLUMN_COUNT_MISMATCH": len(headers) == wanted.columns, "HEADER_SHA256_MISMATCH": header_digest(headers) == wanted.header_sha256,
        "DATA_ROW_COUNT_MISMATCH": sheet.where((F.col("row") > 1) & filled).count() == wanted.rows,
    }
    return [code for code, ok in checks.items() if not ok]
