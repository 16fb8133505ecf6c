"""Raw rows to records and quarantine, inventory uploads, and header mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions import ids, text

#: Columns of a placement row from index 1; the last three are year, quarter and month in the first layout.
PLACEMENT = ("advertiser", "region", "state", "city", "address", "brand", "category", "board_type", "format", "classification", "annual_rate", "monthly_rate")
REQUIRED = ("advertiser", "state", "city", "category", "format")


def placement_rows(rows: DataFrame, month_first: bool = False, superseded_years: tuple[int, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Records and quarantined rows of ``source, sheet, row, cells``; blank rows are dropped."""
    y, q, m = (15, 13, 14) if month_first else (13, 14, 15)
    # Cells, then what they hold, are generated columns: Spark would copy plain ones into the filters and flags that read them.
    rows = rows.select("*", F.inline(F.array(F.struct(F.transform("cells", text.source_text).alias("__cells"))))).where(F.exists("__cells", lambda c: c.isNotNull()))
    cell = lambda k: F.get("__cells", F.lit(k))
    # Numbers and the period are read by functions over arrays: as plain columns they make generated code too long for the JVM to compile.
    read = F.array(cell(y), F.regexp_replace(cell(q), "(?i)^q", ""), *[cell(1 + PLACEMENT.index(n)) for n in ("annual_rate", "monthly_rate")])
    rows = rows.select("*", F.inline(F.array(F.struct(F.transform(read, text.loose_number).alias("__numbers"), F.get(F.transform(F.array(cell(m)), text.source_period), F.lit(0)).alias("period")))))
    number = lambda k: F.get("__numbers", F.lit(k))
    integer = lambda k: F.when(number(k) == F.floor(number(k)), number(k).cast("long"))
    parsed = rows.select(*[c for c in rows.columns if c not in ("__cells", "__numbers", "period")], *[cell(k + 1).alias(n) for k, n in enumerate(PLACEMENT)], integer(0).alias("year"), integer(1).alias("quarter"), "period", number(2).alias("__annual_rate"), number(3).alias("__monthly_rate"))
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), n) for n in REQUIRED]))
    reason = F.when(F.col("year").isNull() | ~F.col("year").between(1900, 2100), "invalid_year").when(F.size(missing) > 0, "invalid_row_shape")
    parsed = parsed.withColumn("reason", reason)
    flags = F.array_compact(
        F.array(
            F.when(F.col("annual_rate").isNotNull() & F.col("__annual_rate").isNull(), "annual_rate_unparsed"),
            F.when(F.col("monthly_rate").isNotNull() & F.col("__monthly_rate").isNull(), "monthly_rate_unparsed"),
            F.when(F.col("period.kind") == "unparsed", "period_unparsed"),
            F.when(F.col("quarter").isNull() | ~F.col("quarter").between(1, 4), "quarter_invalid"),
        )
    )
    status = F.when(F.col("year").isin(*superseded_years), "superseded").otherwise("active") if superseded_years else F.lit("active")
    good = parsed.where("reason IS NULL").select(
        "source", "sheet", "row", *[c for c in PLACEMENT if "rate" not in c], F.col("__annual_rate").alias("annual_rate"), F.col("__monthly_rate").alias("monthly_rate"), "year", "quarter", "period", flags.alias("flags"), status.alias("canonical_status")
    )
    raw = F.to_json("cells", {"ignoreNullFields": "false"})
    bad = parsed.where("reason IS NOT NULL").select("source", "sheet", "row", "reason", raw.alias("raw"), ids.stable_id("quarantine", F.col("source"), F.col("sheet"), F.col("row").cast("string"), F.col("reason"), raw).alias("quarantine_id"))
    return good, bad


#: The names under which uploads give each field.
ALIASES = {
    "asset_id": ("asset id", "billboard id", "site id", "face id"),
    "address": ("address", "location address", "site address"),
    "latitude": ("latitude", "lat"),
    "longitude": ("longitude", "lng", "lon"),
    "coordinate_accuracy_m": ("coordinate accuracy m", "coordinate accuracy metres", "location accuracy m"),
    "supplier": ("supplier", "owner", "media owner"),
    "format": ("format", "media format"),
    "rate": ("rate", "price", "cost"),
    "orientation": ("orientation", "travel direction", "facing"),
    "spatial_rights": ("coordinate source", "spatial rights", "location source"),
    "spatial_license_id": ("spatial license id", "coordinate attestation id", "location license id"),
    "source_artifact_id": ("source artifact id", "source file id", "location source id"),
    "person_name": ("person name", "contact name", "resident name"),
}
MIN_SIMILARITY = 0.6


def map_headers(headers: list[str]) -> dict[str, tuple[str, float, bool]]:
    """header -> (field, similarity, confirmed): an exact name, whatever its case, hyphens or underscores, is confirmed; otherwise the most similar by shared words, if similar enough."""
    plain = lambda s: " ".join(s.lower().replace("_", " ").replace("-", " ").split())
    names = {name: field for field, aliases in ALIASES.items() for name in aliases}
    found = {}
    for header in headers:
        text = plain(header)
        if text in names:
            found[header] = (names[text], 1.0, True)
            continue
        mine = set(text.split())
        likeness = {name: len(mine & set(name.split())) / len(mine | set(name.split())) for name in names}
        best = max(likeness, key=likeness.get)
        if likeness[best] >= MIN_SIMILARITY:
            found[header] = (names[best], likeness[best], False)
    return found


def validate_inventory(rows: DataFrame, order: str = "row") -> DataFrame:
    """Upload rows with status accepted, quarantined or rejected, and reasons.

    Personal data is looked for first, then missing or impossible values; of rows
    with one id that would be accepted the first in ``order`` stays.
    """
    shown = F.concat_ws(" ", *[F.col(c).cast("string") for c in rows.columns if c not in ("latitude", "longitude", "rate", "asset_id", order)])
    person = text.source_text(F.col("person_name")).isNotNull() if "person_name" in rows.columns else F.lit(False)
    personal = F.array_compact(F.array(F.when(person, "PERSON_NAME"), F.when(shown.rlike(text.EMAIL), "EMAIL"), F.when(shown.rlike(text.PHONE), "PHONE")))
    wrong: list[Column] = [F.when(text.source_text(F.col("asset_id")).isNull(), "ASSET_ID_MISSING"), F.when(text.source_text(F.col("address")).isNull(), "ADDRESS_MISSING")]
    pair = F.col("latitude").isNull() != F.col("longitude").isNull()
    wrong += [F.when(pair, "COORDINATE_INCOMPLETE"), F.when((F.abs("latitude") > 90) | (F.abs("longitude") > 180), "COORDINATE_INVALID"), F.when(F.col("rate") < 0, "RATE_INVALID")]
    marked = rows.withColumns({"__p": personal, "__w": F.array_compact(F.array(*wrong))})
    clean = (F.size("__p") == 0) & (F.size("__w") == 0)
    again = F.when(clean, F.row_number().over(Window.partitionBy(F.lower(F.trim("asset_id")), clean).orderBy(order)) > 1).otherwise(False)
    marked = marked.withColumn("__d", again)
    status = F.when(F.size("__p") > 0, "quarantined").when((F.size("__w") > 0) | F.col("__d"), "rejected").otherwise("accepted")
    reasons = F.concat("__p", F.when(F.size("__p") == 0, F.col("__w")).otherwise(F.array().cast("array<string>")), F.when(F.col("__d"), F.array(F.lit("DUPLICATE_ASSET_ID"))).otherwise(F.array().cast("array<string>")))
    return marked.select(*rows.columns, status.alias("status"), reasons.alias("reasons"))


def airport_links(names: DataFrame, aliases: DataFrame, anchors: DataFrame) -> DataFrame:
    """Airport of each label: exact name, else alias, else the only airport of its state; otherwise review.

    ``names``: label, state; ``aliases``: key, airport (names and aliases alike, with ``rank``); ``anchors``: state, airport.
    """
    keyed = names.withColumn("key", text.entity_literal(F.col("label")))
    best = aliases.groupBy("key").agg(F.min(F.struct("rank", "airport")).alias("a"))
    out = keyed.join(best, "key", "left").join(anchors.where("airport IS NOT NULL").select("state", F.col("airport").alias("anchor")), "state", "left")
    how = F.when(F.col("a.rank") == 0, "exact_name").when(F.col("a").isNotNull(), "alias").when(F.col("anchor").isNotNull(), "state_anchor").otherwise("review")
    return out.select("label", "state", F.coalesce("a.airport", "anchor").alias("airport"), how.alias("method"))


SITE_KEY = ("state", "city", "address", "board_type", "format")


def site_entities(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sites by a strict key of five normalised parts, and rows whose key is incomplete, for review."""
    parts = [text.entity_literal(F.col(c)) for c in SITE_KEY]
    # Generated, so that the filters do not make their own copies.
    keyed = rows.select("*", F.inline(F.array(F.struct(*[p.alias(f"__{c}") for c, p in zip(SITE_KEY, parts)]))))
    complete = F.lit(True)
    for c in SITE_KEY:
        complete = complete & F.col(f"__{c}").isNotNull()
    good = keyed.where(complete).withColumn("site_id", ids.site_id(F.concat_ws("|", *[F.col(f"__{c}") for c in SITE_KEY])))
    return good.drop(*[f"__{c}" for c in SITE_KEY]), keyed.where(~complete).select(*rows.columns)


def first_spellings(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row for each spelling of a site's five parts: the first values of the columns of ``order``, and how many rows it stands for (``n_seen``).

    Observations repeat their spellings, so keys and ids are made once for each.
    """
    return rows.groupBy(*SITE_KEY).agg(F.min(F.struct(*order)).alias("__first"), F.count(F.lit(1)).alias("n_seen")).select(*SITE_KEY, "__first.*", "n_seen")


def representative_sites(sites: DataFrame, order: list[Column], count: str | None = None) -> DataFrame:
    """One row per site_id with the attributes of its first row in an order, and its rows' number; ``count`` names the column of how many rows a row stands for."""
    columns = [c for c in sites.columns if c not in ("site_id", count)]
    key = F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)])
    return sites.groupBy("site_id").agg(F.min_by(F.struct(*columns), key).alias("r"), F.sum(F.lit(1) if count is None else F.col(count)).alias("n_rows")).select("site_id", "r.*", "n_rows")


def non_empty_rows(rows: DataFrame) -> DataFrame:
    """Rows of which some cell holds text; ``cells`` is an array of strings."""
    return rows.where(F.exists("cells", lambda x: text.source_text(x).isNotNull()))


def expect_rows(rows: DataFrame, expected: int) -> DataFrame:
    """The rows, or an error when they are read if the sheet does not have as many non-empty rows as its specification says."""
    counted = non_empty_rows(rows).agg(F.count(F.lit(1)).alias("__n"))
    checked = F.when(F.col("__n") != expected, F.raise_error(F.concat(F.lit("SOURCE_ROW_COUNT_MISMATCH:"), F.col("__n").cast("string"))).cast("boolean")).otherwise(True)
    return rows.join(F.broadcast(counted)).where(checked).drop("__n")


#: Cell positions of a board-quality row.
BOARD = {"company": 1, "state": 3, "city": 4, "address": 5, "brand": 6, "category": 7, "board_type": 8, "board_quality": 9, "format": 10, "annual_rate": 11, "monthly_rate": 12, "quarter": 14, "period": 15}


def board_quality_rows(rows: DataFrame, year: int) -> tuple[DataFrame, DataFrame]:
    """Records and quarantined rows of a board-quality sheet (source_id, sheet, source_row, cells); its year comes from the sheet's specification."""
    cell = lambda name: F.get("cells", F.lit(BOARD[name]))
    names = ("company", "state", "city", "address", "brand", "category", "board_type", "board_quality", "format", "quarter")
    rates = {n: text.loose_number(cell(n)) for n in ("annual_rate", "monthly_rate")}
    read = non_empty_rows(rows).select("source_id", "sheet", "source_row", "cells", *[text.source_text(cell(n)).alias(n) for n in names], *[v.alias(n) for n, v in rates.items()], text.source_period(cell("period")).alias("period"))
    whole = F.lit(True)
    for n in names:
        whole = whole & F.col(n).isNotNull()
    flags = F.array_compact(F.array(F.lit("year_from_artifact_context"), F.when(F.col("annual_rate").isNull() | F.col("monthly_rate").isNull(), "missing_rate"), F.when(F.col("period.kind") == "unparsed", "unparsed_period")))
    key = text.natural_key(*[F.col(n) for n in names[:-1]], F.lit(year), F.col("quarter"), F.col("period.raw_month"))
    good = read.where(whole).select("source_id", "sheet", "source_row", *names, "annual_rate", "monthly_rate", F.lit(year).alias("year"), "period", key.alias("natural_key"), flags.alias("flags"))
    return good, read.where(~whole).select("source_id", "sheet", "source_row", F.lit("invalid_row_shape").alias("reason"), "cells")


def weight_months(rows: DataFrame, keys: list[str], cells: str, starts: list[int], annual: int) -> DataFrame:
    """One row per month of weights whose columns start at any place; a month has a reported total only if three columns lie before the next start."""
    ends = [*starts[1:], annual]
    # Cells are read once as an array: a copy of the reader for each of them would be too long a method to compile.
    rows = rows.select(*keys, F.inline(F.array(F.struct(F.transform(cells, text.loose_number).alias("__numbers")))))
    at = lambda k: F.get("__numbers", F.lit(k))
    parts = [F.struct(F.lit(m).alias("month"), at(a).alias("imports"), at(a + 1).alias("exports"), (at(a + 2) if b - a >= 3 else F.lit(None).cast("double")).alias("reported_total"), F.lit(b - a >= 3).alias("has_total")) for m, (a, b) in enumerate(zip(starts, ends), 1)]
    long = rows.select(*keys, F.inline(F.array(*parts)))
    derived = F.col("imports") + F.col("exports")
    flags = F.array_compact(
        F.array(
            F.when(F.col("imports").isNull(), "import_missing"), F.when(F.col("exports").isNull(), "export_missing"), F.when(F.col("has_total") & F.col("reported_total").isNull(), "reported_total_missing"),
            F.when(F.coalesce(F.abs(derived - F.col("reported_total")) > 0.5, F.lit(False)), "reported_total_mismatch"),
        )
    )
    return long.select(*keys, "month", "imports", "exports", "reported_total", derived.alias("derived_total"), flags.alias("flags"))


def active(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("canonical_status") == "active")


def traffic_keys(rows: DataFrame) -> DataFrame:
    """Traffic rows with ``scope_key`` (a missing scope is ``unscoped``) and ``unit_key``, which follows the metric where it has one unit only."""
    unit = F.when(F.col("metric") == "passenger", "persons").when(F.col("metric") == "aircraft", "aircraft_movements").otherwise(F.coalesce(F.nullif(F.trim("unit"), F.lit("")), F.lit("source_unit_unspecified")))
    return rows.withColumns({"scope_key": F.coalesce("scope", F.lit("unscoped")), "unit_key": unit})
