"""What a campaign brief asks for: its audience cells and its survey segment, told by words of its texts."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Per sector the audience cells, their labels and the words that ask for them.
AUDIENCES = (
    ("fmcg", "student_buyers_18_24", "Students / young buyers", ("student", "students", "campus", "university", "youth", "young buyer", "young workers")),
    ("fmcg", "household_nonstudent_buyers_25_44", "Household buyers 25–44", ("household", "family", "families", "parents", "parent", "home shoppers", "home buyers")),
    ("fmcg", "residual_convenience_nonstudent_nonhousehold", "Convenience / general buyers", ("convenience", "on-the-go", "mass market", "general consumers", "shoppers")),
    ("real_estate", "diaspora_intenders", "Diaspora property intenders", ("diaspora", "overseas", "abroad", "expatriate")),
    ("real_estate", "resident_professional_intenders", "Resident professional intenders", ("professional", "professionals", "executive", "executives", "salaried", "corporate")),
    ("real_estate", "resident_nonprofessional_investors", "Resident property investors", ("investor", "investors", "investment", "landlord", "landlords")),
    ("bank_fintech", "merchant_owner_users", "Merchant / business users", ("merchant", "merchants", "business owner", "business owners", "sme", "retailer", "retailers")),
    ("bank_fintech", "student_nonmerchant_users", "Student / young users", ("student", "students", "campus", "university", "youth", "young users")),
    ("bank_fintech", "professional_nonmerchant_nonstudent_users", "Professional users", ("professional", "professionals", "salary", "salaried", "executive", "corporate", "urban professionals")),
)
#: What a sector's whole audience is called.
PRESETS = {"fmcg": "FMCG sector audience preset", "real_estate": "Real Estate sector audience preset", "bank_fintech": "Bank / Fintech sector audience preset"}
#: Survey segments in order of precedence: name, words, and (dimension, value) candidates.
SEGMENTS = (
    ("explicit-age-18-25", ("18-25", "18 to 25", "aged 18 to 25"), (("ageBand", "18-25"),)),
    ("explicit-age-26-35", ("26-35", "26 to 35", "aged 26 to 35"), (("ageBand", "26-35"),)),
    ("explicit-age-36-45", ("36-45", "36 to 45", "aged 36 to 45"), (("ageBand", "36-45"),)),
    ("explicit-age-46-55", ("46-55", "46 to 55", "aged 46 to 55"), (("ageBand", "46-55"),)),
    ("high-income", ("affluent", "high income", "wealthy", "premium buyers", "luxury buyers"), (("incomeBand", "₦500,000 and above"), ("incomeBand", "₦200,000–₦499,999"))),
    ("mid-income", ("middle income", "mid income", "100,000 to 199,999", "100000 to 199999"), (("incomeBand", "₦100,000–₦199,999"),)),
    ("lower-income", ("lower income", "low income", "below 100,000", "below 100000"), (("incomeBand", "Below ₦50,000"), ("incomeBand", "₦50,000–₦99,999"))),
    ("students-and-youth", ("student", "students", "campus", "university", "youth"), (("occupation", "Student"), ("ageBand", "18-25"))),
    (
        "business-owners-and-traders",
        ("sme owner", "sme owners", "merchant", "merchants", "business owner", "business owners", "trader", "traders", "retailer", "retailers", "entrepreneur", "entrepreneurs", "investor", "investors"),
        (("occupation", "Business/trader"),),
    ),
    ("young-professionals", ("young worker", "young workers", "young professional", "young professionals"), (("occupation", "Employed professional"), ("ageBand", "26-35"))),
    ("employed-professionals", ("employed professional", "professional", "professionals", "salaried", "executive", "executives", "corporate"), (("occupation", "Employed professional"),)),
    ("artisans-and-skilled-workers", ("artisan", "artisans", "skilled worker", "skilled workers"), (("occupation", "Artisan/skilled worker"),)),
    ("private-car-users", ("private car", "motorist", "motorists", "car commuters"), (("transportMode", "Private car"),)),
    ("bus-and-brt-users", ("brt", "bus commuter", "bus commuters", "bus users"), (("transportMode", "Bus or BRT"),)),
    ("danfo-users", ("danfo", "danfo users", "danfo commuters"), (("transportMode", "Danfo"),)),
    ("keke-users", ("keke", "tricycle", "tricycle users"), (("transportMode", "tricycle (Keke)"),)),
    ("ride-hailing-users", ("ride hailing", "ride-hailing", "uber", "bolt"), (("transportMode", "Ride hailing"),)),
    ("daily-commuters", ("daily commuter", "daily commuters"), (("commutePattern", "Daily commuter"),)),
    ("hybrid-commuters", ("hybrid worker", "hybrid workers", "hybrid commuter"), (("commutePattern", "Hybrid"),)),
    ("remote-workers", ("remote worker", "remote workers", "work from home"), (("commutePattern", "Remote"),)),
)


def brief_text(c: Column) -> Column:
    """Lower-case ASCII letters and digits, single spaces between."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


@F.pandas_udf(StringType())
def nfkd(s: pd.Series) -> pd.Series:
    """Decomposed compatibility form, for which Spark has no function; briefs are few and short."""
    return s.str.normalize("NFKD")


def _words(terms: tuple[str, ...]) -> Column:
    """The terms as they are and as ``brief_text`` leaves them."""
    import re

    return F.array(*[F.struct(F.lit(t).alias("term"), F.lit(re.sub("[^a-z0-9]+", " ", t.lower()).strip()).alias("word")) for t in terms])


def resolve_audience(sector: Column, texts: list[Column], cells: Column) -> Column:
    """Struct of mode, cell_ids, label and signals.

    A word counts anywhere in the text, also within another.  One matching audience
    among the sector's ``cells`` is taken alone; none or several keep the whole sector.
    """
    text = brief_text(F.concat_ws(" ", *texts))
    rules = F.array(*[F.struct(F.lit(s).alias("sector"), F.lit(c).alias("cell"), F.lit(label).alias("label"), _words(w).alias("words")) for s, c, label, w in AUDIENCES])
    found = F.transform(F.filter(rules, lambda r: r["sector"] == sector), lambda r: F.struct(r["cell"].alias("cell"), r["label"].alias("label"), F.filter(r["words"], lambda w: F.contains(text, w["word"])).alias("hit")))
    found = F.filter(found, lambda r: F.size(r["hit"]) > 0)
    only = F.get(found, F.lit(0))
    focused = (F.size(found) == 1) & F.array_contains(cells, only["cell"])
    preset = F.element_at(F.create_map(*[F.lit(x) for pair in PRESETS.items() for x in pair]), sector)
    signals = F.transform(F.flatten(F.transform(found, lambda r: r["hit"])), lambda w: w["term"])
    return F.struct(
        F.when(focused, "focused").otherwise("sector_preset").alias("mode"), F.when(focused, F.array(only["cell"])).otherwise(F.array_sort(cells)).alias("cell_ids"),
        F.when(focused, only["label"]).otherwise(preset).alias("label"), signals.alias("signals"),
    )


def narrowed(bundle, sector: str, cells: list[str]):
    """The bundle with a sector's panel and shares limited to these cells; other sectors keep theirs."""
    keep = (F.col("sector") != sector) | F.col("cell_id").isin(cells)
    return replace(bundle, panel=bundle.panel.where(keep), shares=bundle.shares.where(keep))


def with_segment(rows: DataFrame, texts: list[Column], available: Column, name: str = "segment") -> DataFrame:
    """The rows with a struct of mode, selected, requested, terms, rules and unavailable as a further column.

    A term counts as whole words only.  Candidates are taken in order of the rules;
    the first that ``available`` (an array of ``dimension=value``) holds is selected.
    """
    # Each step is a generated column: Spark would copy a plain one into every place, lambdas included, that reads it.
    step = lambda df, **made: df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in made.items()]))))
    rows = rows.withColumn("__brief", nfkd(F.concat_ws(" ", *texts)))
    rows = step(rows, __text=F.concat(F.lit(" "), brief_text(F.regexp_replace(F.lower(F.col("__brief")), "[₦,–—-]+", " ")), F.lit(" ")))
    text = F.col("__text")
    candidates = lambda pairs: F.array(*[F.lit(f"{d}={v}") for d, v in pairs])
    rules = F.array(*[F.struct(F.lit(name).alias("name"), _words(terms).alias("words"), candidates(pairs).alias("candidates")) for name, terms, pairs in SEGMENTS])
    found = F.transform(rules, lambda r: F.struct(r["name"].alias("name"), r["candidates"].alias("candidates"), F.filter(r["words"], lambda w: F.contains(text, F.concat(F.lit(" "), w["word"], F.lit(" ")))).alias("hit")))
    rows = step(rows, __found=F.filter(found, lambda r: F.size(r["hit"]) > 0))
    found = F.col("__found")
    rows = step(rows, __asked=F.array_distinct(F.flatten(F.transform(found, lambda r: r["candidates"]))))
    asked = F.col("__asked")
    rows = step(rows, __selected=F.get(F.filter(asked, lambda c: F.array_contains(available, c)), F.lit(0)))
    selected = F.col("__selected")
    place = F.array_position(asked, selected)
    mode = F.when(F.size(asked) == 0, "fallback_no_match").when(selected.isNull(), "fallback_suppressed").when(place == 1, "matched").otherwise("matched_after_suppression")
    answer = F.struct(
        mode.alias("mode"), selected.alias("selected"), F.get(asked, F.lit(0)).alias("requested"), F.array_distinct(F.transform(F.flatten(F.transform(found, lambda r: r["hit"])), lambda w: w["term"])).alias("terms"),
        F.transform(found, lambda r: r["name"]).alias("rules"), F.when(selected.isNull(), asked).otherwise(F.slice(asked, 1, (place - 1).cast("int"))).alias("unavailable"),
    )
    return rows.withColumn(name, answer).drop("__brief", "__text", "__found", "__asked", "__selected")
