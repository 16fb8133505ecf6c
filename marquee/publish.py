"""Publishing survey tables for planning: a snapshot of facets and metrics, or the catalogue of a city's segments.

    python -m marquee.publish snapshot  --responses PATH --store FOLDER --dimensions city,age_band [--minimum 30]
    python -m marquee.publish catalogue --responses PATH --store FOLDER --dimensions age_band --city Lagos

Responses are Parquet.  What is published is a committed run of the store (``sources.runstore``): the same responses,
command and parameters publish nothing twice, and a publication that was lost goes on.  Prints the run's id.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators import survey
from marquee.sources.runstore import RunStore, run_id


def fingerprint(df: DataFrame) -> str:
    """Tells tables with other rows apart, in whatever order rows come."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(20,0)")
    n, total, mixed = df.agg(F.count(F.lit(1)), F.sum(h), F.sum(F.pmod(h * 31 + 7, F.lit(998_244_353)))).first()
    return f"{n}:{total}:{mixed}"


def facet_counts(responses: DataFrame, dimensions: list[str], minimum: int) -> DataFrame:
    """Respondents of every combination of the dimensions' values down to ``minimum``: the facets that planning may use."""
    scope = F.coalesce(F.nullif(F.concat_ws("|", *[F.concat(F.lit(f"{d}="), F.col(d).cast("string")) for d in dimensions]), F.lit("")), F.lit("overall"))
    counted = responses.cube(*dimensions).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    known = F.lit(True)
    for k, d in enumerate(reversed(dimensions)):
        known = known & (F.col("g").bitwiseAND(1 << k).cast("boolean") | F.col(d).isNotNull())
    return counted.where(known & (F.col("n") >= minimum)).select(scope.alias("scope"), "n")


def publish(spark: SparkSession, command: str, responses: str, folder: str, dimensions: list[str], minimum: int = survey.MIN_SAMPLE, city: str | None = None) -> str:
    rows = spark.read.parquet(responses)
    eligible = rows.where("eligible") if "eligible" in rows.columns else rows
    missing = [d for d in [*dimensions, *(["city"] if command == "catalogue" else [])] if d not in rows.columns]
    if missing:
        raise ValueError(f"DIMENSION_UNKNOWN: {', '.join(missing)}")
    if command == "catalogue" and not city:
        raise ValueError("CITY_REQUIRED")
    build = {"snapshot": lambda _: {"facets": facet_counts(eligible, dimensions, minimum)}, "catalogue": lambda _: {"segments": survey.segment_catalogue(eligible, city, dimensions, minimum)}}[command]
    run = run_id(command=command, rows=fingerprint(rows), dimensions=dimensions, minimum=minimum, city=city)
    RunStore(spark, folder).run(run, [(command, build)])
    return run


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("command", choices=("snapshot", "catalogue"))
    parser.add_argument("--responses", required=True)
    parser.add_argument("--store", required=True)
    parser.add_argument("--dimensions", required=True)
    parser.add_argument("--minimum", type=int, default=survey.MIN_SAMPLE)
    parser.add_argument("--city")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    print(publish(spark, given.command, given.responses, given.store, given.dimensions.split(","), given.minimum, given.city))


if __name__ == "__main__":
    main()
