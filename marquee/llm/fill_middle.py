"""Fill-in-middle documents by relational units.

A text is cut into units (a run of letters, or any other single code point).  Units
are posexploded in runs of GROUP matches, so that a text gives one row for GROUP
units; a window sums the lengths of the runs before each run; cut requests, two a
document, join the runs by the ordinal of the run that holds their unit; the units
of that one run are posexploded and the lengths of those before the cut are added;
an aggregate brings both offsets of a document together, and substrings do the rest.

All is DataFrame functions.  Rows are numbered as they are read and dealt once, with
their texts, by that number; every later window, join and aggregate has the number as
its key, so texts are shuffled once and nothing else is.  Repeated rows have numbers
of their own, so a group of copies spreads over all tasks.  The frame given must
yield the same rows in the same order when a task is repeated, as a file scan does.

Defined cases: a null text is the empty one, which has no units and stays plain; a
text that holds a marker stays plain, as its parts could not be told apart; a null id
is hashed as an empty number; rows with equal ids are transformed each, alike if
their texts are; texts of any length are taken whole (a run of letters is one unit
however long); ties: equal cuts give an empty middle; no column but ``doc_id`` and
``text`` is read, whatever its name; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = "[A-Za-z]++|[^A-Za-z]"
#: Units that travel as one row until a cut is known to lie among them.
GROUP = 32
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of documents that stay plain, and per cent of the others that begin with their suffix.
PLAIN, SUFFIX_FIRST = 10, 20
SEED = 1


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def unit_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[A-Za-z]++", "a")).cast("long")


def requests(numbered: DataFrame, seed: int = SEED) -> DataFrame:
    """A row a document with its two cut requests: units before the cut, and the run that holds the unit at the cut."""
    a, b, *_ = draws(F.col("doc_id"), seed)
    counted = numbered.select("row", unit_count(F.col("text")).alias("n"), a.alias("a"), b.alias("b"))
    a, b = F.col("a") % (F.col("n") + 1), F.col("b") % (F.col("n") + 1)
    # A cut behind the last unit lies at the end of the last run.
    run = lambda cut: F.floor(F.least(cut, F.greatest(F.col("n") - 1, F.lit(0))) / GROUP).cast("int")
    cuts = [F.struct(F.lit(side).alias("side"), cut.alias("cut"), run(cut).alias("run")) for side, cut in enumerate((F.least(a, b), F.greatest(a, b)))]
    return counted.select("row", "n", F.array(*cuts).alias("cuts"))


def runs(numbered: DataFrame) -> DataFrame:
    """Runs of GROUP units with the code points before them."""
    found = F.regexp_extract_all("text", F.lit(f"((?:{UNIT}){{1,{GROUP}}}+)"))
    spelt = numbered.select("row", "doc_id", F.posexplode_outer(found).alias("run", "units")).select("row", "doc_id", F.coalesce("run", F.lit(0)).alias("run"), "units")
    before = Window.partitionBy("row").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    return spelt.select("row", "doc_id", "run", "units", F.coalesce(F.sum(F.length("units").cast("long")).over(before), F.lit(0)).alias("before"))


def offsets(numbered: DataFrame, seed: int = SEED) -> DataFrame:
    """row, id, n, and the code points before the first and the second cut.

    The id is carried along so that every branch reads the same columns of the dealt rows: Spark then deals them once.
    """
    # The run's ordinal is no key of the join: as one, Spark would deal the runs anew by both.
    both = runs(numbered).withColumnRenamed("run", "at_run").join(requests(numbered, seed), "row")
    wanted = F.filter("cuts", lambda c: c["run"] == F.col("at_run"))
    hit = both.where(F.size(wanted) > 0).select("row", "doc_id", "n", "before", "units", F.explode(wanted).alias("cut"))
    units = F.regexp_extract_all("units", F.lit(f"({UNIT})"))
    spelt = hit.select("row", "doc_id", "n", "cut.side", "before", (F.col("cut.cut") - F.col("cut.run") * GROUP).alias("left"), F.posexplode_outer(units).alias("at", "unit"))
    inside = F.when(F.col("at") < F.col("left"), F.length("unit").cast("long")).otherwise(0)
    summed = spelt.groupBy("row", "side").agg(F.max("doc_id").alias("id"), F.max("n").alias("n"), (F.max("before") + F.sum(inside)).alias("offset"))
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("offset")))
    return summed.groupBy("row").agg(F.max("id").alias("id"), F.max("n").alias("n"), side(0).alias("first"), side(1).alias("second"))


def transformed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the output text of each document."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartition("row")
    found = numbered.join(offsets(numbered, seed), "row")
    *_, h3, h4 = draws(F.col("id"), seed)
    text, first, second = F.col("text"), F.col("first"), F.col("second")
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (h3 % 100 >= 100 - PLAIN)
    form = F.when(plain, "plain").when(h4 % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    found = found.select("doc_id", "n", "text", "first", "second", form.alias("form"))
    apart = F.col("form") != "plain"
    piece = lambda start, length: F.substring(text, (start + 1).cast("int"), length.cast("int"))
    prefix, middle, suffix = piece(F.lit(0), first), piece(first, second - first), piece(second, F.length(text) - second)
    mark = {k: F.lit(k) for k in (PREFIX, SUFFIX, MIDDLE)}
    output = (
        F.when(F.col("form") == "psm", F.concat(mark[PREFIX], prefix, mark[SUFFIX], suffix, mark[MIDDLE], middle))
        .when(F.col("form") == "spm", F.concat(mark[SUFFIX], suffix, mark[PREFIX], prefix, mark[MIDDLE], middle))
        .otherwise(text)
    )
    return found.select("doc_id", "n", "form", F.when(apart, first).alias("prefix_chars"), F.when(apart, second - first).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    part = F.split(output, "<[PSM]>", -1)
    psm, spm = (F.concat(*[F.get(part, k) for k in order]) for order in ((1, 3, 2), (2, 3, 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(spark, sf_dir: str) -> DataFrame:
    found = transformed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, CASE WHEN text = '' THEN [] ELSE regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') END AS us FROM d),
c AS (SELECT *, len(us) AS n, ('0x' || h[1:8])::BIGINT % (len(us) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(us) + 1) AS b,
        CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}')
               OR ('0x' || h[17:24])::BIGINT % 100 >= {100 - PLAIN} THEN 'plain'
             WHEN ('0x' || h[25:32])::BIGINT % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, n, form, array_to_string(us[1:least(a, b)], '') AS prefix, array_to_string(us[least(a, b) + 1:greatest(a, b)], '') AS middle,
        array_to_string(us[greatest(a, b) + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
                   WHEN 'spm' THEN '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
