"""Host-level quality rules.

Rules judge each document; failures are summed by host (``source``); each
host's failure rate is shrunk towards the mean by a beta prior fitted to the
hosts themselves; hosts whose shrunk rate is too high lose all their documents.

Everything is DataFrame operations.  The only shuffles are the partial counts
by host and a join of narrow rows on host, which adaptive execution splits when
one host holds a large part of the rows.

Defined cases: a null text has no words and fails; a null ``source`` belongs to
no host, so only the rules decide; rows with equal ids are judged one by one;
an empty table gives an empty result; extra columns are carried only by
``keep_documents`` and never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.scratch import materialize

SEPARATORS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A host goes if its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _windows(hashes: Column, n: Column) -> Column:
    at = F.sequence(F.lit(0), n - WINDOW)
    window = F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
    return F.when(n >= WINDOW, window).otherwise(F.array().cast("array<bigint>"))


def rule_metrics(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` with the measures and ``base_failed`` as further columns.

    Windows of eight words are compared by 64-bit hashes of their words' hashes;
    only a text in which a hash occurs twice takes the sorting path.
    """
    lines = F.filter(F.split(F.col("__text"), "\n"), lambda x: x.rlike(WORD))
    df = rows.select("*", F.coalesce(text, F.lit("")).alias("__text"))
    df = df.select("*", F.array_remove(F.split("__text", SEPARATORS), "").alias("__words"), lines.alias("__lines"))
    df = df.select(
        "*",
        F.size("__words").alias("__n"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__hash"),
    ).drop("__text", "__words", "__lines")
    df = df.select("*", _windows(F.col("__hash"), F.col("__n")).alias("__win")).drop("__hash")
    order = F.sort_array(F.arrays_zip(F.col("__win").alias("h"), F.sequence(F.lit(0), F.size("__win") - 1).alias("i")))
    repeats = F.size(F.array_distinct("__win")) < F.size("__win")
    df = df.select("*", F.when(repeats, order).alias("__sorted")).drop("__win")
    twin = F.filter(
        "__sorted",
        lambda x, i: F.coalesce(x["h"] == F.get("__sorted", i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("__sorted", i + 1)["h"], F.lit(False)),
    )
    df = df.select("*", F.sort_array(F.transform(twin, lambda x: x["i"])).alias("__at")).drop("__sorted")
    covered = F.aggregate(
        "__at",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n")),
        lambda a: a["n"],
    )
    df = df.select("*", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), F.col("__n").cast("long").alias("n_words")).drop("__at", "__n")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    df = df.select("*", failed.alias("base_failed"))
    # A later filter on a measure must not be pushed into these steps: inlined, a step would be computed again for every element.
    found = F.struct(*METRICS, "base_failed")
    return df.select(*rows.columns, F.inline(F.array(found)))


def host_rates(scored: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: documents, failures, shrunk rate and verdict.

    The beta prior has the pooled failure rate as its mean.  Its weight comes
    from the variance between hosts beyond what sampling explains (method of
    moments); if there is none, hosts keep the pooled rate.
    """
    counts = scored.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed_docs")
    )
    counts = materialize(counts, "host-counts")
    rate = F.col("host_failed_docs") / F.col("host_docs")
    mean, variance, inverse, hosts = counts.agg(
        F.sum("host_failed_docs") / F.sum("host_docs"), F.var_pop(rate), F.avg(1 / F.col("host_docs")), F.count(F.lit(1))
    ).first()
    mean = float(mean or 0.0)
    alpha, beta = beta_prior(mean, float(variance or 0.0), float(inverse or 0.0), hosts)
    shrunk = (F.col("host_failed_docs") + alpha) / (F.col("host_docs") + alpha + beta)
    return counts.select("source", "host_docs", "host_failed_docs", shrunk.alias("host_rate"), (shrunk > max_rate).alias("host_failed"))


def beta_prior(mean: float, variance: float, inverse: float, hosts: int) -> tuple[float, float]:
    """Alpha and beta; ``inverse`` is the mean of 1/n over hosts, which gives the sampling variance."""
    spread = mean * (1 - mean)
    between = variance - spread * inverse
    weight = 1e6 if hosts < 2 or between <= 0 else min(1e6, max(1.0, spread / between - 1))
    return mean * weight, (1 - mean) * weight


def join_verdicts(scored: DataFrame, hosts: DataFrame) -> DataFrame:
    # Rows without a host are dealt out by a salt that no host has, so they do not meet in one task.
    verdicts = hosts.select(F.col("source").alias("__host"), (F.col("host_docs") % 1).alias("__none"), "host_rate", F.col("host_failed").alias("__bad"))
    salt = F.when(F.col("source").isNull(), 1 + F.pmod(F.xxhash64(*METRICS), F.lit(997))).otherwise(0)
    joined = scored.join(verdicts, (F.coalesce("source", F.lit("")) == F.col("__host")) & (salt == F.col("__none")), "left").drop("__host", "__none")
    bad = F.coalesce(F.col("__bad"), F.lit(False))
    return joined.select("*", bad.alias("host_failed"), (~F.col("base_failed") & ~bad).alias("kept")).drop("__bad")


def quality_rules(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Measures and verdicts per document: doc_id, source, the measures, base_failed, host_rate, host_failed, kept.

    The texts are read once; the narrow measures are written before the host join.
    """
    scored = rule_metrics(docs.select("doc_id", "source", F.col("text").alias("__raw")), F.col("__raw")).drop("__raw")
    scored = materialize(scored, "quality")
    return join_verdicts(scored, host_rates(scored, max_rate)).select("doc_id", "source", *METRICS, "base_failed", "host_rate", "host_failed", "kept")


def keep_documents(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The documents that pass, with all their columns.

    The host table needs a first pass over the texts; the second judges them
    again rather than shuffling or storing whole documents.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), "source")
    scored = rule_metrics(rows, F.col("__doc.text"))
    hosts = host_rates(scored.select("source", "base_failed"), max_rate)
    return join_verdicts(scored, hosts).where("kept").select("__doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = quality_rules(docs)
    return found.select("doc_id", *METRICS, "base_failed", F.round("host_rate", 9).alias("host_rate"), "kept")


SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS s
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, {WINDOW})) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, w.source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS k FROM f WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT sum(k) / sum(n) AS mean, var_pop(k / n) AS v, avg(1 / n) AS inv, count(*) AS c FROM h),
b AS (SELECT mean, CASE WHEN c < 2 OR v - mean * (1 - mean) * inv <= 0 THEN 1e6
        ELSE least(1e6, greatest(1.0, mean * (1 - mean) / (v - mean * (1 - mean) * inv) - 1)) END AS weight FROM p),
r AS (SELECT source, (k + mean * weight) / (n + weight) AS host_rate FROM h, b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(host_rate, 9) AS host_rate,
  (NOT base_failed AND coalesce(host_rate <= {MAX_HOST_RATE}, true)) AS kept
FROM f LEFT JOIN r USING (source)
"""
