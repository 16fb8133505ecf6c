"""Mixing documents to target domain weights by soft membership.

A classifier fitted to a labelled table gives each document a posterior over
domains.  A document's rate (expected number of copies) is non-negative, and the
rates are fitted so that the expected tokens per domain, the sum of
rate x tokens x posterior, meet the targets.

The fit is projected gradient on weighted least squares.  With A the matrix of
tokens x posteriors, the squares are weighted by the inverse of the Gram matrix
G = sum of tokens x posterior x posterior' (with a small ridge), and a document's
step is divided by its tokens; then the step length one is safe, and without the
bound at zero a few steps meet the targets.  A step needs the domain totals under the
present rates: one aggregate over a narrow table, returning as many numbers as
there are domains.  A document's rate follows from its posterior and the list of
steps, so rates are neither stored between steps nor joined to the texts.  Targets
that no rates meet (a domain that no document belongs to) end the steps as well; the
shares reached are returned, and a warning says how far they are from the targets.

Tokens are lower-case runs of letters and digits, the classifier's own words.

The classifier is one FTRL-proximal logistic regression per domain, fitted to a
bounded sample (SAMPLE labelled rows, those of the smallest hashed ids, with at most
``ftrl.FEATURES`` features).

Defined cases: a null or empty text has no tokens and the posterior of the
intercepts, and gets a rate like any other; a document with several labels takes
the largest; domains without a target aim at zero; with no labelled row all
documents share all domains equally; repeated rows are rated each; very long texts
are scored whole; an empty table gives an empty result.  Extra columns are carried by
``mix_documents`` only and never clash.  It draws the broken part of a rate by a hash
of id and text: rows without an id are drawn apart by their texts, while rows equal
in both are kept or dropped together.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.features import grams, word_hashes
from marquee.llm.ftrl import BITS, dense, logistic, sampled, train, unpacked
from marquee.llm.scratch import materialize

#: Labelled rows that are learned from, at most.
SAMPLE = 8_000
STEPS = 30
#: The fit ends once no domain misses its target, or none has moved, by more than this part of all tokens.
CLOSE = 1e-4
#: A domain that misses its target by more is warned of.
FAR = 1e-2

#: Added to the Gram matrix, as a part of its mean diagonal, so that domains hardly any document belongs to cannot drive rates to extremes.
RIDGE = 0.02

#: Domains of the labels table and the parts of all tokens they should have.
TARGETS = {"good": 0.80, "poor": 0.13, "toxic": 0.07}


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain, from the quality and toxic marks; rows without a mark name no domain."""
    known = labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    return known.select("doc_id", F.when(F.col("toxic") > 0, "toxic").when(F.col("quality") > 0, "good").otherwise("poor").alias("domain"))


class Posterior:
    """Tokens and domain posterior of a text: the domains' logistic scores, made to sum to one."""

    def __init__(self, weights: list[tuple[np.ndarray, np.ndarray]]):
        self.weights = weights
        self._dense: list[np.ndarray] | None = None

    def __getstate__(self):
        return {"weights": self.weights, "_dense": None}

    def __call__(self, text: str | None) -> tuple[int, list[float]]:
        if self._dense is None:
            self._dense = [dense(*w) for w in self.weights]
        h = word_hashes(text)
        at = grams(h, BITS, 1, 0)
        p = logistic(np.array([w[at].sum() + w[-1] for w in self._dense]))
        return len(h), (p / p.sum()).tolist()


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = SAMPLE) -> Posterior:
    """The posterior over ``domains`` from at most ``sample`` of the labelled documents."""
    marks = labelled.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max("domain").alias("mark"))
    rows = sampled(docs, marks, sample, 1, 0)

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("t", "ascending")])
        name = table.column("name")[0].as_py()
        at, w = train(unpacked(table), [int(x == name) for x in table.column("mark").to_pylist()])
        return pa.table({"name": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at, pa.int64()), "weight": pa.array(w, pa.float64())})

    per_domain = rows.withColumn("name", F.explode(F.array(*[F.lit(d) for d in domains])))
    fitted = per_domain.groupBy("name").applyInArrow(fit, "name string, bucket long, weight double").toPandas()
    found = {name: (part["bucket"].to_numpy(), part["weight"].to_numpy()) for name, part in fitted.groupby("name")}
    nothing = (np.zeros(0, np.int64), np.zeros(0))
    return Posterior([found.get(d, nothing) for d in domains])


def _scored(posterior: Posterior):
    @F.pandas_udf("n_tokens long, p array<double>")
    def scored(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([posterior(t) for t in texts], columns=["n_tokens", "p"])

    return scored


def rate_after(steps: list[np.ndarray], p: list[Column]) -> Column:
    """The rate of a document with posterior ``p`` after these steps from one."""
    rate = F.lit(1.0)
    for step in steps:
        rate = F.greatest(F.lit(0.0), rate - sum((x * float(g) for x, g in zip(p, step)), F.lit(0.0)))
    return rate


@dataclass
class Fit:
    """Steps to take, and the parts of all tokens that the domains have after them."""

    steps: list[np.ndarray]
    shares: np.ndarray


def fit_rates(weighed: DataFrame, targets: np.ndarray, steps: int = STEPS) -> Fit:
    """Steps towards ``targets``, parts of all tokens by domain; ``weighed`` has n_tokens and p."""
    k = len(targets)
    p = [F.col("p")[i] for i in range(k)]
    t = F.col("n_tokens").cast("double")
    gram = weighed.agg(F.sum(t), *[F.sum(t * p[i] * p[j]) for i in range(k) for j in range(k)]).first()
    total = float(gram[0] or 0.0)
    if not total:
        return Fit([], np.zeros(k))
    gram = np.array(gram[1:], float).reshape(k, k) / total
    inverse = np.linalg.inv(gram + RIDGE * np.trace(gram) / k * np.eye(k))
    taken: list[np.ndarray] = []
    before = np.full(k, np.inf)
    while True:
        rate = rate_after(taken, p)
        have = np.array(weighed.agg(*[F.sum(rate * t * x) for x in p]).first(), float) / total
        if min(np.abs(have - targets).max(), np.abs(have - before).max()) <= CLOSE or len(taken) == steps:
            break
        before = have
        taken.append(inverse @ (have - targets))
    if np.abs(have - targets).max() > FAR:
        warnings.warn(f"domain shares {have.round(4).tolist()} miss the targets {targets.round(4).tolist()}", stacklevel=2)
    return Fit(taken, have)


def _model(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> tuple[Posterior, list[str], np.ndarray]:
    domains = sorted(targets)
    weights = np.array([targets[d] for d in domains], float)
    return learn(docs, labelled, domains), domains, weights / weights.sum()


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """doc_id, n_tokens, the posterior as a column per domain, and rate, per row of ``docs``."""
    posterior, domains, weights = _model(docs, labelled, targets)
    scored = docs.select("doc_id", _scored(posterior)("text").alias("s")).select("doc_id", "s.n_tokens", "s.p")
    scored = materialize(scored, "posteriors")
    steps = fit_rates(scored, weights).steps
    p = [F.col("p")[i] for i in range(len(domains))]
    return scored.select("doc_id", "n_tokens", *[x.alias(f"p_{d}") for x, d in zip(p, domains)], rate_after(steps, p).alias("rate"))


def mix_documents(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """Each row of ``docs`` as often as its rate says: its whole part, and once more if the hashed id falls below the rest.

    The texts are scored again rather than joined with stored rates: scoring is a
    map, and the steps to apply are a few numbers.
    """
    posterior, domains, weights = _model(docs, labelled, targets)
    scored = _scored(posterior)
    weighed = materialize(docs.select(scored("text").alias("s")).select("s.n_tokens", "s.p"), "posteriors")
    steps = fit_rates(weighed, weights).steps
    rate = rate_after(steps, [F.col("__p")[i] for i in range(len(domains))])
    chance = F.pmod(F.xxhash64(F.col("__doc.doc_id"), F.col("__doc.text"), F.lit("copies")), F.lit(1_000_000)) / 1_000_000
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), scored("text").alias("__s"))
    rows = rows.select("__doc", F.col("__s.p").alias("__p")).select("__doc", rate.alias("__rate"))
    copies = (F.floor("__rate") + (chance < F.col("__rate") - F.floor("__rate")).cast("long")).cast("int")
    return rows.select("__doc", F.explode(F.array_repeat(F.lit(0), copies)).alias("__copy")).select("__doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixing_rates(docs, label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")), TARGETS)
