"""The pipeline's stages against plain versions, each on its own input."""

import collections
import os
import sys
import zlib

import numpy as np

import corpus_pipeline
from marquee.llm import language_id, mixing, quality_rules
from marquee.llm.scratch import materialize

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from test_small_cases import brute_components, brute_fingerprint, brute_rules, check_packing, plain_language, plain_profile  # noqa: E402


def brute_languages(docs):
    texts = collections.defaultdict(list)
    for r in docs:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            texts[r.lang].append(r.text)
    profiles = {k: plain_profile(v) for k, v in texts.items()}
    out = []
    for r in docs:
        lang, score = plain_language(r.text, profiles)
        if lang != "und" and score >= language_id.MIN_SCORE:
            out.append(r)
    return out


def brute_hosts(docs):
    failed = {}
    for r in docs:
        n, _, _, _, repeated = brute_rules(r.text)
        failed[r.doc_id] = n < 20 or 100 * repeated > 30 * n
    hosts = collections.defaultdict(list)
    for r in docs:
        hosts[r.source].append(failed[r.doc_id])
    rates = np.array([np.mean(v) for v in hosts.values()])
    alpha, beta = quality_rules.beta_prior(sum(map(sum, hosts.values())) / len(docs), float(rates.var()), float(np.mean([1 / len(v) for v in hosts.values()])), len(hosts))
    bad = {h for h, v in hosts.items() if (sum(v) + alpha) / (len(v) + alpha + beta) > quality_rules.MAX_HOST_RATE}
    return [r for r in docs if not failed[r.doc_id] and r.source not in bad]


def test_stages(spark, sf):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, key = docs.columns, lambda rows: sorted(r.doc_id for r in rows)
    for name, brute in (("languages", brute_languages), ("rules", brute_hosts), ("near_duplicates", None)):
        before = docs.collect()
        docs = materialize(stages[name](spark, docs, sf), name)
        assert docs.columns == columns
        got = docs.collect()
        if brute:
            want = key(brute(before))
        else:
            want = sorted({c for _, _, c in brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in before])})
        assert key(got) == want
        assert {r.doc_id: r for r in before}.items() >= {r.doc_id: r for r in got}.items()
    before = {r.doc_id: r for r in docs.collect()}
    labelled = mixing.label_domains(spark.read.parquet(f"{sf}/labels.parquet"))
    rates = {r.doc_id: r.rate for r in mixing.mixing_rates(docs, labelled, mixing.TARGETS).collect()}
    mixed = materialize(stages["mix"](spark, docs, sf), "mix")
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and set(copies) <= set(before)
    assert all(int(rates[i]) <= copies[i] <= int(rates[i]) + 1 for i in before)
    assert all(r == before[r.doc_id] for r in mixed.collect())
    packed = stages["pack"](spark, mixed, sf).collect()
    used, least = check_packing(packed, [(r.doc_id, r.text) for r in mixed.collect()])
    assert used <= least * 1.01 + 1


def test_run_equals_the_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), name)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, docs.select(*columns).collect())) == sorted(map(tuple, corpus_pipeline.run(spark, sf).select(*columns).collect()))


def test_batches_are_restored(spark, sf):
    import gc

    option = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(option)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    first, second = stages["languages"](spark, docs, sf), stages["rules"](spark, docs, sf)
    assert spark.conf.get(option) == str(corpus_pipeline.BATCH_ROWS)
    del first
    gc.collect()
    assert spark.conf.get(option) == str(corpus_pipeline.BATCH_ROWS)
    del second
    gc.collect()
    assert spark.conf.get(option) == own


def test_odd_tables_through_all_stages(spark, sf):
    """Nulls in any column, repeated rows and ids, clashing names, an empty table."""
    text = " ".join(f"plain{k % 23} words{k % 7} of english" for k in range(30))
    names = "doc_id long, text string, lang string, source string, n_chars long, __doc string, found string, id long, hash long, fp long, rate double, kept string, __s int"
    table = [(i, f"{text} {i % 4}", ["en", None][i % 2], ["h", None][i % 3 == 0], None, "x", None, 1, 2, 3, None, "y", 1) for i in range(12)]
    table += [(3, f"{text} 3", "en", "h", None, "x", None, 1, 2, 3, None, "y", 1), (None, text, None, None, None, None, None, None, None, None, None, None, None), (50, None, "en", "h", 0, None, None, None, None, None, None, None, None), (51, "", "en", "h", 0, None, None, None, None, None, None, None, None)]
    for rows in (table, []):
        docs = spark.createDataFrame(rows, names)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, sf), name)
            assert docs.columns == columns or name == "pack"
        assert (docs.count() > 0) == bool(rows)
