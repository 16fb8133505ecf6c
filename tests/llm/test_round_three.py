"""MinHash groups, fill-in-middle and source divergence against brute force, and on nulls, ties, repeats, clashing names and empty tables."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from marquee.llm import divergence, fill_middle, minhash

LONG = " ".join(f"w{i % 900}" for i in range(60_000))
TEXTS = [None, "", " \n\t", "One two", "one TWO", "a b c", "A b c", "A b c d", "Hello\nworld again", "éàü ß 漢字 emoji 😀 ÀB", "\x1cx\x85y\xa0z", "has <P> inside", "12 34", LONG, LONG + " end"]
SCHEMA = "doc_id long, text string, lang string, source string, n long, form string, row string, `__x.y` int, component_id string"


def rows():
    found = [(i, t, ["en", "fr", None][i % 3], ["h", "g", None, "h"][i % 4], 1, "clash", "clash", i, "clash") for i, t in enumerate(TEXTS)]
    return [*found, (None, "no id here", "en", "h", 1, None, None, None, None), (4, TEXTS[4], "en", None, 1, None, None, None, None), (4, "other text", "en", None, 1, None, None, None, None), (20, None, None, None, 1, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return frozenset(tuple(words[i : i + 3]) for i in range(max(len(words) - 2, 1))) if words else frozenset()


def brute_groups(texts):
    """Sets' sizes and each row's least reachable index."""
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [len(s) for s in sets], [find(x) for x in range(len(sets))]


def family(seed, size, words, edits):
    """Copies of a text with changes drawn from a range of sizes, so that similarities lie on both sides of the threshold."""
    draw = random.Random(seed)
    base = [f"s{seed}w{draw.randrange(10**6)}" for _ in range(words)]
    for _ in range(size):
        text = list(base)
        for _ in range(draw.randint(0, edits)):
            text[draw.randrange(words)] = f"e{draw.randrange(10**6)}"
        yield " ".join(text)


def test_minhash_on_families(spark, monkeypatch):
    shared = " ".join(f"p{i}" for i in range(60))
    texts = [*family(1, 60, 120, 12), *family(2, 25, 40, 3), *family(3, 15, 9, 1), *(f"{shared} " + " ".join(f"u{k}x{i}" for i in range(90)) for k in range(40)), *["the same text here"] * 30]
    sizes, groups = brute_groups(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for shingles, visitors in ((minhash.BLOCK_SHINGLES, minhash.VISITORS), (1_500, 25)):
        monkeypatch.setattr(minhash.cluster_links, "__defaults__", (shingles, minhash.BLOCK_NODES, visitors, minhash.VISIT_SHINGLES if visitors > 25 else 2_000))
        got = {r.doc_id: r for r in minhash.near_duplicates(frame).collect()}
        assert [got[i].n_shingles for i in range(len(texts))] == sizes
        assert [got[i].component_id for i in range(len(texts))] == groups
        assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert len(set(groups)) > 40 and max(Counter(groups).values()) > 20


def test_minhash_odd_rows(spark, docs, empty):
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    size = {t: len(shingle_set(t)) for t in [*TEXTS, "other text", "no id here"]}
    least = {3: 3, 4: 3, 5: 5, 6: 5, 13: 13, 14: 13}
    want = Counter((i, size[t], least.get(i, i), least.get(i, i) == i) for i, t in enumerate(TEXTS))
    want.update([(None, size["no id here"], None, False), (4, size[TEXTS[4]], 3, False), (4, size["other text"], 4, True), (20, 0, 20, True)])
    assert got == want
    assert minhash.near_duplicates(empty).collect() == [] and minhash.near_duplicates(empty).columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_densified_bins_agree_as_often_as_sets():
    """Small sets too: the share of equal bins follows the similarity."""
    draw = np.random.default_rng(5)
    for n, common in ((12, 10), (300, 255), (4_000, 2_000)):
        shares = []
        for _ in range(60):
            both, rest = draw.integers(0, 2**63, common, dtype=np.uint64), draw.integers(0, 2**63, 2 * (n - common), dtype=np.uint64)
            one, other = np.unique(np.r_[both, rest[: n - common]]), np.unique(np.r_[both, rest[n - common :]])
            shares.append((minhash.signature(one, 252, 3) == minhash.signature(other, 252, 3)).mean())
        assert np.mean(shares) == pytest.approx(common / (2 * n - common), abs=0.06)


def plain_fim(doc_id, text):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text or "")
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    text = text or ""
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_middle(spark, docs, empty):
    got = Counter(tuple(r) for r in fill_middle.transformed(docs).collect())
    assert got == Counter(plain_fim(r[0], r[1]) for r in rows())
    draw = random.Random(3)
    texts = ["".join(draw.choice("aZ é<>PSM.\n😀漢") for _ in range(draw.choice([0, 1, 5, 31, 32, 33, 64, 200, 2000]))) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    out = fill_middle.transformed(frame)
    back = out.select("doc_id", "output", "form", fill_middle.restored(out["output"], out["form"]).alias("back"), "n", "prefix_chars", "middle_chars").collect()
    assert {r.doc_id: (r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in back} == {i: plain_fim(i, t) for i, t in enumerate(texts)}
    assert all(r.back == texts[r.doc_id] for r in back)
    assert {r.form for r in back} == {"plain", "psm", "spm"}
    assert fill_middle.transformed(empty).collect() == []


def test_fill_middle_deals_texts_once(spark, sf):
    frame = fill_middle.query(spark, sf)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == plan.count("REPARTITION_BY_COL") == 3 and "Python" not in plan
    frame.write.format("noop").mode("overwrite").save()


def plain_divergence(table, min_docs, top):
    groups, seen = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in table:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang or "", source or ""].update(found)
        seen[lang or ""].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        mine = {s: c for (x, s), c in groups.items() if x == lang}

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in mine.items()}, share(sum(mine.values(), Counter()))
        for s in mine:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in mine if o != s]
            tops = [(q[t] - p[s][t], t.encode()) for t in kept if mine[s][t] > 0 and p[s][t] > q[t]]
            out += [(lang, s, "pair", o.decode(), -f, k) for k, (f, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t.decode(), -f, k) for k, (f, t) in enumerate(sorted(tops)[:top], 1)]
    return out


def test_divergence(spark, docs, empty):
    assert sorted(map(tuple, divergence.divergence(docs, min_docs=1).collect())) == sorted(plain_divergence([(r[1], r[2], r[3]) for r in rows()], 1, 50))
    assert sorted(map(tuple, divergence.divergence(docs).collect())) == sorted(plain_divergence([(r[1], r[2], r[3]) for r in rows()], 30, 50))
    assert divergence.divergence(empty).collect() == []
    draw = random.Random(9)
    table = [(" ".join(draw.choice("Alpha beta gamma δέλτα Été zwölf eta theta iota x y z".split()) for _ in range(draw.randrange(12))), draw.choice(["en", "fr"]), f"s{draw.randrange(13)}") for _ in range(400)]
    table += [("only here", "xx", "one"), (None, "xx", "two"), ("", "yy", "one")]
    frame = spark.createDataFrame(table, "text string, lang string, source string").repartition(4)
    # Many shards, blocks and rounds, the last of them in a job of their own.
    got = divergence.divergence(frame, min_docs=2, top=3, shard=3, block=2, wave=2)
    assert sorted(map(tuple, got.collect())) == sorted(plain_divergence(table, 2, 3))


@pytest.mark.parametrize("blocks", [1, 2, 3, 4, 7, 8])
def test_every_two_blocks_meet_once(spark, blocks):
    from pyspark.sql import functions as F

    rounds = blocks + blocks % 2 - 1 if blocks > 1 else 0
    frame = spark.range(blocks).crossJoin(spark.range(max(rounds, 1)).withColumnRenamed("id", "turn")).where(F.lit(rounds > 0))
    met = frame.select("id", divergence.opponent(F.col("id"), F.lit(blocks), F.col("turn")).alias("other")).where(f"other < {blocks}").collect()
    assert Counter((r.id, r.other) for r in met) == Counter(itertools.permutations(range(blocks), 2))


@pytest.mark.parametrize("module, table", [(minhash, "doc_id"), (fill_middle, "doc_id"), (divergence, None)], ids=lambda m: getattr(m, "__name__", ""))
def test_equals_sql(spark, sf, module, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(module.SQL).df()
    got = module.query(spark, sf).toPandas()
    plain = lambda df: Counter(tuple(None if pd.isna(x) else x for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)
