"""Each operator against a brute-force version, and on nulls, ties, repeats, clashing names and empty tables."""

import itertools
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marquee.llm import elias_fano, html_text, language_id, lm_scoring, mixing, nearest, packing, quality_rules, simhash, token_files, toxicity
from marquee.llm.scratch import new_path

LONG = " ".join(f"w{i % 700}" for i in range(30_000))
LOOP = "a b c d e f g h i j " * 6
TEXTS = [None, "", " \n\t", "one two", "Hello\nworld again.\n\nHello\nworld again. ½ &|<>", LOOP, LOOP, LOOP + "tail", LONG, "éàü ß 漢字 emoji 😀 <|endoftext|>", "\x1cx\x85y\xa0z"]
SCHEMA = "doc_id long, text string, lang string, source string, n_words string, kept string, score string, `__x.y` int"


def rows():
    found = [(i, t, ["en", "fr", None][i % 3], ["h", "h", "g", None][i % 4], "clash", "clash", None, i) for i, t in enumerate(TEXTS)]
    return [*found, (None, "no id here", "en", "h", None, None, None, None), (4, TEXTS[4], "en", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (4, 1, 0), (4, 0, 1), (None, 1, 1), (99, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def brute_rules(text):
    ws = words_of(text)
    windows = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    count = {w: windows.count(w) for w in set(windows)} if len(windows) < 500 else {w: 0 for w in windows}
    if len(windows) >= 500:
        for w in windows:
            count[w] += 1
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, empty):
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(rows())
    want = sorted([(r[0] if r[0] is not None else -1, *brute_rules(r[1])) for r in rows()])
    assert sorted((r.doc_id if r.doc_id is not None else -1, *[r[m] for m in quality_rules.METRICS]) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and not r.host_failed)
        assert (r.host_rate is None) == (r.source is None)
    assert quality_rules.quality_rules(empty).count() == 0
    kept = quality_rules.keep_documents(docs, max_rate=1.0)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if not r.base_failed)
    assert quality_rules.keep_documents(empty).count() == 0


def test_bad_host_loses_its_documents(spark):
    good = " ".join(f"word{i}" for i in range(40))
    table = [(i, "short" if i % 10 else good, "bad") for i in range(100)] + [(100 + i, good, f"fine{i % 5}") for i in range(200)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(table, "doc_id long, text string, source string")).collect()}
    assert got[0].host_failed and not got[0].base_failed and not got[0].kept
    assert all(got[i].kept for i in range(100, 300))


def test_beta_prior():
    assert quality_rules.beta_prior(0.1, 0.0, 0.1, 5)[0] == pytest.approx(1e5)
    a, b = quality_rules.beta_prior(0.2, 0.02, 0.01, 50)
    assert a / (a + b) == pytest.approx(0.2) and a + b == pytest.approx(0.16 / (0.02 - 0.0016) - 1)


def ids(vocabulary, drops):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_chunks_encode_as_whole_texts():
    from marquee.llm.tokens import encoder

    alphabet = ["a", "b", ".", ",", "'s", " ", "\n", "\t", "é", "1", "́", "　", "Σ", "\x1c", "!", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>"]
    texts = ["".join(c) for n in (1, 2, 3) for c in itertools.product(alphabet, repeat=n)] + [t for t in TEXTS if t]
    for vocabulary, drops in ((token_files.VOCABULARY, False), (packing.VOCABULARY, True)):
        whole = ids(vocabulary, drops)
        for text, got in zip(texts, encoder(vocabulary, drops).encode(texts)):
            assert list(np.frombuffer(got, "<u2")) == whole(text)[:-1].tolist(), repr(text)


@pytest.mark.parametrize("values", [[], [0], [7], [3, 3, 3], [0, 1, 2, 10**12], list(range(0, 5000, 7)), [2**40 + i // 3 for i in range(700)], [*range(1000), *range(10**6, 10**6 + 300), 10**9], [i * i * i for i in range(900)]])
def test_elias_fano(values):
    data = b"xx" + elias_fano.encode(np.array(values, np.int64))
    coded = elias_fano.EliasFano(data, 2)
    assert [coded[i] for i in range(len(coded))] == values == coded.to_numpy().tolist() and coded.end == len(data)
    with pytest.raises(IndexError):
        coded[len(values)]


def test_token_files(spark, docs, empty):
    folder = new_path(spark, "test-tokens")
    manifest = token_files.write(docs, folder, per_file=50_000)
    assert manifest.count() > 1
    got = token_files.read(manifest, folder).orderBy("start").collect()
    encode = ids(token_files.VOCABULARY, False)
    order = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for r, g in zip(order, got, strict=True):
        x = encode(r[1])
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r[0], start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)
    assert token_files.read(token_files.write(empty, new_path(spark, "none")), folder).count() == 0


def test_elias_fano_space_and_long_gaps():
    values = np.concatenate([np.arange(50_000), 3_000_000 + np.arange(50_000)])
    data = elias_fano.encode(values)
    assert 8 * len(data) <= len(values) * (3.5 + np.log2(values[-1] / len(values)))
    coded = elias_fano.EliasFano(data)
    assert [coded[i] for i in range(49_000, 51_000)] == values[49_000:51_000].tolist()
    assert len(elias_fano.EliasFano(elias_fano.encode(np.repeat([0, 10**6], [600, 10**6]))).spread) == 1


def test_token_files_deal_rows_without_id(spark):
    table = [(None, f"text number {k}") for k in range(4000)]
    folder = new_path(spark, "nameless")
    # Adaptive execution would join partitions as small as these.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = token_files.write(spark.createDataFrame(table, "doc_id long, text string"), folder)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = token_files.read(manifest, folder).orderBy("start").collect()
    encode = ids(token_files.VOCABULARY, False)
    assert sorted(r.ids_crc32 for r in got) == sorted(zlib.crc32(encode(t).tobytes()) for _, t in table)
    assert manifest.count() > 1 and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))


def test_token_file_random_access():
    file = token_files.TokenFile(token_files.pack([None, -5, -5, 900], [np.array(x, "<u2").tobytes() for x in ([0], [1, 2, 0], [], [9] * 40)]))
    assert [file.doc_id(i) for i in range(4)] == [None, -5, -5, 900] == file.doc_ids()
    assert [file[i].tolist() for i in range(4)] == [[0], [1, 2, 0], [], [9] * 40]


def check_packing(got, table):
    encode = ids(packing.VOCABULARY, True)
    pool = {}
    for r in table:
        pool.setdefault(r[0], []).append(encode(r[1]))
    for g in got:
        assert any(zlib.crc32(x[g.start : g.start + g.length].tobytes()) == g.ids_crc32 and g.start == 2048 * g.piece and (g.length == 2048 or g.start + g.length == len(x)) for x in pool[g.doc_id])
    sequences = {}
    for g in got:
        sequences.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(len(x) for xs in pool.values() for x in xs)
    assert sum(g.length for g in got) == total
    return len(sequences), -(-total // 2048)


def test_packing(spark, docs, empty, sf):
    used, least = check_packing(packing.pack(docs).collect(), rows())
    assert used <= least + 1
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    used, least = check_packing(packing.pack(table).collect(), table.collect())
    assert used <= least * 1.01 + 1
    assert packing.pack(empty).count() == 0


def test_packing_plan_keeps_the_histogram():
    rng = np.random.default_rng(4)
    histogram = np.bincount(np.clip(rng.gamma(2, 300, 40_000).astype(int) + 1, 1, 2048), minlength=2049)
    plan = packing.make_plan(histogram)
    used = np.zeros(2049, int)
    for pattern, n in plan.patterns:
        assert sum(pattern) <= 2048
        for v in pattern:
            used[v] += n
    assert (used == histogram).all()
    assert plan.sequences <= 1.002 * -(-(np.arange(2049) * histogram).sum() // 2048)
    assert sum(n for p, n in plan.patterns if sum(p) == 2048) > 0.5 * plan.sequences


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=/>Home</a></nav>
<div class="cookie-notice">We use cookies</div><div id="main"><article><h1>Head&amp;line</h1><p>First  paragraph
has some text in it.<br>More of it.<p>Second, unclosed<script>var x = "</p>";</script> with <b>bold <i>mixed</b></i> text.
<form><input value=a>Search</form><div class="comments"><p>A reader writes a long comment about everything here.</p></div></article></div>
<aside>Related</aside><footer>&copy; 2020</footer></body></html>"""


def test_html():
    assert html_text.extract(PAGE) == "Head&line\n\nFirst paragraph has some text in it. More of it.\n\nSecond, unclosed with bold mixed text."
    for page, want in [(None, ""), ("", ""), ("<nav>x</nav>", ""), ("plain", "plain"), ("<p>a<p>b <b", "a\n\nb"), ("<p>1 < 2</p>", "1 < 2"), ("<!-- x --><p>y</p><!-- z", "y")]:
        assert html_text.extract(page) == want
    without = "<body><div class=sidebar><a href=x>l</a></div><div><h2>Title here</h2><p>One long paragraph of the text.</p><p>Another long paragraph of it.</p></div><div><a href=1>a</a> <a href=2>b</a></div></body>"
    assert html_text.extract(without) == "Title here\n\nOne long paragraph of the text.\n\nAnother long paragraph of it."
    assert html_text.extract("<div>" * 20_000 + "deep") == "deep"


def test_html_table(spark, sf):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, None, None, "x"), (None, "v", "", None)], "page_id long, url string, html string, text string")
    assert sorted(r.n_chars for r in html_text.main_texts(pages).collect()) == [0, 0, len(html_text.extract(PAGE))]
    assert html_text.main_texts(pages.limit(0)).count() == 0
    real = spark.read.parquet(f"{sf}/pages.parquet")
    html = {r.page_id: r.html for r in real.collect()}
    for r in html_text.query(spark, sf).collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", html[r.page_id], re.S).group(1)
        import html as h

        want = [" ".join(h.unescape(re.sub("</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(x for x in want if x) and r.n_chars == len(r.text)


def brute_neighbours(table, k=5):
    found = {}
    ok = [(i, np.array(v, float)) for i, v in table if i is not None and v is not None and len(v) == 6 and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    for q, a in ok:
        if q % 50 == 0:
            scores = sorted((-float(a @ b) / (float(np.sqrt(a @ a)) * float(np.sqrt(b @ b))), i) for i, b in ok if i != q)
            found[q] = [(i, -s) for s, i in scores[:k]]
    return found


def test_nearest(spark):
    rng = np.random.default_rng(3)
    table = [(i, rng.standard_normal(6).astype("f4").tolist()) for i in range(1200)]
    table += [(2000 + i, table[50][1]) for i in range(300)] + [(5000, None), (5050, [0.0] * 6), (5100, [float("nan")] + [1.0] * 5), (5150, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (5200, [1.0] * 3), (5201, [1.0, 2.0, 0.5]), (None, [1.0] * 6), (5250, [1e30] * 6)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in table], "vec_id long, embedding array<float>, score string")
    got = {}
    for r in nearest.neighbours(frame, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute_neighbours([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in table])
    # Vectors of another length are searched among themselves.
    assert [i for _, i, _ in got.pop(5200)] == [5201]
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    assert [i for _, i, _ in sorted(got[50])] == [2000, 2001, 2002, 2003, 2004]
    assert all([r for r, _, _ in sorted(g)] == [1, 2, 3, 4, 5] for g in got.values())
    assert nearest.neighbours(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = nearest.neighbours(frame.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 50 == 0).collect()
    assert len(few) == 2


def test_nearest_shards(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SHARD", 150)
    monkeypatch.setattr(nearest, "BLOCK_BYTES", 7 * 48)
    test_nearest(spark)


def test_nearest_recall_on_embeddings(spark, monkeypatch):
    """The given vectors have 64 dimensions; in one shard and in many."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.collect()
    x = np.array([r.embedding for r in rows], float)
    ids = np.array([r.vec_id for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for shard in (nearest.SHARD, 100):
        monkeypatch.setattr(nearest, "SHARD", shard)
        got = {}
        for r in nearest.neighbours(table, F.col("vec_id") % 50 == 0).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        hits = total = 0
        for q in np.flatnonzero(ids % 50 == 0):
            c = x @ x[q]
            c[q] = -2
            want = set(ids[np.argsort(-c)[:5]].tolist())
            hits += len(want & got[int(ids[q])])
            total += 5
        assert hits >= 0.9 * total, shard


def test_chi_square_bound():
    assert nearest.chi_square_bound(0.95, 8) == pytest.approx(15.5073, abs=1e-3)


def test_languages(spark, docs, empty, sf):
    got = language_id.query(spark, sf)
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in got.collect() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.collect())
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held)
    profiles = language_id.learn(language_id.learnable(docs))
    found = language_id.identify(docs, profiles).collect()
    assert len(found) == len(rows())
    text = {r[0]: r[1] for r in rows()}
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, text[r.doc_id] or ""))) and 0 <= r.score <= 1 for r in found)
    assert language_id.learn(empty) == {}
    assert {r[0] for r in language_id.identify(docs, {}).select("lang_pred").collect()} == {"und"}
    assert language_id.keep_documents(docs.withColumn("__lang", F.lit(1)).withColumn("doc", F.lit(2)).withColumn("found", F.lit(3))).columns[-3:] == ["__lang", "doc", "found"]
    kept = language_id.keep_documents(docs)
    assert kept.columns == docs.columns and language_id.keep_documents(empty).count() == 0


def plain_letters(text):
    import unicodedata

    words, word = [], ""
    for c in (text or "").lower():
        if c.isalpha() or unicodedata.category(c)[0] == "M":
            word += c
        else:
            words.append(word)
            word = ""
    return [w for w in [*words, word] if w]


def plain_profile(texts, size=300):
    """The commonest n-grams of the words of texts, each word between spaces; a text's words follow each other with one space."""
    import collections

    count = collections.Counter()
    for text in texts:
        words = plain_letters(text)
        if not any(map(str.isalpha, "".join(words))):
            continue
        count.update(c for w in words for c in w)
        for w in (f" {w} " for w in words):
            for n in (2, 3):
                count.update(w[i : i + n] for i in range(len(w) - n + 1))
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return sorted((g for g in count if g != " "), key=lambda g: (-count[g], code(g)))[:size]


def plain_language(text, profiles):
    document = plain_profile([text])
    if not document or not profiles:
        return "und", 0.0
    far = {lang: sum(abs(i - p.index(g)) if g in p else 300 for i, g in enumerate(document)) for lang, p in profiles.items()}
    best = min(sorted(far), key=far.get)
    return best, 1 - far[best] / (300 * len(document))


def test_languages_against_plain_profiles(spark):
    base = {"hi": "हिन्दी भाषा में लिखा हुआ पाठ", "th": "ภาษาไทยที่เขียนไว้นี้", "ar": "نَصٌّ عَرَبِيٌّ مَشْكُول", "en": "plain words of english text, isn't it", "fr": "des mots d'été à l'école", "tie": "plain words of english text, isn't it"}
    rng = np.random.default_rng(8)
    table = []
    for k in range(240):
        lang = list(base)[k % 6]
        words = base[lang].split()
        table.append((k, " ".join(rng.choice(words, 7)) + " 12_3!", lang))
    table += [(900, "123 ...", "en"), (901, None, "fr"), (902, "हि", None), (None, "plain", "hi")]
    frame = spark.createDataFrame(table, "doc_id long, text string, lang string").repartition(3)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    profiles = {x: plain_profile([t for i, t, y in table if y == x and i is not None and not held(i) and t]) for x in base}
    got = {r.doc_id: r for r in language_id.identify(frame, language_id.learn(language_id.learnable(frame))).collect()}
    for i, text, _ in table:
        want = plain_language(text, profiles)
        assert (got[i].lang_pred, got[i].held_out) == (want[0], held(i)) and got[i].score == pytest.approx(want[1])


def test_ranks_and_distance():
    model = language_id.Profiles({"x": [1, 2, 3], "y": [3, 4]}, 3)
    assert model.distances(np.array([2, 3, 9])).tolist() == [1 + 1 + 3, 3 + 1 + 3]
    assert language_id.grams(" ab ").tolist() == [97, 98, 32 << 21 | 97, 97 << 21 | 98, 98 << 21 | 32, 32 << 42 | 97 << 21 | 98, 97 << 42 | 98 << 21 | 32]


def brute_fingerprint(text):
    ws = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words_of(text)]
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    """prints: list of (id, fingerprint)."""
    distinct = sorted({p for _, p in prints})
    parent = {p: p for p in distinct}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in itertools.combinations(distinct, 2):
        if (a ^ b).bit_count() <= 4:
            parent[find(a)] = find(b)
    least = {}
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return [(i, p, least.get(find(p))) for i, p in prints]


def test_simhash(spark, docs, empty, sf):
    key = lambda x: (x[0] is None, x)
    for table, frame in ((rows(), docs), (None, spark.read.parquet(f"{sf}/documents.parquet"))):
        table = table or [(r.doc_id, r.text) for r in frame.collect()]
        got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(frame).collect()]
        want = brute_components([(r[0], brute_fingerprint(r[1])) for r in table])
        assert sorted(got, key=key) == sorted(want, key=key)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_documents(docs)
    assert kept.columns == docs.columns
    brute = brute_components([(r[0], brute_fingerprint(r[1])) for r in rows()])
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for _, _, c in brute} - {None})
    assert sum(r.doc_id is None for r in kept.collect()) == sum(c is None for _, _, c in brute)


def test_simhash_links_through_rows_without_id_and_repeated_ids(spark):
    prints = [(1, 0), (None, 0b1111), (2, 0b11111111), (5, 1 << 40), (5, (1 << 64) - 1), (7, (1 << 64) - 2), (None, 0xABCDEF << 30), (None, 0xABCDEF << 30)]
    table = [(i, p - (1 << 64) if p >> 63 else p) for i, p in prints]
    each = spark.createDataFrame(table, "id long, fp long")
    got = {r.fp % 2**64: r.least for r in simhash.grouped(each.groupBy("fp").agg(F.min("id").alias("id")), F.min("id")).collect()}
    assert got == {p: c for _, p, c in brute_components(prints)}
    assert got[0b11111111] == 1 and got[(1 << 64) - 2] == 5 and got[0xABCDEF << 30] is None


def test_simhash_keeps_one_row_of_each_group(spark):
    far = [" ".join(f"{c}{k}" for k in range(40)) for c in "abcd"]
    table = [(5, far[0], "x"), (5, far[1], "x"), (5, far[1], "x"), (9, far[0], "x"), (None, far[0], "x"), (None, far[2], "x"), (None, far[2], "y"), (None, None, "x"), (3, None, "x"), (8, "", "x")]
    kept = simhash.keep_documents(spark.createDataFrame(table, "doc_id long, text string, __kept string").withColumn("id", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "__kept", "id"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(5, far[0]), (5, far[1]), (None, far[2]), (3, None)], key=str)


@pytest.mark.parametrize("crowded", [False, True])
def test_simhash_links(spark, monkeypatch, crowded):
    if crowded:
        monkeypatch.setattr(simhash, "CROWDED", 1000)
    rng = np.random.default_rng(5)
    prints = {int(x) for x in rng.integers(-(2**63), 2**63, 120)}
    for x in list(prints):
        for _ in range(3):
            x ^= int(np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, rng.integers(1, 6), replace=False).astype(np.uint64)).view(np.int64))
            prints.add(x)
    table = [(p, 10 * k) for k, p in enumerate(sorted(prints))]
    edges = simhash.links(spark.createDataFrame(table, "fp long, node long"))
    from marquee.llm.components import components

    label = {r.u: r.v for r in components(edges).collect()}
    want = brute_components([(n, p % 2**64) for p, n in table])
    # The smallest fingerprint has the smallest number, so components agree number for number.
    number = dict(table)
    assert {n: number[label.get(p, p)] for p, n in table} == {n: c for n, _, c in want}


def test_components(spark):
    from marquee.llm.components import components

    chain = [(i, i + 1) for i in range(100, 160)] + [(7, 7), (3, 2), (2, 3), (500, 3)] + [(9000, i) for i in range(8000, 8050)]
    got = {r.u: r.v for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, 3: 2, 500: 2, **{i: 8000 for i in range(8001, 8050)}, 9000: 8000}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_toxicity(spark, docs, empty, labels):
    insults = ["idiot", "moron", "scum"]
    rng = np.random.default_rng(1)
    table = []
    for i in range(1200):
        text = [f"word{x}" for x in rng.integers(0, 300, 40)]
        toxic = i % 5 == 0
        for x in rng.choice(insults, 2) if toxic else []:
            text.insert(int(rng.integers(0, 40)), x)
        table.append((i, " ".join(text), int(toxic)))
    frame = spark.createDataFrame(table, "doc_id long, text string, toxic int")
    scored = toxicity.score_texts(frame, toxicity.learn(frame.drop("toxic"), frame.select("doc_id", "toxic"))).collect()
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= 0.5) == (r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    model = toxicity.learn(docs, labels)
    assert all(0 <= r.score <= 1 for r in toxicity.score_texts(docs, model).collect())
    nothing = toxicity.learn(empty, labels.limit(0))
    assert all(0.49 < r.score < 0.5 for r in toxicity.score_texts(docs, nothing).collect())
    assert toxicity.score_texts(empty, model).count() == 0


def plain_features(text, order, skips):
    """Distinct buckets of 20 bits, by integer arithmetic."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    h = [zlib.crc32(w.encode()) for w in words]
    m = 2**64

    def bucket(x, salt):
        x = (x + salt) * 0x9E3779B97F4A7C15 % m
        return (x ^ x >> 29) * 0xBF58476D1CE4E5B9 % m >> 44

    found = {bucket(x, 1) for x in h}
    for n in range(2, order + 1):
        for i in range(len(h) - n + 1):
            x = h[i]
            for y in h[i + 1 : i + n]:
                x = (x * 0x100000001B3 + y) % m
            found.add(bucket(x, n))
    for gap in range(2, skips + 2):
        found |= {bucket((a * 0x100000001B3 + b) % m, 100 + gap) for a, b in zip(h, h[gap:])}
    return found


def plain_ftrl(examples, alpha=1.0, beta=1.0, l1=8.0, l2=0.1, epochs=3):
    """Weights by coordinate; examples are (features, label), ``None`` is the intercept."""
    import math

    z, n = {}, {}

    def weight(c):
        bound = 0 if c is None else l1
        v = z.get(c, 0.0)
        return 0.0 if abs(v) <= bound else -(v - math.copysign(bound, v)) / ((beta + math.sqrt(n.get(c, 0.0))) / alpha + l2)

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(examples)):
            features, label = examples[i]
            w = {c: weight(c) for c in [*features, None]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for c, x in w.items():
                z[c] = z.get(c, 0.0) + g - (math.sqrt(n.get(c, 0.0) + g * g) - math.sqrt(n.get(c, 0.0))) / alpha * x
                n[c] = n.get(c, 0.0) + g * g
    return {c: weight(c) for c in z}


def labelled_texts():
    rng = np.random.default_rng(11)
    return [(i, " ".join(f"{'tn'[i % 3 > 0] if x < 12 else 'w'}{x}" for x in rng.integers(0, 60, 30)), int(i % 3 == 0)) for i in range(150)] + [(200, None, 1), (None, "t1", 1)]


def ordered_like_the_sample(spark, table):
    """Labelled rows in the order they are learned from."""
    frame = spark.createDataFrame(table, "doc_id long, text string, mark int").where("doc_id IS NOT NULL")
    return frame.orderBy(F.xxhash64(F.col("doc_id").cast("string")), F.xxhash64("text")).collect()


def logit(x):
    return 1 / (1 + np.exp(-x))


def test_toxicity_equals_plain_ftrl(spark):
    table = labelled_texts()
    frame = spark.createDataFrame(table, "doc_id long, text string, toxic int").repartition(3)
    got = toxicity.score_texts(frame, toxicity.learn(frame, frame)).collect()
    learned = [r for r in ordered_like_the_sample(spark, table) if zlib.crc32(str(r.doc_id).encode()) % 5]
    w = plain_ftrl([(plain_features(r.text, 2, 2), r.mark) for r in learned])
    text = {r[0]: r[1] for r in table}
    assert len(got) == len(table)
    for r in got:
        assert r.score == pytest.approx(logit(sum(w.get(c, 0.0) for c in [*plain_features(text[r.doc_id], 2, 2), None])), abs=1e-9)


def test_samples_are_bounded(spark, monkeypatch):
    from marquee.llm import ftrl

    frame = spark.createDataFrame([(i % 3, f"a{i} b{i} c{i}") for i in range(60)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1) for i in range(3)], "id long, mark int")
    assert ftrl.sampled(frame, marks, 7, 1, 0).count() == 7
    monkeypatch.setattr(ftrl, "FEATURES", 10)
    assert ftrl.sampled(frame, marks, 60, 1, 0).agg(F.sum("n")).first()[0] <= 10
    monkeypatch.setattr(ftrl, "FEATURES", 2)
    assert ftrl.sampled(frame, marks, 60, 1, 0).count() == 1


def test_mixing_equals_plain_projected_gradient(spark):
    table = labelled_texts()
    names = ["no", "yes"]
    frame = spark.createDataFrame([(i, t, names[m]) for i, t, m in table], "doc_id long, text string, domain string").repartition(3)
    got = {r.doc_id: r for r in mixing.mixing_rates(frame, frame.select("doc_id", "domain"), {"yes": 0.7, "no": 0.3}).collect()}
    learned = ordered_like_the_sample(spark, table)
    models = [plain_ftrl([(plain_features(r.text, 1, 0), int(names[r.mark] == d)) for r in learned]) for d in names]
    p, t = [], []
    for _, text, _ in table:
        each = np.array([logit(sum(w.get(c, 0.0) for c in [*plain_features(text, 1, 0), None])) for w in models])
        p.append(each / each.sum())
        t.append(len((text or "").split()))
    p, t = np.array(p), np.array(t, float)
    gram = sum(n * np.outer(x, x) for n, x in zip(t, p)) / t.sum()
    inverse = np.linalg.inv(gram + 0.02 * np.trace(gram) / 2 * np.eye(2))
    rate, before = np.ones(len(t)), np.full(2, np.inf)
    for _ in range(30):
        have = (rate * t) @ p / t.sum()
        if min(np.abs(have - [0.3, 0.7]).max(), np.abs(have - before).max()) <= 1e-4:
            break
        before = have
        rate = np.maximum(0, rate - p @ (inverse @ (have - [0.3, 0.7])))
    for k, (i, _, _) in enumerate(table):
        assert (got[i].n_tokens, got[i].p_no, got[i].rate) == (t[k], pytest.approx(p[k][0], abs=1e-9), pytest.approx(rate[k], abs=1e-6))


def test_mixing_says_what_it_misses(spark):
    weighed = spark.createDataFrame([(10, [1.0, 0.0])] * 5, "n_tokens long, p array<double>")
    with pytest.warns(UserWarning, match="miss the targets"):
        fit = mixing.fit_rates(weighed, np.array([0.5, 0.5]))
    assert fit.shares[1] == 0


def test_mixing_copies(spark):
    many = spark.createDataFrame([(None, f"text {k}", "x", 1, 2) for k in range(200)], "doc_id long, text string, __doc string, __s int, __p int")
    labelled = spark.createDataFrame([], "doc_id long, domain string")
    with pytest.warns(UserWarning):
        got = mixing.mix_documents(many, labelled, {"a": 0.9, "b": 0.1})
    assert got.columns == many.columns
    assert {r["count"] for r in mixing.mix_documents(many, labelled, {"a": 0.5, "b": 0.5}).groupBy("text").count().collect()} == {1}


def test_mixing(spark, docs, empty, labels):
    rng = np.random.default_rng(2)
    table = []
    for i in range(900):
        domain = ["a", "b", "c"][(i % 10 > 5) + (i % 10 > 8)]
        text = " ".join([f"{domain}{x}" for x in rng.integers(0, 8, 30)] + [f"w{x}" for x in rng.integers(0, 50, 20)])
        table.append((i, text, domain))
    frame = spark.createDataFrame(table, "doc_id long, text string, domain string")
    targets = {"a": 0.4, "b": 0.4, "c": 0.2}
    got = mixing.mixing_rates(frame, frame.select("doc_id", "domain"), targets).toPandas()
    tokens = got["n_tokens"].to_numpy()
    for d, w in targets.items():
        assert (got[f"p_{d}"] * tokens * got["rate"]).sum() / tokens.sum() == pytest.approx(w, abs=2e-3)
    assert (got["rate"] >= 0).all()
    copies = mixing.mix_documents(frame, frame.select("doc_id", "domain"), targets)
    assert copies.columns == frame.columns
    counted = copies.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].reindex(got["doc_id"], fill_value=0)
    assert (np.abs(counted.to_numpy() - got["rate"].to_numpy()) < 1).all()
    kinds = mixing.label_domains(labels)
    assert mixing.mixing_rates(docs, kinds, mixing.TARGETS).count() == len(rows())
    assert mixing.mixing_rates(empty, kinds, mixing.TARGETS).count() == 0
    assert mixing.mix_documents(docs, kinds.limit(0), mixing.TARGETS).columns == docs.columns


def brute_losses(table, good):
    """Losses of each text by a plain version of the two models."""
    import collections
    import math

    from marquee.llm.features import words

    docs = [(i, words(t)) for i, t in table]
    count = collections.Counter(w for _, ws in docs for w in ws)

    def model(chosen):
        pairs = collections.Counter()
        for ws in chosen:
            pairs.update(zip(["<s>", *ws], ws))
        unigram, seen, kinds = collections.Counter(), collections.Counter(), collections.Counter()
        for (a, b), n in pairs.items():
            unigram[b] += n
            seen[a] += n
            kinds[a] += 1
        total = sum(unigram.values()) + len(count) + 1  # a start and a word never seen
        def loss(a, b):
            u = (unigram[b] + 1) / total
            return -math.log((pairs[a, b] + kinds[a] * u) / (seen[a] + kinds[a]) if seen[a] else u)
        return loss

    target, background = model([ws for i, ws in docs if i in good]), model([ws for _, ws in docs])
    return {i: tuple(sum(m(a, b) for a, b in zip(["<s>", *ws], ws)) / len(ws) for m in (target, background)) if ws else (None, None) for i, ws in docs}


def test_lm_scoring(spark, docs, empty, labels):
    rng = np.random.default_rng(7)
    table = [(i, " ".join(f"{'xy'[i % 2]}{x}" for x in rng.zipf(1.6, 60) % 40)) for i in range(150)] + [(500, None), (501, "...")]
    frame = spark.createDataFrame(table, "doc_id long, text string")
    good = {i for i in range(0, 100, 2)}
    got = {r.doc_id: r for r in lm_scoring.score_documents(frame, spark.createDataFrame([(i,) for i in good] * 2, "doc_id long")).collect()}
    for i, (t, b) in brute_losses(table, good).items():
        assert (got[i].target_loss, got[i].background_loss) == ((None, None) if t is None else (pytest.approx(t, rel=1e-4), pytest.approx(b, rel=1e-4)))
    assert max(got[i].difference for i in range(100, 150, 2)) < min(got[i].difference for i in range(101, 150, 2))
    assert lm_scoring.score_documents(docs, labels.select("doc_id")).count() == len(rows())
    assert lm_scoring.score_documents(empty, labels.select("doc_id")).count() == 0


def test_lm_scoring_knows_all_words(spark, monkeypatch):
    """Documents that differ in rare words only; several chunks."""
    monkeypatch.setattr(lm_scoring, "CHUNK", 700, raising=False)
    common, rare = [f"c{k}" for k in range(2100)], lambda side, k: f"{side}{k % 30}"
    table = [(i, " ".join([*common, *common])) for i in range(2)]
    table += [(10 + i, " ".join(f"{common[(7 * i + k) % 50]} {rare('xy'[i % 2], k)}" for k in range(20))) for i in range(40)]
    good = {10 + i for i in range(0, 20, 2)}
    frame = spark.createDataFrame(table, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in lm_scoring.score_documents(frame, spark.createDataFrame([(i,) for i in good], "doc_id long")).collect()}
    for i, (t, b) in brute_losses(table, good).items():
        assert (got[i].target_loss, got[i].background_loss) == (pytest.approx(t, rel=1e-9), pytest.approx(b, rel=1e-9))
    assert max(got[10 + i].difference for i in range(20, 40, 2)) < min(got[10 + i].difference for i in range(21, 40, 2))


def test_simhash_links_of_a_dense_centre(spark, monkeypatch):
    """Fingerprints around one centre share most leading bits; no group may hold more variants than CROWDED."""
    import sys

    from pyspark import cloudpickle

    from marquee.llm.components import components

    most = 2000
    monkeypatch.setattr(simhash, "CROWDED", most)
    links = simhash._links

    def bounded(width):
        find, sizes = links(width), np.cumsum([len(m) for m in simhash.flips(64 - width, simhash.HALF)])

        def checked(key, table):
            assert sum(int(sizes[2 - n]) for n in table.column("used").to_pylist()) <= most
            return find(key, table)

        return checked

    monkeypatch.setattr(simhash, "_links", bounded)
    rng = np.random.default_rng(6)
    prints = {int(x) for x in rng.integers(-(2**63), 2**63, 10)} | {0x1234567 << 30 ^ 1 << int(a) ^ 1 << int(b) for a, b in rng.integers(0, 20, (150, 2))}
    table = [(p, 10 * k) for k, p in enumerate(sorted(prints))]
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    try:
        label = {r.u: r.v for r in components(simhash.links(spark.createDataFrame(table, "fp long, node long"))).collect()}
        number = dict(table)
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])
    assert {n: number[label.get(p, p)] for p, n in table} == {n: c for n, _, c in brute_components([(n, p % 2**64) for p, n in table])}


def test_html_keeps_what_only_sounds_like_furniture():
    long = "A paragraph with enough words to count as the text of this page."
    body = f"""<h1>Title</h1><p>{long}</p><h2 id='social-impact'>Impact</h2><section id='related-work'><p>Work before.</p></section><p class='notice-period'>One month.</p>
<h2 id='search'>Search</h2><figure><pre>code here</pre><figcaption>A caption</figcaption></figure><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> and <svg><path d=""/></svg>more <object>of it</object>.</p>
<fieldset><label>Kept</label></fieldset><div class='related-theory'>Theory.</div>"""
    want = ["Title", long, "Impact", "Work before.", "One month.", "Search", "code here", "A caption", "Let x=1 and more of it.", "Kept", "Theory."]
    left_out = "<div class='sidebar'>Side</div><div class='comment-list'>A reader.</div><div class='my-related-things'><a href=x>Elsewhere</a></div><div class='x-search'>Find <input></div><div class='ad'>Buy</div>"
    assert html_text.extract(f"<body><article>{body}{left_out}</article></body>") == "\n\n".join(want)


def test_repeated_query_ids_are_one_query_however_dealt(spark):
    """Of a repeated id the least vector asks; the id's other rows are candidates like any."""
    rng = np.random.default_rng(4)
    table = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    table += [(50, rng.normal(size=6).tolist()), (100, table[100][1]), (7, table[50][1])]
    frame = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    got = {n: sorted(map(tuple, nearest.neighbours(frame.repartition(n), F.col("vec_id") % 50 == 0).collect())) for n in (1, 5)}
    assert got[1] == got[5] and len(got[1]) == 6 * nearest.K
    asked = min((np.array(v).tobytes(), v) for i, v in table if i == 50)[1]
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    score = lambda v: float(np.array(asked) @ np.array(v) / (np.linalg.norm(asked) * np.linalg.norm(v)))
    others = [(i, v) for i, v in table]
    others.remove((50, asked))
    want = sorted((-score(v), i) for i, v in others)[: nearest.K]
    assert [r[2] for r in got[1] if r[0] == 50] == [i for _, i in want] and unit(asked).shape == (6,)
    # A second row with a query's id and vector is not its own row.
    assert (100, 1, 100) in [r[:3] for r in got[1]]
