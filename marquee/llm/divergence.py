"""Audit of how sources of a language differ, by systolic rotation.

Every (lang, source) group has a smoothed share of each term that its language keeps,
as an integer of SCALE parts.  Two groups differ by the sum of the absolute
differences of their shares; a group's terms are ranked by how far its share lies
above that of the whole language.

Texts are counted once, in dictionaries that are handed on before they grow large.
Kept terms are numbered within shards of about SHARD terms, so a group's shares travel
as one compressed vector a shard: the shares of the terms it has, and one share for
all that it lacks.  The groups of a language are dealt into blocks of about BLOCK.

A block of a shard is resident: its vectors are dealt to a partition once and stay
there.  Every two blocks meet once, in the rounds of a tournament by the circle method;
the vectors of the one with the larger number travel to the other, which evaluates both
directions.  WAVE rounds make a job, so a job shuffles at most WAVE copies of the
vectors, however many rounds there are.  Within its own block a resident also meets the
language's vector, where a heap for each group keeps its TOP terms of the shard.  Sums
over shards and last ranks are aggregates and windows of narrow rows.

Residents are persisted on disk from written tables; a lost executor's are dealt again.

Defined cases: null text, lang and source are empty strings; a group without terms, or
of a language that keeps none, has empty counts and still meets all groups of its
language; ids are not read, so null, equal or repeated ids make no difference and every
row counts; ties go to the smaller item by UTF-8 bytes; texts of any length are taken
whole; other columns, whatever their names, are not read; an empty table gives an empty
result.  All arithmetic is exact in 64-bit integers while a language holds fewer than
9e15 occurrences of kept terms.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.scratch import materialize

MIN_DOCS = 30
PRIOR = 5
SCALE = 1_000_000_000
TOP = 50
#: Terms of a shard, groups of a block, rounds of a job.
SHARD, BLOCK, WAVE = 16_384, 16, 8
#: Entries after which a task hands its counts on, and rows of a batch of them.
ENTRIES, ROWS = 200_000, 20_000

#: Bytes of letters, lower-cased, and of code points beyond ASCII stay; all others separate terms.
_TERMS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_COUNTS = "lang string, term string, docs long, sources array<string>, n array<long>"
_VECTOR = "lang string, source string, shard int, block int, places binary, shares binary, base long, size int"
_PAIR = "lang string, source string, item string, value long"
_TERM = "lang string, source string, shard int, place int, value long"


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def _handed_on(tables: dict[tuple, dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
    """One row a language and term, with the documents of all sources and the occurrences by source."""
    for lang in dict.fromkeys(lang for lang, _ in tables):
        names = [source for x, source in tables if x == lang]
        mine = [tables[lang, source] for source in names]
        coded = pa.chunked_array([pa.array(list(table), pa.binary()) for table in mine], pa.binary()).combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy()
        both = np.concatenate([np.fromiter(table.values(), np.int64, len(table)) for table in mine])
        owner = np.repeat(np.arange(len(names), dtype=np.int32), [len(table) for table in mine])
        order = np.argsort(code, kind="stable")
        ends = np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))
        docs = np.add.reduceat((both & 0xFFFFFFFF)[order], np.r_[0, ends[:-1]]) if len(code) else both
        terms_, sources, n = coded.dictionary.cast(pa.string()), pa.array(names, pa.string()), both[order] >> 32
        for k in range(0, len(ends), ROWS):
            last = ends[k : k + ROWS]
            at = pa.array(np.r_[0 if k == 0 else ends[k - 1], last].astype(np.int32))
            part = slice(at[0].as_py(), at[len(at) - 1].as_py())
            offsets = pa.array((at.to_numpy() - part.start).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (sources.take(pa.array(owner[order[part]])), pa.array(n[part]))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(last), pa.string()), terms_.slice(k, len(last)), pa.array(docs[k : k + ROWS]), *lists], names=["lang", "term", "docs", "sources", "n"]
            )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of terms by group; a number holds both, documents in its lower 32 bits."""
    tables: dict[tuple, dict[bytes, int]] = {}
    size = 0
    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for lang, source, text in zip(langs, sources, batch.column("text").cast(pa.binary())):
            found = Counter(terms(text.as_py()))
            if not found:
                continue
            table = tables.setdefault((lang, source), {})
            before, get = len(table), table.get
            for term, n in found.items():
                table[term] = get(term, 0) + (n << 32) + 1
            size += len(table) - before
            if size > ENTRIES:
                yield from _handed_on(tables)
                tables, size = {}, 0
    yield from _handed_on(tables)


def counts(docs: DataFrame) -> DataFrame:
    """Parts of the counts, to be summed: per language and term its documents, and its occurrences by source."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]).mapInArrow(_counted, _COUNTS)


def groups(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()


def _parts(n: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / size)).cast("int")


def kept_terms(counted: DataFrame, grouped: DataFrame, min_docs: int, shard: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The terms each language keeps, with shard and place; and per language its terms, shards and blocks."""
    kept = materialize(counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term"), "kept")
    sizes = grouped.groupBy("lang").agg(F.count(F.lit(1)).alias("groups")).join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms")), "lang", "left")
    terms_ = F.coalesce("terms", F.lit(0))
    langs = materialize(sizes.select("lang", terms_.alias("terms"), _parts(terms_, shard).alias("shards"), _parts(F.col("groups"), block).alias("blocks")), "langs")
    dealt = kept.join(langs.select("lang", "shards"), "lang").select("lang", "term", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"))
    place = F.row_number().over(Window.partitionBy("lang", "shard").orderBy("term")) - 1
    return materialize(dealt.select("lang", "shard", place.alias("place"), "term"), "terms"), langs


def shares(n: np.ndarray, total: int, size: int) -> np.ndarray:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * size)) by long division, three decimal digits at a time."""
    rest, found, divisor = n.astype(np.int64) + PRIOR, np.zeros(len(n), np.int64), np.int64(total + PRIOR * size)
    for _ in range(3):
        rest = rest * 1000
        found = found * 1000 + rest // divisor
        rest %= divisor
    return found + 1


def _packed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A group's vector of one shard: its places as differences, its shares, and the share of all other places."""
    place, n = table.column("place").to_numpy(), table.column("n").to_numpy()
    total, size, width = (table.column(c)[0].as_py() for c in ("total", "terms", "width"))
    has = place >= 0
    order = np.argsort(place[has], kind="stable")
    at, found = place[has][order].astype("<i4"), n[has][order]
    press = zstandard.ZstdCompressor(level=1).compress
    base = int(shares(np.zeros(1, np.int64), total, size)[0]) if size else 0
    values = shares(found, total, size).astype("<u4") if len(at) else np.empty(0, "<u4")
    row = {
        "lang": key[0].as_py(), "source": key[1].as_py(), "shard": key[2].as_py(), "block": table.column("block")[0].as_py(),
        "places": press(np.diff(at, prepend=np.int32(0)).astype("<i4").tobytes()), "shares": press(values.tobytes()), "base": base, "size": width,
    }
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int32()]
    return pa.table({k: pa.array([v], kind) for (k, v), kind in zip(row.items(), kinds)})


def vectors(counted: DataFrame, grouped: DataFrame, vocabulary: DataFrame, langs: DataFrame) -> DataFrame:
    """One row a group and shard; a null source is the language itself, in each of its blocks."""
    each = counted.join(vocabulary, ["lang", "term"]).select("lang", "shard", "place", F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("n").alias("n"))))
    placed = materialize(each.groupBy("lang", "source", "shard", "place").agg(F.sum("n").alias("n")), "placed")
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block")
    each = grouped.join(placed.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang")
    each = each.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "terms", "shards", block)
    whole = langs.join(placed.groupBy("lang").agg(F.sum("n").alias("total")), "lang", "left").select(
        "lang", F.lit(None).cast("string").alias("source"), F.coalesce("total", F.lit(0)).alias("total"), "terms", "shards", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    )
    stats = materialize(each.union(whole), "groups")
    widths = vocabulary.groupBy("lang", "shard").agg(F.count(F.lit(1)).cast("int").alias("width"))
    # A row without a place stands for each shard, so that shards in which a group has no terms are there too.
    frame = stats.select("*", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")).join(widths, ["lang", "shard"], "left")
    frame = frame.select("lang", "source", "shard", "block", "total", "terms", F.coalesce("width", F.lit(0)).alias("width"), F.lit(-1).alias("place"), F.lit(0).cast("long").alias("n"))
    own = placed.join(stats.where(F.col("source").isNotNull()).drop("shards"), ["lang", "source"])
    sums = placed.groupBy("lang", "shard", "place").agg(F.sum("n").alias("n")).join(stats.where(F.col("source").isNull()).drop("shards"), "lang")
    full = [x.select("lang", "source", "shard", "block", "total", "terms", F.lit(0).alias("width"), "place", "n") for x in (own, sums)]
    rows = frame.union(full[0]).union(full[1])
    most = F.max("width").over(Window.partitionBy("lang", "source", "shard", "block"))
    return rows.select("lang", "source", "shard", "block", "total", "terms", most.alias("width"), "place", "n").groupBy("lang", "source", "shard", "block").applyInArrow(_packed, _VECTOR)


def _unpacked(table: pa.Table) -> tuple[list[str | None], np.ndarray, list[np.ndarray]]:
    """Sources, dense shares, and the places each source has."""
    sources = table.column("source").to_pylist()
    size = table.column("size")[0].as_py() if len(sources) else 0
    dense, have = np.empty((len(sources), size), np.int64), []
    for k in range(len(sources)):
        cell = lambda c: zstandard.decompress(table.column(c)[k].as_py())  # noqa: B023, E731
        at = np.cumsum(np.frombuffer(cell("places"), "<i4"))
        dense[k] = table.column("base")[k].as_py()
        dense[k, at] = np.frombuffer(cell("shares"), "<u4")
        have.append(at)
    return sources, dense, have


def _differences(lang: str, one: tuple, other: tuple, within: bool) -> pa.Table:
    """Both directions of every meeting of two groups."""
    source, item, value = [], [], []
    for i, a in enumerate(one[0]):
        rest = range(i + 1, len(one[0])) if within else range(len(other[0]))
        far = np.abs(other[1][rest.start : rest.stop] - one[1][i]).sum(axis=1).tolist() if len(rest) else []
        for j, f in zip(rest, far):
            b = other[0][j]
            source += [a, b]
            item += [b, a]
            value += [f, f]
    return pa.table({"lang": pa.array([lang] * len(source), pa.string()), "source": pa.array(source, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})


def _at_home(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Meetings within a block."""
    mine = _unpacked(table.filter(pc.is_valid(table.column("source"))))
    return _differences(key[0].as_py(), mine, mine, True)


def _visited(key: tuple[pa.Scalar, ...], residents: pa.Table, visitors: pa.Table) -> pa.Table:
    """Meetings of a resident block with the blocks that visit it."""
    return _differences(key[0].as_py(), _unpacked(residents), _unpacked(visitors), False)


def _ranked(top: int):
    def rank(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Of each group the terms of this shard whose shares lie highest above the language's; places follow the terms' order."""
        sources, dense, have = _unpacked(table)
        whole = dense[sources.index(None)]
        source, place, value = [], [], []
        for k, name in enumerate(sources):
            if name is None:
                continue
            above = dense[k, have[k]] - whole[have[k]]
            up = above > 0
            best = heapq.nsmallest(top, zip((-above[up]).tolist(), have[k][up].tolist()))
            source += [name] * len(best)
            value += [-f for f, _ in best]
            place += [p for _, p in best]
        n = len(source)
        return pa.table({"lang": pa.array([key[0].as_py()] * n, pa.string()), "source": pa.array(source, pa.string()), "shard": pa.array([key[1].as_py()] * n, pa.int32()), "place": pa.array(place, pa.int32()), "value": pa.array(value, pa.int64())})

    return rank


def opponent(block: Column, blocks: Column, turn: Column) -> Column:
    """The block met in a round of a tournament by the circle method; a number that no block has is a bye."""
    ring = blocks + blocks % 2 - 1
    other = F.pmod(turn - block, ring)
    # Twice the one that meets the fixed last block is the round, modulo the odd ring.
    half = F.pmod(turn * ((ring + 1) / 2).cast("int"), ring)
    return F.when(block == ring, half).when(other == block, ring).otherwise(other)


def pair_values(residents: DataFrame, langs: DataFrame, rounds: int, wave: int) -> DataFrame:
    """lang, source, item and their difference, both ways, from the meetings at home and of all rounds."""
    mine = residents.groupBy("lang", "shard", "block")
    found = materialize(mine.applyInArrow(_at_home, _PAIR).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pairs")
    groups_only = residents.where(F.col("source").isNotNull())
    for start in range(0, rounds, wave):
        last = F.least(F.lit(start + wave), F.col("blocks") + F.col("blocks") % 2 - 1) - 1
        travelling = groups_only.join(langs.where(F.col("blocks") + F.col("blocks") % 2 - 1 > start).select("lang", "blocks"), "lang")
        travelling = travelling.select("*", F.explode(F.sequence(F.lit(start), last)).alias("turn"))
        home = opponent(F.col("block"), F.col("blocks"), F.col("turn"))
        travelling = travelling.select("lang", "source", "shard", F.col("block").alias("from"), home.alias("block"), "places", "shares", "base", "size").where(F.col("block") < F.col("from"))
        visitors = travelling.select(*[F.col(c).alias(f"{c}_" if c in ("lang", "shard", "block") else c) for c in travelling.columns])
        met = groups_only.groupBy("lang", "shard", "block").cogroup(visitors.groupBy("lang_", "shard_", "block_")).applyInArrow(_visited, _PAIR)
        found = found.union(materialize(met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pairs"))
    return found


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, shard: int = SHARD, block: int = BLOCK, wave: int = WAVE) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` rows for every other source of the language, ``term`` rows for the ``top`` terms."""
    spark = docs.sparkSession
    counted, grouped = materialize(counts(docs), "counts"), materialize(groups(docs), "sources")
    vocabulary, langs = kept_terms(counted, grouped, min_docs, shard, block)
    dealt = vectors(counted, grouped, vocabulary, langs).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "lang", "shard", "block")
    residents = dealt.persist(StorageLevel.DISK_ONLY)
    most = langs.agg(F.max("blocks")).first()[0] or 0
    pairs = pair_values(residents, langs, most + most % 2 - 1 if most > 1 else 0, wave)
    best = materialize(residents.groupBy("lang", "shard", "block").applyInArrow(_ranked(top), _TERM), "best")
    residents.unpersist()
    named = best.join(vocabulary, ["lang", "shard", "place"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = named.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top)
    # The rows of a pair have all its shards: a block pair meets in one round.
    paired = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return paired.select("*", F.row_number().over(order).alias("rank")).union(ranked)


def query(spark, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT row) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
t AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::BIGINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {PRIOR})) // (t.total + {PRIOR} * v.v) AS p
      FROM t JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
l AS (SELECT p.lang, p.term, 1 + ({SCALE}::HUGEINT * (sum(n) + {PRIOR})) // (any_value(total) + {PRIOR} * any_value(v.v)) AS q
      FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS total FROM t GROUP BY lang) USING (lang) GROUP BY ALL),
f AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(a.p - b.p)), 0)::BIGINT AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
tops AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - l.q)::BIGINT AS value FROM p JOIN l USING (lang, term) WHERE p.n > 0 AND p.p > l.q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM tops) QUALIFY part = 'pair' OR rank <= {TOP}
"""
