"""Cross-entropy difference of two word n-gram models (Moore and Lewis, 2010).

A target model (documents marked as good) and a background model (all documents)
are bigram models of the same form over one vocabulary: every word of the corpus,
with one entry for a word never seen and one for the start.  Both back off to
their unigrams by Witten-Bell weights.  A document's score is its loss per token
under the target model less that under the background model; lower is more like
the target.

All words and all bigrams are counted, and the tables of both grow with the
corpus, so neither is ever gathered on the driver or in a worker.  Texts are read
once and written in chunks of about CHUNK words, each with its own list of words.

A chunk asks for the corpus's counts of its distinct bigrams: the keys, ascending,
are dealt by their leading bits into ranges, the task that gets a range sums the
counts of all chunks by key, and each chunk gets the sums of its own keys back, in
their order.  One of the chunks that ask for a key counts as the first, so that
each distinct bigram is counted once among the followers of its first word; these
numbers go back by the chunk's own number of that word.  Then the chunk asks for its
words in the same way.  A frequent word or bigram is one key a chunk.  Only the last
step brings a chunk's tokens and its answers together.

Words and bigrams are told apart by hashes of SPARE_BITS bits more than the number
of tokens has, 64 at most, and travel as packed differences.

Defined cases: a null text, or one without a word, has no tokens and null scores;
a row without an id, or without a label, counts for the background only; several
labels of one document count as good if any is; with no good document the target
model is uniform; target documents are scored by the model that has counted them;
repeated rows count each; texts may be of any length (one is never split between
chunks); other columns, whatever their names, are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm import memo
from marquee.llm.features import words
from marquee.llm.scratch import materialize

#: Words and documents after which a chunk is closed.
CHUNK, CHUNK_DOCS = 1_000_000, 50_000
#: Keys that a range should hold, and the least number of leading bits that make ranges.
RANGE, RANGE_BITS = 1_000_000, 8
SPARE_BITS = 24
#: Good documents up to which their ids (8 bytes each) are broadcast; more are joined as Spark chooses.
BROADCAST_IDS = 2_000_000
#: The start's key; no word is empty.
START = np.uint64(xxhash.xxh64_intdigest(b""))

_CHUNK = "chunk long, ids array<long>, lengths binary, good binary, words binary, places binary, counts binary, n long, n_good long"
_ASK = "range int, chunk long, keys binary, sums binary, owners binary"
_ANSWER = "range int, chunk long, sums binary, leads binary, kinds binary, n_first long"
_SCORE = "doc_id long, n_tokens long, target_loss double, background_loss double"

_known: dict[str, int] = memo.table()


def hashed(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words."""
    found = words(text)
    memo.take(_known)
    if len(_known) > 500_000:
        _known.clear()
    for w in set(found).difference(_known):
        _known[w] = xxhash.xxh64_intdigest(w.encode())
    return np.fromiter(map(_known.__getitem__, found), np.uint64, len(found))


def _pack(x: np.ndarray) -> bytes:
    """Compressed plane by plane: the bytes of equal weight stand together."""
    x = np.ascontiguousarray(x).ravel()
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def _unpack(packed: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _batch(schema: str, **columns: list) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [x.split(" ") for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[name], kinds[kind]) for name, kind in fields], names=[name for name, _ in fields])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _sums(number: np.ndarray, marked: np.ndarray, size: int) -> list[np.ndarray]:
    """How often each number occurs in all documents and in the good ones."""
    return [np.bincount(number, minlength=size), np.bincount(number[marked], minlength=size)]


def _before(places: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
    """The number of the word before each word, ``start`` for a text's first."""
    before = np.empty_like(places)
    before[1:] = places[:-1]
    before[(np.cumsum(lengths, dtype=np.int64) - lengths)[lengths > 0]] = start
    return before


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in chunks: ``words`` are a chunk's distinct words, most frequent first, and the start;
    ``places`` their numbers in the text, ``counts`` how often each is a word and precedes one."""
    number = TaskContext.get().partitionId() << 32
    ids, good, texts, size = [], [], [], 0

    def close() -> pa.RecordBatch:
        lengths = np.array([len(x) for x in texts], np.int64)
        known, places, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *texts]), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        places = rank[places.ravel()]
        marks = np.array(good, np.uint8)
        marked = np.repeat(marks, lengths) > 0
        counts = np.stack([*_sums(places, marked, len(known) + 1), *_sums(_before(places, lengths, len(known)), marked, len(known) + 1)])
        return _batch(
            _CHUNK, chunk=[number], ids=[list(ids)], lengths=[_pack(lengths.astype(np.uint32))], good=[_pack(marks)], words=[_pack(np.append(known[order], START))],
            places=[_pack(places.astype(np.uint32))], counts=[_pack(counts.astype(np.uint32))], n=[int(lengths.sum())], n_good=[int(lengths[marks > 0].sum())],
        )

    for batch in batches:
        for i, text, mark in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("good").to_pylist()):
            ids.append(i)
            good.append(mark)
            texts.append(hashed(text.as_py()))
            size += len(texts[-1])
            if size >= CHUNK or len(ids) >= CHUNK_DOCS:
                yield close()
                number += 1
                ids, good, texts, size = [], [], [], 0
    if ids:
        yield close()


class Chunk:
    """A chunk's tokens: ``before`` and ``places`` number the words of each bigram, ``pairs`` are the distinct bigrams' keys, ``at`` their numbers."""

    def __init__(self, row: dict, bits: int):
        self.lengths = _unpack(row["lengths"], np.uint32).astype(np.int64)
        self.good, self.words = _unpack(row["good"], np.uint8), _unpack(row["words"], np.uint64)
        self.places = _unpack(row["places"], np.uint32).astype(np.int64)
        self.before = _before(self.places, self.lengths, len(self.words) - 1)
        self.marked = np.repeat(self.good, self.lengths) > 0
        x = self.words[self.before] * np.uint64(0x9E3779B97F4A7C15) + self.words[self.places]
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        self.pairs, at, self.at = np.unique(x >> np.uint64(64 - bits), return_index=True, return_inverse=True)
        self.leading = self.before[at]


def _ask(chunk: int, keys: np.ndarray, sums: list[np.ndarray], owners: np.ndarray, bits: int, range_bits: int) -> pa.RecordBatch:
    """A row per range that holds some of the ascending ``keys``."""
    ranges = (keys >> np.uint64(bits - range_bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(ranges, prepend=-1)).tolist()
    spans = list(zip(cuts, [*cuts[1:], len(keys)]))
    sums, steps = np.stack(sums).astype(np.uint32), np.diff(keys, prepend=np.uint64(0))
    steps[cuts] = keys[cuts]
    owners = owners.astype(np.uint32)
    return _batch(
        _ASK, range=[int(ranges[a]) for a, _ in spans], chunk=[chunk] * len(spans), keys=[_pack(steps[a:b]) for a, b in spans],
        sums=[_pack(sums[:, a:b]) for a, b in spans], owners=[_pack(owners[a:b]) for a, b in spans],
    )


def _answer(table: pa.Table) -> pa.Table:
    """Sums by key over all chunks' asks of one range, for each ask in the order of its keys, and how many keys it is the first to ask for, by owner."""
    table = table.sort_by("chunk")
    each = [np.cumsum(_unpack(x, np.uint64), dtype=np.uint64) for x in table.column("keys").to_pylist()]
    sizes = [len(x) for x in each]
    keys = np.concatenate(each)
    sums = np.concatenate([_unpack(x, np.uint32).reshape(-1, n) for x, n in zip(table.column("sums").to_pylist(), sizes)], axis=1)
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    begins, group = np.flatnonzero(new), np.cumsum(new) - 1
    total = np.empty(sums.shape, np.int64)
    for i, row in enumerate(sums):
        total[i, order] = np.add.reduceat(row[order].astype(np.int64), begins)[group]
    first = np.empty(len(keys), bool)
    first[order] = new
    out: dict[str, list] = {name: [] for name in ("sums", "leads", "kinds", "n_first")}
    at = 0
    for size, owners in zip(sizes, table.column("owners").to_pylist()):
        span = slice(at, at + size)
        at += size
        mine = first[span]
        leads, back = np.unique(_unpack(owners, np.uint32)[mine], return_inverse=True)
        out["sums"].append(_pack(total[:, span]))
        out["leads"].append(_pack(leads))
        out["kinds"].append(_pack(np.stack(_sums(back, total[1, span][mine] > 0, len(leads))).astype(np.uint32)))
        out["n_first"].append(int(mine.sum()))
    return pa.Table.from_batches([_batch(_ANSWER, range=table.column("range").to_pylist(), chunk=table.column("chunk").to_pylist(), **out)])


def answers(asks: DataFrame) -> DataFrame:
    return asks.groupBy("range").applyInArrow(_answer, _ANSWER)


def _joined(table: pa.Table, kinds: int) -> np.ndarray:
    """The sums that a chunk got, in the order of its keys."""
    sums = [_unpack(x, np.int64).reshape(kinds, -1) for x in table.sort_by("range").column("sums").to_pylist()]
    return np.concatenate([np.zeros((kinds, 0), np.int64), *sums], axis=1)


def _ask_pairs(bits: int, range_bits: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = Chunk(row, bits)
            yield _ask(row["chunk"], c.pairs, _sums(c.at, c.marked, len(c.pairs)), c.leading, bits, range_bits)

    return ask


def _word_order(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a chunk's words, ascending, and for each word its number among them."""
    return np.unique(words >> np.uint64(64 - bits), return_index=True, return_inverse=True)


def _ask_words(bits: int, range_bits: int):
    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        keys, at, number = _word_order(_unpack(row["words"], np.uint64), bits)
        counts = _unpack(row["counts"], np.uint32).reshape(4, -1)
        kinds = np.zeros((2, counts.shape[1]), np.int64)
        for leads, found in zip(right.column("leads").to_pylist(), right.column("kinds").to_pylist()):
            leads = _unpack(leads, np.uint32)
            kinds[:, leads] += _unpack(found, np.uint32).reshape(2, -1)
        sums = [np.bincount(number, weights=x, minlength=len(keys)) for x in (*counts, *kinds)]
        return pa.Table.from_batches([_ask(row["chunk"], keys, sums, at, bits, range_bits)])

    return ask


def _score(tokens: tuple[int, int], size: int, bits: int):
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        c = Chunk(row, bits)
        of_words = np.array(right.column("of_words").to_pylist(), bool)
        pairs = _joined(right.filter(pa.array(~of_words)), 2)
        sums = _joined(right.filter(pa.array(of_words)), 6)[:, _word_order(c.words, bits)[2]]
        starts = (np.cumsum(c.lengths) - c.lengths)[c.lengths > 0]
        found = []
        # Rows of counts: all documents, good ones.
        for i in (1, 0):
            unigram = (sums[i] + 1.0) / (tokens[i] + size - 1)
            seen, kinds = sums[2 + i][c.before], sums[4 + i][c.before]
            back = unigram[c.places]
            # Witten-Bell: as much weight for the unigrams as there were different followers.
            p = np.where(seen > 0, (pairs[i][c.at] + kinds * back) / np.maximum(seen + kinds, 1), back)
            mean = np.full(len(c.lengths), np.nan)
            some = c.lengths > 0
            if len(p):
                mean[some] = np.add.reduceat(-np.log(p), starts) / c.lengths[some]
            found.append(pa.array(mean, pa.float64(), mask=~some))
        return pa.table([pa.array(row["ids"], pa.int64()), pa.array(c.lengths, pa.int64()), *found], names=["doc_id", "n_tokens", "target_loss", "background_loss"])

    return score


def score_documents(docs: DataFrame, good: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and difference per row; ``good`` has the target documents' doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = materialize(good.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("__good")).distinct(), "good")
    if marked.count() <= BROADCAST_IDS:
        marked = F.broadcast(marked)
    joined = rows.join(marked, F.col("doc_id") == F.col("__good"), "left").select("doc_id", "text", F.col("__good").isNotNull().alias("good"))
    chunks = materialize(joined.mapInArrow(_chunks, _CHUNK), "chunks")
    tokens = tuple(x or 0 for x in chunks.agg(F.sum("n"), F.sum("n_good")).first())
    range_bits = max(RANGE_BITS, int(np.ceil(np.log2(max(1, tokens[0]) / RANGE))))
    bits = min(64, max(40, tokens[0].bit_length() + SPARE_BITS))
    content = chunks.select("chunk", "ids", "lengths", "good", "words", "places")
    pairs = materialize(answers(content.mapInArrow(_ask_pairs(bits, range_bits), _ASK)), "pairs")
    listed = chunks.select("chunk", "words", "counts").groupBy("chunk")
    asks = listed.cogroup(pairs.select("chunk", "leads", "kinds").groupBy("chunk")).applyInArrow(_ask_words(bits, range_bits), _ASK)
    found = materialize(answers(asks), "sums")
    # All distinct words, the start, and one never seen.
    size = (found.agg(F.sum("n_first")).first()[0] or 0) + 1
    sums = pairs.select("chunk", "range", "sums", F.lit(False).alias("of_words")).union(found.select("chunk", "range", "sums", F.lit(True)))
    scored = content.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(_score(tokens, size, bits), _SCORE)
    return scored.select("*", (F.col("target_loss") - F.col("background_loss")).alias("difference"))


def query(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.where(F.col("quality") > 0).select("doc_id"))
