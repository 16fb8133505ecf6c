"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle).

Every learned language has a profile: its most frequent character n-grams in
order of frequency.  A document gets the same kind of profile and the language
whose profile is nearest by out-of-place distance: the sum of rank differences,
with a fixed penalty for n-grams that a profile lacks.

Learning counts n-grams of all learnable texts inside tasks and sums the counts
by (language, n-gram), so what is shuffled is bounded by the number of distinct
n-grams.  The driver gets PROFILE rows per language and sends them to the tasks: the
model, whose size follows the number of languages and not that of documents.

Combining marks belong to words, as in Devanagari, Thai or vocalised Arabic.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
so is every text if nothing could be learned.  Ties go to the n-gram of smaller
code, and to the language first in alphabetical order.  Rows with a null
``doc_id`` are predicted, count as not held out, and are not learned from.
Repeated rows are predicted each; very long texts are counted whole; columns of
other names are carried by ``keep_documents`` only and never clash; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDERS = (1, 2, 3)
PROFILE = 300
UNDETERMINED = "und"
#: Characters that one counting step concatenates, which bounds memory.
BLOCK = 1_000_000
#: Distinct n-grams a task keeps before it hands its counts on.
KEPT = 2_000_000

def _marks() -> str:
    """The combining marks, as a part of a regular expression's set."""
    found = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "M"]
    ends = [k for k in range(len(found)) if k + 1 == len(found) or found[k + 1] != found[k] + 1]
    starts = [0, *(k + 1 for k in ends[:-1])]
    return "".join(f"{chr(found[a])}-{chr(found[b])}" for a, b in zip(starts, ends))


_NON_LETTERS = re.compile(r"[\W\d_]+")
#: Used for texts beyond Latin-1, which has no marks.
_NOT_OF_WORDS = re.compile(rf"(?:(?![{_marks()}])[\W\d_])+")


def letters(text: str | None) -> str:
    """Lower-case letters; each run of anything else is one space, also at both ends."""
    text = (text or "").lower()
    plain = not text or max(text) <= "\u02ff"
    inner = (_NON_LETTERS if plain else _NOT_OF_WORDS).sub(" ", text).strip()
    return f" {inner} " if any(map(str.isalpha, inner)) else ""


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of a ``letters`` string; a space may only begin or end one."""
    c = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    space = c == 32
    found = []
    for n in ORDERS:
        if len(c) < n:
            continue
        m = len(c) - n + 1
        code = c[:m].copy()
        bad = space[:m] if n == 1 else space[:m] & space[1 : m + 1]
        for k in range(1, n):
            code = (code << 21) | c[k : k + m]
            if k < n - 1:
                bad = bad | space[k : k + m]
        found.append(code[~bad])
    return np.concatenate(found) if found else np.empty(0, np.int64)


def ranked(text: str, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams of a ``letters`` string, most frequent first."""
    code, n = np.unique(grams(text), return_counts=True)
    if len(code) > size:
        least = np.partition(n, len(n) - size)[len(n) - size]
        keep = n >= least
        code, n = code[keep], n[keep]
    return code[np.lexsort((code, -n))][:size]


def _add(into: dict[str, list], lang: str, code: np.ndarray, n: np.ndarray) -> None:
    if lang in into:
        code, back = np.unique(np.concatenate([into[lang][0], code]), return_inverse=True)
        n = np.bincount(back, weights=np.concatenate([into[lang][1], n])).astype(np.int64)
    into[lang] = [code, n]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, (code, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        texts: dict[str, list[str]] = {}
        size: dict[str, int] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            texts.setdefault(lang, []).append(letters(text))
            size[lang] = size.get(lang, 0) + len(text)
            if size[lang] > BLOCK:
                _add(held, lang, *np.unique(grams(" ".join(texts.pop(lang))), return_counts=True))
                size.pop(lang)
        for lang, found in texts.items():
            _add(held, lang, *np.unique(grams(" ".join(found)), return_counts=True))
        if sum(len(code) for code, _ in held.values()) > KEPT:
            yield from flush()
    yield from flush()


def learn(docs: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """Profiles of the languages in ``lang``, from the rows of ``docs`` with text and lang."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for lang, code, _ in sorted(top.select("lang", "gram", "rank").collect(), key=lambda r: (r[0], r[2])):
        profiles.setdefault(lang, []).append(code)
    return profiles


class Profiles:
    """Ranks of all n-grams of all profiles, looked up together."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.size, self.langs = size, sorted(profiles)
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int32)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def distances(self, document: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.codes, document)
        at[at == len(self.codes)] = 0
        at = np.where(self.codes[at] == document, at, len(self.codes))
        found = self.ranks[at]
        apart = np.abs(found - np.arange(len(document))[:, None])
        return np.where(found < 0, self.size, apart).sum(axis=0)

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin.  The score is one minus the distance as a part of the largest possible."""
        document = ranked(letters(text), self.size)
        if not len(document) or not self.langs:
            return UNDETERMINED, 0.0, 0.0
        d = self.distances(document)
        best = int(d.argmin())
        most = self.size * len(document)
        rest = np.delete(d, best).min() if len(d) > 1 else most
        return self.langs[best], float(1 - d[best] / most), float((rest - d[best]) / most)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def predicted(profiles: dict[str, list[int]], text: Column) -> Column:
    """A struct of lang_pred, score and margin."""
    model = Profiles(profiles)

    @F.pandas_udf("lang_pred string, score double, margin double")
    def predict(texts):
        import pandas as pd

        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "margin"])

    return predict(text)


def identify(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """doc_id, held_out, lang_pred, score and margin of every row."""
    found = docs.select("doc_id", predicted(profiles, F.col("text")).alias("found"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "found.*")


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, learn(learnable(docs)))


#: Documents nearer to no language than this are noise; running text of any learned language scores well above it.
MIN_SCORE = 0.05


def keep_documents(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents whose language can be told, with all their columns."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = docs.select(whole.alias("doc"), predicted(learn(learnable(docs)), F.col("text")).alias("found"))
    return found.where((F.col("found.lang_pred") != UNDETERMINED) & (F.col("found.score") >= min_score)).select("doc.*")
