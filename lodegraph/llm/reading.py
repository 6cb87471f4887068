"""Reading level of English texts from the grades at which words are acquired.

1. A word's distribution over the levels is its share of the labelled documents
   of each level (so that a frequent level doesn't count more).  Its acquisition
   grade is the mean of that distribution; a word is *known* when enough labelled
   documents have it and its distribution is narrow.
2. A document's statistic is a quantile of the grades of its known words, each
   occurrence counted.  For the labelled documents the document itself is taken
   out of the grades of its words.
3. For each quantile on a grid the cuts between the levels are fitted to the
   labelled documents (fewest errors, by dynamic programming); the quantile of
   the fewest errors is used, among equals the one with the widest gap at its
   cuts.

Which texts are English is learned as well, from the documents whose language is
given (:func:`train_language`).

Bounds (documented parameters): ``max_labelled`` labelled documents are used for
fitting, taken by a hash of their id if there are more.  A known word is in at
least ``min_documents`` of them, so that there are at most max_labelled x (mean
distinct words of a document) / min_documents known words, whatever the size of
the corpus; those, and max_labelled rows of quantiles, are all that reaches the
driver or is broadcast.  Levels are given to all documents.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.runtime import Scratch, task_count

GRID = (0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75)
_STRIP = "".join(chr(c) for c in range(0x2100) if unicodedata.category(chr(c))[0] in "PSZC")
_MEMO = 200_000


class Words:
    """Reads the words of texts; the form of a raw token is remembered, up to a bound."""

    def __init__(self):
        self.memo: dict[str, str] = {}

    def of(self, text: str) -> list[str]:
        """The words of a text in lower case, without outer punctuation; numbers are '' ."""
        memo, out = self.memo, []
        for raw in text.lower().split():
            w = memo.get(raw)
            if w is None:
                w = raw.strip(_STRIP)
                w = w if w and w[0].isalpha() else ""
                if len(memo) >= _MEMO:
                    memo.clear()
                memo[raw] = w
            out.append(w)
        return out


class Tongue(NamedTuple):
    """Log-odds of English against other languages of the words that tell them apart."""

    weight: dict[str, float]
    prior: float

    def is_english(self, words: list[str]) -> bool:
        """Naive Bayes over the distinct words of a text; a text without a telling word goes by the prior."""
        return self.prior + sum(self.weight.get(w, 0.0) for w in set(words)) > 0


def train_language(
    documents: DataFrame, item: str, text: str, lang: str, max_labelled: int = 20_000, least_share: float = 0.02, min_words: int = 20
) -> Tongue:
    """Learn what English is from documents whose language column says so in some spelling (`en`, `EN`, `en-XX`, `English`).

    About max_labelled labelled documents are used, by a hash of their id, of
    those with at least min_words words.  Telling words are those in least_share
    of the documents of either side, so that there are at most 2 x (mean distinct
    words of a document) / least_share of them.  Documents without a language are
    left out; if one side has none, every text goes by the prior: without labels
    all are taken as English.
    """
    spark = documents.sparkSession
    labelled = documents.select(F.col(item).alias("item"), F.lower(F.trim(lang)).alias("lang"), F.col(text).alias("text"))
    labelled = labelled.filter("item is not null and lang <> '' and text is not null")
    n = labelled.select("item").count()
    share = min(1.0, max_labelled / max(n, 1))
    labelled = labelled.filter(F.pmod(F.xxhash64("item"), F.lit(1 << 30)) < int(share * (1 << 30)))
    labelled = labelled.select(F.col("lang").rlike("^en([^a-z]|g|$)").cast("int").alias("english"), "text")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = Words(), Counter()
        for b in batches:
            for english, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = words.of(t)
                if len(found) >= min_words:
                    counts.update((w, english) for w in {"", *found})
        if counts:
            keys, many = zip(*counts.items(), strict=True)
            w, e = zip(*keys, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(e, pa.int32()), pa.array(many, pa.int64())], names=["word", "english", "n"])

    counted = labelled.mapInArrow(count_words, "word string, english int, n long").groupBy("word").agg(
        F.sum(F.col("n") * F.col("english")).alias("yes"), F.sum(F.col("n") * (1 - F.col("english"))).alias("no")
    )
    counted = Scratch(spark, "language").save(counted)
    yes, no = next(iter(counted.filter("word = ''").select("yes", "no").collect()), (0, 0))
    if not yes or not no:
        return Tongue({}, 1.0 if yes or not no else -1.0)
    rows = counted.filter((F.col("word") != "") & ((F.col("yes") >= yes * least_share) | (F.col("no") >= no * least_share))).collect()
    return Tongue({r.word: float(np.log((r.yes + 0.5) / (yes + 1)) - np.log((r.no + 0.5) / (no + 1))) for r in rows}, float(np.log(yes / no)))


class Grades(NamedTuple):
    """Known words and the labelled documents of each level that have them."""

    place: dict[str, int]
    counts: np.ndarray  # words x levels
    documents: np.ndarray  # labelled documents of each level

    def grades(self, places: np.ndarray, without: int | None = None) -> np.ndarray:
        """Acquisition grades of words; without: a level of which one document is taken out."""
        counts, documents = self.counts[places], self.documents
        if without is not None:
            counts, documents = counts.copy(), documents.copy()
            counts[:, without - 1] -= 1
            documents[without - 1] -= 1
        share = counts / np.maximum(documents, 1)
        total = share.sum(axis=1)
        levels = np.arange(1, share.shape[1] + 1)
        return np.where(total > 0, share @ levels / np.where(total > 0, total, 1), np.nan)

    def spread(self) -> np.ndarray:
        share = self.counts / np.maximum(self.documents, 1)
        share = share / share.sum(axis=1, keepdims=True)
        levels = np.arange(1, share.shape[1] + 1)
        mean = share @ levels
        return np.sqrt(np.maximum(share @ levels**2 - mean**2, 0))


def quantiles(grades: np.ndarray, at) -> np.ndarray:
    return np.quantile(grades, at) if len(grades) else np.full(np.shape(at), np.nan)


def fit_cuts(x: np.ndarray, y: np.ndarray, levels: int) -> tuple[int, float, list[float]]:
    """(errors, narrowest gap at a cut, cuts) of the best ordered cuts of x into the levels y."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    n = len(x)
    wrong = np.vstack([np.concatenate([[0], np.cumsum(y != level)]) for level in range(1, levels + 1)])
    # a cut may only lie between different values
    inside = np.concatenate([[False], x[1:] == x[:-1], [False]])
    best, back = wrong[0].astype(float), []
    for level in range(1, levels):
        ahead = np.where(inside, np.inf, best - wrong[level])
        at = np.zeros(n + 1, int)
        for j in range(1, n + 1):
            at[j] = j if ahead[j] < ahead[at[j - 1]] else at[j - 1]
        back.append(at)
        best = ahead[at] + wrong[level]
    errors, j, cuts, gaps = int(best[n]), n, [], []
    for at in reversed(back):
        j = at[j]
        low, high = x[j - 1] if j else x[0] - 1, x[j] if j < n else x[-1] + 1
        cuts.append(-np.inf if j == 0 else np.inf if j == n else (low + high) / 2)
        if 0 < j < n:
            gaps.append(high - low)
    return errors, min(gaps, default=0.0), cuts[::-1]


class Model(NamedTuple):
    grades: Grades
    word_grade: dict[str, float]
    quantile: float
    cuts: list[float]
    usual: int  # the level of a text without known words
    errors: int  # of the labelled documents, each left out of its words' grades
    labelled: int
    tongue: Tongue = Tongue({}, 1.0)


def train(
    documents: DataFrame,
    labels: DataFrame,
    item: str,
    text: str,
    level: str,
    lang: str | None = None,
    levels: int = 5,
    max_labelled: int = 20_000,
    min_documents: int = 3,
    max_spread: float = 0.8,
) -> Model:
    """Fit the word grades and the cuts, and the language model if there is a column lang.

    An item labelled several times has the lower median of its levels.  Without a
    language model every text is taken as English.
    """
    spark = documents.sparkSession
    tongue = train_language(documents, item, text, lang, max_labelled) if lang else Tongue({}, 1.0)
    scratch = Scratch(spark, "reading")
    rated = labels.select(F.col(item).alias("item"), F.col(level).cast("int").alias("level")).filter(F.col("level").between(1, levels) & F.col("item").isNotNull())
    rated = rated.groupBy("item").agg(F.floor(F.percentile("level", 0.5)).cast("int").alias("level"))
    rated = scratch.save(rated.orderBy(F.xxhash64("item"), "item").limit(max_labelled))
    texts = documents.select(F.col(item).alias("item"), F.col(text).alias("text")).join(F.broadcast(rated), "item").dropDuplicates(["item"])
    texts = scratch.save(texts.filter("text is not null").select("text", "level"))
    texts = texts.repartition(task_count(spark, max_labelled, max_labelled))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = Words(), Counter()
        for b in batches:
            for t, lv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts.update((w, lv) for w in {"", *words.of(t)})
        rows = [(w, lv, n) for (w, lv), n in counts.items()]
        if rows:
            w, lv, n = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(lv, pa.int32()), pa.array(n, pa.int64())], names=["word", "level", "n"])

    counted = texts.mapInArrow(count_words, "word string, level int, n long").groupBy("word").pivot("level", list(range(1, levels + 1))).sum("n").na.fill(0)
    total = sum((F.col(str(lv)) for lv in range(1, levels + 1)), F.lit(0))
    seen = counted.filter((total >= min_documents) | (F.col("word") == ""))
    rows = sorted(seen.collect(), key=lambda r: r.word)  # bounded by max_labelled, see above
    whole = next((r for r in rows if r.word == ""), None)
    rows = [r for r in rows if r.word]
    counts = np.array([list(r)[1:] for r in rows], float).reshape(-1, levels)
    grades = Grades({r.word: i for i, r in enumerate(rows)}, counts, np.array(list(whole)[1:] if whole else [0] * levels, float))
    keep = np.flatnonzero(grades.spread() <= max_spread) if rows else np.array([], int)
    grades = Grades({rows[i].word: k for k, i in enumerate(keep)}, grades.counts[keep], grades.documents)
    shared = spark.sparkContext.broadcast(grades)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = Words(), shared.value
        for b in batches:
            out = []
            for t, lv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                places = np.array([p for w in words.of(t) if (p := known.place.get(w)) is not None], int)
                own = known.grades(places, lv) if len(places) else np.array([])
                out.append(quantiles(own[~np.isnan(own)], GRID).tolist())
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out, pa.list_(pa.float64()))], names=["level", "q"])

    stats = texts.mapInArrow(rate, "level int, q array<double>").collect()  # at most max_labelled rows
    y = np.array([r.level for r in stats], int)
    x = np.array([r.q for r in stats], float).reshape(-1, len(GRID))
    known = ~np.isnan(x).any(axis=1)
    usual = int(np.median(y)) if len(y) else (levels + 1) // 2
    if not known.any():
        return Model(grades, {}, 0.5, [], usual, 0, 0, tongue)
    fits = [fit_cuts(x[known, i], y[known], levels) for i in range(len(GRID))]
    i = min(range(len(GRID)), key=lambda i: (fits[i][0], -fits[i][1]))
    own = grades.grades(np.arange(len(grades.place)))
    return Model(grades, {w: float(own[p]) for w, p in grades.place.items()}, GRID[i], fits[i][2], usual, fits[i][0], int(known.sum()), tongue)


def reading_levels(documents: DataFrame, item: str, text: str, model: Model, min_words: int = 40) -> DataFrame:
    """(item, reading_level, word_quantile, known_words) of every document with an English text of at least min_words words.

    A word is a run without white space.  Null, short and foreign texts give no
    row; a text without known words gets the usual level; an item sent again
    counts once.
    """
    spark = documents.sparkSession
    kind = dict(documents.dtypes)[item]
    shared = spark.sparkContext.broadcast((model.word_grade, model.quantile, model.cuts, model.usual, model.tongue))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        grade, q, cuts, usual, tongue = shared.value
        for b in batches:
            keep, level, value, n_known = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                found = words.of(t)
                if len(found) < min_words or not tongue.is_english(found):
                    continue
                known = [g for w in found if (g := grade.get(w)) is not None]
                keep.append(i)
                n_known.append(len(known))
                x = float(np.quantile(known, q)) if known else None
                value.append(x)
                level.append(usual if x is None or not cuts else 1 + sum(x > c for c in cuts))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep, pa.int64())), pa.array(level, pa.int64()), pa.array(value, pa.float64()), pa.array(n_known, pa.int64())],
                names=["item", "reading_level", "word_quantile", "known_words"],
            )

    rows = documents.select(F.col(item).alias("item"), F.col(text).alias("text")).filter("text is not null and item is not null")
    rated = rows.mapInArrow(rate, f"item {kind}, reading_level long, word_quantile double, known_words long")
    return rated.dropDuplicates(["item"]).withColumnRenamed("item", item)
