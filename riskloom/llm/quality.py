"""Quality rules with suffix-array repetition.

The words of a text are sorted as suffixes by prefix doubling. Neighbours in that order
share a longest common prefix; the deepest LCP interval that holds suffix ``i`` has the
greater of its two neighbouring prefixes as its length, so it is the longest substring
starting there that occurs twice, and every maximal repeated substring is one of these.
Substrings of ``min_repeat`` words or more mark the words they cover; a text is rejected
when the union covers too large a part of it or the longest one is too large a part.

Many texts are sorted in one array: the text's number is the first part of each sort key,
so texts never mix, and the arrays stay within ``GROUP_WORDS`` words or one text.

Defined cases: a null, empty or blank text has no words and fails the base rules;
repeated rows are measured each; an empty table gives an empty table; other columns
of the input pass through untouched, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import only, slices, table

#: A word, and the characters that count as symbols (fixed values).
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
#: Base rules: least words, and most percent of words in repeated windows of three.
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 50, 50, 3
#: Repeats of this many words count; most covered fraction of the words; most of them in one repeat.
MIN_REPEAT, MOST_COVERED, MOST_IN_ONE = 10, 0.3, 0.25
#: Words sorted in one array, unless one text alone has more.
GROUP_WORDS = 120_000

MEASURES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")]
)


def longest_repeats(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest substring from there that also starts elsewhere in its text.

    ``words`` numbers the words of several texts one after the other, ``text`` numbers the text of each.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    # A suffix's rank is the place of the first suffix that its first k words do not tell it from.
    key = text.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    ranks = [_ranked(key[order], order, np.zeros(n, np.int64))]
    steps, k = [1], 1
    while len(open_ := _shared(ranks[-1])):
        rank = ranks[-1]
        ahead = np.minimum(open_ + k, n - 1)
        there = (open_ + k < n) & (text[ahead] == text[open_])
        key = rank[open_] * (n + 1) + np.where(there, rank[ahead] + 1, 0)
        order = np.argsort(key, kind="stable")
        ranks.append(_ranked(key[order], open_[order], rank))
        k *= 2
        steps.append(k)
    suffix = np.empty(n, np.int64)
    suffix[ranks[-1]] = np.arange(n)
    common = np.zeros(n - 1, np.int64)
    first, second = suffix[:-1], suffix[1:]
    for rank, k in zip(reversed(ranks), reversed(steps)):
        a, b = np.minimum(first + common, n - 1), np.minimum(second + common, n - 1)
        inside = (first + common < n) & (second + common < n) & (text[a] == text[first]) & (text[b] == text[second])
        common += np.where(inside & (rank[a] == rank[b]), k, 0)
    longest = np.zeros(n, np.int64)
    longest[second] = common
    longest[first] = np.maximum(longest[first], common)
    return longest


def _ranked(keys: np.ndarray, at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """New ranks of the suffixes ``at``, sorted by ``keys``; the others keep theirs. Keys refine the ranks before."""
    places = np.arange(len(keys))
    group = np.maximum.accumulate(np.where(np.r_[True, keys[1:] != keys[:-1]], places, 0))
    old = rank[at]
    start = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], places, 0))
    found = rank.copy()
    found[at] = old + group - start
    return found


def _shared(rank: np.ndarray) -> np.ndarray:
    """Suffixes whose rank is not theirs alone."""
    return np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)


def covered_words(longest: np.ndarray, starts: np.ndarray, least: int, cut: int | None = None) -> np.ndarray:
    """Words per text that the union of spans covers: ``longest`` words (or ``cut``) from each position with ``least``."""
    at = np.flatnonzero(longest >= least)
    edges = np.zeros(len(longest) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + (longest[at] if cut is None else cut), -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(edges)[:-1] > 0)])
    return inside[starts[1:]] - inside[starts[:-1]]


def measure_texts(texts: list[str], min_repeat: int = MIN_REPEAT) -> list[list[int]]:
    """The values of ``MEASURES`` for each text."""
    numbers: dict[str, int] = {}
    parts = [WORD.findall(t) for t in texts]
    counts = np.array([len(p) for p in parts], np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)])
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for p in parts for w in p), np.int64, int(starts[-1]))
    longest = longest_repeats(words, np.repeat(np.arange(len(texts)), counts))
    repeated = covered_words(longest, starts, WINDOW, WINDOW)
    covered = covered_words(longest, starts, min_repeat)
    rows = []
    for i, text in enumerate(texts):
        lines = [line for line in text.split("\n") if WORD.search(line)]
        top = int(longest[starts[i] : starts[i + 1]].max()) if counts[i] else 0
        rows.append([
            int(counts[i]), sum(map(len, parts[i])), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            int(repeated[i]), int(covered[i]), top,
        ])
    return rows


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """Neighbouring texts of about ``GROUP_WORDS`` words; a word with its space is taken as six characters."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > 6 * GROUP_WORDS:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def measure(docs: DataFrame, min_repeat: int = MIN_REPEAT) -> DataFrame:
    """``row`` (every column of ``docs``) and ``measures`` of its ``text``."""
    packed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = pa.struct([(f.name, pa.int64()) for f in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [r for group in _groups(batch.column("text").to_pylist()) for r in measure_texts(group, min_repeat)]
            values = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.StructArray.from_arrays(values, fields=list(kind))], ["row", "measures"])

    schema = T.StructType([packed.schema["row"], T.StructField("measures", MEASURES)])
    return packed.mapInArrow(run, schema)


def judged(docs: DataFrame, min_repeat: int = MIN_REPEAT, most_covered: float = MOST_COVERED, most_in_one: float = MOST_IN_ONE) -> DataFrame:
    """``row``, ``measures``, ``base_failed`` and ``kept``."""
    m = F.col("measures")
    failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED_PERCENT * m["n_words"])
    one = F.when(m["longest_repeat"] >= min_repeat, m["longest_repeat"]).otherwise(0)
    fine = (m["n_covered"] <= most_covered * m["n_words"]) & (one <= most_in_one * m["n_words"])
    return measure(docs, min_repeat).withColumn("base_failed", failed).withColumn("kept", ~failed & fine)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns as they were."""
    return judged(docs).where("kept").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op6_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), doc_id="bigint", text="string")
    return judged(docs).select(
        "row.doc_id", "measures.n_words", "measures.word_chars", "measures.n_symbols", "measures.n_dup_lines",
        "measures.n_repeat_words", "base_failed", "kept", "measures.n_covered", "measures.longest_repeat",
    )
