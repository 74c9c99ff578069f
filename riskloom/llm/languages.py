"""Language identification, words first.

A word that the model knows counts with its log frequency per language. A word that it does not know
falls back to the longest character n-grams (``LONGEST`` down to one letter, with word boundaries) of
which at least one is known, and counts with their mean, so that every word has the same weight. A
text's language has the greatest sum; the score is that language's share of the likelihoods per
word (their geometric mean), which says how clear the choice is.

Words are runs of letters (composed, cut every 64), in lower case. Word counts cover every
document that may be learnt from. The model keeps, for each language, its most frequent words and n-grams,
as many as ``MODEL_CELLS`` allows: a frequency from which all are kept is found from a table of how many have
each count, so nothing is sorted in one task. Its size is therefore bounded whatever the corpus is; words
beyond it are spelt by n-grams. Languages weigh the same, however many documents they have. The share
beyond what is counted (``SMOOTHING``) belongs to words that a language was never seen with.

Defined cases: a null text, or one without a letter, is `und` with score 0, as is every text when there is nothing
to learn from; equal sums go to the language whose name comes first; rows without an id are not learnt from
and not held out; repeated rows count each; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import only, slices, table
from riskloom.sources.staging import stage

#: Letters of the longest n-gram.
LONGEST = 5
#: Numbers in the model: n-grams and words, times languages. Four bytes each.
MODEL_CELLS = 1 << 23
#: Words, or n-grams of one length, that are kept per language at most.
KEPT = 20_000
#: Added to every count.
SMOOTHING = 0.5
#: Words or n-grams that one worker counts before it passes the counts on.
STORE = 1 << 17
#: Numbers held of words that a worker has met before it forgets them, eight bytes each.
MET_CELLS = 1 << 20
#: What texts without letters are in.
UNDETERMINED = "und"

#: Letters; the same in tasks that learn and tasks that predict. A longer run is several words.
WORD = re.compile(r"[^\W\d_]{1,64}")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(unicodedata.normalize("NFC", text.lower())) if text else []


def grams_of(word: str, length: int) -> list[str]:
    """Character n-grams of a word between two boundary marks; one letter is without marks."""
    marked = word if length == 1 else f"<{word}>"
    return [marked[i : i + length] for i in range(len(marked) - length + 1)]


def count_words(docs: DataFrame) -> DataFrame:
    """``lang``, ``word``, ``n``: occurrences over all of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, Counter] = defaultdict(Counter)
        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                held[lang].update(words_of(text))
            if sum(map(len, held.values())) > STORE:
                yield from _drained(held, lambda lang: [lang])
        yield from _drained(held, lambda lang: [lang])

    counts = docs.select("lang", "text").mapInArrow(run, "lang string, word string, n bigint")
    return counts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def count_grams(words: DataFrame) -> DataFrame:
    """``lang``, ``size`` (0 for whole words), ``gram``, ``n``, from counted words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], Counter] = defaultdict(Counter)
        once: dict[str, list[str]] = defaultdict(list)
        for batch in slices(batches, 4096):
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
                held[lang, 0][word] += n
                if n == 1:
                    once[lang].append(word)
                    continue
                for size in range(1, LONGEST + 1):
                    counts = held[lang, size]
                    for gram in grams_of(word, size):
                        counts[gram] += n
            # Most words stand once; their n-grams are counted as one list.
            for lang, rare in once.items():
                for size in range(1, LONGEST + 1):
                    held[lang, size].update(gram for word in rare for gram in grams_of(word, size))
            once.clear()
            if sum(map(len, held.values())) > STORE:
                yield from _drained(held, list)
        yield from _drained(held, list)

    grams = words.mapInArrow(run, "lang string, size int, gram string, n bigint")
    return grams.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


def _drained(held: dict, key_columns) -> Iterator[pa.RecordBatch]:
    """The counts as rows of their key, word and number; ``held`` is empty afterwards."""
    names = ["lang", "word", "n"] if not any(isinstance(k, tuple) for k in held) else ["lang", "size", "gram", "n"]
    kinds = [pa.string(), pa.int32()]
    for key, counts in held.items():
        fixed = [pa.array([v] * len(counts), kind) for v, kind in zip(key_columns(key), kinds)]
        yield pa.RecordBatch.from_arrays([*fixed, pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names)
    held.clear()


class Met:
    """Words that a worker has met, numbered as they come, and what each counts with per language."""

    def __init__(self, langs: int):
        self.numbers: defaultdict[str, int] = defaultdict(count().__next__)
        self.values = np.empty((0, langs))

    def make_room(self) -> None:
        """Forget all words when they are too many."""
        if len(self.numbers) * self.values.shape[1] > MET_CELLS:
            self.numbers = defaultdict(count().__next__)

    def extended(self, fresh: np.ndarray) -> np.ndarray:
        """Values of all words, once ``fresh`` are those of the words numbered last."""
        n = len(self.numbers)
        if n > len(self.values):
            grown = np.empty((max(n, 2 * len(self.values)), self.values.shape[1]))
            grown[: n - len(fresh)] = self.values[: n - len(fresh)]
            self.values = grown
        self.values[n - len(fresh) : n] = fresh
        return self.values[:n]


@dataclass
class Model:
    """Log frequencies of words (size 0) and n-grams; rows of ``logs`` are numbered by ``places``."""

    langs: list[str]
    places: list[dict[str, int]]
    logs: np.ndarray

    def numbers(self, word: str) -> list[int]:
        """The word's row, or the rows of its longest known n-grams."""
        at = self.places[0].get(word)
        if at is not None:
            return [at]
        for size in range(LONGEST, 0, -1):
            known = [i for i in map(self.places[size].get, grams_of(word, size)) if i is not None]
            if known:
                return known
        return []

    def predict(self, texts: list[str | None], met: Met | None = None) -> tuple[list[str], np.ndarray]:
        """Languages and scores of many texts at once; what words met before count with is in ``met``."""
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        met = Met(len(self.langs)) if met is None else met
        met.make_room()
        known = len(met.numbers)
        found: list[int] = []
        often: list[int] = []
        sizes = []
        for text in texts:
            counts = Counter(words_of(text))
            found += map(met.numbers.__getitem__, counts)
            often += counts.values()
            sizes.append(len(counts))
        values = met.extended(self._values(list(islice(met.numbers, known, None))))
        word, times, of = np.array(found, np.int64), np.array(often, np.float64), np.repeat(np.arange(len(texts)), sizes)
        sums = np.stack([np.bincount(of, times * column[word], len(texts)) for column in values.T], axis=1)
        words = np.bincount(of, times, len(texts))
        best = sums.argmax(axis=1)
        shares = np.exp((sums - sums.max(axis=1, keepdims=True)) / np.maximum(words, 1)[:, None])
        langs = [self.langs[i] if n else UNDETERMINED for i, n in zip(best.tolist(), words.tolist())]
        return langs, np.where(words > 0, 1 / shares.sum(axis=1), 0.0)

    def _values(self, words: list[str]) -> np.ndarray:
        """What each word counts with, per language: the mean of its rows, zero without any."""
        rows = list(map(self.numbers, words))
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((i for r in rows for i in r), np.int64, int(counts.sum()))
        values = np.zeros((len(rows), len(self.langs)))
        some = np.flatnonzero(counts)
        if len(some):
            starts = (np.cumsum(counts) - counts)[some]
            values[some] = np.add.reduceat(self.logs[flat].astype(np.float64), starts, axis=0) / counts[some, None]
        return values


def fit(docs: DataFrame, cells: int = MODEL_CELLS, kept: int = KEPT) -> Model:
    """Count the words of all ``docs`` (``lang`` not null) and keep the most frequent."""
    words = stage(count_words(docs), "words")
    grams = stage(count_grams(words), "grams")
    langs = sorted(r[0] for r in words.select("lang").distinct().collect())
    if not langs:
        return Model([], [{} for _ in range(LONGEST + 1)], np.zeros((0, 0), np.float32))
    most = max(1, min(kept, cells // (len(langs) ** 2 * (LONGEST + 1))))
    # How many n-grams have each count, from the greatest on, tells from which count all can be kept.
    tops = grams.groupBy("lang", "size", "n").agg(F.count("*").alias("have"))
    upto = F.sum("have").over(Window.partitionBy("lang", "size").orderBy(F.desc("n")))
    least = tops.withColumn("upto", upto).where(F.col("upto") <= most).groupBy("lang", "size").agg(F.min("n").alias("least"))
    totals = grams.groupBy("lang", "size").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()
    # Six rows per language.
    told = grams.join(F.broadcast(least), ["lang", "size"], "left")
    kept_by_any = told.groupBy("size", "gram").agg(F.collect_list(F.struct("lang", "n")).alias("counts"), F.bool_or(F.coalesce(F.col("n") >= F.col("least"), F.lit(False))).alias("kept"))
    # At most ``cells`` rows: each language keeps at most ``most`` n-grams of each size.
    model = kept_by_any.where("kept").select("size", "gram", F.explode("counts").alias("c")).select("size", "gram", "c.lang", "c.n").toArrow()
    number = {lang: i for i, lang in enumerate(langs)}
    places: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
    rows, column, sizes = np.empty(model.num_rows, np.int64), np.empty(model.num_rows, np.int64), []
    at = 0
    for batch in model.to_batches(max_chunksize=1 << 14):
        for size, gram, lang in zip(*(batch.column(c).to_pylist() for c in ("size", "gram", "lang"))):
            rows[at] = place = places[size].setdefault(gram, len(sizes))
            if place == len(sizes):
                sizes.append(size)
            column[at] = number[lang]
            at += 1
    counts = np.full((len(sizes), len(langs)), SMOOTHING)
    counts[rows, column] += model.column("n").to_numpy()
    sums = np.ones((LONGEST + 1, len(langs)))
    for total in totals:
        sums[total["size"], number[total["lang"]]] = total["n"] + SMOOTHING * total["kinds"]
    return Model(langs, places, np.log(counts / sums[np.array(sizes, np.int64)]).astype(np.float32))


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``lang_pred`` and ``score`` of every text, beside the columns to ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Met(len(shared.value.langs))
        for batch in slices(batches):
            langs, scores = shared.value.predict(batch.column("text").to_pylist(), met)
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}lang_pred string, score double")


def remainder(doc_id: str = "doc_id") -> Column:
    """Which quarter of the ids a document is in."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def op11_word_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), doc_id="bigint", text="string", lang="string")
    model = fit(docs.where(F.col("lang").isNotNull() & (remainder() != 2)))
    held_out = docs.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "text")
    return predict(held_out, model, "doc_id", "held_out")
