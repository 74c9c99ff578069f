"""Mixing documents to target weights with soft domain membership.

A multinomial logistic regression on hashed words, fitted on a bounded sample of a
labelled table, gives every document a posterior over domains. With ``n`` tokens and
posterior ``p`` a document at rate ``r`` brings ``r n p`` expected tokens to the
domains. Nonnegative rates are fitted so that these totals match the targets, by
projected gradient least squares: each step is one distributed sum of as many
numbers as there are pairs of domains, then ``r <- max(0, r - p . G+ (totals - targets))``,
where G is the token-weighted second moment of the posteriors of rows that can still
move. With that metric and gradients scaled by 1/n the curvature is 1, so a handful of
steps is enough and their length is 1 unless too many rows reach zero at once.

Defined cases: a null text has no tokens, keeps its rate and adds nothing; rows
without a label, a null label or without a document are not fitted on; without any
labelled document every posterior lies on the first domain, with one labelled domain
on that one; repeated rows count as often as they appear; an empty table stays empty.
"""

from __future__ import annotations

from functools import reduce
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import only, split_words, table
from riskloom.sources.staging import stage

#: Labelled documents that the classifier is fitted on, at most; the least hashes of the id are taken.
TRAINING_DOCUMENTS = 6000
#: Buckets of the hashed words.
FEATURES = 1 << 14
#: Steps of the fit, at most, and the relative distance from the targets at which it ends.
STEPS, CLOSE = 25, 1e-6

#: Domains of the ``labels`` table: (name, quality, toxic), and the share of tokens each is to have. The shares are a
#: choice in whole hundredths, made without looking at what any corpus holds: 95 clean, 3 poor, 1 for each toxic domain.
DOMAINS = (("clean", 1, 0), ("clean_toxic", 1, 1), ("poor", 0, 0), ("poor_toxic", 0, 1))
WEIGHTS = {"clean": 0.95, "clean_toxic": 0.01, "poor": 0.03, "poor_toxic": 0.01}


def with_words(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__words", split_words(F.col("text")))


def posteriors(docs: DataFrame, labelled: DataFrame, n_domains: int) -> DataFrame:
    """Add ``posterior`` (array of double) to ``docs`` with ``doc_id`` and ``text``.

    ``labelled`` has ``doc_id`` and ``domain`` (0 up to ``n_domains``).
    """
    known = only(labelled, doc_id="bigint", domain="int").dropna().where(F.col("domain").between(0, n_domains - 1))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(TRAINING_DOCUMENTS)
    # The sample's size is bounded by a parameter, so the broadcast is too.
    fitted_on = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    hashed = HashingTF(numFeatures=FEATURES, binary=True, inputCol="__words", outputCol="__features")
    rows = stage(hashed.transform(with_words(fitted_on)).select(F.col("domain").cast("double").alias("domain"), "__features"), "training")
    seen = [int(r["domain"]) for r in rows.select("domain").distinct().orderBy("domain").collect()]
    if len(seen) < 2:
        only_one = seen[0] if seen else 0
        fixed = F.array(*[F.lit(1.0 if k == only_one else 0.0) for k in range(n_domains)])
        return docs.withColumn("__words", split_words(F.col("text"))).withColumn("posterior", fixed)
    # The sample is bounded, and each task of an iteration sends a gradient: few tasks are enough.
    dense = rows.replace([float(k) for k in seen], [float(i) for i in range(len(seen))], subset=["domain"])
    model = LogisticRegression(
        featuresCol="__features", labelCol="domain", predictionCol="__prediction", probabilityCol="__probability",
        rawPredictionCol="__raw", family="multinomial", regParam=1e-4, maxIter=40, standardization=False,
    ).fit(dense.coalesce(4))
    scored = model.transform(hashed.transform(with_words(docs)))
    found = vector_to_array("__probability")
    spread = [found[seen.index(k)] if k in seen else F.lit(0.0) for k in range(n_domains)]
    return scored.withColumn("posterior", F.array(*[F.round(p, 6) for p in spread])).drop(
        "__features", "__raw", "__probability", "__prediction"
    )


def _dot(values: Sequence[Column], numbers: Sequence[float]) -> Column:
    return reduce(lambda a, b: a + b, [v * F.lit(float(x)) for v, x in zip(values, numbers)])


def fit_rates(rows: DataFrame, targets: Sequence[float]) -> Column:
    """The rate of each row of ``rows`` (``n_tokens`` and ``posterior``), as an expression of its posterior.

    ``targets`` are tokens per domain. Each step is one pass over all rows that sums the expected
    totals and the moment of rows with a rate above zero, a few numbers per domain. A step that
    leads further away is taken back and tried at half its length.
    """
    k = len(targets)
    goal = np.asarray(targets, dtype=float)
    p = [F.col("posterior")[i] for i in range(k)]
    n = F.col("n_tokens").cast("double")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def summed(rate: Column) -> tuple[np.ndarray, np.ndarray]:
        moved = F.when(F.col("rate") > 0, n).otherwise(0.0)
        sums = [F.sum(F.col("rate") * n * p[i]) for i in range(k)] + [F.sum(moved * p[i] * p[j]) for i, j in pairs]
        found = rows.withColumn("rate", rate).agg(*[F.coalesce(s, F.lit(0.0)) for s in sums]).first()
        moment = np.zeros((k, k))
        for (i, j), value in zip(pairs, found[k:]):
            moment[i, j] = moment[j, i] = value
        return np.asarray(found[:k], dtype=float) - goal, moment

    best = rate = F.lit(1.0)
    least, length = np.inf, 1.0
    away, moment = summed(rate)
    for _ in range(STEPS):
        distance = np.abs(away).sum()
        if distance < least:
            best, least, step, length = rate, distance, np.linalg.pinv(moment, rcond=1e-9, hermitian=True) @ away, min(1.0, 2 * length)
        else:
            length /= 2
        if least <= CLOSE * max(goal.sum(), 1.0):
            break
        rate = F.greatest(F.lit(0.0), best - _dot(p, length * step))
        away, moment = summed(rate)
    return best


def targets_within(held: Sequence[float], shares: np.ndarray) -> np.ndarray:
    """Tokens per domain at these shares without repeating any: the domain with the greatest share is used
    whole, each other one as its share asks, or whole where it holds less than that."""
    held = np.asarray(held, dtype=float)
    main = int(np.argmax(np.where(held > 0, shares, -1.0)))
    return np.minimum(held, shares * held[main] / shares[main]) if shares[main] > 0 else np.zeros(len(shares))


def copies_of(rate: Column, doc_id: Column, content: Column) -> Column:
    """Whole copies of a document: the rate rounded down, and one more as often as its fraction says.

    The draw is by id, by the text where there is none. Rows that repeat both draw alike.
    """
    drawn_by = F.when(doc_id.isNull(), F.xxhash64(F.lit("copies"), F.lit("text"), content)).otherwise(F.xxhash64(F.lit("copies"), doc_id))
    draw = F.pmod(drawn_by, F.lit(1 << 40)) / F.lit(float(1 << 40))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("bigint")


def mix_documents(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float], budget: float | None = None) -> DataFrame:
    """One row per document: content (hash of the text), n_tokens, the posterior of each domain, rate and copies.

    ``weights`` maps domains, in the order of their numbers, to shares of ``budget`` tokens, which
    are as many as the corpus has if none are given. Documents of a scarce domain are repeated; only
    a domain without any expected token has no rate that meets its target, and it is left out.
    """
    shares = np.asarray(list(weights.values()), dtype=float) / sum(weights.values())
    scored = posteriors(only(docs, doc_id="bigint", text="string"), labelled, len(shares))
    content = F.xxhash64(F.coalesce("text", F.lit(""))).alias("content")
    rows = stage(scored.select("doc_id", content, F.size("__words").cast("bigint").alias("n_tokens"), "posterior"), "posteriors")
    n = F.col("n_tokens").cast("double")
    total, *held = rows.agg(F.sum("n_tokens"), *[F.coalesce(F.sum(n * F.col("posterior")[i]), F.lit(0.0)) for i in range(len(shares))]).first()
    targets = np.where(np.asarray(held) > 0, (total or 0 if budget is None else budget) * shares, 0.0)
    rate = F.round(fit_rates(rows, targets), 6)
    named = [F.col("posterior")[i].alias(f"p_{name}") for i, name in enumerate(weights)]
    mixed = rows.select("doc_id", "content", "n_tokens", *named, rate.alias("rate"))
    return mixed.withColumn("copies", copies_of(F.col("rate"), F.col("doc_id"), F.col("content")))


def mixture_totals(mixed: DataFrame, weights: Mapping[str, float], budget: float | None = None) -> DataFrame:
    """domain, target, and the expected tokens that it holds, has at the fitted rates, and has in the whole copies."""
    n, whole = F.col("n_tokens").cast("double"), sum(weights.values())
    tokens = F.lit(budget) if budget is not None else F.coalesce(F.sum(n), F.lit(0.0))
    sums = [
        F.struct(
            F.lit(name).alias("domain"), (tokens * F.lit(weight / whole)).alias("target"),
            *[F.coalesce(F.sum(n * F.col(f"p_{name}") * often), F.lit(0.0)).alias(k) for k, often in (("held", F.lit(1)), ("fitted", F.col("rate")), ("copied", F.col("copies")))],
        )
        for name, weight in weights.items()
    ]
    return mixed.agg(F.array(*sums).alias("totals")).select(F.inline("totals"))


def label_domains(labels: DataFrame) -> DataFrame:
    """Domain numbers of the ``labels`` table."""
    labels = only(labels, doc_id="bigint", quality="int", toxic="int")
    number = F.coalesce(*[F.when((F.col("quality") == q) & (F.col("toxic") == t), i) for i, (_, q, t) in enumerate(DOMAINS)])
    return labels.select("doc_id", number.alias("domain"))


def op9_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = label_domains(table(spark, sf_dir, "labels"))
    return mix_documents(table(spark, sf_dir, "documents"), labels, WEIGHTS).drop("content")
