"""Column expressions against plain Python on generated text."""

import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.functions import buckets, cleaning

ALPHABET = "0123456789.,-+$ eENAon/"
TEXTS = st.lists(st.none() | st.text(ALPHABET, max_size=9) | st.sampled_from(["None", "NA", "1.5E3"]), min_size=60, max_size=120)


def number(text):
    try:
        return float(text)
    except ValueError:
        return 0.0


def currency(text):
    run = re.search(r"[\d\.]+", text or "")
    return number(run.group()) if run else 0.0


def strict_currency(text):
    run = re.search(r"-?\d+(?:\.\d+)?", (text or "").replace(",", ""))
    return number(run.group()) if run else 0.0


def guarded(text):
    return number(text) if text and text != "None" and re.search(r"^[0-9.]+$", text) else 0.0


def coerced(text):
    usable = text is not None and re.search(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$", text)
    return number(text) if usable else 0.0


def key(text):
    return int(text) if text is not None and re.fullmatch(r"\s*[+-]?\d+\s*", text) else None


def bucket(text):
    return int(hashlib.sha256((text or "").encode()).hexdigest()[:8], 16) % 10_000


PAIRS = [
    (cleaning.currency_amount, currency),
    (lambda c: cleaning.currency_amount(c, strict=True), strict_currency),
    (cleaning.guarded_number, guarded),
    (cleaning.coerced_number, coerced),
    (cleaning.safe_key, key),
    (buckets.sha_bucket, bucket),
]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=TEXTS)
def test_expressions(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    columns = [expression(F.col("t")).alias(f"c{n}") for n, (expression, _) in enumerate(PAIRS)]
    for row in df.select("i", *columns).collect():
        for n, (_, plain) in enumerate(PAIRS):
            text = texts[row["i"]]
            assert row[f"c{n}"] == pytest.approx(plain(text)), (n, text)
