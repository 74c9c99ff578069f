import random
from collections import defaultdict

import numpy as np
import pytest

from riskloom.llm import negatives
from riskloom.llm.negatives import mine_negatives, pack_planes, score, subset_sums, unpack_planes, whole_vectors

SCHEMA = "id bigint, label bigint, vector array<double>, row string, planes string, score int"


def test_scores_are_inner_products():
    r = np.random.default_rng(1)
    for reach, kind in ((1, np.int32), (200, np.int32), (1 << 20, np.int64)):
        rows, anchors = r.integers(-reach, reach, (50, 24)), r.integers(-reach, reach, (7, 24))
        rows[0], rows[1] = -reach, reach - 1
        packed = pack_planes(rows, int(reach).bit_length() + 1)
        assert (unpack_planes(packed) == rows).all()
        assert (score(subset_sums(anchors, kind), packed) == rows @ anchors.T).all()


def brute(rows, positives=5, negatives_=10, low=30, high=90):
    """rows: (id, label, whole numbers). All pairs of anchors and rows, in plain Python."""
    width = max((len(v) for _, _, v in rows), default=0)
    full = [(i, label, [*v, *[0] * (width - len(v))]) for i, label, v in rows]
    found = []
    for a, (anchor, label, v) in enumerate(full):
        if anchor is None or anchor % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), i, other) for k, (i, other, w) in enumerate(full) if k != a]
        order = lambda x: (-x[0], x[1] is None, x[1] or 0)
        for score_, positive, _ in sorted((x for x in scored if x[2] == label), key=order)[:positives]:
            band = [x for x in scored if x[2] != label and low * score_ <= 100 * x[0] <= high * score_]
            for rank, (s, i, _) in enumerate(sorted(band, key=order)[:negatives_], 1):
                found.append((anchor, positive, rank, i, score_, s))
    return found


def mined(spark, rows, **more):
    df = spark.createDataFrame([(i, label, v, "r", "p", 0) for i, label, v in rows], SCHEMA)
    whole = whole_vectors(df, 1).selectExpr("*", "coalesce(id % 100 = 0, false) as anchor")
    out = mine_negatives(whole, **more).drop("positive_place")
    return [tuple(r) for r in out.collect()]


@pytest.fixture(scope="module")
def odd_rows():
    r = random.Random(3)
    rows = [(i * 20, r.randint(0, 3), [float(r.randint(-9, 9)) for _ in range(11)]) for i in range(120)]
    rows += [(7000 + k, 1, [4.0] * 11) for k in range(60)]  # ties
    rows += [(9000 + k, 2, [3.0] * 11) for k in range(60)]
    rows += [(None, 2, [5.0] * 11), (9100, 1, [1.0, 2.0]), (9200, 0, []), (rows[5][0], 3, [1.0] * 11)]
    unsound = [(1, None, [1.0] * 11), (100, 1, None), (200, 1, [1.0, None]), (300, 1, [float("nan")] * 11), (400, 1, [float("-inf")] * 11)]
    return rows, unsound


def test_mining_by_brute_force(spark, odd_rows, monkeypatch):
    rows, unsound = odd_rows
    expected = brute([(i, label, [int(x) for x in v]) for i, label, v in rows])
    ties = lambda found: sorted((a, p or 0, rank, n or 0, s, t) for a, p, rank, n, s, t in found)
    assert ties(mined(spark, rows + unsound)) == ties(expected) and expected
    # Cells of a few rows: what they find is merged to the same rows.
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    monkeypatch.setattr(negatives, "ROWS", 50)
    monkeypatch.setattr(negatives, "CHUNK", 16)
    assert ties(mined(spark, rows + unsound)) == ties(expected)


def test_copies_of_an_anchor_are_its_positives(spark):
    rows = [(100, 1, [2.0, 1.0]), (100, 1, [2.0, 1.0]), (3, 2, [2.0, 0.0]), (4, 2, [1.0, -2.0])]
    found = mined(spark, rows)
    assert sorted(found) == sorted(brute([(i, x, [int(c) for c in v]) for i, x, v in rows]))
    assert found == [(100, 100, 1, 3, 5, 4)] * 2


def test_scale_floors(spark):
    df = spark.createDataFrame([(1, 0, [0.999, -0.001, 0.5], "r", "p", 0)], SCHEMA)
    assert whole_vectors(df).first()["vector"] == [255, -1, 128]


def test_nothing_to_mine(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, 1, [1.0])]) == []
    assert mined(spark, [(100, 1, [1.0]), (2, 1, [1.0])]) == []
    assert mined(spark, [(1, None, None)]) == []
    assert mined(spark, [(100, 1, [1.0]), (2, 2, [1.0])]) == []


def test_scores_beyond_64_bits_stop(spark):
    with pytest.raises(ValueError, match="64 bits"):
        mined(spark, [(100, 1, [1e300]), (2, 1, [1.0])])


def test_given_tables(spark, sf_dir):
    out = [tuple(r)[:6] for r in negatives.op13_bit_plane_negatives(spark, sf_dir).collect()]
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], [int(np.floor(256 * float(x))) for x in r["embedding"]]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    by_anchor = defaultdict(list)
    for row in out:
        by_anchor[row[0]].append(row)
    assert sorted(out) == sorted(brute(rows)) and by_anchor
