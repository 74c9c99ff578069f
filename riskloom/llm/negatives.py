"""Hard-negative mining with Four-Russians scoring.

Vectors are whole numbers, ``floor(scale * x)``. A row is indexed once as bit planes: plane ``p``
holds bit ``p`` (two's complement) of every dimension, eight dimensions to a byte. For each group
of eight dimensions an anchor has a table of 256 subset sums, so that one byte of a plane is one
lookup instead of eight products; planes are joined from the highest down by doubling and adding,
the highest counting negatively. Every score is the exact inner product.

Anchors and rows meet in cells of ``ANCHORS`` by ``ROWS``: each row is sent once to every block of
anchors and each anchor once to every block of rows, so a cell is a bounded group whatever the
labels or copies are. A cell returns only its own first rows per anchor, and these are merged.
Positives come first (only rows of the anchor's label are scored for them); their scores then give
the bands that negatives are looked for in.

Defined cases: rows without a label or a vector, or with a null, NaN or infinite component, take no
part. Rows without an id are no anchors; among equal scores they come last, with a null id in the
result. Rows that repeat an id are rows of their own, so a copy of an anchor is one of its positives.
Shorter vectors count as ending in zeros. A negative or zero positive score has the band that the
inequality gives (none, or only zero). Scores that could leave 64 bits stop the job. An empty
table, and anchors or positives without partners, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import only, table
from riskloom.sources.staging import stage

#: Dimensions of one subset-sum table.
GROUP = 8
#: Anchors and rows of a cell, on average; rows that are scored at a time.
ANCHORS, ROWS, CHUNK = 512, 16_384, 2_048
#: Each component counts as floor(SCALE * x).
SCALE = 256
#: Positives per anchor, negatives per positive, and the band of negatives in percent of the positive's score.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90


def pack_planes(vectors: np.ndarray, planes: int) -> np.ndarray:
    """Bit planes of whole numbers: (row, plane, group of eight dimensions), lowest plane first."""
    bits = ((vectors[:, None, :] >> np.arange(planes)[None, :, None]) & 1).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little")


def unpack_planes(packed: np.ndarray) -> np.ndarray:
    """The whole numbers again, with the last group filled up with zeros."""
    bits = np.unpackbits(packed, axis=2, bitorder="little").astype(np.int64)
    weights = np.int64(1) << np.arange(packed.shape[1], dtype=np.int64)
    weights[-1] = -weights[-1]
    return np.einsum("npd,p->nd", bits, weights)


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """For each group of dimensions: 256 sums of its subsets, per anchor; (group, subset, anchor)."""
    n, width = anchors.shape
    groups = anchors.T.reshape(width // GROUP, GROUP, n).astype(kind)
    sums = np.zeros((width // GROUP, 1, n), kind)
    for i in range(GROUP):
        sums = np.concatenate([sums, sums + groups[:, i : i + 1]], axis=1)
    return sums


def score(sums: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Exact inner products (row, anchor) from the anchors' subset sums and the rows' planes."""
    groups, _, n = sums.shape
    found = np.zeros((len(packed), n), sums.dtype)
    part = np.empty_like(found)
    for plane in reversed(range(packed.shape[1])):
        found += found
        for g in range(groups):
            np.take(sums[g], packed[:, plane, g], axis=0, out=part, mode="clip")
            if plane == packed.shape[1] - 1:
                found -= part
            else:
                found += part
    return found


def first_places(scores: np.ndarray, places: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` of ``places`` with the greatest scores, greatest first; earlier places win ties."""
    values = scores[places]
    if len(places) > most:
        places = places[values >= np.partition(values, len(values) - most)[len(values) - most]]
        values = scores[places]
    return places[np.argsort(-values, kind="stable")[:most]]


class _Cell:
    """Rows of one cell in the order that settles ties, and the anchors' tables."""

    def __init__(self, rows: pa.Table, anchors: pa.Table, planes: int, kind: type):
        ids = rows.column("id").combine_chunks()
        missing = np.asarray(ids.is_null())
        order = np.lexsort((rows.column("row").to_numpy(), np.asarray(ids.fill_null(0)), missing))
        self.rows = rows.take(pa.array(order))
        self.row, self.label = self.rows.column("row").to_numpy(), self.rows.column("label").to_numpy()
        self.packed = _packed(self.rows, planes)
        self.anchor_row, self.anchor_label = anchors.column("row").to_numpy(), anchors.column("label").to_numpy()
        self.sums = subset_sums(unpack_planes(_packed(anchors, planes)), kind)

    def positives(self, most: int) -> list[tuple[int, int, int]]:
        """(anchor, row, score) of each anchor's first rows of its label."""
        found = []
        for label in np.intersect1d(self.label, self.anchor_label):
            rows, anchors = np.flatnonzero(self.label == label), np.flatnonzero(self.anchor_label == label)
            scores = _scores(np.ascontiguousarray(self.sums[:, :, anchors]), self.packed[rows])
            for i, a in enumerate(anchors):
                others = np.flatnonzero(self.row[rows] != self.anchor_row[a])
                found += [(a, rows[at], scores[i, at]) for at in first_places(scores[i], others, most)]
        return found

    def negatives(self, bands: list[list[dict]], most: int, low: int, high: int) -> list[tuple[int, int, int, int]]:
        """(anchor, its positive, row, score) of the first rows of other labels in each positive's band."""
        found = []
        scores = _scores(self.sums, self.packed)
        for a, positives in enumerate(bands):
            other, line = self.label != self.anchor_label[a], scores[a]
            for p, positive in enumerate(positives):
                least, greatest = -(-low * positive["score"] // 100), high * positive["score"] // 100
                places = np.flatnonzero(other & (line >= least) & (line <= greatest)) if least <= greatest else []
                if len(places):
                    found += [(a, p, at, line[at]) for at in first_places(line, places, most)]
        return found


def _scores(sums: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """(anchor, row), so that each anchor's scores lie side by side."""
    found = np.empty((sums.shape[2], len(packed)), sums.dtype)
    for at in range(0, len(packed), CHUNK):
        found[:, at : at + CHUNK] = score(sums, packed[at : at + CHUNK]).T
    return found


def _packed(rows: pa.Table, planes: int) -> np.ndarray:
    data = b"".join(rows.column("planes").to_pylist())
    return np.frombuffer(data, np.uint8).reshape(rows.num_rows, planes, -1)


def _index(vectors: DataFrame, width: int, planes: int) -> DataFrame:
    """``row`` (a number of its own), ``id``, ``label``, ``anchor`` and packed ``planes`` of each vector."""
    groups = -(-width // GROUP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                lists = batch.column("vector")
                sizes = lists.value_lengths().to_numpy()
                matrix = np.zeros((batch.num_rows, groups * GROUP), np.int64)
                line = np.repeat(np.arange(batch.num_rows), sizes)
                matrix[line, np.arange(len(line)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
                packed = pack_planes(matrix, planes)
                columns = [batch.column(c) for c in ("row", "id", "label", "anchor")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes() for x in packed], pa.binary())], ["row", "id", "label", "anchor", "planes"])

    numbered = vectors.withColumn("row", F.monotonically_increasing_id())
    return numbered.mapInArrow(run, "row bigint, id bigint, label bigint, anchor boolean, planes binary")


def _cells(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int):
    """Rows and anchors, both grouped by the cells in which they meet."""
    high, wide = -(-n_rows // ROWS), -(-n_anchors // ANCHORS)
    block = lambda seed, count: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = rows.select("row", "id", "label", "planes", block(1, high).alias("high"), every(wide).alias("wide"))
    right = anchors.select("*", every(high).alias("high"), block(2, wide).alias("wide"))
    return left.groupBy("high", "wide").cogroup(right.groupBy("high", "wide"))


def mine_negatives(
    vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """Negatives of every (anchor, positive): ids, ``rank`` and both scores.

    ``vectors`` has ``id``, ``label``, ``vector`` (whole numbers) and ``anchor`` (whether the row is one).
    """
    vectors = stage(vectors, "vectors")
    facts = vectors.agg(
        F.count("*").alias("rows"), F.count_if("anchor").alias("anchors"), F.max(F.size("vector")).alias("width"),
        F.max(F.array_max("vector")).alias("greatest"), F.min(F.array_min("vector")).alias("least"),
    ).first()
    width, reach = facts["width"] or 0, max(facts["greatest"] or 0, -1 - (facts["least"] or 0), 0)
    planes = int(reach).bit_length() + 1
    bound = max(width, 1) << 2 * (planes - 1)
    if bound >= 1 << 56:
        raise ValueError(f"{width} components of up to {reach} have scores beyond 64 bits")
    kind = np.int32 if bound < 1 << 31 else np.int64
    index = stage(_index(vectors, max(width, 1), planes), "planes")
    anchors = index.where("anchor").select("row", "id", "label", "planes")
    sizes = max(facts["rows"], 1), max(facts["anchors"], 1)

    def positives_in(_, rows: pa.Table, some: pa.Table) -> pa.Table:
        cell = _Cell(rows, some, planes, kind) if rows.num_rows and some.num_rows else None
        found = np.array(cell.positives(positives) if cell else [], np.int64).reshape(-1, 3)
        of, at = pa.array(found[:, 0]), pa.array(found[:, 1])
        rows = cell.rows if cell else rows
        return pa.table([some.column("row").take(of), rows.column("row").take(at), rows.column("id").take(at), pa.array(found[:, 2])], ["anchor", "row", "id", "score"])

    def negatives_in(_, rows: pa.Table, some: pa.Table) -> pa.Table:
        cell = _Cell(rows, some, planes, kind) if rows.num_rows and some.num_rows else None
        bands = some.column("positives").to_pylist()
        found = np.array(cell.negatives(bands, negatives, low, high) if cell else [], np.int64).reshape(-1, 4)
        of, at = pa.array(found[:, 0]), pa.array(found[:, 2])
        rows = cell.rows if cell else rows
        with_ = [bands[a][p] for a, p in found[:, :2]]
        numbers = lambda key: pa.array([x[key] for x in with_], pa.int64())
        return pa.table(
            [
                some.column("row").take(of), some.column("id").take(of), numbers("row"), numbers("id"), numbers("score"), pa.array([x["place"] for x in with_], pa.int32()),
                rows.column("row").take(at), rows.column("id").take(at), pa.array(found[:, 3]),
            ],
            ["anchor", "anchor_id", "positive", "positive_id", "positive_score", "place", "row", "id", "score"],
        )

    near = _cells(index, anchors, *sizes).applyInArrow(positives_in, "anchor bigint, row bigint, id bigint, score bigint")
    near = near.withColumn("place", _place("anchor")).where(F.col("place") <= positives)
    bands = near.groupBy("anchor").agg(F.collect_list(F.struct("row", "id", "score", "place")).alias("positives"))
    asked = stage(anchors.join(bands.withColumnRenamed("anchor", "row"), "row"), "anchors")
    far = _cells(index, asked, *sizes).applyInArrow(
        negatives_in,
        "anchor bigint, anchor_id bigint, positive bigint, positive_id bigint, positive_score bigint, place int, row bigint, id bigint, score bigint",
    )
    far = far.withColumn("rank", _place("anchor", "positive")).where(F.col("rank") <= negatives)
    return far.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"), F.col("place").alias("positive_place"),
    )


def _place(*of: str) -> Column:
    """Number from 1: highest score first, then by id, rows without one last."""
    return F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row"))


def whole_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """``id``, ``label`` and ``vector`` of the rows that take part: a label, and only finite components."""
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    known = rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull()).where(sound)
    # Beyond 2^40 a score leaves 64 bits in any case; cutting there lets the check of the bound speak.
    cut = lambda x: F.greatest(F.least(F.floor(x * F.lit(float(scale))).cast("double"), F.lit(2.0**40)), F.lit(-(2.0**40)))
    return known.select("id", "label", F.transform("vector", lambda x: cut(x).cast("bigint")).alias("vector"))


def op13_bit_plane_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = only(table(spark, sf_dir, "embeddings"), vec_id="bigint", label="bigint", embedding="array<double>")
    vectors = whole_vectors(rows.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector")))
    shifted = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = vectors.select("id", shifted.alias("label"), "vector", F.coalesce(F.col("id") % 100 == 0, F.lit(False)).alias("anchor"))
    return mine_negatives(vectors)


OP13_SQL = """
with whole as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as anchor_id, r.vec_id as row_id, a.label = r.label as same, cast(list_inner_product(a.v, r.v) as bigint) as score
  from whole a join whole r on a.vec_id <> r.vec_id where a.vec_id % 100 = 0
), positives as (
  select anchor_id, row_id as positive_id, score as positive_score,
    row_number() over (partition by anchor_id order by score desc, row_id) as place
  from scored where same
), negatives as (
  select anchor_id, positive_id, row_id as negative_id, positive_score, n.score as negative_score, place,
    row_number() over (partition by anchor_id, positive_id order by n.score desc, row_id) as rank
  from positives p join scored n using (anchor_id)
  where place <= 5 and not n.same and 30 * positive_score <= 100 * n.score and 100 * n.score <= 90 * positive_score
)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score, cast(place as int) as positive_place
from negatives where rank <= 10
"""
