"""Removal of repeated substrings, found by suffix sorting with Lyndon-prefix groups.

Every window of ``LENGTH`` bytes has an anchor: the ``GRAM``-byte gram with the least hash
inside it. A window's anchor depends on its bytes alone, so equal windows meet at equal
anchors, one anchor for about 85 bytes of text. The windows of one anchor are neighbours;
the bytes they cover are a region.

* An anchor seen once has no repeated window. A region with the same bytes in two places
  is repeated as a whole; both need counts and no text.
* The remaining regions lie at the ends of repeated passages and around edits. They are
  compared with the other distinct regions of their anchor, if they agree with one in half a
  window's bytes on either side of it (two equal windows always do). Their bytes are cut at
  local minima into short phrases. Phrases that their anchor has once, or that stand in too short
  a run of others, go; the rest of several regions is one array, and its suffix array is built
  by Lyndon-prefix groups (``suffix_groups``). Neighbouring suffixes that share
  a run of phrases long enough for a whole window's inner part mark their regions; windows
  of marked regions are then compared exactly.
* An anchor with more distinct regions than fit one task has its windows counted by Spark.

Texts with the same 64-bit hash are one text; such a text, if it is long enough, is removed
from every copy. Strings are judged on the input, and overlaps count, also inside one text.

Defined cases: a null text is empty; texts shorter than a window lose nothing, however
often they occur; repeated rows are copies of each other; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import only, slices, table
from riskloom.llm.hashing import least_places, mix
from riskloom.llm.suffix_groups import common_prefixes, suffix_array
from riskloom.sources.staging import passing, stage

#: Bytes of a window that must be repeated, and of the grams among which anchors are chosen.
LENGTH, GRAM = 200, 32
#: Bytes on one side of an anchor on which two equal windows agree at least.
SIDE = (LENGTH - GRAM) // 2
#: Grams and reach of the phrases inside regions; a window's inner part holds whole phrases over CORE bytes.
PHRASE_GRAM, PHRASE_REACH = 8, 16
CORE = LENGTH - 2 * (2 * PHRASE_REACH + PHRASE_GRAM)
#: Starts of windows handled at a time in one text; bytes of regions sorted in one array.
CHUNK, BATCH_BYTES = 1 << 19, 1 << 17
#: Distinct regions of one anchor that one task takes.
REGIONS_PER_ANCHOR = 16_000

_ODD = 0x9E3779B97F4A7C15 | 1
_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    found = np.full(n, base, np.uint64)
    found[0] = 1
    return np.multiply.accumulate(found)


class SliceHasher:
    """Hashes of any slices of a byte string, from running sums of a polynomial modulo 2**64."""

    room = 0
    up = down = np.ones(1, np.uint64)

    def __init__(self, data: bytes):
        n = len(data)
        if SliceHasher.room <= n:
            # An empty slice may start at the end of the string.
            SliceHasher.room = max(n + 1, 2 * SliceHasher.room)
            SliceHasher.up = _powers(_ODD, SliceHasher.room)
            SliceHasher.down = _powers(pow(_ODD, -1, 1 << 64), SliceHasher.room)
        codes = _BYTE_CODES[np.frombuffer(data, np.uint8)]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * SliceHasher.up[:n], dtype=np.uint64)])

    def slices(self, at: np.ndarray, upto: np.ndarray) -> np.ndarray:
        return mix((self.sums[upto] - self.sums[at]) * SliceHasher.down[at])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * SliceHasher.down[:n])


def regions(data: bytes) -> tuple[np.ndarray, ...]:
    """Of each region: first and last start of its windows, anchor, hash of its bytes, hashes left and right of the anchor.

    A side hash is 0 where the text ends before the side does.
    """
    parts = []
    for begin in range(0, len(data) - LENGTH + 1, CHUNK):
        piece = data[begin : begin + CHUNK + LENGTH - 1]
        hasher = SliceHasher(piece)
        grams = hasher.grams(GRAM)
        place = least_places(grams, LENGTH - GRAM + 1)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:] - 1, len(place) - 1]
        at = place[first]
        view = memoryview(piece)
        whole = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), (last + LENGTH).tolist())]
        left = np.where(at >= SIDE, hasher.slices(np.maximum(at - SIDE, 0), at), 0)
        end = at + GRAM + SIDE
        right = np.where(end <= len(piece), hasher.slices(at + GRAM, np.minimum(end, len(piece))), 0)
        parts.append((first + begin, last + begin, grams[at], np.array(whole, np.uint64), left, right))
    return tuple(np.concatenate(c) for c in zip(*parts)) if parts else ()


REGION = "class bigint, doc_id bigint, lo bigint, hi bigint, anchor bigint, region bigint, lside bigint, rside bigint"


def region_rows(texts: DataFrame) -> DataFrame:
    """The regions of each distinct text of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for batch in slices(batches):
            found, names, ids, counts = [], [], [], []
            for name, doc_id, data in zip(*(batch.column(c).to_pylist() for c in ("class", "doc_id", "data"))):
                if name not in met and len(data) >= LENGTH:
                    met.add(name)
                    found.append(regions(data))
                    names.append(name)
                    ids.append(doc_id)
                    counts.append(len(found[-1][0]))
            if found:
                owner = pa.array(np.repeat(np.arange(len(names)), counts))
                columns = [np.concatenate(c).view(np.int64) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()).take(owner), pa.array(ids, pa.int64()).take(owner), *map(pa.array, columns)],
                    [part.split()[0] for part in REGION.split(", ")],
                )

    return texts.mapInArrow(run, REGION)


def _repeatable(names: np.ndarray, lengths: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Places of the phrases that can be in a run over ``CORE`` bytes seen at two places: those in such a run of repeated phrases.

    A phrase that goes can leave another one alone, so there is a second and third look.
    """
    kept = np.arange(len(names))
    for _ in range(3):
        _, which, seen = np.unique(names[kept], return_inverse=True, return_counts=True)
        kept = kept[seen[which] > 1]
        if not len(kept):
            break
        first = _run_starts(kept, owner)
        bytes_of = np.add.reduceat(lengths[kept], first)
        kept = kept[np.repeat(bytes_of >= CORE, np.diff(np.r_[first, len(kept)]))]
        if not len(kept):
            break
    return kept


def _run_starts(kept: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Where, in ``kept``, the runs of neighbouring places with one owner start."""
    return np.flatnonzero(np.concatenate([[True], (np.diff(kept) > 1) | (np.diff(owner[kept]) > 0)]))


def _marked(pieces: list[bytes], anchors: list[int]) -> list[int]:
    """Numbers of the pieces that share a run of phrases over ``CORE`` bytes with another place of their anchor, by suffix array.

    Phrases that no such run can hold are left out of the array.
    """
    joined = b"".join(pieces)
    begins = np.cumsum([0] + [len(p) for p in pieces])
    hasher = SliceHasher(joined)
    cuts = np.unique(np.concatenate([least_places(hasher.grams(PHRASE_GRAM), PHRASE_REACH), begins[:-1]]))
    ends = np.concatenate([cuts[1:], [len(joined)]])
    owner = np.searchsorted(begins, cuts, side="right") - 1
    lengths = ends - cuts
    names = hasher.slices(cuts, ends) + lengths.astype(np.uint64) + mix(np.array(anchors, np.int64).view(np.uint64))[owner]
    kept = _repeatable(names, lengths, owner)
    if not len(kept):
        return []
    opens = _run_starts(kept, owner)
    # A zero before each run; a phrase's number in the array is its own plus those of the zeros so far.
    symbols = np.insert(np.unique(names[kept], return_inverse=True)[1] + 1, opens, 0)
    upto = np.concatenate([[0], np.cumsum(np.insert(lengths[kept], opens, 0))])
    piece = np.insert(owner[kept], opens, owner[kept][opens])
    sequence = symbols.tolist()
    order = suffix_array(sequence)
    shared = np.array(common_prefixes(sequence, order, 0))
    order = np.array(order)
    here = np.flatnonzero(shared)
    long = here[upto[order[here] + shared[here]] - upto[order[here]] >= CORE]
    return np.unique(np.concatenate([piece[order[long]], piece[order[long - 1]]])).tolist()


def _repeated_starts(pieces: list[bytes]) -> list[np.ndarray]:
    """For each piece, starts of windows that stand at another place of the pieces too."""
    joined = b"".join(pieces)
    begins = np.cumsum([0] + [len(p) for p in pieces])
    windows = SliceHasher(joined).grams(LENGTH)
    own = [np.arange(a, b - LENGTH + 1) for a, b in zip(begins[:-1], begins[1:])]
    at = np.concatenate(own)
    _, which, count = np.unique(windows[at], return_inverse=True, return_counts=True)
    again = (count > 1)[which]
    bounds = np.cumsum([len(o) for o in own])[:-1]
    return [o[k] - o[0] if len(o) else o for o, k in zip(own, np.split(again, bounds))]


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """First and last of the runs of neighbouring starts."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate([[0], breaks + 1])].tolist(), starts[np.concatenate([breaks, [len(starts) - 1]])].tolist()))


def sorted_spans(contexts: DataFrame) -> DataFrame:
    """class, at, upto of repeated bytes, from (anchor, class, lo, bytes) rows whose anchors lie together."""

    def spans(rows: list[tuple]) -> list[tuple]:
        marked = [rows[i] for i in _marked([r[3] for r in rows], [r[0] for r in rows])]
        found = []
        if marked:
            for (_, name, lo, _), starts in zip(marked, _repeated_starts([r[3] for r in marked])):
                found += [(name, lo + a, lo + b + LENGTH) for a, b in _runs(starts)]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in slices(batches):
            found: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "class", "lo", "bytes"))):
                if size > BATCH_BYTES and row[0] != rows[-1][0]:
                    found += spans(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
            yield as_batch(found)
        if rows:
            yield as_batch(spans(rows))

    def as_batch(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["class", "at", "upto"])

    return contexts.mapInArrow(run, "class bigint, at bigint, upto bigint")


def counted_spans(contexts: DataFrame) -> DataFrame:
    """The same from windows counted by Spark, for anchors with very many regions."""
    starts = F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - LENGTH)).alias("shift")
    one = contexts.select("class", "lo", "bytes", starts)
    window = F.substring("bytes", F.col("shift") + 1, F.lit(LENGTH))
    one = one.select("class", (F.col("lo") + F.col("shift")).alias("at"), F.xxhash64(window).alias("x"), F.md5(window).alias("y"))
    again = one.groupBy("x", "y").count().where("count > 1")
    found = one.join(stage(again.select("x", "y"), "windows"), ["x", "y"], "left_semi")
    return found.select("class", "at", (F.col("at") + LENGTH).alias("upto"))


def repeated_spans(docs: DataFrame, regions_per_anchor: int = REGIONS_PER_ANCHOR) -> DataFrame:
    """class (hash of a text) and ``spans``: (at, upto) runs of bytes to remove, not merged; -1 is the end of the text."""
    docs = only(docs, doc_id="bigint", text="string")
    texts = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("class"), "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    copies = texts.groupBy("class").agg(F.count("*").alias("n")).where("n > 1")
    whole = copies.select("class", F.lit(0).cast("bigint").alias("at"), F.lit(-1).cast("bigint").alias("upto"))
    with passing(docs.sparkSession) as keep:
        full, wanted = _full_and_wanted(texts)
        contexts = _contexts(texts, wanted)
        small = contexts.where(F.col("regions") <= regions_per_anchor).select("anchor", "class", "lo", "bytes")
        found = stage(sorted_spans(small.repartition("anchor").sortWithinPartitions("anchor")), "sorted-spans")
        hot = counted_spans(contexts.where(F.col("regions") > regions_per_anchor))
        spans = whole.union(full).union(found).union(hot)
        return keep(spans.groupBy("class").agg(F.collect_set(F.struct("at", "upto")).alias("spans")), "spans")


def _full_and_wanted(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans of regions with the same bytes in two places, and the regions whose windows must be compared, with the number of their anchor."""
    with passing(texts.sparkSession) as keep:
        with passing(texts.sparkSession) as hand_on:
            rows = region_rows(texts)
            twice = stage(rows.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
            rows = hand_on(rows.join(twice, "anchor"), "regions")
        counts = stage(rows.groupBy("anchor", "region").agg(F.count("*").alias("n")), "region-counts")
        full = rows.join(stage(counts.where("n > 1").select("anchor", "region"), "full"), ["anchor", "region"], "left_semi")
        full = keep(full.select("class", F.col("lo").alias("at"), (F.col("hi") + LENGTH).alias("upto")), "full-spans")

        # One row per distinct region of anchors that have a region of their own among several.
        edges = counts.groupBy("anchor").agg(F.count("*").alias("regions"), F.min("n").alias("least")).where("regions > 1 and least = 1")
        distinct = rows.join(stage(edges.select("anchor"), "edges"), "anchor").groupBy("anchor", "region").agg(
            F.min(F.struct("class", "doc_id", "lo", "hi", "lside", "rside")).alias("r")
        )
        distinct = stage(distinct.select("anchor", "r.*"), "distinct-regions")
        sides = distinct.select("anchor", F.explode(F.array(F.struct(F.lit(0).alias("s"), F.col("lside").alias("h")), F.struct(F.lit(1).alias("s"), F.col("rside").alias("h")))).alias("side"))
        agreed = sides.where("side.h <> 0").groupBy("anchor", "side").agg(F.count("*").alias("n")).where("n > 1")
        agreed = stage(agreed.select("anchor", "side.s", "side.h"), "sides")
        by = lambda s, column: distinct.join(agreed.where(F.col("s") == s).select("anchor", F.col("h").alias(column)), ["anchor", column], "left_semi")
        columns = ["anchor", "class", "doc_id", "lo", "hi"]
        wanted = stage(by(0, "lside").select(columns).union(by(1, "rside").select(columns)).distinct(), "wanted")
        sizes = stage(wanted.groupBy("anchor").agg(F.count("*").alias("regions")), "sizes")
        return full, keep(wanted.join(sizes, "anchor"), "sized")


def _contexts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """anchor, class, lo, regions and the bytes of the ``wanted`` regions."""
    with passing(texts.sparkSession) as keep:
        listed = wanted.groupBy("class", "doc_id").agg(F.collect_list(F.struct("anchor", "lo", "hi", "regions")).alias("list"))
        listed = stage(listed.select(F.col("class").alias("c"), F.col("doc_id").alias("d"), "list"), "listed")
        held = texts.join(listed, (F.col("class") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("d")))
        held = held.select("class", "data", F.explode("list").alias("r"))
        cut = F.substring("data", (F.col("r.lo") + 1).cast("int"), (F.col("r.hi") - F.col("r.lo") + LENGTH).cast("int"))
        return keep(held.select("r.anchor", "class", "r.lo", "r.regions", cut.alias("bytes")).distinct(), "contexts")


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes that remain) of every document."""
    docs = only(docs, doc_id="bigint", text="string")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("data")).withColumn("class", F.xxhash64("data"))
    joined = docs.join(spans, "class", "left").select("doc_id", F.col("data").cast("binary"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for data, spans in zip(batch.column("data").to_pylist(), batch.column("spans").to_pylist()):
                parts, at, runs, end = [], 0, 0, -1
                n = len(data)
                for a, b in sorted((s["at"], n if s["upto"] < 0 else s["upto"]) for s in spans or ()):
                    if n >= LENGTH:
                        runs += a > end
                        end = max(end, b)
                        parts.append(data[at:a])
                        at = max(at, b)
                kept = b"".join(parts) + data[at:]
                rows.append((n, n - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def op4_lyndon_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return remove_spans(docs, repeated_spans(docs)).drop("kept")
