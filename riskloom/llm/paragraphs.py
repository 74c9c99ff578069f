"""Substring dedup by MinHash banding of paragraphs.

Paragraphs (all lines with words) get MinHash signatures over windows of five words, cut into
bands that are tuned for recall: at Jaccard 0.8 a pair shares one of 8 bands of 3 rows with
probability 0.997. A line of fewer words is one window by itself. Sets of fewer than ``EXACT``
windows reach 0.8 with equal ones only, so their class decides without bands. Paragraphs that collide in a band are verified on
their exact sets of windows and linked at 0.8 or more; each component keeps its first
occurrence (least document, then least place) and the others are removed.

A passage that was pasted into the middle of a longer paragraph is not one of the lines.
It is found as a paragraph of its own: every text also has blocks of ``BLOCK`` words that
start at anchors, words chosen as the least hash of any ``REACH`` neighbouring windows, so
the same passage has the same blocks wherever it stands. Blocks are as short as to lie
inside any passage of 50 words, and collide only when all their words agree. Each is then
extended, word by word in both directions, as far as any earlier occurrence of the block
reads the same: first against the block's first occurrence, then among those that leave it
at the same word in the same way, and so on. A longer run holds a further block, so that
the spans of one run touch, and the whole run is removed. Blocks that read the same on a side for as far
as is looked share one row there, and only where such rows differ are all their words brought together.

In a band's bucket each paragraph is compared with the least one, and only buckets that
still hold different components are joined in full, behind bounds on length and on parity
bits that no linked pair can fail; so a big group of copies is not expanded into pairs.

Defined cases: null, empty and blank texts have no paragraphs and lose nothing; rows repeated with the same id stand in the same places, so they are
kept or removed alike; a null id sorts first; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import only, slices, table
from riskloom.llm.graph import components
from riskloom.llm.hashing import WindowHasher, WordTable, least_places, mix
from riskloom.llm.ngram_join import PARITY, linked
from riskloom.sources.staging import passing, release, stage

#: Words per window, and least Jaccard similarity in percent.
WINDOW, PERCENT = 5, 80
#: Least windows of a set that another set can be linked with: n of n + 1 windows are the percentage.
EXACT = -(-PERCENT // (100 - PERCENT))
#: Paragraphs whose parity bits are counted at once.
COUNTED = 4096
BANDS, ROWS = 8, 3
#: Words per block, and windows of three words among which one starts a block: 20 + 28 + 2 words hold a whole block.
BLOCK, REACH, ANCHOR = 20, 28, 3
#: Words on each side of a block that are compared: a run beyond them holds a block nearer to its end.
AROUND = REACH + ANCHOR - 1
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))

SPAN = "doc_id bigint, at bigint, upto bigint"


class Paragraphs:
    """The paragraphs of several texts, with their distinct windows one paragraph after the other."""

    def __init__(self, texts: list[str | None], hasher: WindowHasher):
        words = WordTable(texts, hasher)
        counts = np.bincount(words.line)
        chosen = np.flatnonzero(counts)
        last = np.cumsum(counts)[chosen]
        first = last - counts[chosen]
        self.text = words.text[first]
        self.at, self.upto = words.at[first], words.upto[last - 1]
        number = np.full(len(counts) + 1, -1)
        number[chosen] = np.arange(len(chosen))
        n = len(words.hashes) - WINDOW + 1
        inside = np.flatnonzero(words.line[: max(n, 0)] == words.line[WINDOW - 1 :])
        owners, sets = [number[words.line[inside]]], [hasher.joined(words.hashes)[inside]]
        for width in range(1, WINDOW):
            short = np.flatnonzero(last - first == width)
            whole = np.full(len(short), width, np.uint64)
            for i in range(width):
                whole = mix(whole + _SEEDS[1]) + words.hashes[first[short] + i]
            owners.append(short)
            sets.append(mix(whole))
        owner, windows = np.concatenate(owners), np.concatenate(sets)
        # One key of both sorts faster than two; it is enough unless windows of a paragraph differ in their low bits alone.
        key = (owner.astype(np.uint64) << np.uint64(40)) | (windows >> np.uint64(24))
        order = np.argsort(key)
        if np.any((key[order][1:] == key[order][:-1]) & (windows[order][1:] != windows[order][:-1])):
            order = np.lexsort((windows, owner))
        owner, windows = owner[order], windows[order]
        fresh = np.flatnonzero((owner != np.roll(owner, 1)) | (windows != np.roll(windows, 1)) | (np.arange(len(owner)) == 0))
        self.owner, self.windows = owner[fresh], windows[fresh]
        self.sizes = np.bincount(self.owner, minlength=len(chosen))
        self.starts = np.cumsum(self.sizes) - self.sizes
        # A set's name: the sum of its scrambled windows, scrambled with its size.
        sums = np.add.reduceat(mix(self.windows ^ _SEEDS[0]), self.starts) if len(chosen) else np.zeros(0, np.uint64)
        self.classes = mix(sums + self.sizes.astype(np.uint64)).view(np.int64)

    def bands(self) -> np.ndarray:
        """One row of band hashes per paragraph. The least of scrambled hashes after one more exclusive or is a MinHash."""
        found = np.empty((len(self.sizes), BANDS), np.uint64)
        for band in range(BANDS):
            found[:, band] = band
            for seed in _SEEDS[band * ROWS : (band + 1) * ROWS]:
                found[:, band] = mix(found[:, band]) + np.minimum.reduceat(self.windows ^ seed, self.starts)
        return mix(found).view(np.int64)

    def parity(self) -> np.ndarray:
        width = 64 * len(PARITY)
        parts = [np.zeros((0, len(PARITY)), np.int64)]
        for low in range(0, len(self.sizes), COUNTED):
            n = min(COUNTED, len(self.sizes) - low)
            of = slice(self.starts[low], self.starts[low + n - 1] + self.sizes[low + n - 1])
            cells = (self.owner[of] - low) * width + (self.windows[of] & np.uint64(width - 1)).astype(np.int64)
            bits = np.bincount(cells, minlength=n * width) & 1
            parts.append(np.packbits(bits.astype(np.uint8).reshape(-1, width), axis=1).view(np.int64))
        return np.concatenate(parts)


def paragraph_rows(docs: DataFrame) -> DataFrame:
    """A row per paragraph; the first of its class in a task also has its bands and parity bits, if it has enough windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, met = WindowHasher(WINDOW), set()
        for batch in slices(batches):
            found = Paragraphs(batch.column("text").to_pylist(), hasher)
            if not len(found.sizes):
                continue
            known = []
            for name in found.classes.tolist():
                known.append(name in met)
                met.add(name)
            known = np.array(known)
            ids = batch.column("doc_id").take(pa.array(found.text))
            bands = pa.FixedSizeListArray.from_arrays(pa.array(found.bands().ravel(), pa.int64()), BANDS).cast(pa.list_(pa.int64()))
            parity = [pa.array(p, pa.int64()) for p in found.parity().T]
            columns = [pa.array(c, pa.int64()) for c in (found.at, found.upto, found.classes, found.sizes)]
            yield pa.RecordBatch.from_arrays([ids, *columns, pa.array(~known & (found.sizes >= EXACT)), bands, *parity], names)

    names = ["doc_id", "at", "upto", "class", "n", "first", "bands", *PARITY]
    rest = ", ".join(f"{p} bigint" for p in PARITY)
    rows = docs.mapInArrow(run, f"{SPAN}, class bigint, n bigint, first boolean, bands array<bigint>, {rest}")
    # Signatures of further copies are dropped before anything is written.
    return rows.select("doc_id", "at", "upto", "class", "n", *[F.when(F.col("first"), F.col(c)).alias(c) for c in ("bands", *PARITY)])


def paragraph_sets(docs: DataFrame) -> DataFrame:
    """class and its sorted windows, as bytes, of every paragraph of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WindowHasher(WINDOW)
        for batch in slices(batches):
            found = Paragraphs(batch.column("text").to_pylist(), hasher)
            sets = [found.windows[a : a + n].tobytes() for a, n in zip(found.starts.tolist(), found.sizes.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(found.classes, pa.int64()), pa.array(sets, pa.binary())], ["class", "windows"])

    return docs.select("text").mapInArrow(run, "class bigint, windows binary")


def _block_hashes(hashes: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = second = np.full(len(chosen), BLOCK, np.uint64)
    for i in range(BLOCK):
        first = mix(first) + hashes[chosen + i]
        second = mix(second ^ _SEEDS[0]) ^ hashes[chosen + i]
    return mix(first).view(np.int64), mix(second).view(np.int64)


def block_rows(docs: DataFrame) -> DataFrame:
    """A row per anchored block: its place and two hashes of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WindowHasher(ANCHOR)
        for batch in slices(batches):
            words = WordTable(batch.column("text").to_pylist(), hasher)
            if len(words.hashes) < BLOCK + REACH + ANCHOR - 1:
                continue
            least = least_places(hasher.joined(words.hashes), REACH)
            # Anchors of reaches inside one text, with room for a block.
            inside = words.text[: len(least)] == words.text[REACH + ANCHOR - 2 : REACH + ANCHOR - 2 + len(least)]
            chosen = np.unique(least[inside])
            chosen = chosen[chosen + BLOCK <= len(words.hashes)]
            chosen = chosen[words.text[chosen] == words.text[chosen + BLOCK - 1]]
            first, second = _block_hashes(words.hashes, chosen)
            columns = words.at[chosen], words.upto[chosen + BLOCK - 1], first, second
            ids = batch.column("doc_id").take(pa.array(words.text[chosen]))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.int64()) for c in columns]], names)

    names = ["doc_id", "at", "upto", "block", "check"]
    return docs.mapInArrow(run, f"{SPAN}, block bigint, check bigint")


def _lists(values: np.ndarray, there: np.ndarray) -> pa.Array:
    ends = pa.array(np.r_[0, np.cumsum(there.sum(axis=1))], pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(values[there].view(np.int64)))


def surroundings(texts: DataFrame) -> DataFrame:
    """For the blocks that start at bytes of each text: the words on one side (0 before, 1 after), nearest first.

    ``places`` has 2 * byte + side of what is asked for.
    ``chain`` has a hash of the nearest word, of the nearest two, and so on, ``edges`` the byte where each of these runs ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WindowHasher(ANCHOR)
        for batch in slices(batches, 64):
            words = WordTable(batch.column("text").to_pylist(), hasher)
            wanted = batch.column("places")
            text = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy())
            wanted = wanted.flatten().to_numpy()
            asked, wanted = wanted & 1, (text << 40) | (wanted >> 1)
            known = (words.text << 40) | words.at
            # Rows that repeat an id may have another text, without a word or a block there.
            chosen = np.searchsorted(known, wanted)
            inside = chosen + BLOCK <= len(known)
            chosen, wanted, asked = chosen[inside], wanted[inside], asked[inside]
            if not len(chosen):
                continue
            there = (known[chosen] == wanted) & (words.text[chosen] == words.text[chosen + BLOCK - 1])
            every, asked = chosen[there], asked[there]
            for side in (0, 1):
                chosen = every[asked == side]
                if not len(chosen):
                    continue
                first, second = _block_hashes(words.hashes, chosen)
                ids = batch.column("doc_id").take(pa.array(words.text[chosen]))
                own = [pa.array(c, pa.int64()) for c in (words.at[chosen], words.upto[chosen + BLOCK - 1], first, second)]
                steps = np.arange(1, AROUND + 1)
                places = chosen[:, None] + (BLOCK - 1 + steps if side else -steps)
                there = (places >= 0) & (places < len(known))
                places = np.where(there, places, 0)
                there &= words.text[places] == words.text[chosen][:, None]
                chain, last = np.empty(places.shape, np.uint64), np.zeros(len(chosen), np.uint64)
                for i in range(AROUND):
                    last = chain[:, i] = mix(last + _SEEDS[side]) + words.hashes[places[:, i]]
                edges = (words.upto if side else words.at)[places]
                sides = pa.array(np.full(len(chosen), side), pa.int32())
                yield pa.RecordBatch.from_arrays([ids, *own, sides, _lists(chain, there), _lists(edges, there)], names)

    names = ["doc_id", "at", "upto", "block", "check", "side", "chain", "edges"]
    return texts.select("doc_id", "text", "places").mapInArrow(run, f"{SPAN}, block bigint, check bigint, side int, chain array<bigint>, edges array<bigint>")


def _around(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``surroundings``, with the cluster, of the blocks in ``id``, ``at`` and ``side``."""
    coded = places.groupBy("id").agg(F.collect_set(2 * F.col("at") + F.col("side")).alias("places"))
    texts = docs.join(stage(coded, "block-places"), F.col("doc_id").eqNullSafe(F.col("id")))
    return surroundings(texts).withColumn("cluster", F.xxhash64("block", "check")).drop("block", "check")


def _extended(docs: DataFrame, found: DataFrame) -> DataFrame:
    """id, block_at, cluster, and the span that the block has in common with earlier occurrences of it."""
    with passing(docs.sparkSession) as keep:
        d = F.coalesce("doc_id", F.lit(-(1 << 62)))
        none = F.when(F.col("side") == 0, F.col("at")).otherwise(F.col("upto"))
        with passing(docs.sparkSession) as hand_on:
            places = found.select(F.col("doc_id").alias("id"), "at", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
            n = F.size("chain")
            # The hash of all words on a side, and where they end.
            whole, furthest = (F.when(n > 0, F.element_at(c, F.greatest(n, F.lit(1)))) for c in ("chain", "edges"))
            reaches = _around(docs, places).select("doc_id", "at", "cluster", "side", n.alias("n"), F.coalesce(whole, F.lit(0)).alias("whole"), F.coalesce(furthest, none).alias("edge"))
            reaches = stage(reaches, "reaches")
            same = ["cluster", "side", "n", "whole"]
            firsts = reaches.groupBy(*same).agg(F.min(F.struct(d.alias("d"), "at", "doc_id")).alias("head"), F.count("*").alias("times"))
            firsts = stage(firsts, "firsts")
            later = reaches.join(firsts.where("times > 1").drop("times"), same).where((d != F.col("head.d")) | (F.col("at") != F.col("head.at")))
            # As far as is looked, these read like an earlier one.
            spans = [hand_on(later.select("doc_id", "at", "cluster", "side", "edge"), "whole-runs")]
            several = firsts.groupBy("cluster", "side").count().where("count > 1").select("cluster", "side")
            others = firsts.join(stage(several, "several"), ["cluster", "side"])
            rows = _around(docs, others.select(F.col("head.doc_id").alias("id"), "head.at", "side"))
            rows = hand_on(rows.withColumn("key", F.col("cluster")), "surroundings")
        for level in range(AROUND + 1):
            heads = rows.groupBy("side", "key").agg(F.min(F.struct(d.alias("d"), "at", "chain")).alias("head"), F.count("*").alias("n"))
            heads = stage(heads.where("n > 1").drop("n"), "run-heads")
            if heads.isEmpty():
                break
            # Hashes of runs agree up to the first word that differs.
            same = F.size(F.filter(F.zip_with("chain", "head.chain", lambda x, y: x == y), lambda x: x))
            later = rows.join(heads, ["side", "key"]).where((d != F.col("head.d")) | (F.col("at") != F.col("head.at")))
            later = later.withColumn("n", same)
            edge = F.when(F.col("n") > 0, F.element_at("edges", F.greatest(F.col("n"), F.lit(1)))).otherwise(none)
            # Words are written again only for those that another one may follow further.
            left = F.col("n") < F.size("chain")
            key = F.when(left, F.xxhash64("key", F.element_at("chain", F.least(F.col("n") + 1, F.size("chain")))))
            words = [F.when(left, F.col(c)).alias(c) for c in ("chain", "edges")]
            later = stage(later.select("doc_id", "at", "upto", "cluster", "side", *words, key.alias("key"), edge.alias("edge")), "runs")
            spans.append(stage(later.select("doc_id", "at", "cluster", "side", "edge"), "run-ends"))
            before, rows = rows, stage(later.where("key is not null").drop("edge"), "rows")
            release(before, heads, later)
        before, after = F.min(F.when(F.col("side") == 0, F.col("edge"))), F.max(F.when(F.col("side") == 1, F.col("edge")))
        every = reduce(DataFrame.union, spans)
        every = every.groupBy(F.col("doc_id").alias("id"), F.col("at").alias("block_at"), F.col("cluster").alias("of"))
        return keep(every.agg(before.alias("from"), after.alias("to")), "extended")


def _repeated_blocks(docs: DataFrame) -> DataFrame:
    """Blocks whose words stand in two places, all occurrences: doc_id, at, upto, cluster, kept."""
    with passing(docs.sparkSession) as keep:
        blocks = stage(block_rows(docs), "all-blocks")
        twice = blocks.groupBy("block").count().where("count > 1").select("block")
        found = stage(blocks.join(stage(twice, "twice"), "block"), "blocks")
        order = F.struct(F.coalesce("doc_id", F.lit(-(1 << 62))).alias("d"), "at")
        heads = found.groupBy("block", "check").agg(F.min(order).alias("head"), F.count("*").alias("n")).where("n > 1")
        found = found.join(stage(heads, "heads"), ["block", "check"])
        found = found.select("doc_id", "at", "upto", F.xxhash64("block", "check").alias("cluster"), (order == F.col("head")).alias("kept"))
        found = keep(found, "repeated-blocks")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("at") == F.col("block_at")) & (F.col("cluster") == F.col("of")) & ~F.col("kept")
    joined = found.join(_extended(docs, found), same, "left")
    return joined.select("doc_id", F.coalesce("from", "at").alias("at"), F.coalesce("to", "upto").alias("upto"), "cluster", "kept")


def _alike(x: str, y: str) -> Column:
    """What every linked pair fulfils: near lengths, and few differing parity bits."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    differ = sum((F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))) for p in PARITY), F.lit(0))
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & ((100 + PERCENT) * differ <= (100 - PERCENT) * (n + m))


def _verified(joined: DataFrame, held: DataFrame, docs: DataFrame) -> DataFrame:
    x, y = F.col("x.class"), F.col("y.class")
    with passing(docs.sparkSession) as keep:
        pairs = stage(joined.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct(), "pairs")
        wanted = stage(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct(), "wanted")
        ids = stage(held.join(wanted, "class").select(F.col("doc_id").alias("id")).distinct(), "ids")
        texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
        sets = stage(paragraph_sets(texts).join(wanted, "class", "left_semi").dropDuplicates(["class"]), "sets")
        both = pairs.join(sets.select(F.col("class").alias("b"), F.col("windows").alias("right")), "b")
        both = both.join(sets.select(F.col("class").alias("a"), F.col("windows").alias("left")), "a")
        return keep(linked(both, PERCENT), "links")


def _repeated_paragraphs(docs: DataFrame) -> DataFrame:
    """Paragraphs with a like elsewhere, all occurrences: doc_id, at, upto, cluster, kept."""
    with passing(docs.sparkSession) as keep:
        rows = stage(paragraph_rows(docs), "paragraphs")
        signed = rows.where("bands is not null")
        bands = signed.select("class", F.explode("bands").alias("band"))
        shared = bands.groupBy("band").agg(F.min("class").alias("head"), F.max("class").alias("last")).where("head <> last")
        shared = stage(shared.select(F.col("band").alias("of"), "head"), "buckets")
        lists = stage(bands.join(shared, F.col("band") == F.col("of")).select("class", "band", "head").distinct(), "lists")
        held = signed.join(stage(lists.select("class").distinct(), "active"), "class").dropDuplicates(["class"])
        held = stage(held.drop("bands", "at", "upto"), "classes")
        bits = held.drop("doc_id")
        lists = stage(lists.join(bits, "class"), "collisions")
        heads = bits.join(stage(lists.select(F.col("head").alias("class")).distinct(), "head-names"), "class", "left_semi")
        stars = lists.alias("x").join(stage(heads, "heads").alias("y"), F.col("x.head") == F.col("y.class"))
        links = _verified(stars.where((F.col("x.class") != F.col("y.class")) & _alike("x", "y")), held, docs)

        grouped = lists.join(components(links), F.col("class") == F.col("node"), "left")
        grouped = grouped.withColumn("component", F.coalesce("component", "class")).drop("node", "head")
        mixed = grouped.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
        rest = stage(grouped.join(stage(mixed.select("band"), "mixed"), "band"), "mixed-lists")
        across = rest.alias("x").join(
            rest.alias("y"),
            (F.col("x.band") == F.col("y.band")) & (F.col("x.component") < F.col("y.component")) & _alike("x", "y"),
        )
        links = links.union(_verified(across, held, docs))

        found = components(links)
        named = rows.select("doc_id", "at", "upto", "class").join(found, F.col("class") == F.col("node"), "left")
        named = stage(named.select("doc_id", "at", "upto", F.coalesce("component", "class").alias("cluster")), "clusters")
        order = F.struct(F.coalesce("doc_id", F.lit(-(1 << 62))).alias("d"), "at")
        firsts = named.groupBy("cluster").agg(F.min(order).alias("head"), F.count("*").alias("n")).where("n > 1")
        named = named.join(stage(firsts, "firsts"), "cluster")
        return keep(named.select("doc_id", "at", "upto", "cluster", (order == F.col("head")).alias("kept")), "repeated-paragraphs")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, at, upto (bytes of the UTF-8 text), cluster, kept of every repeated paragraph and block."""
    docs = only(docs, doc_id="bigint", text="string")
    with passing(docs.sparkSession) as keep:
        return keep(_repeated_paragraphs(docs).union(_repeated_blocks(docs)), "repeats")


def removed_bytes(spans: Column) -> Column:
    """Bytes and number of the runs that (at, upto) spans cover together."""
    walked = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(-1).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans")),
        lambda s, x: F.struct(
            F.greatest(s["end"], x["upto"]).alias("end"),
            (s["n_removed"] + F.greatest(x["upto"] - F.greatest(x["at"], s["end"]), F.lit(0))).alias("n_removed"),
            (s["n_spans"] + F.when(x["at"] > s["end"], 1).otherwise(0)).alias("n_spans"),
        ),
    )
    return F.struct(walked["n_removed"].alias("n_removed"), walked["n_spans"].alias("n_spans"))


def op2_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes, repeated paragraphs and blocks, and what is removed of it."""
    docs = table(spark, sf_dir, "documents")
    with passing(spark) as keep:
        spans = repeated_spans(docs)
        # A document's own spans: as many as it has paragraphs and blocks, however often they stand elsewhere.
        own = F.collect_set(F.when(~F.col("kept"), F.struct("at", "upto")))
        per_doc = spans.groupBy("doc_id").agg(F.count("*").alias("n_repeated"), own.alias("spans"))
        per_doc = keep(per_doc.select(F.col("doc_id").alias("id"), "n_repeated", removed_bytes(F.col("spans")).alias("r")), "per-document")
    sizes = only(docs, doc_id="bigint", text="string").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    none = F.lit(0).cast("bigint")
    return sizes.join(per_doc, F.col("doc_id").eqNullSafe(F.col("id")), "left").select(
        "doc_id", "n_bytes", F.coalesce("n_repeated", none).alias("n_repeated"),
        F.coalesce("r.n_removed", none).alias("n_removed"), F.coalesce("r.n_spans", none).alias("n_spans"),
    )
