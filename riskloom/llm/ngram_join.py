"""N-gram Jaccard join by filtering under several global token orders.

Two documents link when the Jaccard similarity of their sets of word windows reaches a
threshold. Documents with equal sets are one class; the join is between classes. If two
sets of sizes m and n link, they share at least ``need`` windows, so under *any* global
order of windows their first ``n - ceil(t n) + 1`` share one. Three orders are used:
windows of rare words first (by counts of the words of all documents in a fixed number of
buckets), and two by scrambled hash.

A single window, even a rare one, is shared by ever more unrelated texts as a corpus grows. So the lists that
give candidates are of *parts*: hashing deals a set's windows to a number of cells that all sets of near sizes
have in common, and a cell with what is in it is a part. Linked sets differ in at most d windows, hence in at most d
of their parts, and the same law holds for these: under any global order the first d + 1 parts of both
share one. Parts of many windows come first, so that unrelated texts share hardly any. Sizes are cut into bands by
the ratio that links allow; a set has parts for its own band and for the next larger one.

A candidate must also pass the length filter, a bound on the symmetric difference from 512 parity bits,
must share a window of its prefixes under each of the three orders, and as many under the first as
that one is longer for it. Only then are both sets brought together and compared.

All filters keep every link. Components need fewer pairs than there are links: each class is
compared with the heads of most of its lists alone, lists that hold one component by then
are done, and the others get new heads, until few of a turn's pairs are links. Then the pairs of
different components in the lists that are left are looked at. A big group of near copies so costs
a few pairs per copy and turn, not one for any two copies.

Defined cases: a null, empty or blank text has an empty set and is linked with nothing;
a text shorter than a window is one window; repeated rows and copies share a component; a
null id takes part, but cannot be a component's name unless no member has an id; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import content_hash, only, slices, table
from riskloom.llm.graph import components
from riskloom.llm.hashing import TextHasher, WindowHasher, mix
from riskloom.sources.staging import passing, release, stage

#: Buckets that words are counted in for the first order; the driver holds this many numbers.
COUNT_BUCKETS = 1 << 16
#: Seeds of the other orders.
OTHER_ORDERS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)
#: One more window in the first order's prefix for so many in the set; a link then shares one more of them.
SPARE = 64
#: Scrambles windows before they are dealt to cells.
CELL_SEED = np.uint64(0x2545F4914F6CDD1D)
#: Heads that a class is compared with in one turn.
HEADS = 3
#: Parts of a class that each of its postings brings to the last pairs.
FIRSTS = 8
#: Another turn of stars follows one in which a pair of so many was a link.
PAYS = 4
#: 64-bit words of parity bits per class.
PARITY_WORDS = 8
PARITY = [f"parity_{i}" for i in range(PARITY_WORDS)]


def _bucket(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(48)).astype(np.int64) & (COUNT_BUCKETS - 1)


def class_of(windows: np.ndarray) -> int:
    """Name of a sorted set of windows."""
    return int(np.array([xxhash.xxh3_64_intdigest(windows.tobytes())], np.uint64).view(np.int64)[0])


def _least_shared(n: int, percent: int) -> int:
    """Windows that a set of ``n`` shares at least with any set it links with."""
    return -(-percent * n // 100)


def parity_bits(windows: np.ndarray) -> np.ndarray:
    bits = np.bincount((windows & np.uint64(PARITY_WORDS * 64 - 1)).astype(np.int64), minlength=PARITY_WORDS * 64) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """Words of all documents in each bucket, counted in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = TextHasher(), np.zeros(COUNT_BUCKETS, np.int64)
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                np.add.at(seen, _bucket(hasher.words(text)), 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["bucket", "seen"])

    counts = np.zeros(COUNT_BUCKETS, np.int64)
    for bucket, seen in docs.select("text").mapInArrow(run, "bucket bigint, seen bigint").groupBy("bucket").agg(F.sum("seen")).collect():
        counts[bucket] = seen
    return counts


class Parts:
    """The parts of sets of windows, by which linked sets find each other."""

    def __init__(self, percent: int):
        self.percent = percent
        self.lows = [1]

    def differing(self, sizes: int) -> int:
        """Most windows that only one of two linked sets has, if they have ``sizes`` in sum."""
        return (100 - self.percent) * sizes // (100 + self.percent)

    def band(self, n: int) -> int:
        """Number of the band that size ``n`` is in; sizes of linked sets are in one band or in neighbouring ones."""
        while len(self.lows) < 3 or self.lows[-3] <= n:
            self.lows.append(100 * self.lows[-1] // self.percent + 1)
        return bisect_right(self.lows, n) - 1

    def of(self, windows: np.ndarray) -> np.ndarray:
        """Names of the first parts of a set, those of many windows first. Sets that link with no other one have none."""
        n, found = len(windows), [np.zeros(0, np.uint64)]
        if not n:
            return found[0]
        most, mine = 100 * n // self.percent, self.band(n)
        hashes = mix(windows ^ CELL_SEED)
        for band in (mine, mine + 1):
            low, high = self.lows[band], self.lows[band + 1] - 1
            differing = self.differing(n + min(most, high))
            if most < low or not differing:
                continue
            widest = self.differing(2 * high)
            cells = widest + widest // 2 + 2
            cell = ((hashes >> np.uint64(32)) % np.uint64(cells)).astype(np.int64)
            sizes, sums = np.bincount(cell, minlength=cells), np.zeros(cells, np.uint64)
            np.add.at(sums, cell, hashes)
            names = mix(mix(sums + sizes.astype(np.uint64)) + (np.uint64(band) << np.uint64(32)) + np.arange(cells, dtype=np.uint64))
            found.append(names[np.lexsort((names, -sizes))[: differing + 1]])
        return np.concatenate(found)


def describe(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """A row per document: doc_id, content, n, class, and parts for the first row of a class in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, joiner, parts, met = TextHasher(), WindowHasher(size), Parts(percent), set()
        for batch in slices(batches):
            rows: list[tuple] = []
            for text in batch.column("text").to_pylist():
                windows = np.unique(joiner.joined(hasher.words(text)))
                name = class_of(windows) if len(windows) else None
                known = name is None or name in met
                rows.append((len(windows), name, None if known else parts.of(windows).view(np.int64)))
                met.add(name)
            columns = list(zip(*rows)) if rows else [()] * 3
            arrays = [pa.array(c, pa.int64()) for c in columns[:2]] + [pa.array(columns[2], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("content"), *arrays], names)

    names = ["doc_id", "content", "n", "class", "parts"]
    return docs.mapInArrow(run, "doc_id bigint, content bigint, n bigint, class bigint, parts array<bigint>")


def prefixes(docs: DataFrame, counts: np.ndarray, size: int, percent: int) -> DataFrame:
    """class, its prefixes in the three orders and its parity bits, of every document with words."""

    # A word's weight grows with its count; a window's is the sum, in steps of 1/16 of a doubling.
    weights = np.round(16 * np.log2(counts + 1)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, joiner = TextHasher(), WindowHasher(size)
        for batch in slices(batches):
            rows: list[tuple] = []
            for text in batch.column("text").to_pylist():
                words = hasher.words(text)
                windows, where = np.unique(joiner.joined(words), return_index=True)
                if not len(windows):
                    continue
                first = len(windows) - _least_shared(len(windows), percent) + 1
                sums = np.concatenate([[0], np.cumsum(weights[_bucket(words)])])
                common = sums[np.minimum(where + size, len(words))] - sums[where]
                rare = windows[np.lexsort((windows, common))[: first + len(windows) // SPARE]]
                others = [np.sort(mix(windows ^ np.uint64(seed)) >> np.uint64(33))[:first] for seed in OTHER_ORDERS]
                rows.append((class_of(windows), rare.view(np.int64), *[o.astype(np.int32) for o in others], *parity_bits(windows)))
            columns = list(zip(*rows)) if rows else [()] * len(names)
            arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.list_(pa.int64()))]
            arrays += [pa.array(c, pa.list_(pa.int32())) for c in columns[2:4]] + [pa.array(c, pa.int64()) for c in columns[4:]]
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["class", "rare", "other_1", "other_2", *PARITY]
    kinds = {"rare": "array<bigint>", "other_1": "array<int>", "other_2": "array<int>"}
    return docs.select("text").mapInArrow(run, ", ".join(f"{n} {kinds.get(n, 'bigint')}" for n in names))


def window_sets(docs: DataFrame, size: int) -> DataFrame:
    """class and its sorted windows, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, joiner = TextHasher(), WindowHasher(size)
        for batch in slices(batches):
            sets = [np.unique(joiner.joined(hasher.words(text))) for text in batch.column("text").to_pylist()]
            columns = [pa.array([class_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["class", "windows"])

    return docs.select("text").mapInArrow(run, "class bigint, windows binary")


def linked(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose sets ``left`` and ``right`` reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for left, right in zip(batch.column("left"), batch.column("right")):
                x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "left", "right").mapInArrow(run, "a bigint, b bigint")


def _alike(x: str, y: str, percent: int) -> Column:
    """Whether sets ``x`` and ``y`` can be linked: near sizes, and parity bits that differ in few places.

    A link shares at least p (m + n) / (100 + p) windows, so the sets differ in no more than the rest.
    """
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    differ = sum((F.bit_count(F.col(f"{x}{p}").bitwiseXOR(F.col(f"{y}{p}"))) for p in PARITY), F.lit(0))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * differ <= (100 - percent) * (n + m))


def _across(own: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a``, ``b`` of different components that share a part and can be linked.

    A posting brings those of its class's first parts (by name) that come before it. If a pair shares one of them, it came
    out of that list, so that most pairs come out of one list only.
    """
    own = own.withColumn("earlier", F.filter("first", lambda part: part < F.col("part"))).drop("first")
    # The postings are small on disk, where a class's columns stand once, but not as rows of a broadcast.
    x, y = own.alias("x").hint("merge"), own.alias("y")
    across = x.join(
        y,
        (F.col("x.part") == F.col("y.part")) & (F.col("x.component") < F.col("y.component")) & _alike("x.", "y.", percent)
        & ~F.arrays_overlap("x.earlier", "y.earlier"),
    )
    return across.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()


def _sharing(pairs: DataFrame, classes: DataFrame, order: str) -> DataFrame:
    """The pairs whose prefixes under another order share a window."""
    side = lambda name: classes.select(F.col("class").alias(name), F.col(order).alias(f"{name}_{order}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(F.arrays_overlap(f"a_{order}", f"b_{order}")).select("a", "b")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links among ``pairs``: first sizes and parity bits, then the prefixes under all orders, then the sets.

    A first-order prefix has ``n // SPARE`` windows to spare, so a link shares as many of the smaller one and one more.
    """
    carried = ("doc_id", "n", "rare", "other_1", "other_2", *PARITY)
    side = lambda name: classes.select(F.col("class").alias(name), *[F.col(o).alias(f"{name}_{o}") for o in carried])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(_alike("a_", "b_", percent))
    spare = F.floor(F.least("a_n", "b_n") / SPARE)
    both = both.where(F.arrays_overlap("a_other_1", "b_other_1") & F.arrays_overlap("a_other_2", "b_other_2"))
    both = both.where(F.size(F.array_intersect("a_rare", "b_rare")) > spare)
    with passing(docs.sparkSession) as keep:
        left = stage(both.select("a", "b", "a_doc_id", "b_doc_id"), "filtered")
        ids = left.select(F.col("a_doc_id").alias("id")).union(left.select("b_doc_id"))
        texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
        sets = window_sets(texts, size).dropDuplicates(["class"])
        sets = stage(sets, "sets")
        joined = left.join(sets.select(F.col("class").alias("b"), F.col("windows").alias("right")), "b")
        joined = joined.join(sets.select(F.col("class").alias("a"), F.col("windows").alias("left")), "a")
        return keep(linked(joined, percent), "links")


def _star_pairs(rest: DataFrame, turn: int, percent: int) -> DataFrame:
    """A few pairs per class: with the heads that most of its lists have, out of another component and of a near size.

    A list's head is drawn by hash, in every turn anew.
    """
    heads = rest.groupBy("part").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "class").alias("turn"), "class", "n", "component")).alias("head"))
    heads = stage(heads.select(F.col("part").alias("of"), "head.*"), "heads")
    stars = rest.alias("x").join(heads.alias("y"), F.col("x.part") == F.col("y.of"))
    near = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    heads_of = stars.where((F.col("x.component") != F.col("y.component")) & near)
    heads_of = heads_of.groupBy(F.col("x.class").alias("a"), F.col("y.class").alias("b")).agg(F.count("*").alias("times"))
    # As many heads as a class has parts at most.
    best = heads_of.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("times", "b")), False), 1, HEADS).alias("best"))
    best = best.select("a", F.explode("best.b").alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _joined_by(links: DataFrame, found: DataFrame | None) -> DataFrame:
    """Components of the links, and of those ``found`` before."""
    return components(links if found is None else links.union(found.select("node", "component")))


def group_documents(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, content (hash of the text) and group of every document.

    Documents with the same group are joined by links; one without words has none. Groups are numbers
    without a meaning; equal texts have equal groups, so that (doc_id, content) tells rows apart.
    """
    docs = only(docs, doc_id="bigint", text="string").withColumn("content", content_hash(F.col("text")))
    with passing(docs.sparkSession) as keep:
        named, held, lists = _postings(docs, size, percent)
        found = None
        rest = lists.withColumn("component", F.col("class"))
        for turn in count():
            pairs = stage(_star_pairs(rest, turn, percent), "pairs")
            gained = _verified(pairs, held, docs, size, percent)
            before, found = found, _joined_by(gained, found)
            grouped = rest.drop("component").join(found, F.col("class") == F.col("node"), "left")
            grouped = grouped.withColumn("component", F.coalesce("component", "class")).drop("node")
            mixed = grouped.groupBy("part").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
            rest = stage(grouped.join(stage(mixed.select("part"), "mixed"), "part"), "mixed-postings")
            release(lists)
            lists = rest
            # A turn pays as long as many of its pairs are links; what is left after it are mostly pairs that are none.
            paid = gained.count() * PAYS > pairs.count()
            release(pairs, gained, *([before] if before is not None else []))
            if not paid or rest.isEmpty():
                break
        # What the last pairs are made from goes before they are compared, first by one of the short prefixes alone.
        firsts = rest.groupBy("class").agg(F.slice(F.sort_array(F.collect_set("part")), 1, FIRSTS).alias("first"))
        firsts = stage(firsts.join(held.select("class", *PARITY), "class"), "firsts")
        own = stage(rest.join(firsts, "class"), "own-postings")
        release(rest)
        every = stage(_across(own, percent), "pairs")
        release(own)
        pairs = stage(_sharing(every, held, "other_1"), "pairs")
        release(every)
        found = _joined_by(_verified(pairs, held, docs, size, percent), found)

        named = named.join(found, F.col("class") == F.col("node"), "left")
        return keep(named.select("doc_id", "n_shingles", "content", F.coalesce("component", "class").alias("group")), "grouped")


def _postings(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every document's class, the classes that share a part with another one, and their postings of such parts."""
    with passing(docs.sparkSession) as keep:
        described = stage(describe(docs, size, percent), "described")
        classes = described.where("parts is not null")

        # Most parts are in one set, and end here. Then a class that several tasks met counts once.
        postings = classes.select("class", F.explode("parts").alias("part"))
        twice = stage(postings.groupBy("part").count().where("count > 1").select("part"), "twice")
        lists = stage(postings.join(twice, "part").distinct(), "lists")
        shared = lists.groupBy("part").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y")
        lists = stage(lists.join(stage(shared.select("part"), "shared"), "part"), "lists")
        active = stage(lists.select("class").distinct(), "active")
        named = classes.select("class", "doc_id", "n").join(active, "class").dropDuplicates(["class"])
        named = stage(named, "named-classes")
        texts = docs.join(named.select(F.col("doc_id").alias("id")), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
        # Rows that repeat an id may have other texts.
        held = keep(prefixes(texts, bucket_counts(docs), size, percent).join(named, "class").dropDuplicates(["class"]), "classes")
        lists = keep(lists.join(named.select("class", "n"), "class"), "postings")
        return keep(described.select("doc_id", F.col("n").alias("n_shingles"), "content", "class"), "named"), held, lists


def join_documents(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    named = group_documents(docs, size, percent)
    least = stage(named.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("least")), "names")
    return named.join(least, "group", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group: the one with the least id (rows without an id last), among texts of one id the least hash.

    Of rows that repeat this id and text one stays, whichever; rows without words are in no group and all stay.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "content")
    with passing(docs.sparkSession) as keep:
        named = group_documents(docs, size, percent).where("group is not null")
        sizes = stage(named.groupBy("group", "doc_id", "content").agg(F.count("*").alias("rows")), "sizes")
        heads = stage(sizes.groupBy("group").agg(F.min(rank).alias("head")), "group-heads")
        judged = sizes.join(heads, "group").withColumn("first", F.col("head.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("head.content") == F.col("content")))
        named_by = [F.col("doc_id").alias("__id"), F.col("content").alias("__content")]
        later = keep(judged.where("not first or rows > 1").select(*named_by, "first"), "later")
    mine = content_hash(F.col("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (mine == F.col("__content"))
    kept = docs.join(later.drop("first"), same, "left_anti")
    repeated = docs.join(later.where("first").drop("first"), same, "left_semi").withColumn("__content", mine)
    return kept.unionByName(repeated.dropDuplicates(["doc_id", "__content"]).drop("__content"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents"))
