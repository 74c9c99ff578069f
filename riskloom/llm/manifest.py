"""Merkle manifest of a dataset in van Emde Boas layout.

A document is a leaf, a source's documents are a tree of fan-out 16, and the sources' roots are the
leaves of one more tree. A tree of some height is split at half its height: the lower half becomes
aligned subtrees (blocks), their roots are the leaves of the upper half, and both halves are split
again until a block has at most ``BLOCK_HEIGHT`` levels of parents, 4096 leaves. Blocks are rows
of a stored table, one table per tier; one task builds a block, the next tier starts from block
roots, so even a source with a third of all rows is spread over its blocks.

Within a block the same rule orders the digests: the upper half first, then every lower subtree, each
stored as one piece. ``address`` finds a node in that order by arithmetic alone; building fills the
pieces recursively, each upper piece over the roots of the lower ones, and the siblings of a node
are read by their addresses. Proofs go down from the last tier: a block hands each of its leaves the
siblings above it, so that a block of the tier below needs one row only.

Positions within a source come from a range sort by (source, doc_id) and counted offsets.

Defined cases: null values are `-` in a leaf; a null source is a source of its own, the first; a null
doc_id comes first in its source and is never tampered with; rows that repeat an id are leaves of
their own, ordered by digest; a text without A-Z is unchanged by tampering and verifies; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import only, slices, table
from riskloom.sources.staging import stage

#: Children of a node (a power of two) and the bits of a position that a level takes.
FAN_OUT, BITS = 16, 4
#: Most levels above the leaves in a stored block.
BLOCK_HEIGHT = 3
#: Greatest height of a tree: positions are 63-bit numbers.
TALLEST = 15
#: One of so many documents is tampered with by ``op12``.
TAMPER_EVERY = 5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tiers(height: int) -> list[int]:
    """Heights of the blocks of a tree, from the leaves up: halves of halves, none above ``BLOCK_HEIGHT``."""
    if height <= BLOCK_HEIGHT:
        return [height]
    return tiers(height - height // 2) + tiers(height // 2)


def size(levels: int) -> int:
    """Nodes of a full subtree with so many levels."""
    return (FAN_OUT**levels - 1) // (FAN_OUT - 1)


def address(levels: int, depth: int, index: int | np.ndarray) -> int | np.ndarray:
    """Place of the ``index``-th node at ``depth`` in the layout of a subtree with so many levels."""
    at = 0
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        below = BITS * (depth - upper)
        at = at + size(upper) + (index >> below) * size(levels - upper)
        index, depth, levels = index & ((1 << below) - 1), depth - upper, levels - upper
    return at


def join_digests(digests: bytes) -> bytes:
    """Digest of digests, which enter as hexadecimal text."""
    return hashlib.sha256(digests.hex().encode()).digest()


def fill(nodes: np.ndarray, base: int, levels: int, leaves: np.ndarray) -> bytes:
    """Store a subtree over ``leaves`` from ``base`` on; returns its root."""
    if levels == 1:
        nodes[base] = leaves[0]
        return leaves[0].tobytes()
    upper = levels // 2
    if levels == 2:
        roots = leaves
        nodes[base + 1 : base + 1 + len(leaves)] = leaves
    else:
        each, span = size(levels - upper), FAN_OUT ** (levels - upper - 1)
        made = [fill(nodes, base + size(upper) + i * each, levels - upper, leaves[at : at + span]) for i, at in enumerate(range(0, len(leaves), span))]
        roots = np.frombuffer(b"".join(made), np.uint8).reshape(-1, 32)
    parents = [join_digests(roots[at : at + FAN_OUT].tobytes()) for at in range(0, len(roots), FAN_OUT)]
    return fill(nodes, base, upper, np.frombuffer(b"".join(parents), np.uint8).reshape(-1, 32))


def build_block(leaves: list[bytes], height: int) -> tuple[bytes, bytes]:
    """A block's nodes in layout order, without what follows the last one, and its root."""
    nodes = np.zeros((size(height + 1), 32), np.uint8)
    root = fill(nodes, 0, height + 1, np.frombuffer(b"".join(leaves), np.uint8).reshape(-1, 32))
    used = max(int(address(height + 1, d, (len(leaves) - 1) >> BITS * (height - d))) for d in range(height + 1)) + 1
    return nodes[:used].tobytes(), root


class Block:
    """A stored block; reads runs of siblings by address."""

    def __init__(self, nodes: bytes, height: int, leaves: int):
        self.nodes = np.frombuffer(nodes, np.uint8).reshape(-1, 32)
        self.height, self.leaves = height, leaves

    def run(self, depth: int, index: int) -> bytes:
        """Digests of the run that holds a node, left to right."""
        count = ((self.leaves - 1) >> BITS * (self.height - depth)) + 1
        first = index & -FAN_OUT
        places = address(self.height + 1, depth, np.arange(first, min(first + FAN_OUT, count)))
        return self.nodes[places].tobytes()

    def paths(self, above: bytes) -> Iterator[tuple[bytes, bytes]]:
        """For each leaf: its digest, and the runs from its own up to the root (``encode``d)."""
        if self.height == 0:
            yield self.nodes[0].tobytes(), above
            return
        yield from self._paths(1, 0, above)

    def _paths(self, depth: int, first: int, above: bytes) -> Iterator[tuple[bytes, bytes]]:
        run = self.run(depth, first)
        for own in range(len(run) // 32):
            path = encode(run, own) + above
            if depth == self.height:
                yield run[32 * own : 32 * own + 32], path
            else:
                yield from self._paths(depth + 1, (first + own) << BITS, path)


def encode(run: bytes, own: int) -> bytes:
    """One level of a path: how many digests, which one is the own, the digests."""
    return bytes([len(run) // 32, own]) + run


def levels_of(path: bytes) -> Iterator[tuple[bytes, int]]:
    """(run, own place) of each level of a path, from the leaf up."""
    at = 0
    while at < len(path):
        count = path[at]
        yield path[at + 2 : at + 2 + 32 * count], path[at + 1]
        at += 2 + 32 * count


def proof_digest(path: bytes) -> str:
    """Digest of the siblings of a path."""
    parts = [run[: 32 * own] + run[32 * own + 32 :] for run, own in levels_of(path)]
    return hashlib.sha256(b"".join(parts).hex().encode()).hexdigest()


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf leads to with the siblings of a path."""
    for run, own in levels_of(path):
        leaf = join_digests(run[: 32 * own] + leaf + run[32 * own + 32 :])
    return leaf


def _number(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``pos`` (from 0 within ``tree``, by ``order``) and ``n`` (rows of the tree)."""
    placed = rows.repartitionByRange("tree", *order, "part").sortWithinPartitions("tree", *order, "part")
    placed = stage(placed.withColumn("at", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("piece", F.shiftright("at", 33))
    counts = stage(placed.groupBy("tree", "piece").agg(F.count("*").alias("held"), F.min("at").alias("from")), "pieces")
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("held").over(tree.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("tree", "piece", (before - F.col("from")).alias("shift"), F.sum("held").over(tree).alias("n"))
    numbered = placed.join(stage(counts, "offsets"), ["tree", "piece"])
    return numbered.withColumn("pos", F.col("at") + F.col("shift")).drop("at", "shift", "piece")


def _heights(n: Column) -> Column:
    """Block heights of a tree with ``n`` leaves, as in ``tiers``."""
    choice = None
    for height in range(TALLEST + 1):
        heights = F.array(*[F.lit(h) for h in tiers(height)])
        choice = F.when(n <= FAN_OUT**height, heights) if choice is None else choice.when(n <= FAN_OUT**height, heights)
    return choice


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 16):
        made = [
            build_block([x["digest"] for x in leaves], height)
            for leaves, height in zip(batch.column("leaves").to_pylist(), batch.column("height").to_pylist())
        ]
        nodes, roots = pa.array([x for x, _ in made], pa.binary()), pa.array([x for _, x in made], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, nodes, roots], [*batch.schema.names, "nodes", "root"])


def plant(leaves: DataFrame, order: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Build the trees of ``leaves`` (``tree``, ``digest``, ``part``, ``order`` and further columns).

    Returns the blocks tier by tier and the trees' roots (``tree``, ``root``). A block has ``tree``,
    ``block``, ``height``, ``last`` (whether no tier follows), ``nodes`` in layout order and ``leaves``,
    in the first tier with the further columns.
    """
    nodes = _number(leaves, order).withColumn("heights", _heights(F.col("n")))
    carried = [c for c in leaves.columns if c not in ("tree", "part")]
    tallest = nodes.agg(F.max(F.size("heights"))).first()[0] or 1
    found, roots = [], None
    for tier in range(tallest):
        height = F.element_at("heights", tier + 1)
        block = F.expr(f"shiftright(pos, {BITS} * element_at(heights, {tier + 1}))")
        grouped = nodes.groupBy("tree", block.alias("block"), height.alias("height"), "heights").agg(
            F.sort_array(F.collect_list(F.struct("pos", *carried))).alias("leaves")
        )
        grouped = grouped.withColumn("last", F.size("heights") == tier + 1)
        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grouped.schema)
        blocks = stage(grouped.mapInArrow(_build, f"{kind}, nodes binary, root binary"), "blocks")
        found.append(blocks)
        ended = blocks.where("last").select("tree", "root")
        roots = ended if roots is None else roots.union(ended)
        nodes = blocks.where("not last").select("tree", F.col("block").alias("pos"), "heights", F.col("root").alias("digest"))
        carried = ["digest"]
    return found, roots


def _hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path of each block of the tier below."""
    for batch in slices(batches, 4):
        for row in batch.to_pylist():
            leaves = row["leaves"]
            paths = [path for _, path in Block(row["nodes"], row["height"], len(leaves)).paths(row["path"])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["tree"]] * len(leaves)), pa.array([x["pos"] for x in leaves], pa.int64()), pa.array(paths, pa.binary()), pa.array([row["top"]] * len(leaves), pa.binary())],
                ["tree", "block", "path", "top"],
            )


def descend(blocks: list[DataFrame], paths: DataFrame) -> DataFrame:
    """First-tier blocks with ``path`` and ``top``; ``paths`` has ``tree``, ``path`` (above the tree's root) and ``top``."""
    handed = None
    for tier in reversed(range(len(blocks))):
        ends = blocks[tier].where("last").select("tree", "block").join(paths, "tree").select("tree", "block", "path", "top")
        known = ends if handed is None else ends.union(handed)
        joined = blocks[tier].join(stage(known, "paths"), ["tree", "block"])
        if tier == 0:
            return joined
        handed = joined.select("tree", "leaves", "nodes", "height", "path", "top").mapInArrow(_hand_down, "tree string, block bigint, path binary, top binary")
    raise ValueError("no blocks")


def _leaf_digest(text: Column) -> Column:
    """SHA-256 of a document's values, each with its length, or ``-``."""
    values = [F.col(c).cast("string") for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    told = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*told).cast("binary"), 256))


def document_leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """``tree`` (null source first), ``doc_id``, ``digest``, and ``changed``: the digest after tampering, null where it is the same."""
    docs = only(docs, doc_id="bigint", source="string", lang="string", n_chars="bigint", text="string")
    changed = F.when(tampered & F.col("text").rlike("[A-Z]"), _leaf_digest(F.translate("text", UPPER, LOWER)))
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("tree"), "doc_id",
        _leaf_digest(F.col("text")).alias("digest"), changed.alias("changed"), F.spark_partition_id().alias("part"),
    )


def _sources_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 4):
        for row in batch.to_pylist():
            leaves = row["leaves"]
            paths = [path for _, path in Block(row["nodes"], row["height"], len(leaves)).paths(row["path"])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x["source"] for x in leaves], pa.string()), pa.array(paths, pa.binary()), pa.array([x["digest"] for x in leaves], pa.binary())],
                ["tree", "path", "top"],
            )


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 4):
        for row in batch.to_pylist():
            leaves, out = row["leaves"], {k: [] for k in ("leaf", "proof_sha256", "folded_root")}
            for x, (digest, path) in zip(leaves, Block(row["nodes"], row["height"], len(leaves)).paths(row["path"])):
                out["leaf"].append(digest.hex())
                out["proof_sha256"].append(proof_digest(path))
                out["folded_root"].append(fold(x["changed"] or digest, path).hex())
            ids, top = pa.array([x["doc_id"] for x in leaves], pa.int64()), pa.array([row["top"].hex()] * len(leaves))
            yield pa.RecordBatch.from_arrays([ids, pa.array(out["leaf"]), top, pa.array(out["proof_sha256"]), pa.array(out["folded_root"])], ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])


def build_manifest(docs: DataFrame, tampered: Column) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Blocks of the sources' trees, blocks of the tree over sources, and its root (one row, or none)."""
    leaves = stage(document_leaves(docs, tampered), "leaves")
    sources, subroots = plant(leaves, ["doc_id", "digest"])
    tops = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("digest"), F.lit(0).alias("part"))
    whole, root = plant(stage(tops, "subroots"), ["source"])
    return sources, whole, root


def verify_documents(docs: DataFrame, tampered: Column) -> DataFrame:
    """One row per document: leaf, subroot, root, digest of its proof, the root that its proof leads to, and whether that is the root."""
    sources, whole, root = build_manifest(docs, tampered)
    # One digest at most, whatever the size of the table.
    final = root.first()
    above = root.select("tree", F.lit(b"").alias("path"), F.col("root").alias("top"))
    paths = descend(whole, above).select("leaves", "nodes", "height", "path").mapInArrow(_sources_paths, "tree string, path binary, top binary")
    ready = descend(sources, stage(paths, "source-paths")).select("leaves", "nodes", "height", "path", "top")
    rows = ready.mapInArrow(_checked, "doc_id bigint, leaf string, subroot string, proof_sha256 string, folded_root string")
    named = F.lit(bytes(final["root"]).hex() if final else None).cast("string")
    return rows.select("doc_id", "leaf", "subroot", named.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == named).alias("verified"))


def op12_van_emde_boas_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0, F.lit(False))
    return verify_documents(table(spark, sf_dir, "documents"), tampered)


def _told(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


_LEAF = " || ".join(_told(v) for v in ("cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)"))

#: Trees level by level, then every document's walk from its leaf up through its source's tree and the tree over sources.
OP12_SQL = f"""
with recursive crc as (
  select list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)),
    lambda c, i: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as steps
), leaves as (
  select doc_id, coalesce('=' || source, '') as k, sha256({_LEAF} || {_told("text")}) as leaf,
    sha256({_LEAF} || {_told(f"translate(text, '{UPPER}', '{LOWER}')")}) as changed,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(cast(doc_id as varchar), ''), lambda d: ascii(d))),
      lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) % {TAMPER_EVERY} = 0 as tampered
  from documents cross join crc
), placed as (
  select *, row_number() over (partition by k order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by k) as n from leaves
), low as (
  select 0 as lvl, k, pos, leaf as digest, n from placed
  union all
  select lvl + 1, k, pos // 16, sha256(string_agg(digest, '' order by pos)), (n + 15) // 16
  from low where n > 1 group by lvl, k, pos // 16, n
), tops as (
  select k, digest, row_number() over (order by k) - 1 as pos, count(*) over () as n from low where n = 1
), high as (
  select 0 as lvl, pos, digest, n from tops
  union all
  select lvl + 1, pos // 16, sha256(string_agg(digest, '' order by pos)), (n + 15) // 16
  from high where n > 1 group by lvl, pos // 16, n
), low_runs as (
  select lvl, k, pos // 16 as run, list(digest order by pos) as digests from low where n > 1 group by all
), high_runs as (
  select lvl, pos // 16 as run, list(digest order by pos) as digests from high where n > 1 group by all
), climb as (
  select row_number() over () as d, doc_id, k, 0 as lvl, pos, '' as proof, case when tampered then changed else leaf end as now, leaf, n from placed
  union all
  select d, doc_id, c.k, c.lvl + 1, pos // 16,
    proof || array_to_string(digests[:pos % 16], '') || array_to_string(digests[pos % 16 + 2:], ''),
    sha256(array_to_string(digests[:pos % 16], '') || now || array_to_string(digests[pos % 16 + 2:], '')), leaf, (n + 15) // 16
  from climb c join low_runs r on r.k = c.k and r.lvl = c.lvl and r.run = c.pos // 16 where n > 1
), ascend as (
  select d, doc_id, 0 as lvl, t.pos, proof, now, leaf, t.digest as subroot, t.n from climb c join tops t using (k) where c.n = 1
  union all
  select d, doc_id, c.lvl + 1, pos // 16,
    proof || array_to_string(digests[:pos % 16], '') || array_to_string(digests[pos % 16 + 2:], ''),
    sha256(array_to_string(digests[:pos % 16], '') || now || array_to_string(digests[pos % 16 + 2:], '')), leaf, subroot, (n + 15) // 16
  from ascend c join high_runs r on r.lvl = c.lvl and r.run = c.pos // 16 where n > 1
)
select doc_id, leaf, subroot, (select digest from high where n = 1) as root, sha256(proof) as proof_sha256, now as folded_root,
  now = (select digest from high where n = 1) as verified
from ascend where n = 1
"""
