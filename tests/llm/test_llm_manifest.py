import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import manifest
from riskloom.llm.manifest import Block, address, build_block, build_manifest, fold, proof_digest, size, tiers, verify_documents

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, pos int, digest string, part string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_addresses_fill_the_layout_once():
    for levels in range(1, 5):
        places = [address(levels, d, np.arange(16**d)) for d in range(levels)]
        assert sorted(np.concatenate([np.atleast_1d(p) for p in places])) == list(range(size(levels)))
    # Four levels are two over two: the root and its children, then each grandchild with its 16 children in one piece.
    assert list(address(4, 1, np.arange(16))) == list(range(1, 17))
    assert address(4, 2, 3) == 17 + 3 * 17 and list(address(4, 3, np.arange(48, 64))) == list(range(69, 85))


def test_tiers_halve_the_height():
    assert [tiers(h) for h in (0, 1, 3, 4, 5, 7)] == [[0], [1], [3], [2, 2], [3, 2], [2, 2, 3]]
    assert all(sum(tiers(h)) == h and max(tiers(h)) <= 3 for h in range(16))


@pytest.mark.parametrize("count,height", [(1, 0), (1, 2), (2, 1), (16, 1), (17, 2), (256, 2), (300, 3), (4096, 3)])
def test_block_by_levels(count, height):
    leaves = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(count)]
    nodes, root = build_block(leaves, height)
    level = [x.hex() for x in leaves]
    for _ in range(height):
        level = [digest("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
    assert [root.hex()] == level
    paths = list(Block(nodes, height, count).paths(b""))
    assert [leaf for leaf, _ in paths] == leaves
    assert all(fold(leaf, path) == root for leaf, path in paths)
    assert fold(b"x" * 32, paths[-1][1]) != root


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text) rows."""

    def leaf_of(row, text):
        told = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)]
        return digest("".join(told))

    def climb(level):
        """Root, and per leaf the runs above it with the own place."""
        paths = [[] for _ in level]
        at = list(range(len(level)))
        while len(level) > 1:
            runs = [level[i : i + 16] for i in range(0, len(level), 16)]
            for path, i in zip(paths, range(len(paths))):
                path.append((runs[at[i] // 16], at[i] % 16))
                at[i] //= 16
            level = [digest("".join(r)) for r in runs]
        return level[0] if level else None, paths

    order = lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[4]))
    names = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = [sorted((r for r in rows if r[1] == name), key=order) for name in names]
    made = [climb([leaf_of(r, r[4]) for r in tree]) for tree in trees]
    root, tops = climb([subroot for subroot, _ in made])
    out = []
    for tree, (subroot, paths), top in zip(trees, made, tops):
        for row, path in zip(tree, paths):
            proof = "".join("".join(run[:own] + run[own + 1 :]) for run, own in path + top)
            text = row[4]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            now = leaf_of(row, text)
            for run, own in path + top:
                now = digest("".join([*run[:own], now, *run[own + 1 :]]))
            out.append((row[0], leaf_of(row, row[4]), subroot, root, digest(proof), now, now == root))
    return out


@pytest.fixture(scope="module")
def odd_rows():
    r = random.Random(5)
    rows = [(i, r.choice(["a", "a", "a", "é", "Z", None]), r.choice(["en", None]), r.choice([1, None]), f"Text {i}") for i in range(700)]
    rows += [(900 + i, f"s{i}", "en", 2, "ÀB c") for i in range(40)]
    rows += [(None, "a", None, None, "No id"), (5, "a", "x", 1, "Other"), (5, "a", "x", 1, "Other"), (6, "", "x", 1, ""), (7, "q", "x", 1, None)]
    return rows + [(8, "long", "en", 9, "Long TEXT " * 40_000)]


def verified(spark, rows):
    df = spark.createDataFrame([(*r, "t", 1, "d", "p") for r in rows], SCHEMA)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return [tuple(r) for r in verify_documents(df, tampered).collect()]


@pytest.mark.parametrize("height", [3, 1])
def test_documents_by_brute_force(spark, odd_rows, monkeypatch, height):
    monkeypatch.setattr(manifest, "BLOCK_HEIGHT", height)
    key = lambda r: (r[0] is None, *map(str, r))
    found, expected = verified(spark, odd_rows), brute(odd_rows)
    assert sorted(found, key=key) == sorted(expected, key=key)
    assert {r[-1] for r in found} == {True, False}


def test_small_tables(spark):
    assert verified(spark, []) == []
    for rows in ([(3, None, None, None, None)], [(1, "a", "b", 2, "C"), (2, "a", "b", 2, "D")]):
        assert sorted(verified(spark, rows)) == sorted(brute(rows))


def test_blocks_are_aligned_and_stored_once(spark, odd_rows):
    df = spark.createDataFrame([(*r, "t", 1, "d", "p") for r in odd_rows * 12], SCHEMA)
    sources, whole, root = build_manifest(df, F.lit(False))
    blocks = sources[0].collect()
    assert sum(len(b["leaves"]) for b in blocks) == 12 * len(odd_rows)
    for b in blocks:
        assert [x["pos"] for x in b["leaves"]] == [(b["block"] << 4 * b["height"]) + i for i in range(len(b["leaves"]))]
        assert len(b["leaves"]) <= 4096 and len(b["nodes"]) <= 32 * size(b["height"] + 1)
    assert len(sources) == 2 and [b["height"] for b in sources[1].collect()] == [2]
    assert root.count() == 1 and len(whole) == 1
    assert proof_digest(b"") == digest("")
