import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm import decontamination, graph, hashing, ngram_join, paragraphs, substrings
from riskloom.llm.graph import components
from riskloom.llm.suffix_groups import common_prefixes, suffix_array
from riskloom.sources import staging


def shingle_set(text, size):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))) if words else frozenset()


def brute_components(pairs, size, percent):
    sets = [shingle_set(t, size) for _, t in pairs]
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if shared and 100 * shared >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(pairs):
        if doc_id is not None:
            least[find(i)].append(doc_id)
    return Counter((d, len(s), min(least[find(i)], default=d)) for i, ((d, _), s) in enumerate(zip(pairs, sets)))


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_ngram_join_is_the_brute_force_join(frame, corpus, rows, size, percent):
    found = Counter(rows(ngram_join.join_documents(frame(corpus), size, percent)))
    assert found == brute_components(corpus, size, percent)


@settings(max_examples=200, deadline=None)
@given(st.sampled_from([50, 80, 90, 99, 100]), st.integers(1, 400), st.integers(0, 400), st.integers(0, 400), st.integers(0, 1 << 30))
def test_linked_sets_share_a_part(percent, shared, left, right, seed):
    # As many windows of their own as a link allows, or fewer.
    most = shared * (100 - percent) // percent
    left, right = min(left, most), min(right, most - min(left, most))
    windows = hashing.mix(np.arange(seed, seed + shared + left + right, dtype=np.uint64))
    both, mine, yours = np.split(windows, [shared, shared + left])
    parts = ngram_join.Parts(percent)
    x, y = (parts.of(np.sort(np.concatenate([both, own]))) for own in (mine, yours))
    assert 100 * shared >= percent * (shared + left + right)
    assert left + right == 0 or set(x.tolist()) & set(y.tolist())


def test_one_shared_window_gives_no_candidate(spark, frame, monkeypatch):
    # Any two of these texts share their last three words, and those are rare; other words are their own.
    texts = [(i, " ".join(f"w{i}x{k}" for k in range(60)) + " only here together") for i in range(30)]
    written = {}

    def noted(df, name):
        staged = staging.stage(df, name)
        written[name] = staged.count()
        return staged

    monkeypatch.setattr(ngram_join, "stage", noted)
    with staging.passing(spark):
        docs = frame(texts)
        _, classes, lists = ngram_join._postings(docs.withColumn("content", ngram_join.content_hash(docs["text"])), 3, 90)
        assert written["described"] == 30 and written["twice"] == 0
        assert classes.count() == 0 and lists.count() == 0


@pytest.mark.parametrize("firsts", [1, 8])
def test_a_pair_of_many_shared_parts_comes_out_of_few_lists(spark, monkeypatch, firsts):
    parts = [[2, 3, 5, 8, 13], [1, 3, 5, 8, 13], [13, 21], [34]]
    rows = [(c, p, c, 100, *[0] * len(ngram_join.PARITY), sorted(own)[:firsts]) for c, own in enumerate(parts) for p in own]
    bits = ", ".join(f"{p} bigint" for p in ngram_join.PARITY)
    own = spark.createDataFrame(rows, f"class bigint, part bigint, component bigint, n bigint, {bits}, first array<bigint>")
    monkeypatch.setattr(type(own), "distinct", lambda df: df)
    found = Counter(map(tuple, ngram_join._across(own, 80).collect()))
    assert set(found) == {(0, 1), (0, 2), (1, 2)}
    assert found[0, 1] == (1 if firsts == 8 else 4)


def test_components_of_a_path_a_star_and_ties(spark):
    edges = [(i + 1, i) for i in range(20)] + [(100, k) for k in range(101, 140)] + [(7, 7), (5, 4), (None, 3)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert {found[k] for k in range(21)} == {0} and {found[k] for k in range(100, 140)} == {100} and len(found) == 61


def test_tasks_draw_edges_together_and_rounds_do_the_rest(spark, monkeypatch):
    path = spark.createDataFrame([(i + 1, i) for i in range(60)], "a bigint, b bigint").repartition(3)
    written = []
    monkeypatch.setattr(graph, "stage", lambda df, name: written.append(name) or staging.stage(df, name))
    for drawn, rounds in ((1 << 16, 0), (2, 9)):
        written.clear()
        assert set(map(tuple, components(path, drawn).collect())) == {(i, 0) for i in range(61)}
        assert written.count("least") <= 2 * rounds


def left_over(spark):
    folder = Path(urlparse(staging.staging_root(spark)).path, "riskloom", spark.sparkContext.applicationId)
    return {f.name for f in folder.iterdir()} if folder.exists() else set()


@pytest.mark.parametrize(
    "work", [lambda d: ngram_join.join_documents(d), lambda d: ngram_join.drop_near_copies(d), paragraphs.repeated_spans, substrings.repeated_spans]
)
def test_only_what_the_result_reads_stays_on_disk(spark, frame, corpus, work):
    before = left_over(spark)
    result = work(frame(corpus[:40]))
    stayed = {name.rsplit("-", 1)[0] for name in left_over(spark) - before}
    assert stayed <= {"grouped", "names", "later", "repeats", "spans"}
    assert result.count()


def test_copies_write_no_words_around_their_blocks(frame, monkeypatch):
    r = random.Random(8)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300))
    counts, keep = {}, staging.stage
    monkeypatch.setattr(staging, "stage", lambda df, name: counts.__setitem__(name, (made := keep(df, name)).count()) or made)
    spans = paragraphs.repeated_spans(frame([(i, text) for i in range(12)])).where("not kept").collect()
    assert counts["surroundings"] == 0 and len({s["doc_id"] for s in spans}) == 11


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array_by_lyndon_groups(symbols):
    order = suffix_array(symbols)
    assert order == sorted(range(len(symbols)), key=lambda i: symbols[i:])
    for at, k in enumerate(common_prefixes(symbols, order, -1)):
        if at:
            a, b = symbols[order[at - 1] :], symbols[order[at] :]
            assert a[:k] == b[:k] and (len(a) == k or len(b) == k or a[k] != b[k])


def brute_removal(pairs, length=200):
    count = Counter()
    texts = [(t or "").encode() for _, t in pairs]
    for d in texts:
        count.update(d[s : s + length] for s in range(len(d) - length + 1))
    found = []
    for (doc_id, _), d in zip(pairs, texts):
        keep, runs, end = bytearray(b"\1" * len(d)), 0, -1
        for s in range(len(d) - length + 1):
            if count[d[s : s + length]] > 1:
                runs += s > end
                end = s + length
                keep[s:end] = bytes(length)
        left = bytes(c for c, k in zip(d, keep) if k)
        found.append((doc_id, len(d), len(d) - len(left), runs, hashlib.sha256(left).hexdigest()))
    return Counter(found)


def test_suffix_arrays_hold_only_phrases_that_can_repeat(monkeypatch):
    r = random.Random(9)
    text = lambda n: bytes(r.choice(b"abcdefghij ") for _ in range(n))
    short, long = text(substrings.CORE - 1), text(substrings.LENGTH + 30)
    pieces = [text(150) + short, short + text(150), text(90) + long, long + text(120), text(300), long + text(40)]
    anchors, sizes, whole = [1, 1, 2, 2, 2, 3], [], substrings.suffix_array
    monkeypatch.setattr(substrings, "suffix_array", lambda symbols: sizes.append(sum(s > 0 for s in symbols)) or whole(symbols))
    # The last piece has the same bytes at another anchor, where they cannot be a repeated window.
    assert substrings._marked(pieces, anchors) == [2, 3]
    assert len(sizes) == 1 and sizes[0] <= 2 * len(long) / 6
    assert substrings._marked(pieces[:2] + pieces[4:], [1, 1, 2, 3]) == [] and len(sizes) == 1


@pytest.mark.parametrize("most", [substrings.REGIONS_PER_ANCHOR, 1])
def test_substring_removal_is_exact(frame, corpus, rows, most):
    pairs = [*corpus, (900, "ab" * 150), (901, "x" * 700 + "y"), (902, "q" * 199), (903, "q" * 199)]
    docs = frame(pairs)
    found = rows(substrings.remove_spans(docs, substrings.repeated_spans(docs, most)).drop("kept"))
    assert Counter(found) == brute_removal(pairs)


def test_last_anchor_of_the_longest_text_so_far(monkeypatch):
    r = random.Random(6)
    monkeypatch.setattr(substrings.SliceHasher, "up", np.ones(1, np.uint64))
    monkeypatch.setattr(substrings.SliceHasher, "down", np.ones(1, np.uint64))
    ends = 0
    for _ in range(1000):
        monkeypatch.setattr(substrings.SliceHasher, "room", 0)
        data = bytes(r.choice(b"abcdefghij ") for _ in range(substrings.LENGTH))
        first, last, anchor, _, _, right = substrings.regions(data)
        if anchor[0] == substrings.SliceHasher(data).grams(substrings.GRAM)[-1]:
            ends += 1
            assert (first.tolist(), last.tolist(), right.tolist()) == ([0], [0], [0])
    assert ends


def test_text_longer_than_a_chunk(monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 300)
    data = hashlib.sha512(b"x").hexdigest().encode() * 20
    first, last = substrings.regions(data)[:2]
    starts = [s for a, b in zip(first, last) for s in range(a, b + 1)]
    assert starts == list(range(len(data) - substrings.LENGTH + 1))


def test_paragraphs_catch_passages_and_leave_clean_texts(frame, corpus, rows):
    spans = rows(paragraphs.repeated_spans(frame(corpus)))
    by_doc = defaultdict(list)
    for doc_id, at, upto, _, kept in spans:
        by_doc[doc_id].append((at, upto, kept))
    pasted, clean = range(87, 92), range(16, 30)
    assert not set(clean) & set(by_doc)
    for doc_id in pasted:
        assert by_doc[doc_id]
    clusters = defaultdict(set)
    for doc_id, at, _, cluster, kept in spans:
        if kept:
            clusters[cluster].add((doc_id, at))
    assert all(len(firsts) == 1 for firsts in clusters.values()) and set(clusters) == {s[3] for s in spans}
    # Exact and lightly edited copies lose their paragraph; the first of them keeps it.
    assert any(not kept for *_, kept in by_doc[30]) and all(kept for *_, kept in by_doc[0])


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(4, 7))) for _ in range(n))


def test_a_pasted_passage_is_removed_whole(frame, rows):
    r = random.Random(8)
    passages = [sentence(r, n) for n in (50, 65, 200)]
    cut = " ".join(passages[2].split()[:120])
    texts = [f"{sentence(r, 45)} {p} {sentence(r, 45)}" for p in (*passages[:2], cut) for _ in range(3)]
    # The first occurrences have 120 words of the passage; the next one all 200, and the later ones repeat it.
    texts += [f"{sentence(r, 45)} {passages[2]} {sentence(r, 45)}" for _ in range(3)]
    covered = defaultdict(set)
    for doc_id, at, upto, _, kept in rows(paragraphs.repeated_spans(frame(list(enumerate(texts))))):
        if not kept:
            covered[doc_id].update(range(at, upto))
    for doc_id, passage in ((1, passages[0]), (2, passages[0]), (4, passages[1]), (5, passages[1]), (7, cut), (9, cut), (10, passages[2]), (11, passages[2])):
        begin = texts[doc_id].index(passage)
        assert covered[doc_id] == set(range(begin, begin + len(passage))), doc_id
    assert not {0, 3, 6} & set(covered)


def test_short_lines_are_compared(frame, rows):
    r = random.Random(9)
    lines = [sentence(r, n) for n in (1, 3, 5, 7, 15)]
    near = sentence(r, 14).split()
    texts = ["\n".join([sentence(r, 12), *lines, " ".join(near), sentence(r, 6)]) for _ in range(3)]
    texts.append("\n".join([sentence(r, 9), " ".join([*near, "more"]), sentence(r, 2)]))
    gone = defaultdict(list)
    for doc_id, at, upto, _, kept in sorted(rows(paragraphs.repeated_spans(frame(list(enumerate(texts)))))):
        if not kept:
            gone[doc_id].append(texts[doc_id][at:upto])
    for doc_id in (1, 2):
        assert set(gone[doc_id]) >= {*lines, " ".join(near)}
    assert gone[3] == [" ".join([*near, "more"])] and 0 not in gone


def test_band_recall_at_the_threshold():
    chance = 1 - (1 - (paragraphs.PERCENT / 100) ** paragraphs.ROWS) ** paragraphs.BANDS
    assert chance > 0.99


def brute_contained(docs, items, size=5):
    found = Counter()
    for item_id, text in items:
        item = {s for s in lowered(text, size)}
        for doc_id, other in docs:
            shared = len(item & lowered(other, size))
            if item and 10 * shared >= 8 * len(item):
                found[(doc_id, item_id, shared, len(item))] = 1
    return found


def lowered(text, size):
    import re

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    return {" ".join(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()


def test_containment_search_is_the_brute_force_search(spark, frame, corpus, rows):
    texts = dict(corpus[:40])
    cut = lambda i, a, b: " ".join(texts[i].split()[a:b])
    items = [
        (0, cut(0, 5, 35)), (1, cut(1, 0, 12).upper()), (2, cut(2, 10, 30) + " " + cut(9, 0, 4)), (3, cut(3, 0, 20) + " " + cut(12, 0, 20)),
        (4, "one two"), (5, None), (6, " "), (7, "nothing of this kind stands anywhere at all"), (0, cut(0, 5, 35)), (None, cut(6, 3, 40)),
    ]
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, hash int")
    found = Counter(rows(decontamination.contained_items(frame(corpus), table)))
    expected = brute_contained(corpus, items)
    assert found == expected, (found - expected, expected - found)
    assert len(found) > 8


def test_empty_tables(spark, frame, rows):
    empty = frame([])
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert rows(ngram_join.join_documents(empty)) == []
    assert rows(paragraphs.repeated_spans(empty)) == []
    assert rows(substrings.remove_spans(empty, substrings.repeated_spans(empty))) == []
    assert rows(decontamination.contained_items(empty, items)) == []
    assert rows(decontamination.contained_items(frame([(1, "a b c d e f")]), items)) == []
    assert sorted(rows(ngram_join.join_documents(frame([(1, None), (2, "")])))) == [(1, 0, 1), (2, 0, 2)]


def test_words_hashed_from_prefix_sums(monkeypatch):
    """Equal words have equal hashes wherever they stand, different ones different hashes."""
    r = random.Random(3)
    words = ["".join(r.choice("abAB0é") for _ in range(r.randint(1, 6))) for _ in range(3000)]
    text = "".join(w + r.choice(" \t\n\v\f\r") * r.randint(1, 3) for w in words) + "x" * 500
    for chunk in (hashing.TextHasher.CHUNK, 40, 1):
        monkeypatch.setattr(hashing.TextHasher, "CHUNK", chunk)
        hashed = hashing.TextHasher().words(text).tolist()
        expected = text.encode().lower().split()
        assert len(hashed) == len(expected) and len(set(hashed)) == len(set(expected)) == len(set(zip(hashed, expected)))
        assert all(len(hashing.TextHasher().words(t)) == 0 for t in (None, "", " \n"))
    assert hashed == [int(hashing.TextHasher().words(w.decode())[0]) for w in expected]


def test_few_edges_in_many_partitions_are_drawn_by_one_task(spark, monkeypatch):
    path = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(9, 9), (None, 70)], "a bigint, b bigint").repartition(30)
    written = []
    monkeypatch.setattr(graph, "stage", lambda df, name: written.append(name) or staging.stage(df, name))
    assert sorted(map(tuple, components(path).collect())) == [(i, 0) for i in range(61)]
    assert written == ["components"]
    assert components(path.where("a < 0")).collect() == []


def test_last_pairs_are_compared_without_their_postings(spark, frame, corpus, rows, monkeypatch):
    beside = []
    verified = ngram_join._verified

    def noted(pairs, *rest):
        beside.append({name.rsplit("-", 1)[0] for name in left_over(spark) - before})
        return verified(pairs, *rest)

    monkeypatch.setattr(ngram_join, "_verified", noted)
    before = left_over(spark)
    found = Counter(rows(ngram_join.join_documents(frame(corpus))))
    assert found == brute_components(corpus, 3, 90)
    assert not beside[-1] & {"postings", "mixed-postings", "own-postings"}
