from collections import Counter

import corpus_pipeline
from riskloom.llm.catalog import QUERIES
from riskloom.llm.common import table
from riskloom.llm.mixing import label_domains
from test_llm_joins import brute_components, brute_contained
from test_llm_scans import brute_quality


def test_stages_by_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = {r["doc_id"] for r in label_domains(table(spark, sf_dir, "labels")).where("domain = 0").collect()}
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    kept = {}
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stage(function(spark, docs, sf_dir), "test-stage")
        assert out.columns == docs.columns
        before, after = [r["doc_id"] for r in docs.collect()], [r["doc_id"] for r in out.collect()]
        kept[name] = (set(before), Counter(after))
        docs = out
    before, after = kept["quality rules"]
    passing = {i for i in before if not brute_quality(texts[i])[-1]}
    assert set(after) <= passing and clean & passing <= set(after)
    before, after = kept["n-gram Jaccard join"]
    firsts = {first for _, _, first in brute_components([(i, texts[i]) for i in before], 5, 80)}
    assert set(after) == firsts
    before, after = kept["benchmark decontamination"]
    hit = {d for d, *_ in brute_contained([(i, texts[i]) for i in before], items)}
    assert hit and set(after) == before - hit
    before, after = kept["mixing to target weights"]
    assert set(after) <= before and len(clean & set(after)) >= 0.95 * len(clean & before)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert Counter(r["doc_id"] for r in last) == after
    for shard in {r["shard"] for r in last}:
        slots = sorted(r["slot"] for r in last if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_stages_on_odd_documents(spark, frame, corpus, sf_dir):
    docs = frame(corpus)
    for _, function in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(function(spark, docs, sf_dir), "odd")
        assert docs.columns == frame([]).columns
    assert docs.count() > 0
    empty = frame([])
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, empty, sf_dir).collect() == []


def test_every_operator_has_one_query():
    numbers = Counter(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == dict.fromkeys(range(1, 14), 1)


def test_rows_without_or_with_repeated_ids(spark, frame, sf_dir):
    """Rows are told apart by id and text: copies go whatever their ids are, and no clean text goes with them."""
    words = [" ".join(f"w{k}x{i}" for i in range(90)) for k in range(4)]
    item = " ".join(r["text"] for r in table(spark, sf_dir, "benchmark").limit(3).collect())
    pairs = [(1, words[0]), (1, words[0]), (2, words[0]), (None, words[0]), (None, words[0]), (3, words[1]), (3, words[0]), (None, words[2])]
    pairs += [(None, words[3]), (None, words[3])]
    kept = corpus_pipeline.near_duplicates(spark, frame(pairs), sf_dir)
    assert kept.columns == frame(pairs).columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(1, words[0]), (3, words[1]), (None, words[2]), (None, words[3])])
    dirty = [(None, item + " " + words[0]), (5, item), (5, words[1]), (None, words[2]), (None, None)]
    clean = corpus_pipeline.decontamination(spark, frame(dirty), sf_dir)
    assert Counter((r["doc_id"], r["text"]) for r in clean.collect()) == Counter([(5, words[1]), (None, words[2]), (None, None)])
