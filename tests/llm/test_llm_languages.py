import math
import unicodedata
from collections import Counter

import numpy as np
import pytest

from riskloom.llm import languages
from riskloom.llm.languages import count_words, fit, grams_of, op11_word_backoff, predict, words_of

SCHEMA = "doc_id bigint, text string, lang string, word string, n int, size int, gram string, score string"
DOCS = [
    (1, "the cat sat on the mat and the dog ran", "en"), (2, "A dog and a cat, the end!", "en"),
    (3, "le chat est sur la table et le chien", "fr"), (4, "Où est le château? L'été est là", "fr"),
    (5, "der Hund ist größer als die Katze", "de"), (6, None, "de"), (7, "", "fr"), (8, "123 -- 45", "en"),
    (9, "the the the le", None),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "w", 1, 2, "g", "s") for i, t, lang in rows], SCHEMA)


def brute_model(docs):
    """Log frequency of each (size, gram) per language, and of the unseen."""
    counts = {}
    for _, text, lang in docs:
        for word in words_of(text) if lang else []:
            for size, gram in [(0, word)] + [(s, g) for s in range(1, 6) for g in grams_of(word, s)]:
                counts.setdefault((lang, size), Counter())[gram] += 1
    langs = sorted({lang for lang, _ in counts})
    known = {(size, gram) for (_, size), c in counts.items() for gram in c}

    def log(lang, size, gram):
        c = counts.get((lang, size), Counter())
        return math.log((c[gram] + 0.5) / (sum(c.values()) + 0.5 * len(c)))

    return langs, known, log


def brute_predict(model, text):
    langs, known, log = model
    words = words_of(text)
    if not words:
        return "und", 0.0
    sums = dict.fromkeys(langs, 0.0)
    for word in words:
        for size in (0, 5, 4, 3, 2, 1):
            grams = [word] if size == 0 else grams_of(word, size)
            if found := [g for g in grams if (size, g) in known]:
                for lang in langs:
                    sums[lang] += sum(log(lang, size, g) for g in found) / len(found)
                break
    best = max(langs, key=lambda x: (sums[x], -langs.index(x)))
    return best, 1 / sum(math.exp((s - sums[best]) / len(words)) for s in sums.values())


TEXTS = [
    "the cat", "le chat noir", "die Katze", "catdogs running", "châteaux", "ß", "q", "東京", "zzz the", None, "", "42 !?", "a " * 5000 + "le",
    "ü" * 3000, "The THE le LE",
]


def test_prediction_by_brute_force(spark):
    model = fit(frame(spark, DOCS).where("lang is not null"))
    expected = brute_model([d for d in DOCS if d[2]])
    assert model.langs == expected[0] == ["de", "en", "fr"]
    out = predict(frame(spark, [(i, t, None) for i, t in enumerate(TEXTS)]), model, "doc_id").collect()
    assert len(out) == len(TEXTS)
    for row in out:
        lang, score = brute_predict(expected, TEXTS[row["doc_id"]])
        assert row["lang_pred"] == lang and row["score"] == pytest.approx(score, abs=1e-5)
        assert 0 <= row["score"] <= 1


def test_words_and_marks():
    assert words_of("L'Été 3x_y étude") == ["l", "été", "x", "y", "étude"]
    assert words_of(unicodedata.normalize("NFD", "été")) == ["été"]
    assert words_of("a" * 130) == ["a" * 64, "a" * 64, "aa"]
    assert grams_of("ab", 3) == ["<ab", "ab>"] and grams_of("ab", 5) == [] and grams_of("ab", 1) == ["a", "b"]


def test_words_are_counted_over_all_documents(spark, monkeypatch):
    monkeypatch.setattr(languages, "STORE", 2)
    rows = {(r["lang"], r["word"]): r["n"] for r in count_words(frame(spark, DOCS * 3)).collect()}
    assert rows["en", "the"] == 12 and rows[None, "the"] == 9 and rows["fr", "est"] == 9


def test_the_model_is_bounded(spark):
    rows = [(i, " ".join(f"w{chr(97 + i % 26)}{chr(97 + j % 26)}{'common ' * (j < 3)}" for j in range(30)), "en" if i % 2 else "fr") for i in range(60)]
    model = fit(frame(spark, rows), kept=20)
    assert all(len(p) <= 2 * 20 for p in model.places) and model.logs.size <= 2 * 2 * 20 * 6
    assert np.isfinite(model.logs).all()


def test_nothing_to_learn_from(spark):
    model = fit(frame(spark, []))
    assert [r["lang_pred"] for r in predict(frame(spark, DOCS[:2]), model).collect()] == ["und", "und"]
    assert predict(frame(spark, []), model).collect() == []


def test_accuracy_on_documents_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    out = op11_word_backoff(spark, sf_dir).collect()
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = [r for r in out if r["held_out"]]
    assert len(out) == len(docs) and 0.15 < len(held) / len(out) < 0.35
    assert sum(r["lang_pred"] == docs[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_words_met_before_are_looked_up_once(spark, monkeypatch):
    model = fit(frame(spark, [d for d in DOCS if d[2]]).select("text", "lang"))
    asked = Counter()
    numbers = languages.Model.numbers

    def counted(self, word):
        asked[word] += 1
        return numbers(self, word)

    monkeypatch.setattr(languages.Model, "numbers", counted)
    alone = [model.predict([text]) for text in TEXTS]
    asked.clear()
    met = languages.Met(len(model.langs))
    together = [model.predict([text], met) for text in TEXTS]
    assert set(asked.values()) == {1}
    # Forgetting changes nothing but the work.
    monkeypatch.setattr(languages, "MET_CELLS", 3)
    met = languages.Met(len(model.langs))
    forgetful = [model.predict([text], met) for text in TEXTS]
    assert asked["the"] > 1
    for found in (together, forgetful):
        assert [langs for langs, _ in found] == [langs for langs, _ in alone]
        assert all(np.array_equal(x, y) for (_, x), (_, y) in zip(found, alone))


def test_grams_of_words_that_stand_once_or_often(spark):
    rows = [("en", "the", 3), ("en", "then", 1), ("fr", "le", 1), ("fr", "the", 1), ("en", "aaaa", 1), ("en", "aaa", 2)]
    found = languages.count_grams(spark.createDataFrame(rows, "lang string, word string, n bigint"))
    wanted = Counter()
    for lang, word, n in rows:
        wanted[lang, 0, word] += n
        for size in range(1, 6):
            for gram in grams_of(word, size):
                wanted[lang, size, gram] += n
    assert {(r["lang"], r["size"], r["gram"]): r["n"] for r in found.collect()} == wanted
