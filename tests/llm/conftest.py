import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, class string, window int, row string, copies int, component_id string, bytes string"


@pytest.fixture(scope="session")
def frame(spark):
    """A documents frame of (doc_id, text) pairs, with other columns whose names the operators use inside."""

    def build(pairs):
        return spark.createDataFrame([(i, t, "en", "c", 1, "r", 9, "x", "b") for i, t in pairs], SCHEMA)

    return build


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Small documents with copies, edited copies, a shared passage, nulls, blanks, repeats and one very long text."""
    r = random.Random(4)
    passage = sentence(r, 70)
    base = [sentence(r, r.randint(60, 160)) for _ in range(30)]
    pairs = list(enumerate(base))
    add = lambda text: pairs.append((len(pairs), text))
    for text in base[:8]:
        add(text)
        words = text.split()
        for k in (1, 2, 4):
            edited = list(words)
            for at in r.sample(range(len(words)), k):
                edited[at] = "edited" + str(r.randint(0, 99))
            add(" ".join(edited))
    hot = base[9].split()
    for k in range(25):
        add(" ".join([*hot[:20], f"copy{k}", *hot[21:]]))
    for text in base[10:14]:
        words = text.split()
        add(" ".join(words[:30]) + " " + passage + " " + " ".join(words[30:]))
    add("\n".join([base[14], passage, "a short line", base[15]]))
    add(sentence(r, 9000))
    add("one two")
    add("One  TWO\t")
    add("the same line again\n" * 60)
    add("ßé ünïcödé " * 40 + sentence(r, 60))
    for text in (None, "", " \n\t ", None):
        add(text)
    pairs += [(3, base[3]), (3, base[3]), (None, base[5]), (None, None)]
    return pairs


@pytest.fixture(scope="session")
def rows():
    return lambda df: [tuple(x) for x in df.collect()]
