"""Main text of web pages by a recurrent block labeller.

A page is a sequence of blocks. Each block is a vector: its tag path and classes (hashed),
its words (hashed), its length and its share of link text. A bidirectional LSTM in numpy
reads the sequence both ways and labels every block as article or not, so a block is judged
by the whole page around it.

The labeller is trained on a bounded sample of the given pages. Blocks whose container
says what they are (``article``, ``main``, ``nav``, ``footer``, ...) carry the labels; the
sample's pages are varied by putting boilerplate of many kinds around and between their
blocks and by renaming containers, so that it does not depend on one site's template.
Weights are a few thousand numbers, sent to the tasks with the code.

Defined cases: a null or blank page has an empty text; broken markup is read as far as
tags can be told; repeated rows are extracted each; an empty table gives an empty table;
without a page that names its article, nothing can be learned or extracted; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import only, sampled, slices, table
from riskloom.llm.hashing import WindowHasher
from riskloom.llm.html_blocks import Block, page_blocks

#: Pages that the labeller is trained on, at most; the least hashes of the id are taken.
TRAINING_PAGES = 300
#: Longest page that is trained on, in blocks; longer ones are labelled all the same.
TRAINING_BLOCKS = 200
#: Longest page that is sent to the driver for training, in characters.
TRAINING_CHARS = 1 << 16
#: Rows of the path table, buckets of words, other measures, and cells per direction.
PATHS, WORDS, MEASURES, CELLS = 2048, 32, 4, 16
STEPS, PAGES_PER_STEP, RATE = 220, 16, 0.02
#: Blocks that a task labels in one pass, and tag paths that a worker keeps the rows of.
BLOCKS_PER_PASS, KEPT_PATHS = 8192, 4096

#: Containers of the article, of everything else, and ways to say them on pages unlike the sample.
ARTICLE = ("<article>", "<main>")
OTHER = ("<nav>", "<header>", "<footer>", "<aside>", "<form>", "<head>", "<title>", "<menu>", "<dialog>", "<button>", "<select>")
OTHER_NAMES = (
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie consent footer form header login "
    "menu modal nav navbar navigation newsletter notice pager pagination popup promo related replies reply search share "
    "sidebar signup social sponsor sponsored subscribe tags toc toolbar widget"
).split()
ARTICLE_NAMES = "article body content entry main post story text".split()
OTHER_TAGS = ("<div>", "<section>", "<ul>", "<p>", "<span>", "<table>")


def path_rows(path: tuple[str, ...]) -> tuple[int, ...]:
    return tuple(sorted({xxhash.xxh3_64_intdigest(name) % PATHS for name in path})) or (0,)


class Sequences:
    """Vectors of the blocks of several pages. Words and paths met before are kept, up to a number."""

    hasher = WindowHasher(1)
    known_paths: dict[tuple[str, ...], tuple[int, ...]] = {}

    def __init__(self, pages: Sequence[Sequence[Block]]):
        self.lengths = np.array([len(p) for p in pages])
        blocks = [b for p in pages for b in p]
        known = self.known_paths
        if len(known) > KEPT_PATHS:
            known.clear()
        rows = [known[b.path] if b.path in known else known.setdefault(b.path, path_rows(b.path)) for b in blocks]
        self.row_counts = np.array([len(r) for r in rows])
        self.rows = np.fromiter((r for part in rows for r in part), np.int64, int(self.row_counts.sum()))
        self.row_starts = np.cumsum(np.r_[0, self.row_counts[:-1]])
        words = [b.text.split() for b in blocks]
        counts = np.array([len(w) for w in words])
        buckets = (self.hasher.words([w for part in words for w in part]) % np.uint64(WORDS)).astype(np.int64)
        cells = np.repeat(np.arange(len(blocks)) * WORDS, counts) + buckets
        shares = np.sqrt(np.bincount(cells, minlength=len(blocks) * WORDS).reshape(-1, WORDS) / counts[:, None])
        stops = np.array([sum(map(b.text.count, ".!?;,")) for b in blocks])
        measures = np.log1p(counts) / 5, np.array([b.link_share for b in blocks]), stops / counts, np.array([len(b.path) for b in blocks]) / 10
        self.numbers = np.concatenate([shares, np.stack(measures, axis=1)], axis=1).astype(np.float32)


class Labeller:
    """The network's weights; forward and backward in time share the input layer."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        wide = 8 * CELLS
        self.weights = {
            "paths": r.normal(0, 0.3, (PATHS, wide)), "numbers": r.normal(0, 0.1, (WORDS + MEASURES, wide)), "bias": np.zeros(wide),
            "ahead": r.normal(0, 0.2, (CELLS, 4 * CELLS)), "back": r.normal(0, 0.2, (CELLS, 4 * CELLS)),
            "out": r.normal(0, 0.3, 2 * CELLS), "out_bias": np.zeros(1),
        }
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    def _inputs(self, s: Sequences) -> np.ndarray:
        w = self.weights
        return np.add.reduceat(w["paths"][s.rows], s.row_starts, axis=0) + s.numbers @ w["numbers"] + w["bias"]

    @staticmethod
    def _padded(flat: np.ndarray, lengths: np.ndarray, places: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        out = np.zeros((int(lengths.max()), len(lengths), flat.shape[1]), flat.dtype)
        out[places] = flat
        return out

    @staticmethod
    def _run(x: np.ndarray, u: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, list]:
        """LSTM over the first axis; cells of ended pages stay at zero."""
        n = x.shape[1]
        h = c = np.zeros((n, CELLS), np.float32)
        states, kept = np.zeros((*x.shape[:2], CELLS), np.float32), []
        for t in range(len(x)):
            z = x[t] + h @ u
            i, f, o = (1 / (1 + np.exp(-z[:, k * CELLS : (k + 1) * CELLS])) for k in range(3))
            g = np.tanh(z[:, 3 * CELLS :])
            before, held = c, h
            c = (f * c + i * g) * live[t][:, None]
            h = o * np.tanh(c)
            states[t] = h
            kept.append((i, f, o, g, before, held, c))
        return states, kept

    @staticmethod
    def _run_back(grad: np.ndarray, kept: list, u: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dx = np.zeros((*grad.shape[:2], 4 * CELLS), np.float32)
        du = np.zeros_like(u)
        dh = dc = np.zeros(grad.shape[1:], np.float32)
        for t in range(len(grad) - 1, -1, -1):
            i, f, o, g, before, held, c = kept[t]
            dh = dh + grad[t]
            tc = np.tanh(c)
            dc = (dc + dh * o * (1 - tc * tc)) * live[t][:, None]
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            dx[t] = dz
            du += held.T @ dz
            dh = dz @ u.T
            dc = dc * f
        return dx, du

    def _forward(self, s: Sequences) -> dict:
        starts = np.cumsum(np.r_[0, s.lengths[:-1]])
        page = np.repeat(np.arange(len(s.lengths)), s.lengths)
        step = np.arange(int(s.lengths.sum())) - starts[page]
        flip = s.lengths[page] - 1 - step
        flat = self._inputs(s)
        live = (np.arange(int(s.lengths.max()))[:, None] < s.lengths).astype(np.float32)
        ahead, kept_a = self._run(self._padded(flat[:, : 4 * CELLS], s.lengths, (step, page)), self.weights["ahead"], live)
        back, kept_b = self._run(self._padded(flat[:, 4 * CELLS :], s.lengths, (flip, page)), self.weights["back"], live)
        both = np.concatenate([ahead[step, page], back[flip, page]], axis=1)
        return {"both": both, "step": step, "flip": flip, "page": page, "live": live, "kept": (kept_a, kept_b), "shape": ahead.shape}

    def scores(self, s: Sequences) -> np.ndarray:
        both = self._forward(s)["both"]
        return both @ self.weights["out"] + self.weights["out_bias"]

    def gradients(self, s: Sequences, labels: np.ndarray) -> tuple[float, dict]:
        w, run = self.weights, self._forward(s)
        score = run["both"] @ w["out"] + w["out_bias"]
        chance = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        loss = -np.mean(np.log(np.where(labels > 0, chance, 1 - chance) + 1e-9))
        d = ((chance - labels) / len(labels)).astype(np.float32)
        grads = {"out": run["both"].T @ d, "out_bias": np.array([d.sum()], np.float32)}
        dboth = d[:, None] * w["out"]
        parts = []
        for k, (name, places) in enumerate((("ahead", run["step"]), ("back", run["flip"]))):
            padded = np.zeros(run["shape"], np.float32)
            padded[places, run["page"]] = dboth[:, k * CELLS : (k + 1) * CELLS]
            dx, grads[name] = self._run_back(padded, run["kept"][k], w[name], run["live"])
            parts.append(dx[places, run["page"]])
        dflat = np.concatenate(parts, axis=1)
        grads["numbers"], grads["bias"] = s.numbers.T @ dflat, dflat.sum(0)
        grads["paths"] = np.zeros_like(w["paths"])
        np.add.at(grads["paths"], s.rows, np.repeat(dflat, s.row_counts, axis=0))
        return float(loss), grads


def labelled_blocks(html: str) -> list[tuple[Block, int]]:
    """Blocks and what their containers say of them; a block without a telling container is not article."""
    found = []
    for block in page_blocks(html):
        names = set(block.path)
        other = names.intersection(OTHER) or names.intersection(OTHER_NAMES)
        found.append((block, int(bool(names.intersection(ARTICLE)) and not other)))
    return found


def _varied(page: list[tuple[Block, int]], texts: list[Block], r: np.random.Generator) -> list[tuple[Block, int]]:
    """The page with containers renamed and boilerplate of other kinds around and inside the article."""
    as_div = r.random() < 0.5
    name = str(r.choice(ARTICLE_NAMES))
    swap = {"<article>": ("<div>", name) if as_div else (str(r.choice(ARTICLE)),)}
    out: list[tuple[Block, int]] = []

    def other(inside: bool) -> list[tuple[Block, int]]:
        if r.random() < 0.5:
            mark: tuple[str, ...] = (str(r.choice(OTHER_TAGS)), str(r.choice(OTHER_NAMES)))
        else:
            mark = (str(r.choice([t for t in OTHER if t not in ("<head>", "<title>")])),)
        base = ("<html>", "<body>", *(swap["<article>"] if inside else ()))
        leaf = (str(r.choice(["<p>", "<li>", "<div>", "<h2>"])),)
        picked = [texts[int(k)] for k in r.integers(0, len(texts), int(r.integers(1, 4)))]
        return [(Block((*base, *mark, *leaf), b.text, float(r.choice([0.0, 0.0, b.link_share, 1.0]))), 0) for b in picked]

    for block, label in page:
        if r.random() < 0.12:
            out += other(inside=bool(label) and r.random() < 0.6)
        path = tuple(x for name_ in block.path for x in (swap.get(name_, (name_,)) if label else (name_,)))
        out.append((block._replace(path=path), label))
    if r.random() < 0.5:
        out += other(inside=False)
    return out


def train_labeller(pages: Sequence[str], steps: int = STEPS, seed: int = 7) -> Labeller | None:
    """A labeller fitted to the pages that name their article, and variations of them; None if none does."""
    known = [p for p in map(labelled_blocks, pages) if len(p) <= TRAINING_BLOCKS and any(label for _, label in p)]
    if not known:
        return None
    r = np.random.default_rng(seed)
    texts = [b for p in known for b, _ in p]
    model = Labeller(seed)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    for step in range(1, steps + 1):
        chosen = [known[int(k)] for k in r.integers(0, len(known), PAGES_PER_STEP)]
        chosen = [p if r.random() < 0.4 else _varied(p, texts, r) for p in chosen]
        batch = Sequences([[b for b, _ in p] for p in chosen])
        labels = np.array([x for p in chosen for _, x in p], np.float32)
        _, grads = model.gradients(batch, labels)
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            model.weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return model


def main_texts(pages: Sequence[str], model: Labeller) -> list[str]:
    """Article blocks of each page, in order, one per line."""
    found = [""] * len(pages)
    group: list[tuple[int, list[Block]]] = []

    def label() -> None:
        scores = model.scores(Sequences([b for _, b in group]))
        at = 0
        for i, blocks in group:
            found[i] = "\n".join(b.text for b, s in zip(blocks, scores[at : at + len(blocks)]) if s > 0)
            at += len(blocks)
        group.clear()

    # Pages of like length go together; a pass holds that many steps times pages.
    parsed = [(i, page_blocks(html)) for i, html in enumerate(pages)]
    for i, blocks in sorted((p for p in parsed if p[1]), key=lambda p: len(p[1])):
        if group and len(blocks) * (len(group) + 1) > BLOCKS_PER_PASS:
            label()
        group.append((i, blocks))
    if group:
        label()
    return found


def extract_pages(pages: DataFrame, training_pages: int = TRAINING_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = only(pages, page_id="bigint", url="string", html="string")
    short = pages.where(F.length("html") <= TRAINING_CHARS)
    model = train_labeller(sampled(short, "page_id", F.col("html"), training_pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            html = [h or "" for h in batch.column("html").to_pylist()]
            texts = main_texts(html, model) if model else [""] * len(html)
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), lengths], names)

    names = ["page_id", "url", "text", "n_chars"]
    return pages.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op7_recurrent_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
