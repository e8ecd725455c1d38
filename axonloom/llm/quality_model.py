"""Quality by attention over passages (multiple-instance learning).

A text is a bag of passages of 64 words. Each passage is described by shares of byte classes, word shapes and
repetition, encoded by a learnt layer, and weighed by learnt gated attention: the softmax over a bag of
w . (tanh(V h) * sigmoid(U h)). The weighted sum of encodings is scored by a logistic layer. All weights are learnt
together from the labels of whole documents, with Adam, on a bounded sample of the labelled rows.

Defined cases: null, empty and wordless texts are one passage of zeros; without labels every score is 0.5; repeated
rows stay rows; other columns are ignored. The model is a few thousand numbers; a task's memory is one chunk's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonloom.llm.textops import Words, drawn, sliced

#: Labelled rows that training sees at most (about; chosen by a hash of their id).
SAMPLE_ROWS = 6_000
PASSAGE_WORDS, HIDDEN, ATTENTION, EPOCHS, BATCH, RATE, THRESHOLD = 64, 16, 8, 30, 64, 0.01, 0.7

NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0, 0x20, *range(0x09, 0x0E)]] = False
_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "!", "?", "#", "$", "%", "&", "*", "|", "<>", "@", "-_=+/\\", "\"'()[]{};:"]
CLASS = np.full(256, len(_GROUPS), np.int64)
for _i, _g in enumerate(_GROUPS):
    CLASS[list(_g.encode())] = _i
CLASS[0x80:] = len(_GROUPS) + 1
N_CLASS = len(_GROUPS) + 2
N_FEATURES = N_CLASS + 7


def passages(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a chunk, and each text's first row (with the end)."""
    words = Words(texts, NOT_SPACE, lower=False)
    counts = words.counts()
    n_pass = np.maximum(-(-counts // PASSAGE_WORDS), 1)
    first = np.concatenate([[0], np.cumsum(n_pass)])
    x = np.zeros((first[-1], N_FEATURES))
    if not words.n:
        return x, first
    place = np.arange(words.n) - words.first[words.text]
    owner = first[words.text] + place // PASSAGE_WORDS
    size = np.bincount(owner, minlength=len(x)).astype(float)
    some = np.maximum(size, 1)
    length = words.end - words.start
    # byte classes: a byte belongs to the passage of the last word that began
    span = np.repeat(owner, length)
    at = np.arange(length.sum()) - np.repeat(np.concatenate([[0], np.cumsum(length)[:-1]]) - words.start, length)
    held = np.bincount(span * N_CLASS + CLASS[words.bytes[at]], minlength=len(x) * N_CLASS).reshape(len(x), N_CLASS)
    chars = np.maximum(held.sum(axis=1), 1)
    x[:, :N_CLASS] = held / chars[:, None]
    h = words.hashes()
    same = np.zeros(words.n, bool)
    same[1:] = (h[1:] == h[:-1]) & (words.text[1:] == words.text[:-1])
    by = np.lexsort((h, words.text))
    again = np.zeros(words.n, bool)
    again[by[1:]] = (h[by[1:]] == h[by[:-1]]) & (words.text[by[1:]] == words.text[by[:-1]])
    again &= length > 4  # long words that came before in the text
    lines = np.zeros(words.n, bool)
    breaks = np.flatnonzero(words.bytes == 0x0A)
    ahead = np.searchsorted(breaks, words.start)
    lines[1:] = ahead[1:] != ahead[:-1]
    tail = words.bytes[words.end - 1]
    c = N_CLASS
    x[:, c] = np.log(chars / some)
    x[:, c + 1] = np.bincount(owner, same, len(x)) / some
    x[:, c + 2] = np.bincount(owner, again, len(x)) / some
    x[:, c + 3] = np.bincount(owner, lines, len(x)) / some
    x[:, c + 4] = np.bincount(owner, CLASS[tail] >= 3, len(x)) / some
    x[:, c + 5] = np.log1p(size)
    x[:, c + 6] = np.bincount(owner, length == 1, len(x)) / some
    return x, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Mil:
    """The network; ``fit`` and ``score`` take passages and the bags' first rows."""

    NAMES = ("E", "e", "V", "U", "w", "c", "c0")

    def __init__(self, seed: int = 1):
        g = np.random.default_rng(seed)
        self.mean, self.sd = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.p = {
            "E": g.normal(0, N_FEATURES**-0.5, (N_FEATURES, HIDDEN)), "e": np.zeros(HIDDEN), "V": g.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
            "U": g.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "w": g.normal(0, ATTENTION**-0.5, ATTENTION), "c": g.normal(0, HIDDEN**-0.5, HIDDEN), "c0": np.zeros(1),
        }

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, np.diff(first)
        x = np.clip((x - self.mean) / self.sd, -8, 8)
        h = np.maximum(x @ p["E"] + p["e"], 0)
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        raw_a = (t * s) @ p["w"]
        top = np.maximum.reduceat(raw_a, first[:-1])
        a = np.exp(raw_a - np.repeat(top, n))
        a /= np.repeat(np.add.reduceat(a, first[:-1]), n)
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["c0"])}

    def gradients(self, f: dict[str, np.ndarray], first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss."""
        p, n = self.p, np.diff(first)
        dy = (f["y"] - y) / len(y)
        dz = np.repeat(dy[:, None] * p["c"], n, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        da = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first[:-1]), n))
        g = da[:, None] * p["w"]
        dt, ds = g * f["s"] * (1 - f["t"] ** 2), g * f["t"] * f["s"] * (1 - f["s"])
        dh = (dz * f["a"][:, None] + dt @ p["V"].T + ds @ p["U"].T) * (f["h"] > 0)
        return {"E": f["x"].T @ dh, "e": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": ((f["t"] * f["s"]) * da[:, None]).sum(0), "c": f["z"].T @ dy, "c0": np.array([dy.sum()])}

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, seed: int = 2) -> Mil:
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-3
        g, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for epoch in range(EPOCHS):
            rate = RATE * (0.5 + 0.5 * np.cos(np.pi * epoch / EPOCHS))
            order = g.permutation(len(y))
            for at in range(0, len(y), BATCH):
                bags = order[at : at + BATCH]
                rows = np.concatenate([np.arange(first[b], first[b + 1]) for b in bags])
                starts = np.concatenate([[0], np.cumsum(first[bags + 1] - first[bags])])
                d = self.gradients(self.forward(x[rows], starts), starts, y[bags])
                step += 1
                for k, w in self.p.items():
                    grad = d[k] + 1e-4 * w
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad**2
                    w -= rate * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, texts in sliced(batch.column(2)):
            x, first = passages(texts)
            rows = [x[first[i] : first[i + 1]].astype(np.float32).ravel() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(rows, pa.list_(pa.float32()))], names=["doc_id", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", holdout: tuple[int, int] | None = (4, 2), sample_rows: int = SAMPLE_ROWS) -> Mil | None:
    """A network fitted to a sample of the rows with a 0/1 label that aren't held out (see toxicity.train)."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    if holdout is not None:
        known = known.where(F.crc32(F.col("doc_id").cast("string")) % holdout[0] != holdout[1])
    total = known.count()
    if not total:
        return None
    known = known.where(drawn(F.col("doc_id"), sample_rows, total, 8))
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "label", "text")  # sample_rows ids at most, about
    xs, ys = [], []
    for r in sample.mapInArrow(_bags, "doc_id bigint, label int, x array<float>").orderBy("doc_id", "label").toLocalIterator():
        xs.append(np.array(r[2], np.float32).reshape(-1, N_FEATURES))
        ys.append(r[1])
    if not ys:
        return None
    first = np.concatenate([[0], np.cumsum([len(x) for x in xs])])
    return Mil().fit(np.concatenate(xs).astype(float), first, np.array(ys, float))


def _scorer(model: Mil | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in sliced(batch.column(1)):
                if model is None:
                    scores, top, n = np.full(b - a, 0.5), np.zeros(b - a), np.zeros(b - a)
                else:
                    x, first = passages(texts)
                    f = model.forward(x, first)
                    scores, n = f["y"], np.diff(first)
                    top = np.array([int(np.argmax(f["a"][first[i] : first[i + 1]])) for i in range(b - a)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(top.astype(np.int64))],
                    names=["doc_id", "score", "predicted", "n_passages", "top_passage"],
                )

    return run


def scored(docs: DataFrame, model: Mil | None) -> DataFrame:
    """doc_id, score, predicted, n_passages, top_passage (the one with the most attention) of every row."""
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(_scorer(model), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int, n_passages bigint, top_passage bigint")
