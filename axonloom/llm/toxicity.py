"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The examples are a bounded sample of the labelled rows of either label, each text once. Terms are all words and word
beginnings (4 to 6 letters, marked) that two examples share, of both labels. A term's weight in a text is
(1 + log tf) x idf x (FLOOR + association): document frequencies are counted over all documents, and the association is
the phi coefficient of term and label in the sample beyond chance (supervised term weighting: every term counts, those
that tell the labels apart count more). Vectors have unit length.

Examples lie in blocks of like ones, made by halving them along their leading direction. The index holds, for each
term, its largest weight in every block that has it, and below that its weights in the block's examples; the longest
postings (``DENSE`` terms at most) are kept as a dense matrix, whose part of all cosines is one product. A query adds
that part's best and the block maxima up to bound each block's best cosine, scores the examples of the ``FIRST`` blocks
with the highest bounds, and then opens every block whose bound reaches the k-th best cosine so far: the k largest
cosines are exact, of equal ones the example with the smaller id comes first. Votes weighted by cosine (and by how densely each label was
sampled), shrunk to the base rate, are calibrated by isotonic regression on the examples, each left out.

Defined cases: null and empty texts, and texts without a known term, get the rate among examples without one; without
labels every score is 0.5; repeated rows stay rows; labels of repeated ids count once each; with labels of one kind all
votes go to it; other columns are ignored. The model's size is bounded by the terms of SAMPLE_ROWS examples a label,
whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonloom.llm.textops import Words, drawn, mix, sliced
from axonloom.session import cut

#: Labelled rows of each label that serve as examples at most (about; chosen by a hash of their id): label 1, label 0.
SAMPLE_ROWS = (1_200, 2_000)
NEIGHBOURS, BLOCK, SHRINK, THRESHOLD = 15, 64, 0.5, 0.7
#: Blocks that are opened first, queries that are searched together, and what single precision may miss.
FIRST, TOGETHER, NEAR = 2, 64, 1e-5
#: Bits by which a term's hash is looked up.
TOP = 18
#: Terms whose postings are dense at most; they lie in one of so many examples at least.
DENSE, DENSE_SHARE = 2_048, 64
#: What a term counts without any association with the label, and the chi-square that chance may reach.
FLOOR, CHANCE = 0.02, 20.0
PREFIXES = (4, 5, 6)

IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x41:0x5B] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True


def terms(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, term hash) of every word and word beginning."""
    w = Words(texts, IS_WORD)
    if not w.n:
        return w.text, np.zeros(0, np.uint64)
    lead = np.flatnonzero((w.bytes & 0xC0) != 0x80)  # first bytes of characters
    first = np.searchsorted(lead, w.start)
    letters = np.searchsorted(lead, w.end) - first
    lead = np.append(lead, len(w.bytes))
    text, hashes = [w.text], [w.hashes()]
    for n in PREFIXES:
        long = letters >= n
        cut_at = np.where(long, lead[np.minimum(first + n, len(lead) - 1)], w.end)
        text.append(w.text[long])
        hashes.append(mix(w.hashes(cut_at)[long] + np.uint64(n)))
    return np.concatenate(text), np.concatenate(hashes)


def _counted(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, times), sorted by both."""
    if not len(key):
        return text, key, text
    by = np.lexsort((key, text))
    text, key = text[by], key[by]
    at = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (key[1:] != key[:-1])))
    return text[at], key[at], np.diff(np.append(at, len(key)))


def starts(vocabulary: np.ndarray) -> np.ndarray:
    """Where the hashes with each value of the top ``TOP`` bits start in the sorted vocabulary."""
    return np.searchsorted(vocabulary >> np.uint64(64 - TOP), np.arange((1 << TOP) + 1, dtype=np.uint64)).astype(np.int32)


def known_terms(vocabulary: np.ndarray, start: np.ndarray, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in the vocabulary, times) of the known terms, sorted by both. ``start``: of starts()."""
    text, h = terms(texts)
    top = (h >> np.uint64(64 - TOP)).astype(np.int64)
    at, end = start[top], start[top + 1]
    some = np.flatnonzero(at < end)
    text, h, at, end = text[some], h[some], at[some], end[some]
    keys = []
    while len(h):  # few hashes share their top bits
        hit = vocabulary[at] == h
        keys.append(text[hit].astype(np.int64) * len(vocabulary) + at[hit])
        at = at + 1
        rest = ~hit & (at < end)
        text, h, at, end = text[rest], h[rest], at[rest], end[rest]
    key, times = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
    return key // max(1, len(vocabulary)), key % max(1, len(vocabulary)), times


def _sample_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, text) to (doc_id, label, terms, times), the last two as packed numbers."""
    for batch in batches:
        for a, b, texts in sliced(batch.column(2)):
            text, h, n = _counted(*terms(texts))
            at = np.searchsorted(text, np.arange(b - a + 1))
            parts = [(h[x:y].tobytes(), n[x:y].astype(np.int32).tobytes()) for x, y in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *(pa.array(x, pa.binary()) for x in zip(*parts))], names=["doc_id", "label", "terms", "times"])


def _frequencies(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, start = np.zeros(len(vocabulary) + 1, np.int64), starts(vocabulary)
        for batch in batches:
            for a, b, texts in sliced(batch.column(0)):
                df[-1] += b - a
                df[:-1] += np.bincount(known_terms(vocabulary, start, texts)[1], minlength=len(vocabulary))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["term", "n"])

    return run


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Steps (from x on, value) of the best non-decreasing fit, by pooling violators."""
    order = np.argsort(x, kind="stable")
    weight = np.ones(len(x)) if weight is None else weight
    pools: list[list[float]] = []
    for a, b, w in zip(x[order].tolist(), y[order].tolist(), weight[order].tolist()):
        pools.append([a, b, w])
        while len(pools) > 1 and (pools[-2][1] >= pools[-1][1] or pools[-2][0] == pools[-1][0]):
            _, v, n = pools.pop()
            p = pools[-1]
            p[1], p[2] = (p[1] * p[2] + v * n) / (p[2] + n), p[2] + n
    return np.array([p[0] for p in pools]), np.array([p[1] for p in pools])


def _spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, and the number of the range each lies in."""
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size - start, size), of


def _alike(row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int, n_terms: int, size: int) -> np.ndarray:
    """An order of the rows in which like ones are near: halves along the leading direction, down to ``size`` rows."""
    order, groups = np.arange(n), [(0, n)]
    ptr = np.searchsorted(row, np.arange(n + 1))
    while groups:
        lo, hi = groups.pop()
        if hi - lo <= size:
            continue
        at, of = _spread(ptr[order[lo:hi]], ptr[order[lo:hi] + 1] - ptr[order[lo:hi]])
        c, v, m = col[at], val[at], hi - lo
        mean = np.bincount(c, v, n_terms) / m
        x = np.random.default_rng(0).normal(size=m)
        for _ in range(6):  # power iteration on the centred rows
            y = np.bincount(c, v * x[of], n_terms) - mean * x.sum()
            x = np.bincount(of, v * y[c], m) - mean @ y
            x /= np.linalg.norm(x) or 1.0
        half = -(-m // size) // 2 * size  # whole blocks on the left
        order[lo:hi] = order[lo:hi][np.argsort(x, kind="stable")]
        groups += [(lo, lo + half), (lo + half, hi)]
    return order


class Index:
    """Examples as unit vectors in blocks, with block maxima by term.

    ``vocabulary``: sorted term hashes; ``weight``: idf x association of each; an example is (terms, times)."""

    def __init__(self, vocabulary: np.ndarray, weight: np.ndarray, ids: np.ndarray, labels: np.ndarray, examples: list[tuple[np.ndarray, np.ndarray]], share: tuple[float, float] = (1.0, 1.0), block: int = BLOCK):
        self.vocabulary, self.weight, self.block = vocabulary, weight, block
        self.start = starts(vocabulary)
        some = np.array([len(t) > 0 for t, _ in examples], bool)
        labels, ids = np.asarray(labels, float), np.asarray(ids, np.int64)
        each = np.where(labels > 0, 1 / share[0], 1 / share[1])
        self.base = float((each @ labels + 0.5) / (each.sum() + 1))
        bare = each[~some]
        self.bare = float((bare @ labels[~some] + self.base) / (bare.sum() + 1))
        kept = np.flatnonzero(some)
        kept = kept[np.argsort(ids[kept], kind="stable")]
        size = np.array([len(examples[i][0]) for i in kept], np.int64)
        row = np.repeat(np.arange(len(kept)), size)
        col = np.concatenate([examples[i][0] for i in kept]) if len(kept) else np.zeros(0, np.int64)
        times = np.concatenate([examples[i][1] for i in kept]) if len(kept) else np.zeros(0)
        val = self.unit(row, col, times, len(kept))
        #: Example numbers follow the ids; ``place`` is an example's place in the blocks.
        self.ids, self.labels, self.each = ids[kept], labels[kept], each[kept]
        n, terms_ = len(kept), len(vocabulary)
        place = np.empty(n, np.int64)
        place[_alike(row, col, val, n, terms_, block)] = np.arange(n)
        self.blocks = -(-n // block)
        often = np.argsort(-np.bincount(col, minlength=terms_), kind="stable")[:DENSE]
        often = often[np.bincount(col, minlength=terms_)[often] * DENSE_SHARE >= max(n, 1)]
        #: Column of the dense matrix of each term, -1 for those with postings.
        self.column = np.full(terms_, -1, np.int32)
        self.column[often] = np.arange(len(often))
        self.dense = np.zeros((n, len(often)), np.float32)
        full = self.column[col] >= 0
        self.dense[row[full], self.column[col[full]]] = val[full]
        self.block_by_example = (place // block).astype(np.int32)
        by = np.argsort(self.block_by_example, kind="stable")
        self.by_block, self.begins = by, np.searchsorted(self.block_by_example[by], np.arange(self.blocks))
        self.ptr, self.col, self.val = np.concatenate([[0], np.cumsum(size)]), col.astype(np.int32), val.astype(np.float32)
        row, col, val = row[~full], col[~full], val[~full]
        by = np.lexsort((place[row], col))
        self.example, self.value = row[by].astype(np.int32), val[by].astype(np.float32)
        key = col[by] * max(1, self.blocks) + place[row[by]] // block
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.block_of = (key[first] % max(1, self.blocks)).astype(np.int32)
        self.peak = np.maximum.reduceat(self.value, first) if len(first) else np.zeros(0, np.float32)
        self.below = np.append(first, len(key)).astype(np.int64)
        self.entry = np.searchsorted(key[first] // max(1, self.blocks), np.arange(terms_ + 1))
        self.steps = self.values = np.zeros(0)

    def unit(self, row: np.ndarray, col: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
        """Weights of the rows' terms, each row at unit length."""
        w = (1 + np.log(np.maximum(times, 1))) * self.weight[col]
        return w / np.sqrt(np.maximum(np.bincount(row, w * w, n), 1e-30))[row]

    def cosines(self, row: np.ndarray, col: np.ndarray, w: np.ndarray, n: int, k: int, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cosines of ``n`` queries with the examples in two parts: that of the postings, exact in all blocks that can
        hold one of the k largest and 0 elsewhere, and that of the dense terms to single precision; and the queries'
        weights of the dense terms. ``leave``: an example each query mustn't find."""
        m, blocks = len(self.ids), self.blocks
        full = self.column[col] >= 0
        query = np.zeros((n, self.dense.shape[1]))
        query[row[full], self.column[col[full]]] = w[full]
        part = query.astype(np.float32) @ self.dense.T
        score = np.zeros((n, m))
        row, col, w = row[~full], col[~full], w[~full]
        at, of = _spread(self.entry[col], self.entry[col + 1] - self.entry[col])
        query_of, w = row[of], w[of]
        cell = query_of * blocks + self.block_of[at]
        bound = np.maximum.reduceat(part[:, self.by_block], self.begins, axis=1) + np.bincount(cell, w * self.peak[at], n * blocks).reshape(n, blocks)

        def open_(which: np.ndarray) -> None:
            sel = np.flatnonzero(which.ravel()[cell])
            first = self.below[at[sel]]
            inner, up = _spread(first, self.below[at[sel] + 1] - first)
            if len(inner):
                score.ravel()[:] += np.bincount((query_of[sel] * m)[up] + self.example[inner], w[sel][up] * self.value[inner], score.size)
            if leave is not None:
                score[np.arange(n), leave] = part[np.arange(n), leave] = 0

        begun = np.zeros_like(bound, bool)
        np.put_along_axis(begun, np.argsort(-bound, axis=1, kind="stable")[:, :FIRST], True, 1)
        open_(begun)
        kth = np.partition(score + part, -k, axis=1)[:, -k] if m >= k else np.zeros(n)
        open_(~begun & (bound >= kth[:, None] - NEAR))
        return score, part, query

    def near(self, row: np.ndarray, col: np.ndarray, w: np.ndarray, n: int, k: int = NEIGHBOURS, leave: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each of ``n`` queries (unit vectors, sorted by row) the k largest cosines above 0, best first, with their
        examples' numbers. Of what can be among them the dense part is summed again in double precision."""
        for lo in range(0, n, TOGETHER):
            hi = min(n, lo + TOGETHER)
            ends = np.searchsorted(row, np.arange(lo, hi + 1))
            s = slice(ends[0], ends[-1])
            if not len(self.ids):
                yield from [(np.zeros(0), np.zeros(0, np.int64))] * (hi - lo)
                continue
            score, part, query = self.cosines(row[s] - lo, col[s], w[s], hi - lo, k, None if leave is None else leave[lo:hi])
            both = score + part
            least = np.partition(both, -k, axis=1)[:, -k] if both.shape[1] >= k else np.zeros(hi - lo)
            for i in range(hi - lo):
                found = np.flatnonzero((both[i] >= least[i] - NEAR) & (both[i] > 0))
                # row by row, so that equal examples get equal sums
                cosine = score[i, found] + (self.dense[found] * query[i]).sum(axis=1)
                best = np.argsort(-cosine, kind="stable")[:k]
                yield cosine[best], found[best]

    def vote(self, cosine: np.ndarray, found: np.ndarray) -> float:
        weight = cosine * self.each[found]
        return float((weight @ self.labels[found] + SHRINK * self.base) / (weight.sum() + SHRINK))

    def calibrate(self) -> None:
        row = np.repeat(np.arange(len(self.ids)), np.diff(self.ptr))
        votes = [self.vote(*x) for x in self.near(row, self.col, self.val, len(self.ids), leave=np.arange(len(self.ids)))]
        if votes:
            self.steps, self.values = isotonic(np.array(votes), self.labels, self.each)
        del self.ptr, self.col, self.val  # queries need the postings and the dense matrix only

    def scores(self, texts: list[bytes | None]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """(score, cosines, examples) of each text."""
        row, col, times = known_terms(self.vocabulary, self.start, texts)
        for cosine, found in self.near(row, col, self.unit(row, col, times, len(texts)), len(texts)):
            if not len(found):
                yield self.bare, cosine, found
                continue
            vote = self.vote(cosine, found)
            at = max(int(np.searchsorted(self.steps, vote, side="right")) - 1, 0)
            # a little of the vote keeps the order within a step
            yield min(1.0, max(0.0, 0.97 * float(self.values[at]) + 0.03 * vote)), cosine, found


def association(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> np.ndarray:
    """The phi coefficient of having a term and having label 1, beyond what chance may reach."""
    n, rows = n_pos + n_neg, pos + neg
    chi = n * (pos * n_neg - neg * n_pos) ** 2 / np.maximum(rows * (n - rows) * max(n_pos * n_neg, 1.0), 1e-9)
    return np.sqrt(np.maximum(chi - CHANCE, 0.0) / max(n, 1.0))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", holdout: tuple[int, int] | None = (3, 1), sample_rows: tuple[int, int] = SAMPLE_ROWS) -> Index | None:
    """The index over a sample of rows with a 0/1 label that aren't held out: crc32(doc_id) mod holdout[0] is
    holdout[1]. None without labels."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    if holdout is not None:
        known = known.where(F.crc32(F.col("doc_id").cast("string")) % holdout[0] != holdout[1])
    total = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if not total:
        return None
    n_of = [total.get(1, 0), total.get(0, 0)]
    known = known.where(F.when(F.col("label") == 1, drawn(F.col("doc_id"), sample_rows[0], n_of[0], 5)).otherwise(drawn(F.col("doc_id"), sample_rows[1], n_of[1], 5)))
    share = tuple(min(1.0, rows / max(n, 1)) for rows, n in zip(sample_rows, n_of))
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "label", "text")  # sample_rows ids at most, about
    sample = sample.groupBy("text").agg(F.min("doc_id").cast("bigint").alias("doc_id"), F.min_by("label", "doc_id").alias("label")).select("doc_id", "label", "text")
    rows = cut(sample.mapInArrow(_sample_terms, "doc_id bigint, label int, terms binary, times binary")).orderBy("doc_id").collect()  # the terms of sample_rows texts
    held = [(np.frombuffer(r[2], np.uint64), np.frombuffer(r[3], np.int32)) for r in rows]
    y = np.array([r[1] for r in rows], float)
    vocabulary, place, n = np.unique(np.concatenate([h for h, _ in held]) if held else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    of = np.repeat(y, [len(h) for h, _ in held])
    pos = np.bincount(place, of, len(vocabulary))
    shared = n >= 2
    vocabulary, pos, n = vocabulary[shared], pos[shared], n[shared].astype(float)
    df = np.zeros(len(vocabulary) + 1)
    for r in docs.select("text").mapInArrow(_frequencies(vocabulary), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        df[r[0]] = r[1]
    idf = np.log((df[-1] + 1) / (df[:-1] + 1)) + 1
    weight = idf * (FLOOR + association(pos, n - pos, float(y.sum()), float(len(y) - y.sum())))
    examples = []
    for h, times in held:
        at = np.minimum(np.searchsorted(vocabulary, h), max(len(vocabulary) - 1, 0))
        hit = vocabulary[at] == h if len(vocabulary) else np.zeros(len(h), bool)
        examples.append((at[hit], times[hit]))
    index = Index(vocabulary, weight, np.array([r[0] for r in rows], np.int64), y, examples, share)
    index.calibrate()
    return index


def _scorer(index: Index | None):
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in sliced(batch.column(1)):
                scores, found = [], []
                for s, cosine, near in index.scores(texts) if index else [(0.5, np.zeros(0), np.zeros(0, np.int64))] * (b - a):
                    scores.append(s)
                    found.append([{"doc_id": int(index.ids[j]), "label": int(index.labels[j]), "cosine": float(c)} for c, j in zip(cosine[:5], near[:5])])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(found, evidence)], names=["doc_id", "score", "predicted", "evidence"])

    return run


def scored(docs: DataFrame, index: Index | None) -> DataFrame:
    """doc_id, score, predicted and evidence (the nearest examples) of every row."""
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(_scorer(index), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int, evidence array<struct<doc_id:bigint,label:int,cosine:double>>")
