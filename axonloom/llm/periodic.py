"""Periodic runs of words, by branching tandem repeats over an enhanced suffix array.

Texts of a chunk become one symbol sequence in which no two texts share a symbol. Each interval of the suffix array with
common prefix ``depth`` stands for a repeated word sequence. For every suffix i of its children but the largest, the
inverse suffix array tells if i + depth or i - depth lies in the interval too: if so, the sequence occurs twice in a row,
a square, and if the words after its halves differ it can't be moved right. Each run has one such square at its end; it
is rotated left as long as the words agree, which gives the run. Squares with the same end whose period is a multiple of
one that reaches as far are the same run and go. Intervals come from the LCP array alone: no tree nodes are made.

A run is a stretch of words with smallest period q, at least max(``shortest``, 2q) long, that no neighbouring word
extends. Texts are worked on in chunks of a megabyte; one longer text is a chunk of its own, in memory linear in it.

Defined cases: null, empty and blank texts have no words and no runs; repeated rows are rows of their own; null doc_ids
stay null; other columns are ignored by ``runs`` and kept by ``without_repeats``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonloom.llm.suffixes import agreements, lcp_array, nearest_below, suffix_array
from axonloom.llm.textops import sliced

#: Shortest run, in words.
SHORTEST = 12
#: Suffixes of smaller children that are looked at together.
_BLOCK = 1 << 20

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _smaller_children(lcp: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first, last, low, high, depth) of each child interval but the largest of every interval with depth >= 1:
    places in the suffix array, ``last`` and ``high`` inclusive."""
    n = len(lcp)
    padded = np.concatenate([[-1], lcp[1:], [-1]])
    low, left = nearest_below(padded)
    high, right = (n - x[::-1] for x in nearest_below(padded[::-1].copy()))
    at = np.flatnonzero(padded[:n] >= 1)
    # the child that ends before boundary ``at``; the last child of an interval begins at its last boundary
    ends = at[right[at] == high[at]]
    first, last = np.concatenate([left[at], ends]), np.concatenate([at - 1, high[ends] - 1])
    lo, hi = np.concatenate([low[at], low[ends]]), np.concatenate([high[at], high[ends]]) - 1
    depth = np.concatenate([padded[at], padded[ends]])
    order = np.lexsort((first - last, hi, lo))  # the largest child of each interval first
    lo_, hi_ = lo[order], hi[order]
    keep = np.zeros(len(order), bool)
    keep[1:] = (lo_[1:] == lo_[:-1]) & (hi_[1:] == hi_[:-1])
    order = order[keep]
    return first[order], last[order], lo[order], hi[order], depth[order]


def _branching_squares(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end, period) of all squares that can't be moved right; ``end`` exclusive."""
    n = len(symbols)
    sa, isa = suffix_array(symbols)
    first, last, low, high, depth = _smaller_children(lcp_array(symbols, sa))
    found = []
    sizes = last - first + 1
    upto = np.cumsum(sizes)
    begin = 0
    while begin < len(sizes):
        done = upto[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(upto, done + _BLOCK, side="right")))
        size = sizes[begin:stop]
        child = np.repeat(np.arange(begin, stop), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[child]
        i, d, lo, hi = sa[place], depth[child], low[child], high[child]
        for start in (i, i - d):
            other = start + d if start is i else start
            ok = np.flatnonzero((other >= 0) & (other < n))
            ok = ok[(isa[other[ok]] >= lo[ok]) & (isa[other[ok]] <= hi[ok])]
            s, p = start[ok], d[ok]
            branching = symbols[s + p] != symbols[s + 2 * p]
            found.append(np.stack([s + 2 * p, p])[:, branching])
        begin = stop
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.unique(np.concatenate([e * (n + 1) + p for e, p in found]))
    return key // (n + 1), key % (n + 1)


def _runs(symbols: np.ndarray, shortest: int) -> tuple[np.ndarray, ...]:
    """(start, length, period) of all runs, by start, then period."""
    end, period = _branching_squares(symbols)  # by end, then period
    out = []
    while len(end):
        lead = np.ones(len(end), bool)
        lead[1:] = end[1:] != end[:-1]
        e, p = end[lead], period[lead]
        s = e - 2 * p
        s = s - agreements(symbols, s - 1, s - 1 + p, -1)
        out.append((s, e - s, p))
        # longer periods with the same end: multiples inside the run are the same run
        group = np.cumsum(lead) - 1
        rest = ~lead & ~((period % p[group] == 0) & (end - 2 * period >= s[group]))
        end, period = end[rest], period[rest]
    if not out:
        return (np.zeros(0, np.int64),) * 3
    s, length, p = (np.concatenate(x) for x in zip(*out))
    keep = length >= shortest
    s, length, p = s[keep], length[keep], p[keep]
    order = np.lexsort((p, s))
    return s[order], length[order], p[order]


def _found(texts: list[bytes | None], shortest: int) -> tuple[np.ndarray, ...]:
    """(bounds, start, length, period, collapsed): runs of texts[t] are those from bounds[t] to bounds[t + 1], with
    places inside the text; the words of each text without what repeats."""
    words = [(t or b"").split() for t in texts]
    ids: dict[bytes, int] = {}
    sizes = np.array([len(w) for w in words], np.int64)
    bases = np.concatenate([[0], np.cumsum(sizes + 1)])  # each text ends with a symbol of its own
    number = np.zeros(bases[-1], np.int64)
    for base, ws in zip(bases.tolist(), words):
        number[base : base + len(ws)] = [ids.setdefault(w, len(ids) + 1) for w in ws]
    text = np.repeat(np.arange(len(texts)), sizes + 1)
    start, length, period = _runs(text * (len(ids) + 1) + number, shortest)
    bounds = np.searchsorted(start, bases)
    edge = np.zeros(len(number) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    dropped = np.cumsum(edge)[:-1] > 0
    collapsed = []
    for t, ws in enumerate(words):
        if bounds[t] < bounds[t + 1]:
            gone = dropped[bases[t] : bases[t] + len(ws)].tolist()
            ws = [w for w, g in zip(ws, gone) if not g]
        collapsed.append(b" ".join(ws))
    return bounds, start - bases[text[start]] if len(start) else start, length, period, collapsed


def _runner(shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in sliced(batch.column(2)):
                bounds, start, length, period, collapsed = _found(texts, shortest)
                values = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(_RUN))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)
                counts = pa.array([len(c) for c in map(bytes.split, collapsed)], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), lists, pa.array(collapsed, pa.binary()).cast(pa.string()), counts],
                    names=["doc_id", "text_key", "runs", "collapsed", "n_kept"],
                )

    return run


def runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), runs (start, length, period in words, by start, then period), collapsed
    (words that no run repeats, joined by spaces) and n_kept (their number) of every row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_runner(shortest), f"doc_id bigint, text_key bigint, runs {RUNS}, collapsed string, n_kept bigint")


def longest(found: Column) -> Column:
    """The run of greatest length; ties go to the smallest start, then period. Null without a run."""
    best = F.array_max(F.transform(found, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return F.when(best.isNotNull(), F.struct((-best["s"]).alias("start"), best["length"].alias("length"), (-best["p"]).alias("period")))


def listed_runs(found: Column) -> Column:
    """``start,length,period`` of each run, a line each."""
    return F.array_join(F.transform(found, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")


def without_repeats(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` with the words that runs repeat taken out of ``text``; texts without a run stay as they are, byte for
    byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts: list[bytes | None] = []
            for _, _, part in sliced(batch.column(at)):
                bounds, *_, collapsed = _found(part, shortest)
                texts += [c if bounds[t] < bounds[t + 1] else part[t] for t, c in enumerate(collapsed)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.binary()).cast(batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text: of every tenth id (by its checksum) the words repeat from some place on with some period; other
    texts are as they are."""
    h, n, g = F.crc32(F.col("doc_id").cast("string")), F.size("_words").cast("bigint"), F.floor(F.col("_h") / 10)
    rows = docs.select("doc_id", "text", h.alias("_h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)).alias("_words"))
    a = g % F.nullif(n, F.lit(0))
    rows = rows.select("doc_id", "text", "_words", n.alias("_n"), a.alias("_a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("_p"))
    again = F.expr("array_repeat(slice(_words, int(_a + 1), int(_p)), int(ceil((_n - _a) / _p)))")
    words = F.slice(F.concat(F.slice("_words", F.lit(1), F.col("_a").cast("int")), F.flatten(again)), F.lit(1), F.col("_n").cast("int"))
    return rows.select("doc_id", F.when(F.col("_n") > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))
