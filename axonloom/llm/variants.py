"""Spelling variants grouped by search schemes over a bidirectional FM-index of the vocabulary.

Words one edit apart share a half: cut a word in two, and the edit spares one part. The scheme has two searches. The first
matches the left half exactly, with the delimiter before it, and extends to the right over the other half, where one
symbol may be inserted, deleted or replaced; the second matches the right half with the delimiter behind it and extends to
the left. Both move an interval of suffix ranks in the index of the delimited vocabulary and, in step, the one of the
reversed vocabulary, so a match grows either way. A finished match with both delimiters has one suffix, whose place names
the word. All words of a block move together as arrays.

No index holds the whole vocabulary. Each word goes to a group by its first three letters and to one by its last three
(halves have three at least), and groups are dealt into blocks of about ``BLOCK`` words. A group larger than that is dealt
over several blocks, and each block's words are searched for in each of them. Words are counted in tasks, so one row a word and task is
shuffled; a word's pairs are reduced before they are.

Words are maximal runs of A-Z, a-z and U+00C0-U+00FF, A-Z in lower case, of ``SHORTEST`` letters and ``LEAST``
occurrences or more. A word's form is its near word of largest n (ties: smallest), if that is ``RATIO`` times its own or
more; forms grow, so following them ends at the root, which is found by doubling the steps.

Defined cases: null and empty texts have no words; rows that repeat count each time; other columns are ignored; an empty
vocabulary gives an empty result; a text of any length is counted piece by piece.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonloom.llm.suffixes import suffix_array
from axonloom.llm.textops import CHUNK_BYTES, LOWER, sliced
from axonloom.session import cut

SHORTEST, LEAST, RATIO = 6, 5, 5
#: Words of a block, and distinct words that a task holds before it passes their counts on.
BLOCK, HELD = 4_000, 200_000
_WORD = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: Rows between two samples of an index, and states that are looked at together.
_SAMPLE, _STATES = 64, 1 << 14

Change = Callable[[bytes, bytes], bytes]


def _counter(change: Change | None, shortest: int):
    def tally(text: bytes) -> Counter:
        text = text.translate(LOWER)
        return Counter(_WORD.findall(text) if len(text) <= CHUNK_BYTES else (m.group() for m in _WORD.finditer(text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, _, texts in sliced(batch.column(1)):
                for doc_id, text in zip(ids[lo:], texts):
                    prefix = b"" if doc_id is None else b"%d" % doc_id
                    for word, n in tally(text or b"").items():
                        if change is not None and prefix:
                            word = change(prefix, word)
                        if len(word) - word.count(b"\xc3") >= shortest:
                            held[word] += n
                    if len(held) > HELD:
                        yield out()
        yield out()

    return run


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, change: Change | None = None) -> DataFrame:
    """(word, n) of the words with enough letters and occurrences. ``change(doc_id, word)`` may alter a document's
    words, each distinct one once, as bytes."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(_counter(change, shortest), "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class _Side:
    """Ranks in a Burrows-Wheeler transform: how many symbols equal to c, or smaller, its first i rows hold."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.sa, _ = suffix_array(symbols)
        bwt = symbols[self.sa - 1].astype(np.uint8)
        n = len(bwt)
        self.bwt = np.full((n // _SAMPLE + 1) * _SAMPLE, 255, np.uint8)
        self.bwt[:n] = bwt
        self.rows = self.bwt.reshape(-1, _SAMPLE)
        # below[b, c]: symbols smaller than c in the rows before sample b
        each = np.zeros((len(self.rows) + 1, sigma + 1), np.int64)
        np.add.at(each, (np.arange(n) // _SAMPLE + 1, bwt.astype(np.int64) + 1), 1)
        self.below = each.cumsum(axis=0).cumsum(axis=1)
        self.first = self.below[-1]

    def ranks(self, c: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        equal, smaller = np.empty(len(i), np.int64), np.empty(len(i), np.int64)
        for at in range(0, len(i), _STATES):
            s = slice(at, at + _STATES)
            b, inside = i[s] // _SAMPLE, np.arange(_SAMPLE) < (i[s] % _SAMPLE)[:, None]
            rows, x = self.rows[b], c[s]
            smaller[s] = self.below[b, x] + ((rows < x[:, None]) & inside).sum(axis=1)
            equal[s] = self.below[b, x + 1] - self.below[b, x] + ((rows == x[:, None]) & inside).sum(axis=1)
        return equal, smaller


class Index:
    """A bidirectional FM-index of words, each between delimiters. A state is (low, reversed low, size)."""

    END, DELIMITER = 0, 1

    def __init__(self, words: list[str]):
        codes = [np.array([*map(ord, w)], np.int64) for w in words]
        self.letters = np.unique(np.concatenate(codes))
        sizes = np.array([len(c) for c in codes])
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        text = np.full(int((sizes + 1).sum()) + 1, self.DELIMITER, np.int64)
        text[np.concatenate([s + 1 + np.arange(k) for s, k in zip(self.starts, sizes)])] = 2 + np.searchsorted(self.letters, np.concatenate(codes))
        self.sigma = 2 + len(self.letters)
        self.n = len(text) + 1
        self.sides = [_Side(np.concatenate([t, [self.END]]), self.sigma) for t in (text, text[::-1])]

    def encoded(self, word: str) -> np.ndarray:
        """Symbols of a word; letters that no word of the index has get one past the last."""
        code = np.array([*map(ord, word)], np.int64)
        at = np.minimum(np.searchsorted(self.letters, code), len(self.letters) - 1)
        return np.where(self.letters[at] == code, at + 2, self.sigma)

    def extended(self, state: np.ndarray, c: np.ndarray, left: bool) -> np.ndarray:
        """States (3 x n) after one more symbol on the left or on the right; size 0 where nothing matches."""
        low, other, size = state if left else state[[1, 0, 2]]
        side = self.sides[0 if left else 1]
        known = np.where(c < self.sigma, c, 0)
        e0, s0 = side.ranks(known, low)
        e1, s1 = side.ranks(known, low + size)
        new = np.stack([side.first[known] + e0, other + (s1 - s0), np.where(c < self.sigma, e1 - e0, 0)])
        return new if left else new[[1, 0, 2]]

    def children(self, state: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(parent, symbol, states): every letter by which each state can grow. Letters of a short interval are read off
        its rows; of a long one all are tried."""
        low, size = state[0 if left else 1], state[2]
        short = np.flatnonzero(size <= self.sigma)
        of = np.repeat(short, size[short])
        row = np.arange(len(of)) - np.repeat(np.cumsum(size[short]) - size[short], size[short]) + low[of]
        pairs = np.unique(of * self.sigma + self.sides[0 if left else 1].bwt[row])
        long = np.flatnonzero(size > self.sigma)
        parent = np.concatenate([pairs // self.sigma, np.repeat(long, self.sigma)])
        symbol = np.concatenate([pairs % self.sigma, np.tile(np.arange(self.sigma), len(long))])
        letter = symbol > self.DELIMITER
        parent, symbol = parent[letter], symbol[letter]
        new = self.extended(state[:, parent], symbol, left)
        some = new[2] > 0
        return parent[some], symbol[some], new[:, some]

    def words_at(self, state: np.ndarray) -> np.ndarray:
        """Numbers of the words whose delimiter begins the match."""
        return np.searchsorted(self.starts, self.sides[0].sa[state[0]], side="right") - 1


def _search(index: Index, words: list[str], left: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) pairs with one edit in the half to which the match is extended: the left one, or the right one."""
    coded = [index.encoded(w) for w in words]
    halves = np.array([len(w) // 2 for w in words])
    # symbols in the order in which they are matched: the kept half outwards from the middle, its delimiter, the other
    # half outwards from the middle, its delimiter
    delimiter = [Index.DELIMITER]
    kept = [np.concatenate([c[h:] if left else c[:h][::-1], delimiter]) for c, h in zip(coded, halves)]
    rest = [np.concatenate([c[:h][::-1] if left else c[h:], delimiter]) for c, h in zip(coded, halves)]

    def table(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(x) for x in xs])
        out = np.zeros((len(xs), int(size.max()) + 1), np.int64)
        for i, x in enumerate(xs):
            out[i, : len(x)] = x
        return out, size

    kept, kept_size = table(kept)
    rest, rest_size = table(rest)
    query = np.arange(len(words))
    state = np.stack([np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.full(len(words), index.n, np.int64)])
    for j in range(kept.shape[1]):
        go = np.flatnonzero((kept_size[query] > j) & (state[2] > 0))
        state[:, go] = index.extended(state[:, go], kept[query[go], j], not left)
    alive = state[2] > 0
    query, state = query[alive], state[:, alive]

    edited: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # query, place in the rest, state
    for j in range(rest.shape[1]):
        go = rest_size[query] > j
        query, state = query[go], state[:, go]
        if not len(query):
            break
        symbol, inner = rest[query, j], rest_size[query] > j + 1
        edited.append((query[inner], np.full(int(inner.sum()), j + 1), state[:, inner]))  # the word lacks this symbol
        parent, letter, new = index.children(state, left)
        edited.append((query[parent], np.full(len(parent), j), new))  # it has one more
        other = inner[parent] & (symbol[parent] != letter)
        edited.append((query[parent[other]], np.full(int(other.sum()), j + 1), new[:, other]))  # it has another
        same = inner[parent] & (symbol[parent] == letter)
        query, state = query[parent[same]], new[:, same]

    if not edited:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    query, at, state = np.concatenate([e[0] for e in edited]), np.concatenate([e[1] for e in edited]), np.concatenate([e[2] for e in edited], axis=1)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(query):
        state = index.extended(state, rest[query, at], left)
        at = at + 1
        alive = state[2] > 0
        over = alive & (at == rest_size[query])
        done.append((query[over], index.words_at(state[:, over])))
        alive &= ~over
        query, at, state = query[alive], at[alive], state[:, alive]
    return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])


def _near(frame: pd.DataFrame) -> pd.DataFrame:
    """Near pairs of one block: every ``asks`` row is searched for among the ``held`` ones. Pairs that share the left half
    come from the first search alone."""
    left = bool(frame["side"].iloc[0])
    held, asks = frame[frame["held"]], frame[frame["asks"]]
    words, queries = held["word"].tolist(), asks["word"].tolist()
    query, word = _search(Index(words), queries, left) if words and queries else (np.zeros(0, np.int64),) * 2
    pairs = np.unique(query * (len(words) + 1) + word)
    query, word = pairs // (len(words) + 1), pairs % (len(words) + 1)
    if left:
        other = np.array([words[w][: len(queries[q]) // 2] != queries[q][: len(queries[q]) // 2] for q, w in zip(query.tolist(), word.tolist())], bool)
        query, word = query[other], word[other]
    pick = lambda of, column, i: of[column].to_numpy()[i]
    return pd.DataFrame({"word": pick(asks, "word", query), "n": pick(asks, "n", query), "near": pick(held, "word", word), "near_n": pick(held, "n", word)})


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs of ``words`` (word, n; six letters or more each) that differ by one
    inserted, deleted or replaced letter."""
    total = words.count()
    sides = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", 1, 3).alias("ends")), F.struct(F.lit(1).alias("side"), F.substring("word", -3, 3).alias("ends")))
    rows = words.select("word", "n", F.explode(sides).alias("s")).select("word", "n", "s.side", "s.ends")
    sizes = rows.groupBy("side", "ends").agg(F.count("*").alias("size"))
    # at most total / block groups a side are larger than a block
    large = sizes.where(F.col("size") > block).select("side", "ends", F.ceil(F.col("size") / block).alias("parts"))
    bins = -(-total // block) if total else 1
    rows = rows.join(large, ["side", "ends"], "left")
    parts = F.coalesce("parts", F.lit(1).cast("bigint"))
    own = F.pmod(F.xxhash64("word"), parts)
    # a task takes the questions of one part and the index of another: a word asks in each part and is held for each
    every = F.sequence(F.lit(0).cast("bigint"), parts - 1)
    asking = F.transform(every, lambda p: F.struct(own.alias("of"), p.alias("part"), F.lit(True).alias("asks"), (p == own).alias("held")))
    holding = F.transform(F.filter(every, lambda p: p != own), lambda p: F.struct(p.alias("of"), own.alias("part"), F.lit(False).alias("asks"), F.lit(True).alias("held")))
    rows = rows.withColumn("bin", F.when(F.col("parts").isNull(), F.concat(F.lit("#"), F.pmod(F.xxhash64("ends"), F.lit(bins)).cast("string"))).otherwise(F.col("ends")))
    rows = rows.select("word", "n", "side", "bin", F.explode(F.concat(asking, holding)).alias("p")).select("word", "n", "side", "bin", "p.*")
    # blocks keep their size as the vocabulary grows, so there are more tasks then, not longer ones
    rows = rows.repartition(2 * bins, "side", "bin", "of", "part")
    return rows.groupBy("side", "bin", "of", "part").applyInPandas(_near, "word string, n bigint, near string, near_n bigint")


def grouped(words: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near and form_n of every row of ``words`` (word, n)."""
    words = cut(words)
    best = near_words(words, block).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    rows = words.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    fits = F.col("form_n") >= ratio * F.col("n")
    rows = cut(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")))
    steps = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # each turn doubles the steps taken; a chain's n grow by ``ratio``, so turns are few
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = cut(steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if steps.where("moved").isEmpty():
            break
        steps = steps.drop("moved")
    return rows.join(steps.drop("moved"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
