"""Benchmark decontamination by winnowing.

Both sides keep the smallest k-gram hash of every sliding window of w k-grams, so two texts that share
k + w - 1 words share a fingerprint. Documents test theirs against a fixed-size bitmap of the benchmark's and pass
on only likely hits; those join the benchmark's fingerprints, compare words, and extend to both sides up to the
window. Items with fewer words than a window are matched whole, by their own length.

Defined cases: a null or empty text has no words, is never hit and yields a row of zeros; an empty benchmark hits
nothing; items with null id hit words but aren't named; equal rows (doc_id and text) each keep their own row; other
columns of the inputs are ignored, whatever their names. Memory in a task is about 100 bytes a word of the largest
chunk (1 MB of text, or one longer document).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axonloom.llm.textops import Words, lean, listed, mix, sliced

#: Word bytes after lower-casing: 0-9, a-z and all of UTF-8's non-ASCII.
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True
#: Slots of the bitmap that benchmark fingerprints set: 512 kB, however large the benchmark.
BITMAP_BITS = 1 << 22
#: Benchmark contexts up to which they are broadcast (some 500 bytes each); beyond, the join shuffles.
BROADCAST_CONTEXTS = 50_000
WINDOW, GRAM = 10, 5

_GRAM = "array<struct<need:int,k:int,pos:int,h:bigint,left:array<string>,mid:string,right:array<string>>>"
_ARROW_GRAM = pa.list_(
    pa.struct(
        [("need", pa.int32()), ("k", pa.int32()), ("pos", pa.int32()), ("h", pa.int64()), ("left", pa.list_(pa.string())), ("mid", pa.string()), ("right", pa.list_(pa.string()))]
    )
)


def winnow(words: Words, hashes: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the selected k-grams: the smallest of each w (the last of equals)."""
    n = words.n - k + 1
    if n < w:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.zeros(n, np.uint64)
    for j in range(k):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    grams = mix(grams + np.uint64(k))
    windows = n - w + 1
    least, at = grams[:windows].copy(), np.arange(windows)
    for j in range(1, w):
        here = grams[j : j + windows]
        take = here <= least
        least[take] = here[take]
        at[take] = np.flatnonzero(take) + j
    at = np.unique(at[words.text[:windows] == words.text[k + w - 2 : k + w - 2 + windows]])
    return at, grams[at]


def _shapes(window: int, gram: int, short: list[int]) -> list[tuple[int, int, int]]:
    """(k, w, words needed): the window's, and whole items of each shorter length."""
    return [(gram, window - gram + 1, window), *((m, 1, m) for m in short)]


def _extract(key_types: list[pa.DataType], window: int, gram: int, short: list[int], bitmap: bytes | None, items: bool):
    """A mapInArrow function: (keys..., text) to (keys..., n_words, grams); for items only grams of their own shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else np.frombuffer(bitmap, np.uint8)
        for batch in batches:
            for a, b, texts in sliced(batch.column(batch.num_columns - 1)):
                words = Words(texts, IS_WORD)
                counts, hashes = words.counts(), words.hashes()
                found: list[list[dict]] = [[] for _ in range(b - a)]
                for k, w, need in _shapes(window, gram, short):
                    at, h = winnow(words, hashes, k, w)
                    if bits is not None:
                        slot = h & np.uint64(BITMAP_BITS - 1)
                        keep = (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                        at, h = at[keep], h[keep]
                    for i, x in zip(at.tolist(), h.view(np.int64).tolist()):
                        d = int(words.text[i])
                        if items and need < window and counts[d] != need:
                            continue
                        lo, hi, side = words.first[d], words.first[d + 1], need - k
                        found[d].append(
                            {
                                "need": need, "k": k, "pos": i - int(lo), "h": x,
                                "left": [words.word(j) if j >= lo else None for j in range(i - 1, i - 1 - side, -1)],
                                "mid": " ".join(map(words.word, range(i, i + k))),
                                "right": [words.word(j) if j < hi else None for j in range(i + k, i + k + side)],
                            }
                        )
                keys = [batch.column(c).slice(a, b - a).cast(t) for c, t in enumerate(key_types)]
                yield pa.RecordBatch.from_arrays(
                    [*keys, pa.array(counts, pa.int64()), pa.array(found, _ARROW_GRAM)],
                    names=[*(f"key{c}" for c in range(len(keys))), "n_words", "grams"],
                )

    return lean(run)


def _reach(a: Column, b: Column, side: Column) -> Column:
    """How many words in a row agree, outwards from the k-gram."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)).cast("int") - 1, side)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document: doc_id, text_key (a hash of the text), n_words, n_hit, items (sorted ids as strings) and spans
    (hit word ranges, end exclusive). A word is hit if it lies in an occurrence of a window of ``window`` item words
    (or of a whole shorter item). ``gram`` is the fingerprint's words; windows are guaranteed for any 1..window."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    item_schema = f"key0 string, n_words bigint, grams {_GRAM}"
    lengths = bench.mapInArrow(_extract([pa.string()], window, gram, [], None, True), item_schema)
    short = sorted(r[0] for r in lengths.where(F.col("n_words").between(1, window - 1)).select("n_words").distinct().collect())
    grams = bench.mapInArrow(_extract([pa.string()], window, gram, short, None, True), item_schema)
    contexts = (
        grams.select("key0", F.inline("grams"))
        .groupBy("h", "k", "need", "left", "mid", "right")
        .agg(F.collect_set("key0").alias("named"))
        .select(F.struct("h", "k", "mid").alias("g"), F.col("left").alias("b_left"), F.col("right").alias("b_right"), "named")
    )
    # of equal fingerprints the first context counts its document's row
    contexts = contexts.join(contexts.groupBy("g").agg(F.min(F.struct("b_left", "b_right")).alias("head")), "g").withColumn(
        "is_head", F.struct("b_left", "b_right") == F.col("head")
    ).drop("head")
    slots = grams.select(F.inline("grams")).select(F.expr(f"h & {BITMAP_BITS - 1}").alias("slot")).groupBy("slot").agg(F.count("*").alias("n")).toArrow()
    bitmap = np.zeros(BITMAP_BITS, bool)  # at most that many rows come, as two packed columns
    bitmap[slots["slot"].to_numpy()] = True
    if slots["n"].to_numpy().sum() <= BROADCAST_CONTEXTS:
        contexts = F.broadcast(contexts)

    rows = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    id_type = rows.schema["doc_id"].dataType
    arrow_id = {T.StringType(): pa.string(), T.IntegerType(): pa.int32()}.get(id_type, pa.int64())
    scanned = rows.mapInArrow(
        _extract([arrow_id, pa.int64()], window, gram, short, np.packbits(bitmap, bitorder="little").tobytes(), False),
        f"key0 {id_type.simpleString()}, key1 bigint, n_words bigint, grams {_GRAM}",
    )
    probes = scanned.select("key0", "key1", "n_words", F.posexplode_outer("grams").alias("nth", "f"))
    side = F.col("f.need") - F.col("f.k")
    near = probes.withColumn("g", F.struct("f.h", "f.k", "f.mid")).join(contexts, "g", "left")
    near = near.select(
        "key0", "key1", "n_words", "named", "f",
        (F.coalesce(F.col("nth") == 0, F.lit(True)) & F.coalesce("is_head", F.lit(True))).alias("counts"),
        _reach(F.col("f.left"), F.col("b_left"), side).alias("l"), _reach(F.col("f.right"), F.col("b_right"), side).alias("r"),
    )
    hit = F.col("named").isNotNull() & (F.col("l") + F.col("f.k") + F.col("r") >= F.col("f.need"))
    span = F.struct((F.col("f.pos") - F.col("l")).alias("s"), (F.col("f.pos") + F.col("f.k") + F.col("r")).alias("e"))
    per_doc = near.groupBy("key0", "key1").agg(
        F.max("n_words").alias("n_words"),
        F.sum(F.col("counts").cast("int")).alias("copies"),
        F.array_sort(F.collect_set(F.when(hit, span))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(hit, F.col("named")))))).alias("items"),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("e"))
    union = F.aggregate(
        "spans", start,
        lambda acc, x: F.struct((acc.n + F.greatest(x.e - F.greatest(x.s, acc.e), F.lit(0))).alias("n"), F.greatest(acc.e, x.e).alias("e")),
        lambda acc: acc.n,
    )
    return per_doc.select(
        F.col("key0").alias("doc_id"), F.col("key1").alias("text_key"), "n_words", union.alias("n_hit"), "items", "spans", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("_copy")
    ).drop("_copy")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``docs`` without the contaminated rows, columns as they were."""
    return listed(docs, contamination(docs, benchmark, **settings).where("n_hit > 0"), "left_anti")
