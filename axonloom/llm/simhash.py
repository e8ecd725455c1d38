"""Near-duplicate groups by SimHash, with pivot distance tables as the filter.

Each text gets a 64-bit fingerprint of its word shingles. Equal fingerprints fold into one row. Every distinct
fingerprint carries a row of the pivot table: its Hamming distances to fixed reference fingerprints. By the triangle
inequality two fingerprints at most d bits apart differ by at most d in every coordinate, so a pair with a larger
difference is thrown away without touching the bits; survivors are verified by their exact distance.

Pairs are proposed by block: with 64 bits in d + 2 blocks, two of the blocks agree for any linked pair. A block key
shared by more than ``crowd`` fingerprints isn't paired off. Its fingerprints are linked exactly through the points one
bit away (d = 2: two fingerprints are linked if and only if those neighbourhoods meet), each point's members to
their smallest only, which is linear and keeps the same components.

With a ``similarity`` the groups follow the word sets instead: documents are linked if the Jaccard similarity of their
shingle sets reaches it. The steps are the same. A set has a fingerprint, whose pairs of blocks are keys; equal sets fold
into one row. At 0.8 two 64-bit fingerprints are about 10 bits apart, up to 20, so blocks alone would lose most links:
``BANDS`` keys of ``ROWS`` minhashes stand beside them (a pair at 0.8 is missed by these with probability 3e-5). The pivot
table holds distances of sets, by symmetric difference, to reference sets. References are all unions of ``CELLS`` ranges
of hash values; how many hashes a set has in each range gives its distance to every union, and the largest difference
over all of them is the sum of the ranges' differences. Pairs at ``similarity`` s differ by at most
(1 - s) / (1 + s) of both sizes, so pairs with a larger coordinate difference are thrown away without touching the sets,
and no link is lost; survivors are verified on the exact sets. Keys shared by up to ``NEAR``
sets are paired off. Of larger ones each member is compared to one head; what still lies in different components then is
compared block by block, all but the pairs inside a key's largest component. So a large group whose members are like
their head costs a pair a member, and components are found twice, whatever the groups.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other; repeated rows stay rows;
null doc_ids take part and get their group's smallest id (null if it has none); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonloom.llm.textops import BROADCAST_IDS, CHUNK_BYTES, LOWER, give_back, lean, listed, mix, raw, sliced
from axonloom.session import cut

SHINGLE, SEED, BITS = 3, 42, 2
#: References of the pivot table, and fingerprints of a block key beyond which it isn't paired off.
PIVOTS, CROWD = 16, 64
#: Keys a document gets, minhashes a key, and sets of a key beyond which it isn't paired off.
BANDS, ROWS, NEAR = 20, 4, 8
#: Ranges of hash values whose unions are the references of the sets' pivot table (a power of two).
CELLS = 64
#: Sets of a block of a larger key, and hashes that all its sets together may have.
BLOCK, BLOCK_HASHES = 256, 2_000_000
#: Hashes counted at once.
_STEP = 1 << 14


def _shingles(text: bytes | None, shingle: int) -> list[bytes]:
    """Runs of ``shingle`` words; all words of a shorter text, none of a blank one."""
    words = (text or b"").translate(LOWER).split()
    if len(words) < shingle:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[j:] for j in range(shingle)))))


def _votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(votes: np.ndarray, of: int) -> np.uint64:
    return np.packbits(votes * 2 > of, bitorder="little").view(np.uint64)[0]


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Bit j is set if over half of the shingles' hashes have it; repeats count each time."""
    shingles = _shingles(text, shingle)
    if not shingles:
        return 0
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(shingles), _STEP):
        part = np.fromiter((digest(s, SEED) for s in shingles[at : at + _STEP]), np.uint64)
        votes += _votes(part)
    return int(_majority(votes, len(shingles)))


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, shingle) for t in raw(batch.column(2))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], names=["doc_id", "text_key", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, fp (the fingerprint's bits as a bigint) of every row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(_fingerprints(shingle), "doc_id bigint, text_key bigint, fp bigint")


def pivots(count: int = PIVOTS, seed: int = 7) -> list[int]:
    """Reference fingerprints as bigints: fixed random bits."""
    return np.random.default_rng(seed).integers(-(2**63), 2**63 - 1, count, np.int64).tolist()


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _block(j: int, of: int) -> Column:
    lo, hi = 64 * j // of, 64 * (j + 1) // of
    return F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


def links(prints: DataFrame, count: int = PIVOTS, crowd: int = CROWD) -> DataFrame:
    """(a, b), a < b: links at two bits or fewer between distinct fingerprints ``fp``; from crowded block keys enough
    of them to connect the same components."""
    table = prints.select("fp", *(_apart(F.col("fp"), F.lit(p)).cast("tinyint").alias(f"d{i}") for i, p in enumerate(pivots(count))))
    blocks = BITS + 2
    keys = F.array(*(F.struct(F.lit(i).alias("c"), F.shiftleft(_block(x, blocks), 16).bitwiseOR(_block(y, blocks)).alias("v")) for i, (x, y) in enumerate(combinations(range(blocks), 2))))
    keyed = table.withColumn("key", F.explode(keys)).select("key.c", "key.v", "*").drop("key")
    sizes = keyed.groupBy("c", "v").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(keyed.join(sizes, ["c", "v"]))
    left = shared.where(f"n <= {crowd}")
    right = left.select("c", "v", *(F.col(x).alias(f"{x}_") for x in ("fp", *(f"d{i}" for i in range(count)))))
    close = F.col("fp") < F.col("fp_")
    for i in range(count):  # the largest coordinate difference bounds the distance from below
        close &= F.abs(F.col(f"d{i}") - F.col(f"d{i}_")) <= BITS
    pairs = left.join(right, (left["c"] == right["c"]) & (left["v"] == right["v"]) & close).where(_apart(F.col("fp"), F.col("fp_")) <= BITS)
    pairs = pairs.select(F.col("fp").alias("a"), F.col("fp_").alias("b"))

    crowded = shared.where(f"n > {crowd}").select("fp").distinct()
    around = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), j))))
    points = crowded.select("fp", F.explode(around).alias("z"))
    heads = points.groupBy("z").agg(F.min("fp").alias("a"), F.max("fp").alias("last")).where("a < last").drop("last")
    stars = points.join(heads, "z").where("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each linked node and the smallest node of its component. Edges (a, b) are contracted to their
    smallest neighbours in turns, which halves paths, until every node points at its root; each turn is checkpointed."""
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        # every neighbour above u moves to u's smallest neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every neighbour below u, and u, move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = cut(small)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, SEED) for s in _shingles(text, shingle)), np.uint64))


def _set_id(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED) if len(hashes) else 0).astype(np.int64))


def _block_pairs(prints: np.ndarray) -> np.ndarray:
    """The keys of each fingerprint: every two of its blocks, as in ``links``."""
    width = 64 // (BITS + 2)
    parts = [prints >> np.uint64(width * j) & np.uint64((1 << width) - 1) for j in range(BITS + 2)]
    return np.stack([x << np.uint64(width) | y for x, y in combinations(parts, 2)], axis=1)


def _sketches(shingle: int):
    rng = np.random.default_rng(11)
    odd, plus = (rng.integers(0, 2**64, BANDS * ROWS, np.uint64) for _ in range(2))
    odd |= np.uint64(1)
    ranges = np.arange(1, CELLS, dtype=np.uint64) << np.uint64(64 - (CELLS - 1).bit_length())

    def sketch(ids: list[pa.Array], texts: list[bytes | None]) -> pa.RecordBatch:
        n = len(texts)
        least, sets, sizes = np.full((n, BANDS * ROWS), 2**64 - 1, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        prints, table = np.zeros(n, np.uint64), np.zeros((n, CELLS), np.int32)
        for i, text in enumerate(texts):
            h = shingle_set(text, shingle)
            sets[i], sizes[i] = _set_id(h), len(h)
            table[i] = np.diff(np.searchsorted(h, ranges), prepend=0, append=len(h))
            votes = np.zeros(64, np.int64)
            for at in range(0, len(h), _STEP):
                part = h[at : at + _STEP]
                votes += _votes(part)
                np.minimum(least[i], (part[:, None] * odd + plus).min(axis=0), out=least[i])
            prints[i] = _majority(votes, len(h))
        keys = np.tile(np.arange(BANDS, dtype=np.uint64), (n, 1))
        for j in range(ROWS):
            keys = mix(keys * np.uint64(31) + least[:, j::ROWS])
        keys = np.concatenate([keys, _block_pairs(prints)], axis=1)
        ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, keys.shape[1], 0))]).astype(np.int32)
        bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[sizes > 0].ravel().view(np.int64)))
        tables = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * CELLS), pa.array(table.ravel()))
        return pa.RecordBatch.from_arrays([*ids, pa.array(sets), pa.array(sizes), bands, tables], names=["doc_id", "text_key", "fp", "size", "bands", "pivots"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in sliced(batch.column(2)):
                yield sketch([batch.column(c).slice(a, b - a) for c in range(2)], texts)

    return lean(run)


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in sliced(batch.column(0)):
                sets = [shingle_set(t, shingle) for t in texts]
                ids = pa.array([_set_id(h) for h in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], names=["fp", "hashes"])

    return lean(run)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_key, fp (for the shingle set), size, bands (its keys: of minhashes, then of the fingerprint's blocks)
    and pivots (its row of the pivot table) of every row."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return source.mapInArrow(_sketches(shingle), "doc_id bigint, text_key bigint, fp bigint, size bigint, bands array<bigint>, pivots array<int>")


def within_pivots(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) that the pivot table of ``nodes`` (fp, size, pivots) doesn't exclude at this similarity: the distances
    to some reference set differ by more than those of the two sets could. No pair that reaches it is lost."""
    one = nodes.select(F.col("fp").alias("a"), F.col("size").alias("m"), F.col("pivots").alias("x"))
    two = nodes.select(F.col("fp").alias("b"), F.col("size").alias("m_"), F.col("pivots").alias("y"))
    apart = F.aggregate(F.zip_with("x", "y", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    return pairs.join(one, "a").join(two, "b").where(apart * (1 + similarity) <= (1 - similarity) * (F.col("m") + F.col("m_")) + 1e-6).select("a", "b")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) whose sets are similar enough."""
    one = sets.select(F.col("fp").alias("a"), F.col("hashes").alias("x"))
    two = sets.select(F.col("fp").alias("b"), F.col("hashes").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return pairs.join(one, "a").join(two, "b").where(shared >= similarity * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b")


def similar_links(docs: DataFrame, sketches: DataFrame, shingle: int, similarity: float, near: int = NEAR) -> DataFrame:
    """(a, b), a < b: links between distinct shingle sets ``fp``; from keys with more than ``near`` sets enough of them
    to connect the same components. ``sketches``: those of every row of ``docs``."""
    nodes = sketches.groupBy("fp").agg(F.min("text_key").alias("text_key"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    keyed = nodes.select("fp", "text_key", "size", F.posexplode("bands").alias("c", "v"))
    sizes = keyed.groupBy("c", "v").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(keyed.join(sizes, ["c", "v"]))
    left = shared.where(f"n <= {near}").select("c", "v", F.col("fp").alias("a"), F.col("size").alias("m"))
    right = left.select("c", "v", F.col("a").alias("b"), F.col("m").alias("m_"))
    fits = lambda x, y: F.least(x, y) >= similarity * F.greatest(x, y) - 1e-9
    pairs = cut(left.join(right, ["c", "v"]).where((F.col("a") < F.col("b")) & fits("m", "m_")).select("a", "b").distinct())

    crowded = cut(shared.where(f"n > {near}").select("c", "v", "n", "fp", "size"))
    heads = crowded.groupBy("c", "v").agg(F.min(F.struct("fp", "size")).alias("head"))
    to_head = crowded.join(heads, ["c", "v"]).where((F.col("fp") != F.col("head.fp")) & fits("size", "head.size"))
    pairs = pairs.unionByName(to_head.select(F.col("head.fp").alias("a"), F.col("fp").alias("b"))).distinct()
    ends = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    tables = cut(sketches.join(ends, "fp", "left_semi").groupBy("fp").agg(F.first("size").alias("size"), F.first("pivots").alias("pivots")))
    pairs = cut(within_pivots(pairs, tables, similarity))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("fp")).unionByName(crowded.select("fp")).distinct()
    keys = cut(shared.join(nodes, "fp", "left_semi").select(F.col("text_key").alias("_key")).distinct())
    small = keys.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = docs.select("text").join(F.broadcast(keys) if small else keys, F.xxhash64("text") == F.col("_key"), "left_semi")
    sets = cut(texts.mapInArrow(_sets(shingle), "fp bigint, hashes array<bigint>").groupBy("fp").agg(F.first("hashes").alias("hashes")))
    found = cut(components(_alike(pairs, sets, similarity)))
    known = found.select(F.col("root").alias("a"), F.col("node").alias("b")).where("a < b")
    return known.unionByName(_across(crowded, found, sets, similarity))


def _across(crowded: DataFrame, found: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that join different components (``found``) of sets that share a crowded key. In each key the largest
    component's sets are only compared with the others, and those with all, block by block: a task holds two blocks of
    sets, bounded in number and in size, and counts what they share by one product."""
    members = cut(crowded.join(found, F.col("fp") == F.col("node"), "left").select("c", "v", "fp", "size", F.coalesce("root", "fp").alias("root")))
    of_root = members.groupBy("c", "v", "root").agg(F.count("*").alias("k"), F.max("size").alias("most"))
    keys = of_root.groupBy("c", "v").agg(F.max(F.struct("k", "root")).alias("main"), F.sum("k").alias("n"), F.max("most").alias("most"), F.count("*").alias("roots"))
    block = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(BLOCK_HASHES / F.greatest("most", F.lit(1)))))
    keys = cut(keys.where("roots > 1").select("c", "v", "n", F.col("main.root").alias("main"), (F.col("n") - F.col("main.k")).alias("others"), block.alias("rows")))
    if keys.isEmpty():
        return members.limit(0).select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    rows = members.join(keys, ["c", "v"])
    up = lambda n: F.ceil(F.col(n) / F.col("rows"))
    part = lambda n: F.pmod(F.xxhash64("fp", "c"), up(n))
    every = lambda n: F.sequence(F.lit(0).cast("bigint"), up(n) - 1)
    asks = F.transform(every("n"), lambda j: F.struct(part("others").alias("i"), j.alias("j"), F.lit(True).alias("asks")))
    held = F.transform(every("others"), lambda i: F.struct(i.alias("i"), part("n").alias("j"), F.lit(False).alias("asks")))
    both = F.when(F.col("root") != F.col("main"), F.concat(asks, held)).otherwise(held)
    dealt = rows.join(sets, "fp").select("c", "v", "fp", "root", "hashes", F.explode(both).alias("t")).select("c", "v", "fp", "root", "hashes", "t.*")

    def compare(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        fp, root = table["fp"].to_numpy(), table["root"].to_numpy()
        size = pc.list_value_length(table["hashes"]).to_numpy().astype(np.int64)
        row, flat = np.repeat(np.arange(len(size)), size), pc.list_flatten(table["hashes"]).to_numpy()
        x, y = np.flatnonzero(asks), np.flatnonzero(~asks)
        shared = _shared(row, flat, asks)
        i, j = np.nonzero((shared >= similarity * (size[x][:, None] + size[y] - shared) - 1e-9) & (root[x][:, None] != root[y]))
        # one link between a set and a component is enough
        _, first = np.unique(np.stack([fp[x[i]], root[y[j]]]), axis=1, return_index=True)
        ends = np.stack([fp[x[i[first]]], fp[y[j[first]]]])
        return pa.table({"a": ends.min(axis=0), "b": ends.max(axis=0)})

    def run(table: pa.Table) -> pa.Table:
        out = compare(table)
        if table.nbytes > CHUNK_BYTES:
            give_back()
        return out

    return dealt.groupBy("c", "v", "i", "j").applyInArrow(run, "a bigint, b bigint").distinct()


def _shared(row: np.ndarray, flat: np.ndarray, asks: np.ndarray) -> np.ndarray:
    """How many hashes each set that asks shares with each other one, by products over the hashes that both kinds have.
    ``row``: the set of each hash in ``flat``; ``asks``: the kind of each set."""
    kind = asks[row]
    common = np.intersect1d(flat[kind], flat[~kind])
    out = np.zeros((int(asks.sum()), int((~asks).sum())), np.float32)
    if not len(common):
        return out
    at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
    keep = common[at] == flat
    row, at, kind = row[keep], at[keep], kind[keep]
    place = np.where(asks, np.cumsum(asks), np.cumsum(~asks)) - 1
    for lo in range(0, len(common), _STEP):
        inside = (at >= lo) & (at < lo + _STEP)
        sides = []
        for rows, of in zip(out.shape, (kind, ~kind)):
            m = np.zeros((rows, min(_STEP, len(common) - lo)), np.float32)
            m[place[row[inside & of]], at[inside & of] - lo] = 1.0
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, count: int = PIVOTS, crowd: int = CROWD, similarity: float | None = None) -> DataFrame:
    """doc_id, text_key, fp, component_id (smallest doc_id reachable over links) of every row of ``docs``. With a
    ``similarity``, fp stands for the shingle set and links are pairs of sets with at least that Jaccard similarity."""
    if similarity is None:
        rows = cut(fingerprints(docs, shingle))
        linked = links(rows.select("fp").distinct(), count, crowd)
    else:
        rows = cut(sketches(docs, shingle))
        linked = similar_links(docs, rows, shingle, similarity)
        rows = rows.select("doc_id", "text_key", "fp")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = cut(components(linked))
    named = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = cut(named)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "text_key", "fp", "component_id")


def deduplicated(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one document of each group, its smallest doc_id; columns as they were. Of repeated rows one stays.
    Rows without an id can't be named: they stay unless they repeat or their group has an id."""
    found = cut(near_duplicates(docs, **settings))
    kept = listed(docs, found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))), "left_anti")
    repeated = found.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        return kept
    return listed(kept, repeated, "left_anti").unionByName(listed(kept, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))
