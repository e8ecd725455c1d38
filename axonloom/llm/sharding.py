"""Sharding by a hierarchical weighted hash tree (region, rack, shard).

At each level a row draws -ln(u) / weight for every child, u a hash of its id and the child's name, and descends into
the smallest draw; a node weighs what its leaves weigh. A child's draws don't depend on its siblings, so a weight that
changes moves rows only into or out of the subtrees on its path. Shards beyond the base tree hang in regions of their
own, so that one more shard takes rows from all others into itself and moves nothing else.

Law: ``key`` (id and shard count decide). Slots number each shard's rows without gaps, by hash bucket, then id: a shard
has ``BUCKETS`` of them at any size, so no task has to hold or sort a whole shard, and equal rows are counted before they
are shuffled.

Defined cases: null ids hash as the empty text; null texts have size 16 and the checksum of the empty text (0);
repeated rows get a slot each; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Regions, racks a region and shards a rack of the base tree.
BASE = (4, 2, 5)
#: Hash buckets in which a shard's rows are numbered.
BUCKETS = 4_096

Tree = list[list[list[tuple[int, float]]]]


def tree(shards: int, base: tuple[int, int, int] = BASE, weights: dict[int, float] | None = None) -> Tree:
    """Regions of racks of (shard, weight). ``weights``: of single shards, else 1."""
    w = lambda s: (weights or {}).get(s, 1.0)
    regions, racks, leaves = base
    full = regions * racks * leaves
    if shards < full:
        raise ValueError(f"the base tree has {full} shards")
    out = [[[(s := (i * racks + j) * leaves + k, w(s)) for k in range(leaves)] for j in range(racks)] for i in range(regions)]
    return out + [[[(s, w(s))]] for s in range(full, shards)]


def _least(key: Column, children: Column) -> Column:
    """The child (name, weight, i) with the smallest draw: exponential waiting times from 52 bits of an md5."""

    def draw(x: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(x["name"], F.lit(":"), key)), 1, 13), 16, 10).cast("bigint")
        return F.struct((-F.log((bits.cast("double") + 0.5) / float(1 << 52)) / x["weight"]).alias("d"), x["i"].alias("i"))

    return F.array_min(F.transform(children, draw))["i"]


def _nodes(xs: list[tuple[str, float, int]]) -> Column:
    return F.array(*(F.struct(F.lit(name).alias("name"), F.lit(float(w)).alias("weight"), F.lit(i).alias("i")) for name, w, i in xs))


def placed(rows: DataFrame, key: Column, nodes: Tree, name: str) -> DataFrame:
    """``rows`` with the shard of each key as column ``name``: one draw a child on the way down."""
    total = lambda x: sum(w for _, w in x)
    regions = _nodes([(f"r{i}", sum(map(total, r)), i) for i, r in enumerate(nodes)])
    racks = F.array(*(_nodes([(f"r{i}k{j}", total(k), j) for j, k in enumerate(r)]) for i, r in enumerate(nodes)))
    leaves = F.array(*(F.array(*(_nodes([(f"s{s}", w, s) for s, w in k]) for k in r)) for r in nodes))
    rows = rows.withColumn("_region", _least(key, regions))
    rows = rows.withColumn("_rack", _least(key, F.get(racks, F.col("_region"))))
    return rows.withColumn(name, _least(key, F.get(F.get(leaves, F.col("_region")), F.col("_rack")))).drop("_region", "_rack")


def sharded(docs: DataFrame, shards: int = 40, base: tuple[int, int, int] = BASE, weights: dict[int, float] | None = None) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 16), text_crc32, law, shard, slot, grown_shard of every row."""
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"))
    rows = rows.groupBy("doc_id", (F.col("bytes") + 16).alias("size"), "text_crc32").agg(F.count("*").alias("n"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    bucket = F.pmod(F.crc32(F.concat_ws("|", key, "size", "text_crc32")), F.lit(BUCKETS)).cast("int")
    rows = placed(rows.withColumn("bucket", bucket), key, tree(shards, base, weights), "shard")
    rows = placed(rows, key, tree(shards + 1, base, weights), "grown_shard")
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "bucket").agg(F.sum("n").alias("held")).select("shard", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, -1)
    numbered = rows.withColumn("skip", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, ["shard", "bucket"])
    first = F.col("start") + F.col("skip")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(F.sequence(first, first + F.col("n") - 1)).alias("slot"), "grown_shard")


def _crc_table() -> list[int]:
    """CRC-32's table, from its polynomial."""
    step = lambda v: v >> 1 ^ (0xEDB88320 if v & 1 else 0)
    return [reduce(lambda v, _: step(v), range(8), i) for i in range(256)]



def crc32_sql(text: str) -> str:
    """The unsigned checksum of a string expression's UTF-8 bytes in DuckDB's SQL."""
    return (
        f"xor(list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::bigint), "
        f"lambda c, b: xor(({_crc_table()}::bigint[])[xor(c, b) % 256 + 1], c // 256), 4294967295::bigint), 4294967295::bigint)"
    )


def sharded_sql(shards: int = 40, base: tuple[int, int, int] = BASE) -> str:
    """The same in DuckDB's SQL."""

    def at(name: str, w: float) -> str:
        return f"(-ln((('0x' || substr(md5('{name}:' || k), 1, 13))::bigint::double + 0.5) / {1 << 52}.0) / {w})"

    def least(xs: list[tuple[str, int]]) -> str:
        return "list_min([" + ", ".join(f"{{'d': {d}, 'i': {i}}}" for d, i in xs) + "]).i"

    def down(nodes: Tree) -> str:
        total = lambda x: sum(w for _, w in x)
        region = least([(at(f"r{i}", sum(map(total, r))), i) for i, r in enumerate(nodes)])
        cases = []
        for i, racks in enumerate(nodes):
            rack = least([(at(f"r{i}k{j}", total(k)), j) for j, k in enumerate(racks)])
            inner = " ".join(f"when {j} then {least([(at(f's{s}', w), s) for s, w in k])}" for j, k in enumerate(racks))
            cases.append(f"when {i} then (case {rack} {inner} end)")
        return f"case {region} {' '.join(cases)} end"

    crc = "text_crc32"
    return f"""
with base as (select doc_id, coalesce(strlen(text), 0) + 16 as size, {crc32_sql("coalesce(text, '')")} as {crc}, coalesce(doc_id::varchar, '') as k from documents),
numbered as (select *, {crc32_sql(f"k || '|' || size || '|' || {crc}")} % {BUCKETS} as bucket from base),
placed as (select *, ({down(tree(shards, base))})::int as shard, ({down(tree(shards + 1, base))})::int as grown_shard from numbered)
select doc_id, size::bigint as size, {crc}, 'key' as law, shard,
       row_number() over (partition by shard order by bucket, doc_id, size, {crc}) - 1 as slot, grown_shard from placed"""

