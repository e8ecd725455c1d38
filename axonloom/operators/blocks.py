"""Pairs of rows by blocks: a block of one side is held in a task, and the rows of another stream past it.

Rows are shuffled once for each block that they meet; pairs never are. What a task makes of them leaves it in pieces, so
its memory is the held block, one batch of rows and one tile of pairs, however many pairs pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs that are compared at once.
TILE = 1 << 21
#: Most partitions of a shuffle of block pairs.
PARTITIONS = 1_000


def streamed(held: DataFrame, passing: DataFrame, groups: Sequence[str], hold: Callable, meet: Callable, schema: str, count: int, order: Sequence[str] = ()) -> DataFrame:
    """Rows of record batches from ``meet(group, hold(table of the group's held rows), passing batches)`` for each of about
    ``count`` groups that have both; ``passing`` in the order of its columns ``order``. ``hold`` also gets the group."""
    rows = held.withColumn("_side", F.lit(0)).unionByName(passing.withColumn("_side", F.lit(1)))
    rows = rows.repartition(max(1, min(count, PARTITIONS)), *groups) if groups else rows.coalesce(1)
    rows = rows.sortWithinPartitions(*groups, "_side", *order)
    marks = [*groups, "_side"]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        for batch in batches:
            of = list(zip(*(batch.column(c).to_pylist() for c in marks)))
            cuts = [0, *(k for k in range(1, len(of)) if of[k] != of[k - 1]), len(of)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    yield of[lo], batch.slice(lo, hi - lo)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = runs(batches)
        at = next(parts, None)
        while at is not None:
            group, block = at[0][:-1], []
            while at is not None and at[0] == (*group, 0):
                block.append(at[1])
                at = next(parts, None)

            def others():
                nonlocal at
                while at is not None and at[0] == (*group, 1):
                    yield at[1]
                    at = next(parts, None)

            rest = others()
            if block:
                yield from meet(group, hold(group, pa.Table.from_batches(block).combine_chunks()), rest)
            for _ in rest:
                pass

    return rows.mapInArrow(run, schema)


def matrix(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lists as rows (zeros behind the shorter ones) with their sizes; a missing list has size -1."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    wide = int(sizes.max(initial=0))
    if len(sizes) and (sizes == wide).all():
        return flat.reshape(len(sizes), wide), sizes
    out = np.zeros((len(sizes), wide))
    own = np.maximum(sizes, 0)
    starts = np.cumsum(own) - own
    rows = np.repeat(np.arange(len(sizes)), own)
    out[rows, np.arange(len(flat)) - starts[rows]] = flat
    return out, sizes


def nullable(column: pa.Array | pa.ChunkedArray) -> pa.Array | pa.ChunkedArray:
    """Lists as those of a schema string, which may hold nulls."""
    return column.cast(pa.list_(pa.field("element", column.type.value_type))) if pa.types.is_list(column.type) else column


def unit_rows(x: np.ndarray, sizes: np.ndarray, centred: bool = True) -> np.ndarray:
    """Rows (of their sizes, zeros behind) at unit length, without their mean if ``centred``; zeros for a row without spread."""
    if not x.size:
        return x
    inside = np.arange(x.shape[1]) < sizes[:, None]
    c, flat = x, False
    if centred:
        c = np.where(inside, x - x.sum(1, keepdims=True) / np.maximum(sizes, 1)[:, None], 0.0)
        flat = np.where(inside, x, -np.inf).max(1) == np.where(inside, x, np.inf).min(1)
    n = np.sqrt(np.einsum("ij,ij->i", c, c))
    return c / np.where((n == 0) | flat, np.inf, n)[:, None]


def tiles(rows: int, held: int) -> Iterator[slice]:
    """Slices of ``rows`` that meet ``held`` others in about TILE pairs."""
    step = max(1, TILE // max(held, 1))
    return (slice(at, min(at + step, rows)) for at in range(0, rows, step))


def block_pairs(left: DataFrame, right: DataFrame | None, keys: Sequence[str], blocks: int, arrays: Sequence[str], prepare: Callable, compare: Callable, values: dict[str, str], key_count: int = 1) -> DataFrame:
    """(keys, a, b, values): what ``compare`` keeps of the pairs of rows (keys, cell_id, arrays); a < b of one side, or all
    of ``left`` with ``right``. Both sides are dealt into hash blocks. ``prepare(side, matrices)`` is called once for the
    arrays of a block; ``compare(held, passing)`` gets both results for slices of rows, arrays along their first axis, and
    gives places in the held ones, in the passing ones, and a column for each of ``values`` (name: type)."""
    one_sided = right is None
    columns = [*keys, "cell_id", *arrays]
    dealt = lambda df: df.select(*columns, F.pmod(F.xxhash64("cell_id"), F.lit(blocks)).cast("int").alias("_at"))
    a = dealt(left)
    b = a if one_sided else dealt(right)
    here, last = F.col("_at"), F.lit(blocks - 1)
    # one side walks along the rows of the block grid, the other down its columns; of one side only the half i <= j
    held = a.withColumn("_j", F.explode(F.sequence(here if one_sided else F.lit(0), last))).select(*columns, here.alias("_i"), "_j")
    passing = b.withColumn("_i", F.explode(F.sequence(F.lit(0), here if one_sided else last))).select(*columns, "_i", here.alias("_j"))
    types = dict(left.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), f"a {types['cell_id']}", f"b {types['cell_id']}", *(f"{c} {t}" for c, t in values.items())])
    ids_of = lambda rows: rows.column("cell_id").to_numpy() if isinstance(rows, pa.Table) else rows.column("cell_id").to_numpy(zero_copy_only=False)
    prepared = lambda side, rows: (ids_of(rows), prepare(side, [matrix(rows.column(c)) for c in arrays]))

    def meet(group, block, batches):
        x_ids, xs = block
        for batch in batches:
            y_ids, ys = prepared(1, batch)
            for cut in tiles(len(y_ids), len(x_ids)):
                p, q, columns = compare(xs, [y[cut] for y in ys])
                ids, other = x_ids[p], y_ids[cut][q]
                if one_sided:
                    # inside one block both orders appear: one is kept; across blocks each pair appears once
                    keep = ids < other if group[-2] == group[-1] else ids != other
                    ids, other = np.where(ids < other, ids, other)[keep], np.where(ids < other, other, ids)[keep]
                    columns = [c[keep] for c in columns]
                if len(ids):
                    key = [pa.array([group[k]] * len(ids), batch.schema.field(c).type) for k, c in enumerate(keys)]
                    kind = batch.schema.field("cell_id").type
                    yield pa.RecordBatch.from_arrays([*key, pa.array(ids, kind), pa.array(other, kind), *map(pa.array, columns)], names=[*keys, "a", "b", *values])

    count = key_count * (blocks * (blocks + 1) // 2 if one_sided else blocks * blocks)
    return streamed(held, passing, [*keys, "_i", "_j"], lambda _, rows: prepared(0, rows), meet, schema, count)
