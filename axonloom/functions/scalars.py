"""Column functions: time bases, identifiers, text rules, small geometry and wave features."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SAMPLE_RATE = 20_000
#: Fixed value: clusters an electrode can have in a neuron id.
CLUSTERS_PER_ELECTRODE = 15


def samples_to_ms(samples: Column, rate: float = SAMPLE_RATE) -> Column:
    return samples / rate * 1000.0


def label_matches(label: str, text: str) -> Column:
    """Case-insensitive substring; a null label never matches."""
    return F.coalesce(F.lower(label).contains(text.lower()), F.lit(False))


def file_of(path: str) -> Column:
    """Second-last part of a path."""
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def parameter(parameters: str, name: str, kind: str = "double") -> Column:
    return F.col(parameters)[name].try_cast(kind)


def ticks_to_timestamp(ticks: Column) -> Column:
    """.NET ticks (100 ns since year 1), as UTC."""
    return F.timestamp_micros(F.call_function("div", ticks, F.lit(10)) - 62_135_596_800_000_000)


def without_uuid(label: str) -> Column:
    """Text without a trailing five-part UUID."""
    return F.regexp_replace(label, r"[-_ ]*[0-9a-fA-F]+(-[0-9a-fA-F]+){4}$", "")


def data_file_name(path: str, prefix: str = "data") -> Column:
    """'<prefix>NNN' from the last number of the last path part."""
    return F.concat(F.lit(prefix), F.lpad(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"([0-9]+)[^0-9]*$", 1), 3, "0"))


def good_cells(spikes: DataFrame, labels: DataFrame, wanted: str = "good") -> DataFrame:
    """Spikes of clusters with a wanted label; ``cell_id`` is the cluster's number + 1."""
    return spikes.join(labels.where(F.col("label") == wanted).select("cluster_id"), "cluster_id").withColumn("cell_id", F.col("cluster_id") + 1)


def electrode_pitch(array_id: str) -> Column:
    a = F.col(array_id)
    return F.when(a < 1501, 60).when(a < 3501, 30).otherwise(120)


def neuron_id(electrode: Column, cluster: Column) -> Column:
    return (electrode - 1) * CLUSTERS_PER_ELECTRODE + cluster + 1


def electrode_of(neuron: Column) -> Column:
    return F.floor((neuron - 1) / CLUSTERS_PER_ELECTRODE) + 1


def cluster_of(neuron: Column) -> Column:
    return F.pmod(neuron - 1, F.lit(CLUSTERS_PER_ELECTRODE))


def cell_class(text: str) -> Column:
    """Free text to on/off parasol/midget or a1, else null; 'off' is looked for first, as 'on' is in other words."""
    c = F.lower(text)
    side = F.when(c.contains("off"), "off").when(c.contains("on"), "on")
    kind = F.when(c.contains("parasol"), "parasol").when(c.contains("midget"), "midget")
    return F.when(c.contains("a1"), "a1").when(side.isNotNull() & kind.isNotNull(), F.concat_ws(" ", side, kind))


def flash_class(kind: str, contrast: str) -> Column:
    """Achromatic flashes by the sign of their contrast."""
    return F.when(F.col(kind) == "achromatic", F.when(F.col(contrast) > 0, "on").otherwise("off")).otherwise(F.col(kind))


def expanded_ranges(spec: str) -> Column:
    """'0-10,34-36' to ['data000', ...]."""
    def one(part):
        ends = F.split(part, "-")
        return F.sequence(F.get(ends, F.lit(0)).cast("int"), F.element_at(ends, -1).cast("int"))

    numbers = F.flatten(F.transform(F.split(spec, ","), lambda p: one(F.trim(p))))
    return F.transform(numbers, lambda i: F.concat(F.lit("data"), F.lpad(i.cast("string"), 3, "0")))


def recorded_epochs(epochs: DataFrame, keys: Sequence[str], start: str, n_samples: str, n_triggers: str) -> DataFrame:
    """Epochs that began while recording, no more than there were triggers."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(start))
    return epochs.where(F.col(start) <= F.col(n_samples)).withColumn("_r", rank).where(F.col("_r") <= F.col(n_triggers)).drop("_r")


def repaired_starts(rows: DataFrame, keys: Sequence[str], predicted: str, trigger: str) -> DataFrame:
    """With ``start``: the predicted starts of a key if any differs from its trigger by over half the mean step."""
    w = W.partitionBy(*keys)
    mean_step = (F.max(predicted).over(w) - F.min(predicted).over(w)) / (F.count("*").over(w) - 1)
    worst = F.max(F.abs(F.col(predicted) - F.col(trigger))).over(w)
    return rows.withColumn("start", F.when(worst > mean_step / 2, F.col(predicted)).otherwise(F.col(trigger)))


def cosd(degrees: Column) -> Column:
    return F.cos(F.radians(degrees))


def sind(degrees: Column) -> Column:
    return F.sin(F.radians(degrees))


def gaussian2d(x: Column, y: Column, x0: float, y0: float, sx: float, sy: float, angle: float = 0.0) -> Column:
    u = (x - x0) * cosd(F.lit(angle)) + (y - y0) * sind(F.lit(angle))
    v = -(x - x0) * sind(F.lit(angle)) + (y - y0) * cosd(F.lit(angle))
    return F.exp(-0.5 * (u * u / sx**2 + v * v / sy**2))


def gabor(x: Column, y: Column, x0: float, y0: float, sx: float, sy: float, angle: float, period: float, phase: float = 0.0) -> Column:
    u = (x - x0) * cosd(F.lit(angle)) + (y - y0) * sind(F.lit(angle))
    return gaussian2d(x, y, x0, y0, sx, sy, angle) * F.cos(u * (2 * 3.141592653589793 / period) + phase)


def in_ellipse(x: Column, y: Column, x0: Column, y0: Column, a: Column, b: Column, angle: Column) -> Column:
    u = (x - x0) * cosd(angle) + (y - y0) * sind(angle)
    v = -(x - x0) * sind(angle) + (y - y0) * cosd(angle)
    return (u / a) ** 2 + (v / b) ** 2 <= 1


def bar_arrival(x: Column, y: Column, orientation: Column, speed: Column, travel: float) -> Column:
    """When a bar that starts ``travel`` before the middle reaches a place: its place along the motion over speed."""
    return (x * cosd(orientation) + y * sind(orientation) + travel) / speed


def polygon_properties(vertices: DataFrame, key: str) -> DataFrame:
    """(key, area, cx, cy): shoelace over vertices (key, i, x, y) in order."""
    w = W.partitionBy(key).orderBy("i")
    first = W.partitionBy(key).orderBy("i").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = vertices.select(key, "x", "y", F.coalesce(F.lead("x").over(w), F.first("x").over(first)).alias("x2"), F.coalesce(F.lead("y").over(w), F.first("y").over(first)).alias("y2"))
    c = F.col("x") * F.col("y2") - F.col("x2") * F.col("y")
    sums = rows.groupBy(key).agg(F.sum(c).alias("a"), F.sum((F.col("x") + F.col("x2")) * c).alias("sx"), F.sum((F.col("y") + F.col("y2")) * c).alias("sy"))
    return sums.select(key, F.abs(F.col("a") / 2).alias("area"), (F.col("sx") / (3 * F.col("a"))).alias("cx"), (F.col("sy") / (3 * F.col("a"))).alias("cy"))


def polygon_orientation(vertices: DataFrame, key: str) -> DataFrame:
    """(key, orientation): angle in degrees of the line fitted to the vertices (key, x, y); 0 for fewer than two, or for
    vertices above each other."""
    slope = F.regr_slope(F.col("y"), F.col("x"))
    return vertices.groupBy(key).agg(F.coalesce(F.degrees(F.atan(slope)), F.lit(0.0)).alias("orientation"))


def bounded_field(sx: Column, sy: Column, least: float = 0.5, aspect: float = 3.0) -> list[Column]:
    """Deviations not under ``least`` and not over ``aspect`` apart."""
    a, b = F.greatest(sx, F.lit(least)), F.greatest(sy, F.lit(least))
    return [F.least(a, b * aspect), F.least(b, a * aspect)]


def wave_polarity(wave: str) -> Column:
    """1 or -1: the sign of the extremum that comes first, unless the other is over twice as large."""
    hi, lo = F.array_max(wave), F.array_min(wave)
    first = F.array_position(wave, hi) < F.array_position(wave, lo)
    return F.when(hi > 2 * F.abs(lo), 1).when(F.abs(lo) > 2 * hi, -1).when(first, 1).otherwise(-1)


def half_snr(wave: str) -> Column:
    """Deviation of the first half (without its first value) over that of the second; 0 where undefined."""
    n = F.size(wave)
    h = F.floor(n / 2).cast("int")

    def sd(x):
        m = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
        q = F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) / F.size(x)
        return F.sqrt(F.greatest(q - m * m, F.lit(0.0)))

    a, b = sd(F.slice(wave, F.lit(2), h - 1)), sd(F.slice(wave, h + 1, n - h))
    return F.when(b > 0, F.coalesce(F.nanvl(a / b, F.lit(0.0)), F.lit(0.0))).otherwise(0.0)


def blueness(blue: str, green: str) -> Column:
    """Sum of |blue| over sum of |green| in the last half."""
    def total(c):
        n = F.size(c)
        h = F.floor(n / 2).cast("int")
        return F.aggregate(F.slice(c, h + 1, n - h), F.lit(0.0), lambda s, v: s + F.abs(v))

    return total(blue) / F.nullif(total(green), F.lit(0.0))


def unit_peak(values: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """With ``unit``: values over their largest magnitude per key (0 where all are 0)."""
    top = F.max(F.abs(x)).over(W.partitionBy(*keys))
    return values.withColumn("unit", F.when(top > 0, F.coalesce(F.nanvl(F.col(x) / top, F.lit(0.0)), F.lit(0.0))).otherwise(0.0))


def centred(wave: str, at: int, length: int) -> Column:
    """The wave moved so that its minimum lies at ``at``, zero-padded or cut to ``length``."""
    shift = F.lit(at) - (F.array_position(wave, F.array_min(wave)).cast("int") - 1)
    padded = F.concat(F.array_repeat(F.lit(0.0), F.greatest(shift, F.lit(0))), F.slice(wave, F.greatest(-shift, F.lit(0)) + 1, F.size(wave)), F.array_repeat(F.lit(0.0), length))
    return F.slice(padded, 1, length)


def permuted(values: str, order: Sequence[int]) -> Column:
    """Elements in a new order of places (from 0)."""
    return F.transform(F.array(*map(F.lit, order)), lambda i: F.get(values, i))


def reduced_chi2(pairs: DataFrame, keys: Sequence[str], x: str, y: str, ex: str, ey: str) -> DataFrame:
    """(keys, chi2): mean of (x - y)^2 / (ex^2 + ey^2) over rows."""
    return pairs.groupBy(*keys).agg(F.avg((F.col(x) - F.col(y)) ** 2 / (F.col(ex) ** 2 + F.col(ey) ** 2)).alias("chi2"))


def cut_and_value(cells: DataFrame, cut: str, value: str, name: str = "value") -> DataFrame:
    """Rows that satisfy a SQL condition, with a SQL expression's value."""
    return cells.where(F.expr(cut)).withColumn(name, F.expr(value))


class Calculators:
    """A registry of named column calculators over the per-cell table: each gives typed columns."""

    def __init__(self):
        self._made: dict[str, Callable[[DataFrame], dict[str, Column]]] = {}

    def register(self, name: str):
        def keep(f: Callable[[DataFrame], dict[str, Column]]):
            self._made[name] = f
            return f

        return keep

    def run(self, cells: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
        for name in names or list(self._made):
            cells = cells.withColumns({f"{name}_{c}" if c else name: e for c, e in self._made[name](cells).items()})
        return cells
