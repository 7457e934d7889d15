"""Vector functions as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product; vectors of different lengths: minus infinity."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(float("-inf"))


def literal(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def length(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column, n: Column | None = None) -> Column:
    """v over its length; a zero vector stays. ``n``: its length, where that is a column already."""
    n = length(v) if n is None else n
    return F.transform(v, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def threshold(positives: Column, negatives: Column) -> Column:
    """0.85 of the least positive, raised to 1.05 of the largest negative; no finite positive: null."""
    finite = lambda c: F.filter(c, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    base, high = F.array_min(finite(positives)) * 0.85, F.array_max(finite(negatives)) * 1.05
    return F.when(base.isNotNull(), F.greatest(base, high))


def mean_pool(values: Column, mask: Column, dims: int) -> Column:
    """Mean of the masked rows of a flat row-major array."""
    rows = F.sequence(F.lit(0), F.size(mask) - 1)
    weight = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, x: s + x), F.lit(1e-9))
    return F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda d: F.aggregate(rows, F.lit(0.0), lambda s, r: s + F.element_at(values, (r * dims + d).cast("int")) * F.element_at(mask, (r + 1).cast("int"))) / weight)


def peak_bytes(n: Column, dims: int) -> Column:
    """Vectors, a distance list of 15 neighbours, and a reduced copy."""
    return n * (dims * 4 + 15 * 12 + 15 * 8)


def backfill_seconds(images: Column, megapixels: Column) -> Column:
    return F.greatest(F.round(images * 0.15 + megapixels * 0.25), F.lit(0.0)).cast("long")


def nice_bucket(span_ms: Column, steps: tuple[int, ...] = (60_000, 300_000, 900_000, 1_800_000, 3_600_000, 21_600_000, 86_400_000, 604_800_000, 2_592_000_000), count: int = 150) -> Column:
    """The first step of at least span / count, else the last."""
    out = F.lit(steps[-1])
    for s in reversed(steps):
        out = F.when(span_ms / count <= s, F.lit(s)).otherwise(out)
    return out
