"""Two runs, or two engines, compared by key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import dot
from ..sources.checkpoints import written
from .similarity import BLOCK, LEAST, SIDES, STEP

#: Fixed values of the gates: confidences that decide a class, and what equal embeddings must reach.
CONFIDENCES, LEAST_COSINE, MOST_ERROR = (0.38, 0.50, 0.55), 0.99999, 1e-4


def metric_delta(before: Column, after: Column, before_seconds: float, after_seconds: float) -> Column:
    """struct of both values, the raw difference, the rates, and what the second run has above the first one's rate.

    A null value is 0. The excess is stated for the time that both runs have.
    """
    a, b = (F.coalesce(c.cast("double"), F.lit(0.0)) for c in (before, after))
    rate = lambda x, s: x / s if s > 0 else F.lit(0.0)
    excess = rate(b, after_seconds) - rate(a, before_seconds)
    common = min(before_seconds, after_seconds) if before_seconds and after_seconds else after_seconds
    return F.struct(
        a.cast("long").alias("baseline"), b.cast("long").alias("workload"), (b - a).cast("long").alias("delta_raw"), rate(a, before_seconds).alias("baseline_per_second"),
        rate(b, after_seconds).alias("workload_per_second"), excess.alias("excess_per_second"), (excess * common).cast("long").alias("adjusted_delta"),
    )


def named_totals(baseline: DataFrame, workload: DataFrame, name: str, values: list[str], before_seconds: float, after_seconds: float) -> DataFrame:
    """(name, a struct of ``metric_delta`` for each of ``values``) of every name that either side has."""
    a = baseline.select(name, *[F.col(v).alias(f"_a_{v}") for v in values])
    b = workload.select(name, *[F.col(v).alias(f"_b_{v}") for v in values])
    return a.join(b, name, "full_outer").select(name, *[metric_delta(F.col(f"_a_{v}"), F.col(f"_b_{v}"), before_seconds, after_seconds).alias(v) for v in values])


def counter_deltas(before: DataFrame, after: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """((key, before, after, delta) of each row of ``after``, one row: total of the deltas, and whether there is any).

    A counter that fell, or that one side hasn't, has no delta; without any the total is null.
    """
    j = after.select(key, F.col(value).alias("after")).join(before.select(key, F.col(value).alias("before")), key, "left")
    rows = j.select(key, "before", "after", F.when(F.col("after") >= F.col("before"), F.col("after") - F.col("before")).alias("delta"))
    return rows, rows.agg(F.sum("delta").alias("total"), (F.count("delta") > 0).alias("available"))


def agreement(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row on two classifications (key, category, branch, confidence, ...) of the same keys; other keys are an error.

    Shares of equal categories and branches, the largest difference of
    confidences, and how often one side alone reaches each of ``CONFIDENCES``.
    """
    names = ("category", "branch", "confidence")
    j = left.select(key, *[F.col(n).alias(f"l_{n}") for n in names], F.lit(True).alias("_l")).join(right.select(key, *[F.col(n).alias(f"r_{n}") for n in names], F.lit(True).alias("_r")), key, "full_outer")
    share = lambda n: F.avg(F.col(f"l_{n}").eqNullSafe(F.col(f"r_{n}")).cast("double"))
    crossed = [F.count_if((F.col("l_confidence") >= t) != (F.col("r_confidence") >= t)).alias(f"crossed_{round(100 * t)}") for t in CONFIDENCES]
    one = j.agg(F.count("*").alias("n"), F.count_if(F.col("_l").isNull() | F.col("_r").isNull()).alias("_other"), F.coalesce(share("category"), F.lit(0.0)).alias("category_agreement"), F.coalesce(share("branch"), F.lit(0.0)).alias("branch_agreement"), F.max(F.abs(F.col("l_confidence") - F.col("r_confidence"))).alias("most_delta"), *crossed)
    none = sum((F.col(f"crossed_{round(100 * t)}") for t in CONFIDENCES), F.lit(0)) == 0
    passed = (F.col("n") > 0) & (F.col("category_agreement") == 1) & (F.col("branch_agreement") == 1) & none
    n = F.when(F.col("_other") == 0, F.col("n")).otherwise(F.raise_error(F.lit("the sides have different keys")).cast("long"))
    return one.withColumn("passed", passed).withColumn("n", n).drop("_other")


def pairwise_delta(rows: DataFrame, block: int | None = None) -> DataFrame:
    """One row: the largest difference between x_i . x_j and y_i . y_j over all pairs of rows (x, y).

    Rows are dealt into blocks, each sent once for each block there is; a task
    compares two blocks a few rows at a time and sends one number.
    """
    dealt = rows.select(F.col("x").cast("array<double>"), F.col("y").cast("array<double>"), F.xxhash64("x", "y").alias("h"))
    n = max(dealt.count(), 1)
    blocks = -(-n // block) if block else max(-(-n // BLOCK), min(SIDES, -(-n // LEAST)))
    own = dealt.withColumn("own", F.pmod("h", F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = own.select("x", "y", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def compare(t: pa.Table) -> pa.Table:
        x, y = (np.asarray(t.column(c).combine_chunks().flatten()).reshape(t.num_rows, -1) for c in ("x", "y"))
        side = t.column("own").to_numpy()
        a, b = (np.flatnonzero(side == t.column(c)[0].as_py()) for c in ("low", "high"))
        most = 0.0
        if len(b):
            p, q, step = x[b].T, y[b].T, max(1, STEP // len(b))
            for at in range(0, len(a), step):
                i = a[at : at + step]
                d = x[i] @ p
                d -= y[i] @ q
                most = max(most, float(d.max()), -float(d.min()))
        return pa.table({"d": [most]})

    return pairs.groupBy("low", "high").applyInArrow(compare, "d double").agg(F.max("d").alias("pairwise_delta"))


def embedding_comparison(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row on two encodings (id, vector) of the same items: cosines, errors, norms, and whether they pass as equal."""
    j = left.select("id", F.col("vector").alias("x")).join(right.select("id", F.col("vector").alias("y")), "id")
    size = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    cosine = dot(F.col("x"), F.col("y")) / F.greatest(size("x") * size("y"), F.lit(1e-12))
    errors = F.zip_with("x", "y", lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    each = j.select("x", "y", cosine.alias("c"), F.array_max(errors).alias("worst"), F.aggregate(errors, F.lit(0.0), lambda s, x: s + x).alias("total"), F.size(errors).alias("n"), size("x").alias("sx"), size("y").alias("sy"))
    one = each.agg(F.count("*").alias("n"), F.min("c").alias("min_cosine"), F.avg("c").alias("mean_cosine"), F.max("worst").alias("max_abs_error"), (F.sum("total") / F.sum("n")).alias("mean_abs_error"), F.max(F.abs(F.col("sx") - 1)).alias("norm_error_left"), F.max(F.abs(F.col("sy") - 1)).alias("norm_error_right"))
    passed = (F.col("min_cosine") >= LEAST_COSINE) & (F.col("max_abs_error") <= MOST_ERROR)
    return one.join(pairwise_delta(j)).withColumn("passed", passed)


def archived(clusters: DataFrame, vectors: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """(cold rows, hot vectors): clusters (label, centroid, start, end, n) that ended before the cutoff, keyed by label and start, and the vectors (id, at, ...) that are not older."""
    key = F.concat_ws("_", F.lit("cold_cluster"), "label", F.unix_timestamp("start").cast("string"))
    return clusters.filter(F.col("end") < cutoff).select(key.alias("key"), "label", "centroid", "start", "end", "n", F.lit("cold").alias("layer")), vectors.filter(F.col("at") >= cutoff)



#: Buckets between a power of two and the next, for values of ``quantiles``.
FINE = 4096


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(*keys, n, most, q0, q1, ...): rows, maximum and interpolated quantiles of each group's values, exact; nulls have no rank.

    Ranks are found by counts, first of buckets that rise with the value, then of
    the different values in the buckets that hold a rank, so that no task or
    buffer has all values of a group.
    """
    x = F.col("_x")
    size = F.abs(x)
    power = F.when(size > 0, F.floor(F.log2(size)))
    # Rising in |x|, whichever way the logarithm is rounded; of equal sign and power, the part of the way to the next.
    part = F.least(F.greatest(F.floor((size / F.pow(F.lit(2.0), power) - 1) * FINE), F.lit(0)), F.lit(FINE - 1))
    bucket = F.when(F.isnan("_x"), 2e18).when(size == float("inf"), F.signum(x) * 1e18).when(size > 0, F.signum(x) * ((power + 1100) * FINE + part)).otherwise(0.0)
    # Structs of keys are equal where both have a null.
    named, keys = keys, ["_k"]
    rows = rows.select(F.struct(*named).alias("_k"), F.col(value).cast("double").alias("_x"))
    values = rows.filter("_x is not null").withColumn("_b", bucket)
    counts = values.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    rising = Window.partitionBy(*keys).orderBy("_b")
    ranked = counts.withColumns({"_to": F.sum("_n").over(rising), "_all": F.sum("_n").over(Window.partitionBy(*keys))}).withColumn("_from", F.col("_to") - F.col("_n"))
    place = lambda s: F.lit(s) * (F.col("_all") - 1)
    ends = [f(place(s)) for s in shares for f in (F.floor, F.ceil)]
    held = F.lit(False)
    for e in ends:
        held = held | ((F.col("_from") <= e) & (e < F.col("_to")))
    few = written(ranked.filter(held).select(*keys, "_b", "_from", "_all"))
    total = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max("_x").alias("most"))
    each = values.join(few, [*keys, "_b"]).groupBy(*keys, "_b", "_from", "_all", "_x").agg(F.count("*").alias("_n"))
    inside = each.withColumn("_to", F.col("_from") + F.sum("_n").over(Window.partitionBy(*keys, "_b").orderBy("_x"))).withColumn("_at", F.col("_to") - F.col("_n"))
    hit = lambda e: F.max(F.when((F.col("_at") <= e) & (e < F.col("_to")), x))
    found = inside.groupBy(*keys, "_all").agg(*[hit(e).alias(f"_e{i}") for i, e in enumerate(ends)])
    between = [(F.col(f"_e{2 * i}") + (F.col(f"_e{2 * i + 1}") - F.col(f"_e{2 * i}")) * (place(s) - F.floor(place(s)))).alias(f"q{i}") for i, s in enumerate(shares)]
    return total.join(found.select(*keys, *between), keys, "left").select("_k.*", "n", "most", *[f"q{i}" for i in range(len(shares))])
