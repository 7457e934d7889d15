"""Whitening of embeddings by principal components of an exact covariance.

Entries become whole numbers, so that sums and deviations are exact. The fit
list holds every distinct vector once. One aggregation sums each dimension, a
second one the centred products of every pair of dimensions (``moments``); the
driver assembles the covariance of one length of vectors, which is as large as
the square of the dimensions and not of the rows, and decomposes it with LAPACK.
Rows are then projected in their own partitions, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import frugal
from .common import discard, materialize
from .moments import by_key, products, sums

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Entries at or beyond this have no long after scaling.
MOST = float(1 << 61) / SCALE


def whole(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each entry, as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + F.lit(SHIFT).cast("long"))


def sound(vector: Column) -> Column:
    """Whether a vector is there and every entry is a number whose scaled value fits a long."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < MOST)), F.lit(False))


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors as rows), at most ``most``; the entry of a vector that is largest in size is positive."""
    e, v = np.linalg.eigh(covariance)
    e, v = e[::-1][:most], v.T[::-1][:most]
    return e, v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])[:, None]


def fit(vectors: DataFrame, most: int = COMPONENTS) -> dict:
    """length -> model of the distinct whole ``x`` (array<long>) of that length.

    A model has n, the exact mean as ``base`` + ``rest`` / n (whole numbers, 0
    <= rest < n), trace, eigenvalues, components, and the error: the largest
    entry of the whitened covariance minus the identity, measured by a pass
    over the fit list. A component without variance (its eigenvalue is no more
    than rounding of the largest) has the eigenvalue 0 and does not count in
    the error.
    """
    listed = materialize(vectors.select("x").distinct().withColumn("length", F.size("x")))
    width = listed.agg(F.max("length")).first()[0] or 0
    model: dict = {}
    for length, (n, s) in sums(listed, "length", "x", width).items():
        base, rest = zip(*(divmod(int(v), n) for v in s[:length]), strict=True) if length else ((), ())
        model[length] = {"n": n, "base": list(base), "rest": list(rest)}
    model = {k: m for k, m in model.items() if k}
    if not model:
        discard(listed)
        return model
    centred = F.zip_with(
        F.zip_with("x", by_key(F.col("length"), {k: m["base"] for k, m in model.items()}), lambda a, b: (a - b).cast("double")),
        by_key(F.col("length"), {k: [r / m["n"] for r in m["rest"]] for k, m in model.items()}),
        lambda a, b: a - b,
    )
    about = listed.filter("length > 0").select("length", centred.alias("d"))
    for length, p in products(about, "length", "d", width).items():
        m, v = model[length], p[:length, :length] / model[length]["n"]
        e, m["vectors"] = components(v, most)
        floor = np.finfo(float).eps * length * max(float(e[0]), 0.0)
        m["values"], m["trace"] = np.where(e > floor, e, 0.0), float(np.trace(v))
    widest = max(len(m["values"]) for m in model.values())
    seen = whiten(listed.filter("length > 0").select("x", "length"), model, "x").select("length", "whitened")
    mean, square = sums(seen, "length", "whitened", widest), products(seen, "length", "whitened", widest)
    for length, m in model.items():
        use = np.flatnonzero(m["values"] > 0)
        centre = np.array(mean[length][1])[use] / m["n"]
        off = square[length][np.ix_(use, use)] / m["n"] - np.outer(centre, centre) - np.eye(len(use))
        m["error"] = float(np.abs(off).max()) if len(use) else 0.0
    discard(listed)
    return model


def whiten(df: DataFrame, model: dict, x: str = "x") -> DataFrame:
    """``df`` with ``deviation`` long and ``whitened`` array<double>, for rows whose length of ``x`` has a model.

    Other columns stay; those two names are replaced. ``deviation`` is null
    where the sum of squares does not fit a long, and an entry of ``whitened``
    is null where the component has no variance.
    """
    clean = df.drop("deviation", "whitened")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.schema.get_field_index(x))
            lengths = np.asarray(column.value_lengths())
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                part = b.take(pa.array(rows))
                m = model[int(length)]
                vectors = np.asarray(part.column(b.schema.get_field_index(x)).flatten(), np.int64).reshape(len(rows), -1)
                near = vectors - np.array(m["base"], np.int64)
                far = near.astype(float) - np.array(m["rest"], float) / m["n"]
                deviation = [squares(near[i], m) if s > 4e18 else None for i, s in enumerate((far * m["n"] * far * m["n"]).sum(axis=1))]
                exact = np.flatnonzero([d is None for d in deviation])
                times = near[exact] * np.int64(m["n"]) - np.array(m["rest"], np.int64)
                for i, d in zip(exact, (times * times).sum(axis=1).tolist(), strict=True):
                    deviation[i] = d
                fits = [d if d < 1 << 63 else None for d in deviation]
                with np.errstate(divide="ignore", invalid="ignore"):
                    white = (far @ m["vectors"].T) / np.sqrt(m["values"])
                none = np.broadcast_to(m["values"] <= 0, white.shape).ravel()
                ends = pa.array(np.arange(0, white.size + 1, white.shape[1], dtype=np.int32))
                white = pa.ListArray.from_arrays(ends, pa.array(white.ravel(), mask=none))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fits, pa.int64()), white], names=[*part.schema.names, "deviation", "whitened"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clean.schema)
    return clean.mapInArrow(frugal(run), f"{fields}, deviation long, whitened array<double>")


def squares(near: np.ndarray, m: dict) -> int:
    """The deviation in Python's integers, of a row too far out for 64 bits on the way."""
    return sum((m["n"] * int(a) - r) ** 2 for a, r in zip(near, m["rest"], strict=True))


def whitened_components(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): rows x components.

    Rows whose vector is null or holds null or non-finite entries are left
    out, and so are those with an entry of 2^55 or more, which has no long
    after scaling. Rows that repeat an id or a vector keep rows each; the fit
    list has each vector once. Vectors of another length are a space of their
    own with its own fit. Empty vectors have no component, hence no row. Where
    a component has no variance (as with one distinct vector), ``whitened`` is
    null and ``explained`` 0, or null if nothing varies at all. Other columns
    of ``df`` are not read. An empty table gives no rows.
    """
    # Negative zero and zero are one entry after scaling.
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter(sound(F.col("v")))
    rows = rows.select("id", whole(F.col("v")).alias("x")).filter(F.size("x") > 0)
    model = fit(rows, most)
    kind = df.schema[id_col].dataType.simpleString()
    if not model:
        return df.sparkSession.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    length = F.size("x")
    seen = whiten(rows, model).select(
        "id",
        F.posexplode("whitened").alias("at", "whitened"),
        "deviation",
        by_key(length, {k: [m["n"]] for k, m in model.items()})[0].cast("long").alias("n"),
        by_key(length, {k: [(float(v) / m["trace"]) if m["trace"] > 0 else None for v in m["values"]] for k, m in model.items()}).alias("shares"),
        by_key(length, {k: [m["error"]] for k, m in model.items()})[0].alias("identity_error"),
    )
    share = F.get("shares", F.col("at")).cast("double").alias("explained")
    return seen.select(F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", share, "identity_error")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every embedding."""
    return whitened_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op12_whitening": op12_whitening}
SQL: dict[str, str] = {}
