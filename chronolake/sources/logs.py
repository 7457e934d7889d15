"""Event logs and packed vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def normalized(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def find_column(columns: list[str], aliases: list[str]) -> str | None:
    """The column whose plain name equals an alias, else one that contains it."""
    plain = {normalized(c): c for c in reversed(columns)}
    for a in map(normalized, aliases):
        if a in plain:
            return plain[a]
    return next((c for a in map(normalized, aliases) for c in columns if a in normalized(c)), None)


def encode_vectors(df: DataFrame) -> DataFrame:
    """(id, body, dims): little-endian 32-bit vectors; empty, zero or non-finite ones are an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [np.asarray(v, "<f4") for v in b["vector"]]
            if any(not len(v) or len(v) > 65_536 or not np.isfinite(v).all() or not v.any() for v in rows):
                raise ValueError("a vector is empty, too long, zero or not finite")
            yield pd.DataFrame({"id": b["id"], "body": [v.tobytes() for v in rows], "dims": [len(v) for v in rows]})

    return df.select("id", "vector").mapInPandas(run, "id long, body binary, dims int")


def decode_vectors(df: DataFrame) -> DataFrame:
    """(id, vector) of (id, body, dims); a length that disagrees is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [np.frombuffer(x, "<f4") for x in b["body"]]
            if any(len(v) != n for v, n in zip(rows, b["dims"], strict=True)):
                raise ValueError("a vector's length differs from its dimensions")
            yield pd.DataFrame({"id": b["id"], "vector": rows})

    return df.select("id", "body", "dims").mapInPandas(run, "id long, vector array<float>")
