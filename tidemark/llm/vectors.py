"""Usable vectors and random rotations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (array of double), one row an id: vectors that are not null or zero and hold neither null nor non-finite components.

    Repeated ids take the least vector (arrays compare component by component); null ids take no part; of several lengths
    only the most frequent takes part (ties: the longer).
    """
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("v", lambda x: x != 0)
    fine = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = fine.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(finite & some)
    fine = fine.groupBy("vec_id").agg(F.min("v").alias("v"))
    lengths = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return fine if lengths is None else fine.filter(F.size("v") == lengths["n"])


def stacked(column: pd.Series, dimensions: int) -> np.ndarray:
    """A column of arrays as one matrix."""
    return np.stack(column.to_numpy()).astype(np.float64, copy=False) if len(column) else np.zeros((0, dimensions))


def rotation(rows: int, columns: int, seed: int) -> np.ndarray:
    """``rows`` x ``columns`` with orthonormal columns (rows >= columns), uniformly random."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(rows, columns)))
    return q * np.sign(np.diag(r))
