"""Deterministic sampling designs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stride_design(targets: DataFrame, stride: int, *, census_below: int = 0) -> DataFrame:
    """One point per target cell and block of ``stride`` x ``stride`` pixels, weighted by the block's population.

    ``targets``: ``code, row, col``.  The point nearest the block's centre stands for it (ties: row,
    then column).  Cells with fewer than ``census_below`` pixels keep every pixel.
    """
    cell = Window.partitionBy("code")
    step = F.when(F.count("*").over(cell) < census_below, F.lit(1)).otherwise(F.lit(stride))
    t = targets.withColumn("step", step)
    rb, cb = F.floor(F.col("row") / F.col("step")), F.floor(F.col("col") / F.col("step"))
    off = lambda c: F.pmod(F.col(c), F.col("step")) + F.lit(0.5) - F.col("step") / 2
    t = t.withColumns({"row_block": rb, "col_block": cb, "away": off("row") * off("row") + off("col") * off("col")})
    block = t.groupBy("code", "row_block", "col_block")
    first = F.min(F.struct("away", "row", "col")).alias("p")
    return block.agg(first, F.count("*").alias("weight")).select("code", F.col("p.row").alias("row"), F.col("p.col").alias("col"), "weight")


def nested_prefix(design: DataFrame, requested: Column) -> DataFrame:
    """The first ``requested`` points of each source's ordered design."""
    return design.where(F.col("sample_index") < requested)


def stable_seed(seed: int, *parts: Column) -> Column:
    """Seed below 2**32 from the SHA-256 of the parts joined by bars: its first 16 hexadecimal digits modulo 2**32."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")


def maximin(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Indexes of a nested farthest-point design; starts at the point nearest the centroid, ties to the first."""
    chosen = [int(np.round(np.hypot(x - x.mean(), y - y.mean()), 6).argmin())]
    away = np.hypot(x - x[chosen[0]], y - y[chosen[0]])
    while len(chosen) < min(n, len(x)):
        ranked = np.round(away, 6)
        ranked[chosen] = -1
        chosen.append(int(ranked.argmax()))
        away = np.minimum(away, np.hypot(x - x[chosen[-1]], y - y[chosen[-1]]))
    return np.array(chosen)


def maximin_design(candidates: DataFrame, n: int) -> DataFrame:
    """Per source: ``sample_index, x, y`` of a nested maximin design over its candidate points (``source_h3, x, y``).

    A source's candidates are a bounded grid, so a group fits in a task.
    """

    def design(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"], kind="stable").drop_duplicates(["x", "y"])
        picked = pdf.iloc[maximin(pdf["x"].to_numpy(), pdf["y"].to_numpy(), n)]
        return pd.DataFrame({"source_h3": picked["source_h3"].to_numpy(), "sample_index": np.arange(len(picked)), "x": picked["x"].to_numpy(), "y": picked["y"].to_numpy()})

    return candidates.groupBy("source_h3").applyInPandas(design, "source_h3 string, sample_index int, x double, y double")


def candidate_grid(boxes: DataFrame, side: int) -> DataFrame:
    """Inner grid points of each source's box (``source_h3, x0, y0, x1, y1``)."""
    k = F.explode(F.sequence(F.lit(1), F.lit(side)))
    step = lambda a, b, i: F.col(a) + (F.col(b) - F.col(a)) * F.col(i) / F.lit(float(side + 1))
    grid = boxes.withColumn("i", k).withColumn("j", k)
    return grid.select("source_h3", step("x0", "x1", "i").alias("x"), step("y0", "y1", "j").alias("y"))
