"""Integrity checks.  ``find_*`` return the offending rows; ``assert_*`` run one action and raise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class IntegrityError(ValueError):
    """A table breaks its contract."""


def _raise_if_any(rows: DataFrame, what: str) -> None:
    some = rows.limit(10).collect()
    if some:
        raise IntegrityError(f"{what}: {[r.asDict() for r in some]}")


def find_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def assert_unique(df: DataFrame, keys: list[str], name: str) -> None:
    """No key twice."""
    _raise_if_any(find_duplicates(df, keys), f"duplicate keys in {name}")


def find_uncovered(universe: DataFrame, factor: DataFrame, keys: list[str]) -> DataFrame:
    """Keys missing from the factor, and keys of the factor outside the universe."""
    one, two = universe.select(*keys), factor.select(*keys)
    return one.join(two, keys, "left_anti").withColumn("side", F.lit("missing")).union(two.join(one, keys, "left_anti").withColumn("side", F.lit("extra")))


def assert_covered(universe: DataFrame, factor: DataFrame, keys: list[str], name: str) -> None:
    """The factor has exactly the universe's keys."""
    _raise_if_any(find_uncovered(universe, factor, keys), f"{name} does not match the pair universe")


def find_unmatched(frames: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Keys that do not occur exactly once in every frame, with their count in each: one aggregation for all frames."""
    tagged = None
    for name, frame in frames.items():
        one = frame.select(*keys, F.lit(name).alias("frame"))
        tagged = one if tagged is None else tagged.unionByName(one)
    counts = [F.count_if(F.col("frame") == name).alias(f"in_{name}") for name in frames]
    wrong = [F.col(f"in_{name}") != 1 for name in frames]
    return tagged.groupBy(*keys).agg(*counts).where(reduce(lambda a, b: a | b, wrong))


def assert_one_to_one(frames: dict[str, DataFrame], keys: list[str]) -> None:
    """Every frame has the same keys, each once."""
    _raise_if_any(find_unmatched(frames, keys), "pair factors do not match one to one")


def out_of_unit(column: str) -> Column:
    """Whether a weight is null, NaN, infinite or outside [0, 1]."""
    c = F.col(column)
    return c.isNull() | F.isnan(c) | (c < 0) | (c > 1)


def find_invalid_weights(df: DataFrame, keys: list[str], weights: list[str]) -> DataFrame:
    """Rows with empty keys or weights outside [0, 1], and which columns are wrong."""
    bad_keys = [F.when(F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == ""), F.lit(k)) for k in keys]
    bad = F.array_compact(F.array(*bad_keys, *[F.when(out_of_unit(w), F.lit(w)) for w in weights]))
    return df.withColumn("wrong", F.concat_ws(",", bad)).where("wrong <> ''")


def assert_pair_kernel(df: DataFrame, keys: list[str], weights: list[str]) -> None:
    """Keys present and unique, weights observed and in [0, 1]."""
    _raise_if_any(find_invalid_weights(df, keys, weights), "invalid weights")
    assert_unique(df, keys, "pairs")


def weighted_above_joint(joint: str, weighted: str, tolerance: float = 1e-6) -> Column:
    """Whether the distance-weighted fraction exceeds the joint fraction."""
    return F.col(weighted) > F.col(joint) + F.lit(tolerance)


def find_weighted_above_joint(df: DataFrame, joint: str, weighted: str, tolerance: float = 1e-6) -> DataFrame:
    """Rows whose distance-weighted fraction exceeds the joint fraction."""
    return df.where(weighted_above_joint(joint, weighted, tolerance))


def wrong_product(tolerance: float = 1e-7) -> Column:
    """Whether the static weight is not terrain times vegetation."""
    gap = F.abs(F.col("weight_static_viewability") - F.col("weight_terrain") * F.col("weight_vegetation"))
    return gap.isNull() | (gap > tolerance)


def find_wrong_products(df: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """Rows whose static weight is not terrain times vegetation."""
    return df.where(wrong_product(tolerance))


def wrong_distance(cutoff_km: float, slack_km: float = 1e-4) -> Column:
    """Whether the distance is null, negative, too far, or metres and kilometres disagree."""
    m, km = F.col("distance_m"), F.col("distance_km")
    apart = F.abs(m - km * 1000) > F.lit(1e-6) + F.lit(1e-12) * F.abs(km * 1000)
    return m.isNull() | km.isNull() | (km < 0) | (km > cutoff_km + slack_km) | apart


def find_wrong_distances(df: DataFrame, cutoff_km: float, slack_km: float = 1e-4) -> DataFrame:
    """Distances that are null, negative, too far, or whose metres and kilometres disagree."""
    return df.where(wrong_distance(cutoff_km, slack_km))


def find_wrong_bounds(df: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Transmission rows whose bounds are disordered, or whose gap is not the unknown share, or whose score contradicts them."""
    lower, upper, unknown, score = (F.col(c) for c in ("lower", "upper", "unknown", "score"))
    bad = (lower < 0) | (upper > 1 + tolerance) | (lower > upper + tolerance) | (F.abs(upper - lower - unknown) > tolerance) | (score.isNull() != (unknown > 0))
    return df.where(F.coalesce(bad, F.lit(True)))


def assert_schema(df: DataFrame, schema: StructType) -> None:
    """Same columns, in order, with the same types."""
    have = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    want = [(f.name, f.dataType.simpleString()) for f in schema.fields]
    if have != want:
        raise IntegrityError(f"schema {have} is not {want}")


def table_audit(df: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """One row: rows, distinct keys, bounds and mean of the weight, nulls."""
    distinct = [F.countDistinct(k).alias(f"{k}_count") for k in keys]
    return df.agg(
        F.count("*").alias("row_count"), *distinct, F.min(weight).alias("min_weight"), F.max(weight).alias("max_weight"), F.avg(weight).alias("mean_weight"), F.count_if(F.col(weight).isNull()).alias("null_weights"),
    )


def content_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: row count and an order-free digest of the rows (sum of 60-bit parts of SHA-256)."""
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]), 256)
    part = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("row_count"), F.sum(part).cast("string").alias("digest"))


def all_of(conditions: list[Column]) -> Column:
    """Conjunction of conditions."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
