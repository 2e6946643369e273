"""Dependency-driven builds: from samples to validated products.

``build`` plans the stages a target needs, makes those whose product is absent or was made with
other settings, and reads the rest.  Every product has a contract; the settings' fingerprint is in it.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import scalars as S
from sightline.operators import checks, compose, kernels, summaries
from sightline.plans.stages import plan
from sightline.schemas import ROLES, SCHEMAS
from sightline.sources.products import read_product, write_product

PAIR = ["source_h3", "target_h3"]


@dataclass(frozen=True)
class Settings:
    """What a build depends on, besides its samples."""

    role: str = "land"
    decay: S.Decay = field(default_factory=S.Decay)
    max_distance_km: float = 30.0

    def __post_init__(self) -> None:
        if self.role not in ROLES:
            raise ValueError(f"unknown role {self.role!r}")
        if not self.max_distance_km > 0:
            raise ValueError("max_distance_km must be positive")

    @classmethod
    def from_mapping(cls, raw: dict) -> "Settings":
        """Settings from plain values (as parsed from YAML or JSON); unknown keys are errors."""
        known = {f.name for f in dataclasses.fields(cls)}
        if extra := set(raw) - known:
            raise ValueError(f"unknown settings {sorted(extra)}")
        values = dict(raw)
        if isinstance(values.get("decay"), dict):
            values["decay"] = S.Decay(**values["decay"])
        return cls(**values)

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(dataclasses.asdict(self), sort_keys=True).encode()).hexdigest()


def _typed(df: DataFrame, name: str) -> DataFrame:
    """Columns of a schema, in its order and types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields])


def _surface(samples: DataFrame, settings: Settings, surface: str) -> DataFrame:
    return kernels.water_kernel(samples, F.col(surface) & (F.col("distance_km") <= settings.max_distance_km), settings.decay.weight("distance_km"))


def _lookup(samples: DataFrame, settings: Settings, got: dict) -> DataFrame:
    pairs = samples.groupBy(*PAIR, "source_type").agg(F.min("distance_km").alias("distance_km"))
    return _typed(pairs.where(F.col("distance_km") <= settings.max_distance_km), "source_target_lookup")


def _distances(samples: DataFrame, settings: Settings, got: dict) -> DataFrame:
    km = F.col("distance_km").cast("double")
    return _typed(got["lookup"].withColumns({"distance_m": km * 1000, "distance_km": km}), "pair_distances")


def _distance_weights(samples: DataFrame, settings: Settings, got: dict) -> DataFrame:
    return _typed(got["pair-distances"].withColumn("weight_distance", settings.decay.weight("distance_km")), "distance_weights")


def _terrain(samples: DataFrame, settings: Settings, got: dict) -> DataFrame:
    sparse = _surface(samples, settings, "bare").where("terrain_binary").select(*PAIR, F.col("weighted_fraction").alias("weight_terrain"))
    return _typed(compose.densify(got["lookup"].select(*PAIR), sparse, "weight_terrain"), "terrain_weights")


def _vegetation(samples: DataFrame, settings: Settings, got: dict) -> DataFrame:
    keys = got["lookup"].select(*PAIR, "source_type")
    if settings.role == "water":
        return _typed(keys.withColumns({"weight_vegetation": F.lit(1.0), "vegetation_status": F.lit("not_applicable")}), "vegetation_weights")
    sparse = _surface(samples, settings, "canopy").where("terrain_binary").select(*PAIR, F.col("weighted_fraction").alias("weight_terrain"))
    bare = got["terrain-weights"].select(*PAIR, F.col("weight_terrain").cast("double"))
    factors = compose.dual_surface(keys.withColumn("source_type", F.lit("land")), bare, sparse)
    return _typed(factors.withColumn("source_type", F.lit(settings.role)), "vegetation_weights")


def _static(samples: DataFrame, settings: Settings, got: dict) -> DataFrame:
    out = compose.compose_static(got["lookup"].select(*PAIR), got["terrain-weights"], got["canopy-weights"])
    return _typed(out.join(got["distance-weights"].select(*PAIR, "weight_distance"), PAIR, "left"), "static_weights")


def _summaries(samples: DataFrame, settings: Settings, got: dict) -> DataFrame:
    return summaries.pair_summary(got["static-weights"], "target_h3", role=settings.role)


def _validated(samples: DataFrame, settings: Settings, got: dict) -> DataFrame:
    static = got["static-weights"]
    checks.assert_pair_kernel(static, PAIR, ["weight_terrain", "weight_distance", "weight_vegetation", "weight_static_viewability"])
    checks.assert_covered(got["lookup"], static, PAIR, "static weights")
    wrong = checks.find_wrong_products(static, 1e-6)
    if not wrong.isEmpty():
        raise checks.IntegrityError("static weights are not the product of their factors")
    return checks.table_audit(static, PAIR, "weight_static_viewability")


STAGES = {
    "lookup": _lookup, "pair-distances": _distances, "distance-weights": _distance_weights, "terrain-weights": _terrain, "canopy-weights": _vegetation, "static-weights": _static,
    "summaries": _summaries, "validate": _validated,
}
_KEYS = {"summaries": ["target_h3"], "validate": ["row_count"]}


def build(spark: SparkSession, samples: DataFrame, folder: str, targets: list[str], settings: Settings | None = None) -> dict[str, DataFrame]:
    """Products of the targets and of all they need, by stage.

    ``samples``: ``source_h3, target_h3, source_type, observer, pixel, distance_km, bare, canopy`` of
    both roles.  Stages without a table of their own here (areas, rasters, cells) are inputs and skipped.
    """
    settings = settings or Settings()
    mine = samples.where(F.col("source_type") == settings.role)
    got: dict[str, DataFrame] = {}
    for stage in plan(targets, role=settings.role):
        if stage not in STAGES:
            continue
        path = f"{folder}/{settings.role}/{stage}"
        if not _made(spark, path, settings):
            write_product(STAGES[stage](mine, settings, got), path, keys=_KEYS.get(stage, PAIR), metadata={"settings": settings.fingerprint()}, overwrite=True)
        got[stage] = read_product(spark, path, verify=False)
    return got


def _made(spark: SparkSession, path: str, settings: Settings) -> bool:
    """Whether a product of the same settings is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.contract")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return False
    return json.loads(spark.read.text(f"{path}.contract").first()[0])["metadata"].get("settings") == settings.fingerprint()
