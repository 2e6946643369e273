"""Table schemas (column order is part of the contract), roles and states."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, FloatType, LongType, StringType, StructType

ROLES = ("land", "water")
CELL_TYPES = ("land", "water", "mixed", "excluded")
WEIGHT_STATES = ("positive", "derived_zero", "source_unavailable")
VEGETATION_STATES = (*WEIGHT_STATES, "not_applicable", "no_baseline_support_neutral")
RAY_STATES = {"clear": 1, "blocked": 0, "unknown": -1, "out_of_range": -2}

_KEYS = "source_h3 string, target_h3 string"
_DDL = {
    "source_target_lookup": f"{_KEYS}, distance_km float, source_type string",
    "target_water_area": "target_h3 string, total_water_area_m2 double, equivalent_water_pixel_count bigint",
    "distance_weights": f"{_KEYS}, distance_km float, weight_distance float",
    "pair_distances": f"{_KEYS}, source_type string, distance_m double, distance_km double",
    "distance_profile": f"{_KEYS}, source_type string, distance_m double, distance_km double, weight_distance float",
    "terrain_weights": f"{_KEYS}, weight_terrain float",
    "canopy_los_weights": f"{_KEYS}, weight_canopy_los float",
    "vegetation_weights": f"{_KEYS}, source_type string, weight_vegetation float, vegetation_status string",
    "static_weights": f"{_KEYS}, weight_terrain float, weight_distance float, weight_vegetation float, weight_static_viewability float",
    "transmission_bounds": "target_h3 string, score double, lower double, upper double, unknown double, out_of_range double",
}
_TYPES = {"string": StringType(), "float": FloatType(), "double": DoubleType(), "bigint": LongType()}


def _schema(ddl: str) -> StructType:
    out = StructType()
    for column in ddl.split(", "):
        name, kind = column.split(" ")
        out.add(name, _TYPES[kind])
    return out


SCHEMAS: dict[str, StructType] = {name: _schema(ddl) for name, ddl in _DDL.items()}
