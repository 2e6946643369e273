"""Builds from samples to products."""

from __future__ import annotations

import pytest
from conftest import rows_of

from sightline import api
from sightline.functions import scalars as S
from sightline.operators.checks import assert_schema
from sightline.plans import domain
from sightline.schemas import SCHEMAS


def test_build_and_reuse(spark, small, tmp_path):
    samples = domain.samples(spark, small)
    got = api.build(spark, samples, f"file://{tmp_path}", ["validate"])
    assert_schema(got["static-weights"], SCHEMAS["static_weights"])
    assert got["validate"].first()["row_count"] == got["lookup"].count()
    expected = domain.pairs(spark, small).where("source_type = 'land'").select("source_h3", "target_h3", "weight_static_viewability")
    names = expected.columns
    near = lambda df: [(a, b, round(float(w), 4)) for a, b, w in rows_of(names, df.select(*names).collect(), names)]
    assert near(got["static-weights"]) == near(expected)
    stamp = (tmp_path / "land/lookup/_SUCCESS").stat().st_mtime_ns
    api.build(spark, samples, f"file://{tmp_path}", ["validate"])
    assert (tmp_path / "land/lookup/_SUCCESS").stat().st_mtime_ns == stamp
    api.build(spark, samples, f"file://{tmp_path}", ["lookup"], api.Settings(max_distance_km=5.0))
    assert (tmp_path / "land/lookup/_SUCCESS").stat().st_mtime_ns != stamp


def test_water_has_neutral_vegetation(spark, small, tmp_path):
    got = api.build(spark, domain.samples(spark, small), f"file://{tmp_path}", ["summaries"], api.Settings(role="water"))
    assert {tuple(r) for r in got["canopy-weights"].select("weight_vegetation", "vegetation_status").distinct().collect()} == {(1.0, "not_applicable")}
    assert {r[0] for r in got["summaries"].select("canopy_support").distinct().collect()} == {"not_applicable"}


def test_settings():
    made = api.Settings.from_mapping({"role": "water", "decay": {"kind": "exponential", "scale": 5.0}})
    assert made.decay == S.Decay("exponential", scale=5.0) and made.fingerprint() != api.Settings().fingerprint()
    for raw in ({"rolle": 1}, {"role": "air"}, {"max_distance_km": 0}):
        with pytest.raises(ValueError):
            api.Settings.from_mapping(raw)
