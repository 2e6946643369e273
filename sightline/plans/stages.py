"""Stages and their order."""

from __future__ import annotations

from collections.abc import Callable, Mapping

# stage -> stages it needs
DEPENDENCIES: dict[str, tuple[str, ...]] = {
    "area": (),
    "elevation": ("area",),
    "canopy": ("area",),
    "source-cells": ("area",),
    "target-cells": ("area",),
    "lookup": ("source-cells", "target-cells"),
    "pair-distances": ("lookup",),
    "terrain-weights": ("elevation", "lookup"),
    "canopy-weights": ("canopy", "terrain-weights"),
    "distance-weights": ("pair-distances",),
    "static-weights": ("canopy-weights", "terrain-weights", "distance-weights"),
    "summaries": ("static-weights",),
    "validate": ("summaries",),
    "export": ("validate",),
}
#: Water sources see over opaque land alone and need no rasters.
WATER_OVERRIDES = {"terrain-weights": ("lookup",), "canopy-weights": ("terrain-weights",)}


class CycleError(ValueError):
    """Stages that need each other."""


def plan(targets: list[str], *, role: str = "land", dependencies: Mapping[str, tuple[str, ...]] | None = None) -> list[str]:
    """The targets and all they need, dependencies first, in a fixed order."""
    needs = dict(DEPENDENCIES if dependencies is None else dependencies)
    if role == "water" and dependencies is None:
        needs |= WATER_OVERRIDES
    elif role not in ("land", "water"):
        raise ValueError(f"unknown role {role!r}")
    done: dict[str, bool] = {}
    for target in targets:
        stack = [(target, iter(needs[target]))] if target not in done else []
        done.setdefault(target, False)
        while stack:
            stage, rest = stack[-1]
            step = next(rest, None)
            if step is None:
                stack.pop()
                done.pop(stage)
                done[stage] = True  # order of completion
            elif step not in needs:
                raise ValueError(f"unknown stage {step!r}")
            elif done.get(step) is False:
                raise CycleError(f"{step} needs itself through {stage}")
            elif step not in done:
                done[step] = False
                stack.append((step, iter(needs[step])))
    return [s for s, finished in done.items() if finished]


def execute(stages: Mapping[str, Callable[[dict], object]], targets: list[str], *, role: str = "land", results: dict | None = None, dependencies: Mapping[str, tuple[str, ...]] | None = None) -> dict:
    """Run the stages of a plan in order; each gets the results so far.  Given results are not made again."""
    out = dict(results or {})
    for stage in plan(targets, role=role, dependencies=dependencies):
        if stage not in out:
            out[stage] = stages[stage](out)
    return out
