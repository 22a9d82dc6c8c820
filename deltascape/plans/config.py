"""Settings of the detection plan, by step, checked before a plan is built."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace


def within(default: float, low: float, high: float = float("inf"), open_low: bool = False, open_high: bool = False):
    """A number with the range that it must lie in."""
    return field(default=default, metadata={"low": low, "high": high, "open": (open_low, open_high)})


# The defaults of these steps are fixed values.
@dataclass(frozen=True)
class Threshold:
    """Which scores are change: those over a percentile of the scene, or over one given value."""

    percentile: float = within(98.5, 0, 100, True, True)
    fixed: float | None = within(None, 0, 1)


@dataclass(frozen=True)
class Shape:
    """Cleaning of the mask, and what becomes of its regions."""

    opening_m: float = within(0.6, 0)
    min_area_m2: float = within(20.0, 0)
    rectangularity: float = within(0.35, 0, 1)
    min_rise_m: float = 1.5
    regularise: bool = True


@dataclass(frozen=True)
class Shadow:
    """Deferral of regions that lie in shadow."""

    enabled: bool = True
    percentile: float = within(8.0, 0, 100)
    brightness: float = within(0.60, 0)
    context_m: float = within(8.0, 0)
    dilation_m: float = within(0.5, 0)
    overlap: float = within(0.5, 0, 1, True)


@dataclass(frozen=True)
class Registration:
    """Laying the earlier date on the later one."""

    enabled: bool = True
    most_px: float = within(10.0, 0)


@dataclass(frozen=True)
class Settings:
    """All steps of one run."""

    threshold: Threshold = Threshold()
    shape: Shape = Shape()
    shadow: Shadow = Shadow()
    registration: Registration = Registration()

    def __post_init__(self):
        for step in fields(self):
            part = getattr(self, step.name)
            for f in fields(part):
                value, rule = getattr(part, f.name), f.metadata
                if value is None or not rule:
                    continue
                below = value <= rule["low"] if rule["open"][0] else value < rule["low"]
                above = value >= rule["high"] if rule["open"][1] else value > rule["high"]
                if below or above:
                    raise ValueError(f"{step.name}.{f.name} is {value}, outside {rule['low']} to {rule['high']}")

    def with_values(self, values: Mapping[str, object]) -> Settings:
        """These settings with others by name, such as shape.min_area_m2."""
        out = self
        for name, value in values.items():
            step, _, key = name.partition(".")
            out = replace(out, **{step: replace(getattr(out, step), **{key: value})})
        return out


#: What a named preset changes, fixed values.
PRESETS = {
    "balanced": {},
    "high-recall": {"threshold.percentile": 96.0, "shape.min_area_m2": 10.0, "shape.opening_m": 0.2, "shadow.enabled": False},
}


def preset(name: str) -> Settings:
    """The settings of a preset."""
    if name not in PRESETS:
        raise ValueError(f"no preset {name!r}; there are {', '.join(PRESETS)}")
    return Settings().with_values(PRESETS[name])
