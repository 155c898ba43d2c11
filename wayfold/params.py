"""Parameters of the road operators, as frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Extraction:
    road_max_len: float = 2000
    road_max_width: float = 30
    road_buffer: float = 80
    section_length: float = 10
    profile_resolution: float = 0.5


@dataclass(frozen=True)
class Conductivity:
    sigma_min: float = 0.1
    s: tuple[float, float] = (5, 20)
    r: tuple[float, float] = (0.05, 0.1)
    e: tuple[float, ...] = (40,)
    q: tuple[float, float] = (0.1, 0.5)
    h: tuple[float, float] = (0.1, 0.2)
    d: tuple[float, float] = (0.25, 0.95)
    alpha_h: float = 1
    alpha_d: float = 2
    alpha_r: float = 1
    alpha_i: float = 1


@dataclass(frozen=True)
class State:
    percentage_veg: tuple[float, float] = (10, 40)
    drivable_width: tuple[float, float] = (1, 5)
    conductivity: tuple[float, float] = (0.25, 0.5)
    shoulder: tuple[float, float] = (50, 75)


@dataclass(frozen=True)
class Parameters:
    """The defaults that define the operators' meaning."""

    extraction: Extraction = field(default_factory=Extraction)
    confidence: float = 0.1
    min_slope: float = 10
    max_sd_ground: float = 0.1
    max_elevation_ground: float = 0.15
    max_percentage_drivable: float = 0.15
    conductivity: Conductivity = field(default_factory=Conductivity)
    state: State = field(default_factory=State)


DEFAULTS = Parameters()
#: For the second conductivity model, whose edges are graded.
DEFAULTS_V2 = Parameters(conductivity=Conductivity(e=(1, 20)))
