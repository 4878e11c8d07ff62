"""A named vector of bounded parameters, for the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass, field


@dataclass
class Vector:
    """Values are clipped to their bounds when set; `hit` tells whether one was."""

    names: list[str]
    defaults: list[float]
    mins: list[float] = field(default_factory=list)
    maxs: list[float] = field(default_factory=list)
    accept_nan: bool = False
    hit: bool = False

    def __post_init__(self):
        if len(set(self.names)) < len(self.names):
            raise ValueError("names must differ")
        self.mins = self.mins or [-math.inf] * len(self.names)
        self.maxs = self.maxs or [math.inf] * len(self.names)
        self.values = list(self.defaults)

    def __getitem__(self, name: str) -> float:
        return self.values[self.names.index(name)]

    def __setitem__(self, name: str, value: float) -> None:
        if math.isnan(value) and not self.accept_nan:
            raise ValueError(f"{name} must be a number")
        i = self.names.index(name)
        clipped = value if math.isnan(value) else min(max(value, self.mins[i]), self.maxs[i])
        self.hit |= clipped != value and not math.isnan(value)
        self.values[i] = clipped

    def reset(self) -> None:
        self.values, self.hit = list(self.defaults), False

    def clone(self) -> Vector:
        out = Vector(list(self.names), list(self.defaults), list(self.mins), list(self.maxs), self.accept_nan)
        out.values, out.hit = list(self.values), self.hit
        return out

    def to_rows(self) -> list[tuple]:
        return list(zip(self.names, self.values, self.mins, self.maxs, self.defaults, strict=True))
