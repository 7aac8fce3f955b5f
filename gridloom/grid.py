"""Georeferencing: an opaque CRS label and a regular grid."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class CRS:
    """A label that is compared, never interpreted; an empty one matches any."""

    name: str = ""

    def matches(self, other: CRS) -> bool:
        return not self.name or not other.name or self.name == other.name

    def describe(self) -> str:
        return self.name or "unspecified CRS"


@dataclass(frozen=True)
class Grid:
    """Cells of a signed resolution from an outer corner; north-up grids have a negative res_y."""

    width: int
    height: int
    res_x: float = 1.0
    res_y: float = -1.0
    origin_x: float = 0.0
    origin_y: float = 0.0
    crs: CRS = CRS()

    def __post_init__(self):
        if self.width < 0 or self.height < 0:
            raise ValueError("a grid has no negative size")
        values = (self.res_x, self.res_y, self.origin_x, self.origin_y)
        if not all(map(math.isfinite, values)) or not self.res_x or not self.res_y:
            raise ValueError("resolutions and origins are finite, resolutions not zero")

    def window(self, x: int, y: int, width: int, height: int) -> Grid:
        """The grid of a window; its origin moves."""
        if x < 0 or y < 0 or width < 0 or height < 0 or x + width > self.width or y + height > self.height:
            raise ValueError("the window leaves the grid")
        return replace(self, width=width, height=height, origin_x=self.origin_x + x * self.res_x, origin_y=self.origin_y + y * self.res_y)
