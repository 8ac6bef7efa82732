"""What an index is made of: coordinates, domain and sizes. Passed explicitly; there is no global configuration."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

#: Types of coordinates and of ids.
COORDINATE, IDENTIFIER = "double", "long"


#: Rows that a segment has at least before there are more segments than a spec asks for, and the most segments there are.
SEGMENT_ROWS, MOST_SEGMENTS = 50_000, 1_000_000


@dataclass(frozen=True)
class IndexSpec:
    """``parts`` equi-depth parts for each dimension but the last; ``low`` and ``high`` bound the domain of each."""

    coords: tuple[str, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    parts: int = 16
    eta: float = 0.01
    page_size: int = 113
    segments: int = 8
    knots: int = 16
    lattice_intervals: int = 8

    def __post_init__(self):
        if not self.coords or len(self.coords) != len(self.low) or len(self.coords) != len(self.high):
            raise ValueError("coords, low and high have to be equally long and not empty")
        if any(h < l for l, h in zip(self.low, self.high)) or self.parts < 1 or not 0 <= self.eta < 1:
            raise ValueError("the domain, parts or eta is out of range")

    def sized(self, rows: int) -> IndexSpec:
        """The same with segments that follow the rows, so that one of them fits a task at any size."""
        return replace(self, segments=max(self.segments, min(MOST_SEGMENTS, rows // SEGMENT_ROWS)))

    @property
    def dims(self) -> int:
        return len(self.coords)

    @property
    def cells(self) -> int:
        return self.parts ** (self.dims - 1)


@dataclass(frozen=True)
class Grid:
    """Upper bounds of the parts: ``bounds[i]`` has a row of ``parts`` bounds for each cell of the dimensions before i.

    The size is set by the spec, at most 2 * parts^(dims - 1) numbers, and does not grow with the data.
    """

    spec: IndexSpec
    bounds: tuple[np.ndarray, ...]

    def edges(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds, (parents, parts). The first lower bound is the domain's minimum."""
        upper = self.bounds[dim]
        lower = np.hstack([np.full((len(upper), 1), self.spec.low[dim]), upper[:, :-1]])
        return lower, upper

    def place(self, dim: int, parent: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The part of x below each parent cell: a point on a split goes to the right, one beyond the domain to the outermost part."""
        out = np.zeros(len(x), np.int64)
        for p in np.unique(parent):
            mine = parent == p
            out[mine] = np.minimum(np.searchsorted(self.bounds[dim][p], x[mine], side="right"), self.spec.parts - 1)
        return out
