"""Affine transforms of the plane: build, compose, invert, and apply to points or geometries."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column

from landgrid.functions import measure, st


@dataclass(frozen=True)
class Affine:
    """x' = a x + b y + c, y' = d x + e y + f."""

    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 0.0
    e: float = 1.0
    f: float = 0.0

    @classmethod
    def shift(cls, dx: float, dy: float) -> "Affine":
        return cls(c=dx, f=dy)

    @classmethod
    def scale(cls, sx: float, sy: float, about: tuple[float, float] = (0.0, 0.0)) -> "Affine":
        return cls(a=sx, e=sy, c=about[0] * (1 - sx), f=about[1] * (1 - sy))

    @classmethod
    def rotate(cls, angle: float, about: tuple[float, float] = (0.0, 0.0)) -> "Affine":
        """Counter-clockwise, in radians."""
        turn = cls(math.cos(angle), -math.sin(angle), 0.0, math.sin(angle), math.cos(angle), 0.0)
        return cls.shift(-about[0], -about[1]).then(turn).then(cls.shift(*about))

    @classmethod
    def shear(cls, along_x: float, along_y: float) -> "Affine":
        return cls(b=along_x, d=along_y)

    @classmethod
    def flip_x(cls, low: float, high: float) -> "Affine":
        """Mirrors the interval of x onto itself."""
        return cls(a=-1.0, c=low + high)

    @classmethod
    def flip_y(cls, low: float, high: float) -> "Affine":
        return cls(e=-1.0, f=low + high)

    @classmethod
    def box_to_box(cls, source: tuple[float, float, float, float], target: tuple[float, float, float, float]) -> "Affine":
        """Takes one envelope onto another; a side without extent is only shifted."""
        sx, sy = ((target[2 + i] - target[i]) / (source[2 + i] - source[i]) if source[2 + i] != source[i] else 1.0 for i in (0, 1))
        return cls(a=sx, c=target[0] - sx * source[0], e=sy, f=target[1] - sy * source[1])

    def then(self, other: "Affine") -> "Affine":
        """This transform, and the other on its result."""
        return Affine(
            other.a * self.a + other.b * self.d, other.a * self.b + other.b * self.e, other.a * self.c + other.b * self.f + other.c,
            other.d * self.a + other.e * self.d, other.d * self.b + other.e * self.e, other.d * self.c + other.e * self.f + other.f,
        )

    def inverse(self) -> "Affine":
        det = self.a * self.e - self.b * self.d
        if det == 0:
            raise ValueError("the transform has no inverse")
        return Affine(self.e / det, -self.b / det, (self.b * self.f - self.e * self.c) / det, -self.d / det, self.a / det, (self.d * self.c - self.a * self.f) / det)

    def on(self, x: float, y: float) -> tuple[float, float]:
        return self.a * x + self.b * y + self.c, self.d * x + self.e * y + self.f

    def points(self, ring: Column) -> Column:
        """On an array of structs (x, y)."""
        return measure.affine(ring, self.a, self.b, self.c, self.d, self.e, self.f)

    def geometry(self, geom) -> Column:
        return st.st_affine(geom, self.a, self.b, self.c, self.d, self.e, self.f)
