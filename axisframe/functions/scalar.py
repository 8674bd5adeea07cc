"""Scalar functions as columns, and the few that plans need as numbers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = float(np.finfo(float).eps)


def deg2rad(x: Column) -> Column:
    return F.radians(x)


def rad2deg(x: Column) -> Column:
    return F.degrees(x)


def pol2cart(theta: Column, radius: Column, z: Column | None = None, radians: bool = True) -> Column:
    """struct(x, y[, z])"""
    t = theta if radians else F.radians(theta)
    parts = [(radius * F.cos(t)).alias("x"), (radius * F.sin(t)).alias("y")]
    return F.struct(*parts, *([z.alias("z")] if z is not None else []))


def cart2pol(x: Column, y: Column, z: Column | None = None, radians: bool = True) -> Column:
    """struct(theta, radius[, z])"""
    t = F.atan2(y, x)
    parts = [(t if radians else F.degrees(t)).alias("theta"), F.hypot(x, y).alias("radius")]
    return F.struct(*parts, *([z.alias("z")] if z is not None else []))


def next_pow2(n: int) -> int:
    """Least p with 2**p >= n."""
    return max(0, int(n) - 1).bit_length()


def next_pow2_column(n: Column) -> Column:
    """The same of a column of whole numbers of 1 or more: the binary digits of n - 1."""
    return F.when(n <= 1, F.lit(0)).otherwise(F.length(F.bin((n - 1).cast("long")))).cast("int")


def fisher_z(r: Column, limit: float = 0.9999) -> Column:
    return F.atanh(F.least(F.greatest(r, F.lit(-limit)), F.lit(limit)))


def phase(re: Column, im: Column) -> Column:
    """Angle of a complex number; 0 at the origin."""
    return F.when((re == 0) & (im == 0), F.lit(0.0)).otherwise(F.atan2(im, re))


def rewrap(x: Column) -> Column:
    """An angle into [-pi, pi)."""
    return F.pmod(x + F.lit(math.pi), F.lit(2 * math.pi)) - F.lit(math.pi)


def log10_floor(x: Column) -> Column:
    """log10, with what isn't positive at the smallest spacing of doubles."""
    return F.log10(F.when(x <= 0, F.lit(EPS)).otherwise(x))


def rint(x: Column) -> Column:
    """Nearest whole number, halves to the even one."""
    return F.rint(x)
