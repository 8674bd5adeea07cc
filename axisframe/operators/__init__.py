"""Operators on cubes; those in METHODS are also methods of a cube."""

from . import bins, clusters, combine, reduce, reshape, windows

METHODS = {**reduce.METHODS, **reshape.METHODS, **bins.METHODS, **combine.METHODS, **windows.METHODS, **clusters.METHODS}
