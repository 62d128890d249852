"""Adaptive point-cloud grids as PySpark DataFrame operators."""

from tessgrid.params import GridParams

__all__ = ["GridParams"]
