"""Connected components, those of the raster engine."""

from ..operators.components import components

__all__ = ["components"]
