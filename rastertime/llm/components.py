"""Connected components, as the engine's patches have them too."""

from rastertime.operators.graph import components

__all__ = ["components"]
