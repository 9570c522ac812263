"""Connected components, see quarry.operators.components."""

from quarry.operators.components import connected_components

__all__ = ["connected_components"]
