"""Connected components: the operator of the road networks, which needs nothing of the corpus operators."""

from roadweave.operators.components import connected_components

__all__ = ["connected_components"]
