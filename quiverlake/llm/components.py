"""Connected components, which the vector queries share."""

from ..operators.components import connected_components  # noqa: F401
