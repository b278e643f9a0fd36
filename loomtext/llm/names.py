"""Free column names, as the rest of the library picks them."""

from loomtext.names import unused

__all__ = ["unused"]
