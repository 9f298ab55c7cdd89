"""Relational helpers where Spark's own method differs from what is asked for."""

from .dataset import from_objects, objects, schema_of
from .relational import exchange, join, strict_union, typed

__all__ = ["exchange", "from_objects", "join", "objects", "schema_of", "strict_union", "typed"]
