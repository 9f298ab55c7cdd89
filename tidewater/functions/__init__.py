"""Functions beyond Spark's own: arithmetic that yields null where ANSI would fail."""

from .legacy import legacy_add, legacy_avg, legacy_cast, legacy_divide, legacy_mod, legacy_multiply, legacy_subtract, legacy_sum

__all__ = ["legacy_add", "legacy_avg", "legacy_cast", "legacy_divide", "legacy_mod", "legacy_multiply", "legacy_subtract", "legacy_sum"]
