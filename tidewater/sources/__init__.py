"""Reading and writing tables by format, options and mode."""

from .reader import read, time_travel
from .writer import MEMORY, write

__all__ = ["MEMORY", "read", "time_travel", "write"]
