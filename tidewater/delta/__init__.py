"""Tables in the public Delta Lake log format: Parquet files and a JSON commit log, over Spark's own Parquet scans."""

from .table import DeltaTable
from .errors import CommitConflict, ConstraintViolation, DeltaError, SchemaMismatch, UnsupportedProtocol

__all__ = ["CommitConflict", "ConstraintViolation", "DeltaError", "DeltaTable", "SchemaMismatch", "UnsupportedProtocol"]
