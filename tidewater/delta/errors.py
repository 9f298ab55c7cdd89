"""What can go wrong with a table."""


class DeltaError(Exception):
    """Any failure of the table layer."""


class UnsupportedProtocol(DeltaError):
    """The table needs a version or feature that is not implemented."""


class CommitConflict(DeltaError):
    """Another writer committed something this transaction cannot live with."""


class SchemaMismatch(DeltaError):
    """Written rows do not fit the table."""


class ConstraintViolation(DeltaError):
    """A row for which a constraint is not TRUE."""
