"""Errors raised before or while an operation is planned."""


class SieveError(Exception):
    """Base class."""


class UnknownColumnError(SieveError):
    """A named column is not in the table."""


class NotNumericError(SieveError):
    """A numeric column was required."""


class FilterError(SieveError):
    """A filter names an unsupported operator or an unusable value."""


class AggregationError(SieveError):
    """An aggregation is unsupported or lacks its column."""


class UnknownMethodError(SieveError):
    """No outlier method of that name."""


class UnknownOperationError(SieveError):
    """No cleaning operation of that key."""


class OperationError(SieveError, ValueError):
    """A cleaning operation cannot run on this data or with these parameters."""


class SourceError(SieveError):
    """A source cannot be resolved or read."""


class VersionError(SieveError):
    """A dataset version does not exist, or there is none to undo."""


class ReadOnlyError(SieveError):
    """The SQL text is not a single read-only statement."""


class ExportError(SieveError):
    """No export format of that name."""
