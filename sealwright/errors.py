"""Failures, each with the exit code a command line ends with."""


class AuditError(Exception):
    code = 1


class PackError(AuditError):
    """A rule pack can't be read, parsed, compiled or trusted."""

    code = 78


class LogParseError(AuditError):
    """A log line isn't a whole entry."""

    code = 1


class LogHalted(AuditError):
    """A log takes no more entries."""

    code = 1


class ChainBreak(AuditError):
    code = 2


class LineageMismatch(AuditError):
    code = 3


class SegmentError(AuditError):
    code = 4


class ManifestMismatch(AuditError):
    code = 5


class TimestampError(AuditError):
    code = 6
