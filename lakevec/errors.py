"""Errors of the library."""


class LakevecError(Exception):
    """Base of all errors."""


class Validation(LakevecError, ValueError):
    """An argument is malformed."""


class NotFound(LakevecError, LookupError):
    """A bucket, index or table does not exist."""


class Conflict(LakevecError):
    """Something of that name exists, or is not empty."""


class Unsupported(LakevecError, NotImplementedError):
    """A known operation that is not offered."""
