"""Errors raised for bad requests and refused inputs."""


class QuaysideError(Exception):
    """Base class of every error raised by this package."""


class InputError(QuaysideError):
    """The files, headers or rows given for an import cannot be accepted."""


class RequestError(QuaysideError):
    """An argument of a query (limit, cursor, literal, date range) is not valid."""


class StateError(QuaysideError):
    """A replace session is not in a state that allows the requested step."""
