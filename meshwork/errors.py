"""Exceptions of the engine."""


class MeshworkError(Exception):
    """Base of all errors raised here."""


class ValidationError(MeshworkError, ValueError):
    """Input that no operator accepts."""


class GraphError(MeshworkError):
    """A graph on which an operator is undefined."""


class ConfigurationError(MeshworkError):
    """Settings that contradict each other."""


class BackendError(MeshworkError):
    """A run that Spark could not finish."""
