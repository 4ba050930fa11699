"""Errors of the engine. Each is also the Python error that callers expect for its kind."""

from __future__ import annotations


class EngineError(Exception):
    code = "error"


class InvalidInput(EngineError, ValueError):
    code = "invalid_input"


class NumericalIssue(EngineError, FloatingPointError):
    code = "numerical_issue"


class NotSupported(EngineError, NotImplementedError):
    code = "not_supported"


class ResourceLimit(EngineError, RuntimeError):
    code = "resource_limit"


class InputOutput(EngineError, OSError):
    code = "io_error"


class BadJson(EngineError, ValueError):
    code = "json_error"


class Cancelled(EngineError, RuntimeError):
    code = "cancelled"

    def __init__(self, message: str = "cancelled"):
        super().__init__(message)
