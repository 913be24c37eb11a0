"""Errors with their SQLSTATE."""


class EngineError(Exception):
    sqlstate = "XX000"


class ParseError(EngineError):
    sqlstate = "42601"


class CatalogError(EngineError):
    sqlstate = "42P01"


class Unsupported(EngineError):
    sqlstate = "0A000"


class TypeMismatch(EngineError):
    sqlstate = "42804"


class Internal(EngineError):
    """Names that aren't known or aren't unique."""
