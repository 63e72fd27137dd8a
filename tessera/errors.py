"""Errors that statements and operators raise."""


class EngineError(ValueError):
    """Anything a statement or call gets wrong."""


class ParseError(EngineError):
    """A statement outside the grammar."""


class CatalogError(EngineError):
    """An unknown or clashing table, column or index, or a broken key."""
