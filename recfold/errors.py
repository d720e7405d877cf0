"""Errors raised when a record type is declared or a value is encoded."""


class RecordError(TypeError):
    """A record type that can't become columns; ``rule`` names the broken rule."""

    def __init__(self, rule: str, message: str):
        super().__init__(message)
        self.rule = rule


class EncodeError(ValueError):
    """A value that its declared type can't hold."""
