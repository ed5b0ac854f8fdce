"""Errors that callers may catch."""


class TreesError(ValueError):
    """Wrong input, configuration or model text."""
