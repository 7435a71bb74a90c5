"""Errors."""


class ConfigurationError(ValueError):
    """A specification that can't be used; the message begins with the place."""
