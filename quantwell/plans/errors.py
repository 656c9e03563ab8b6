"""Typed failures of requests and plans."""

from __future__ import annotations


class QueryError(ValueError):
    """A request that can't be answered: a code, a message and where in the request it lies."""

    def __init__(self, code: str, message: str, path: str = ""):
        super().__init__(f"{code}: {message}" + (f" ({path})" if path else ""))
        self.code, self.message, self.path = code, message, path
