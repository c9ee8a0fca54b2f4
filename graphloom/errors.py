"""Errors of specification, data and mutation; `code` is stable for programs."""

from __future__ import annotations


class GraphError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(f"[{code}] {message}")
        self.code = code


class NotFound(GraphError):
    def __init__(self, message: str):
        super().__init__("NotFound", message)
