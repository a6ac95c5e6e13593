"""Refusals: a program or a graph that is not accepted, known by a code ``area/kind``."""

from __future__ import annotations


class Refusal(Exception):
    """Raised with a stable code; ``line`` is the line of the program it is about, if any, ``related`` what lies behind it."""

    def __init__(self, code: str, message: str, line: int | None = None, related: tuple[Refusal, ...] = ()):
        super().__init__(f"{code}: {message}" + (f" (line {line})" if line else ""))
        self.code = code
        self.message = message
        self.line = line
        self.related = related
