"""Column names of an operator's own, beside whatever columns its input has."""

from __future__ import annotations


def fresh(taken: list[str], *names: str) -> list[str]:
    """One column name for each of ``names`` that no column of ``taken`` has, in whatever case."""
    held, front = {c.lower() for c in taken}, "__sc"
    while any(f"{front}_{n}".lower() in held for n in names):
        front += "_"
    return [f"{front}_{n}" for n in names]
