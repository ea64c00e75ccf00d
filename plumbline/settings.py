"""Settings from the environment, checked when they are read."""

from __future__ import annotations

import os


def integer(name: str, default: int) -> int:
    """The whole number that the variable holds; unset or blank gives the default, anything else is an error that names it."""
    raw = os.environ.get(name, "").strip()
    if not raw:
        return default
    try:
        return int(raw)
    except ValueError:
        raise ValueError(f"{name} must be a whole number, not {raw!r}") from None
