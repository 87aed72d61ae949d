"""Rules on column names."""

from __future__ import annotations


def clean_name(name: str) -> str:
    """Header text without double quotes and outer blanks, in lower case."""
    return name.replace('"', "").strip().lower()


def quoted(name: str) -> str:
    """The name as one identifier, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"
