"""Settings, lists and named command lines in JSON files on the driver."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from typing import Any


class Settings:
    """A JSON object with dotted lookup; values that are set keep the type of those they replace."""

    def __init__(self, values: dict | None = None):
        self.values = values or {}

    @classmethod
    def load(cls, path: str) -> Settings:
        """The file's settings; a missing or broken file has none."""
        return cls(_json(path, dict))

    def get(self, name: str, default: Any = None) -> Any:
        found: Any = self.values
        for part in name.split("."):
            if not isinstance(found, dict) or part not in found:
                return default
            found = found[part]
        return found

    def set(self, name: str, value: Any) -> None:
        """Put a value in, in the type of the one before where it can be read so; else ValueError."""
        *way, last = name.split(".")
        holder = self.values
        for part in way:
            holder = holder.setdefault(part, {})
            if not isinstance(holder, dict):
                raise ValueError(f"{name} lies below a plain value")
        holder[last] = _like(holder.get(last), value)


def _like(old: Any, value: Any) -> Any:
    if isinstance(old, bool) and isinstance(value, str):
        if value.lower() not in ("true", "false", "1", "0", "yes", "no"):
            raise ValueError(f"{value!r} is no truth value")
        return value.lower() in ("true", "1", "yes")
    if old is None or isinstance(value, type(old)):
        return value
    return type(old)(value)


def _json(path: str, kind: type) -> Any:
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return kind()
    return found if isinstance(found, kind) else kind()


def _save(path: str, value: Any) -> None:
    """Write beside the file and put it in its place."""
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=1)
    os.replace(part, path)


class NameList:
    """A JSON list of strings, such as hidden codes or ignored messages."""

    def __init__(self, path: str):
        self.path = path

    def names(self) -> list[str]:
        return sorted({str(x) for x in _json(self.path, list)})

    def add(self, names: Iterable[str]) -> None:
        _save(self.path, sorted({*self.names(), *names}))

    def reset(self) -> None:
        _save(self.path, [])


class Workflows:
    """Named command lines, stored by lower-case name."""

    def __init__(self, path: str):
        self.path = path

    def all(self) -> dict[str, str]:
        return {str(k): str(v) for k, v in _json(self.path, dict).items()}

    def save(self, name: str, line: str) -> None:
        found = self.all() | {name: " ".join(line.split())}
        _save(self.path, dict(sorted(found.items(), key=lambda x: x[0].lower())))

    def remove(self, name: str) -> bool:
        found = self.all()
        if found.pop(name, None) is None:
            return False
        _save(self.path, found)
        return True
