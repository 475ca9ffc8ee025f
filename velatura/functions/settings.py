"""Settings of a job: an option beats the environment, which beats the settings file, which beats the default."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from velatura.operators.dataset import parse_flag, parse_tags


@dataclass(frozen=True)
class Setting:
    name: str
    default: Any
    variable: str | None = None
    parse: Callable[[Any], Any] = lambda value: value


EXCLUDED = Setting("excluded_tags", [], "VELATURA_EXCLUDED_TAGS", parse_tags)
REVERSIBLE = Setting("mapping_enabled", True, "VELATURA_MAPPING", lambda value: parse_flag(value, True))
SETTINGS = (EXCLUDED, REVERSIBLE)
#: The settings file, and the name it had before.
FILES = ("settings.json", "preferences.json")


def read_file(folder: str) -> dict[str, Any]:
    """The first of FILES that holds a JSON object; without one, nothing. A damaged file counts as missing."""
    for name in FILES:
        try:
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                found = json.load(f)
        except (OSError, ValueError):
            continue
        if isinstance(found, dict):
            return found
    return {}


def resolve(options: Mapping[str, Any], folder: str, environment: Mapping[str, str] | None = None, settings: tuple[Setting, ...] = SETTINGS) -> dict[str, Any]:
    """The value of every setting. An option that is None wasn't given; a variable that is set counts even if it is empty."""
    environment, stored = os.environ if environment is None else environment, read_file(folder)
    out = {}
    for s in settings:
        given = options.get(s.name)
        if given is None and s.variable in environment:
            given = environment[s.variable]
        if given is None:
            given = stored.get(s.name)
        out[s.name] = s.default if given is None else s.parse(given)
    return out


def save(folder: str, settings: tuple[Setting, ...] = SETTINGS, **values: Any) -> dict[str, Any]:
    """Merge values into the settings file; None leaves what is there, and keys of others stay. The file is replaced in one step."""
    merged = read_file(folder)
    for s in settings:
        if values.get(s.name) is not None:
            merged[s.name] = s.parse(values[s.name])
        merged.setdefault(s.name, s.default)
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, FILES[0])
    with open(f"{path}.next", "w", encoding="utf-8") as f:
        json.dump(merged, f, indent=2, ensure_ascii=False)
    os.replace(f"{path}.next", path)
    return merged
