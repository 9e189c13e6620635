"""A JSON configuration file with placeholders, and dictionaries laid over each other.

Placeholders are ``$NAME`` and ``${NAME}``: the file's own names (``MODEL_ROOT``, ``APP_DIR``) first, then the environment; an
unknown one stays.  A leading ``~`` is the home folder.  Values that look like paths are relative to the file's folder.
"""

from __future__ import annotations

import json
import os
import re
from collections import ChainMap
from collections.abc import Callable, Mapping
from pathlib import Path
from typing import Any

_PLACEHOLDER = re.compile(r"\$(?:\{(\w+)\}|(\w+))")
#: What makes a value a path.
_PATH = re.compile(r"\A\.|\\|\.(?:gguf|db)\Z", re.I)


class ConfigError(ValueError):
    """A configuration file that cannot be used, with the reason."""


def overlay(*layers: Mapping[str, Any]) -> dict[str, Any]:
    """The layers over each other, the last on top: where all values of a key are dictionaries they are joined, else the top one counts."""
    out: dict[str, Any] = {}
    for key in dict.fromkeys(k for layer in layers for k in layer):
        values = [layer[key] for layer in layers if key in layer]
        under = next((i for i in range(len(values) - 1, -1, -1) if not isinstance(values[i], Mapping)), -1)
        out[key] = overlay(*values[under + 1 :]) if under < len(values) - 1 else values[-1]
    return out


def each_text(value: Any, change: Callable[[str], str]) -> Any:
    """A JSON value with every text changed, keys excepted."""
    kinds: dict[type, Callable] = {str: change, dict: lambda d: {k: each_text(v, change) for k, v in d.items()}, list: lambda items: [each_text(v, change) for v in items]}
    return kinds.get(type(value), lambda v: v)(value)


class Resolver:
    """Fills placeholders and finds paths, from the folder of a file."""

    def __init__(self, folder: Path, **names: str) -> None:
        self.folder, self.names = folder, ChainMap(names, os.environ)

    def fill(self, text: str) -> str:
        filled = _PLACEHOLDER.sub(lambda m: self.names.get(m[1] or m[2], m[0]), text)
        return str(Path(filled).expanduser()) if filled.startswith("~") else filled

    def absolute(self, text: str) -> str:
        return os.path.realpath(os.path.join(self.folder, self.fill(text)))

    def __call__(self, text: str) -> str:
        filled = self.fill(text)
        return self.absolute(filled) if _PATH.search(filled) and not os.path.isabs(filled) else filled


def load(path: str | Path) -> dict[str, Any]:
    """The configuration; its ``paths.model_root`` (./models where it is missing) is the placeholder MODEL_ROOT in all other values."""
    file = Path(path).expanduser().resolve()
    try:
        raw = json.loads(file.read_bytes())
    except (OSError, ValueError) as e:
        raise ConfigError(f"cannot read {file}: {e}") from e
    if not isinstance(raw, dict):
        raise ConfigError("the root must be an object")
    models = Resolver(file.parent).absolute(str(overlay({"paths": {"model_root": "./models"}}, raw)["paths"]["model_root"]))
    filled = each_text(raw, Resolver(file.parent, MODEL_ROOT=models, APP_DIR=str(file.parent)))
    return overlay(filled, {"paths": {"model_root": models}})
