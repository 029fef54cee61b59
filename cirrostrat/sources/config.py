"""Configuration files: JSON, or YAML where that library is there."""

from __future__ import annotations

import json


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML files need the yaml library; JSON files with the same keys need none") from e
    return yaml.safe_load(text)
