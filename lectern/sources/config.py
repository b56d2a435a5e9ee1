"""SRC8, T20: settings from a JSON file, and paths relative to its folder."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Config:
    root: Path
    values: dict = field(default_factory=dict)

    def path(self, value: str) -> str:
        """A URI or an absolute path as it is; else below the root."""
        return value if "://" in value else str((self.root / value).resolve())

    def stage_root(self, stage: str, partition: str) -> str:
        """Where documents of a stage and a partition are."""
        return f"{self.path(self.values.get('data_root', 'data'))}/{stage}/{partition}"


def load_config(path: str | Path, root: str | Path | None = None) -> Config:
    """root: the project's folder for a bundled file; without it, the file's own."""
    where = Path(path).resolve()
    values = json.loads(where.read_text(encoding="utf-8"))
    if not isinstance(values, dict):
        raise ValueError(f"the settings must be an object: {where}")
    return Config(Path(root).resolve() if root else where.parent, values)
