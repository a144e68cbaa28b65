"""Settings of a task: a dataclass filled from a YAML mapping."""

from __future__ import annotations

import types
import typing
from dataclasses import fields
from pathlib import Path
from typing import TypeVar

C = TypeVar("C")


def load_yaml(path: str | Path) -> dict:
    """The mapping of a file; an empty file is an empty one."""
    import yaml

    found = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found


def _is_path(kind) -> bool:
    if typing.get_origin(kind) in (typing.Union, types.UnionType):
        return any(_is_path(k) for k in typing.get_args(kind))
    return kind is Path


def load_as(path: str | Path, cls: type[C]) -> C:
    """Unknown keys are left out; texts become paths where the field is one."""
    found, kinds = load_yaml(path), typing.get_type_hints(cls)
    known = {f.name: found[f.name] for f in fields(cls) if f.name in found}
    return cls(**{k: Path(v) if v is not None and _is_path(kinds[k]) else v for k, v in known.items()})
