"""Settings of models and runs, on the driver: JSON of a recogniser, its alphabet, a chosen embedding, and paths beside a settings file."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Recogniser:
    """What a recogniser needs to be run: the height of its lines, how far they reach, its weights, its symbols and its embedding."""

    line_px_height: int
    line_vertical_scale: float
    checkpoint: str
    characters: tuple[str, ...]
    net_name: str | None = None
    embed_num: int | None = None
    embed_id: int | str | None = None
    max_line_width: int | None = None
    rest: dict = field(default_factory=dict)


def compose_path(file: str, reference: str) -> str:
    """A path relative to the folder of a settings file; an absolute one as it is, and any as it is without a reference."""
    return file if not reference or os.path.isabs(file) else os.path.join(reference, file)


def characters(path: str) -> list[str]:
    """The symbols of a recogniser's settings."""
    return list(json.loads(Path(path).read_text(encoding="utf-8"))["characters"])


def recogniser(path: str) -> Recogniser:
    """A recogniser's settings; its checkpoint is beside them."""
    raw = json.loads(Path(path).read_text(encoding="utf-8"))
    known = {k: raw.get(k) for k in ("net_name", "embed_num", "embed_id", "max_line_width")}
    rest = {k: v for k, v in raw.items() if k not in {*known, "line_px_height", "line_vertical_scale", "checkpoint", "characters"}}
    return Recogniser(int(raw["line_px_height"]), float(raw["line_vertical_scale"]), compose_path(raw["checkpoint"], os.path.dirname(path)), tuple(raw["characters"]), rest=rest, **known)


def choose_embedding(path: str, embed_id: int | str, out: str | None = None) -> None:
    """Writes the settings again with the embedding chosen, to the same file or another."""
    raw = json.loads(Path(path).read_text(encoding="utf-8")) | {"embed_id": embed_id}
    Path(out or path).write_text(json.dumps(raw, ensure_ascii=False, indent=2), encoding="utf-8")
