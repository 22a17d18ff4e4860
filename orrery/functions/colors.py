"""Colours as hex strings."""

from __future__ import annotations

import colorsys


def to_rgb(color: str) -> tuple[float, float, float]:
    raw = color.lstrip("#")
    return tuple(int(raw[i : i + 2], 16) / 255 for i in (0, 2, 4))  # type: ignore[return-value]


def to_hex(rgb: tuple[float, float, float]) -> str:
    return "#" + "".join(f"{round(255 * x):02x}" for x in rgb)


def mixed(colors: list[str]) -> str:
    parts = [to_rgb(c) for c in colors]
    return to_hex(tuple(sum(p[i] for p in parts) / len(parts) for i in range(3)))  # type: ignore[arg-type]


def distinct(n: int) -> list[str]:
    return [to_hex(colorsys.hsv_to_rgb(i / max(1, n), 0.8, 0.9)) for i in range(n)]
