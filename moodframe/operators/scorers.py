"""External scorers inside Python workers.

A scorer is built by an importable factory, once per worker: this module is
imported there, so its table lives as long as the worker does.
"""

from __future__ import annotations

import importlib

import numpy as np

_built: dict[str, object] = {}


def scorer_named(name: str):
    if name not in _built:
        module, _, factory = name.partition(":")
        _built[name] = getattr(importlib.import_module(module), factory)()
    return _built[name]


def _rows(scorer, texts: list[str]) -> list[list[float]]:
    return [list(map(float, row)) for row in np.asarray(scorer(texts), dtype="float64").reshape(len(texts), -1)]


def probabilities(name: str, texts: list[str]) -> list[list[float] | None]:
    """Probabilities per text; None for a text whose scoring raises."""
    if not texts:
        return []
    try:
        scorer = scorer_named(name)
        return _rows(scorer, texts)
    except Exception:  # noqa: BLE001 - a scorer may raise anything; find the texts it fails on
        pass
    out: list[list[float] | None] = []
    for text in texts:
        try:
            out.append(_rows(scorer_named(name), [text])[0])
        except Exception:  # noqa: BLE001 - this text falls back
            out.append(None)
    return out
