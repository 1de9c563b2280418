"""Detector plug-ins: named functions from observation tables to layer results."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

Detector = Callable[[dict[str, DataFrame]], DataFrame]
COLUMNS = ["case_id", "layer", "name", "category", "weight", "score", "confidence", "status"]
_DETECTORS: dict[str, Detector] = {}


def register(layer: str, detector: Detector) -> None:
    """Add a detector; its results take part in fusion like any other layer."""
    if layer in _DETECTORS:
        raise ValueError(f"layer {layer} is registered already")
    _DETECTORS[layer] = detector


def unregister(layer: str) -> None:
    _DETECTORS.pop(layer, None)


def run(tables: dict[str, DataFrame]) -> DataFrame:
    """Layer results of all registered detectors."""
    results = [detector(tables).select(*COLUMNS) for detector in _DETECTORS.values()]
    if not results:
        raise ValueError("no detector registered")
    return reduce(DataFrame.unionByName, results)
