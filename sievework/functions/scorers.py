"""Model scores are inputs: a registry of named scorers, with an `auto` that takes the first one that loads.

A scorer is made once in each Python worker and maps a batch of asset bytes to a list of values (None where an
asset can't be read). Models themselves are not part of this package.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Scorer = Callable[[list[bytes]], list]
_registry: dict[tuple[str, str], Callable[[], Scorer]] = {}
_order: dict[str, tuple[str, ...]] = {"face": ("mediapipe", "yunet", "haar"), "unsafe": ("classifier", "clip"), "person": ("yolo",), "embedding": ("clip",)}


def register(kind: str, name: str, make: Callable[[], Scorer]) -> None:
    _registry[kind, name] = make


def names(kind: str) -> list[str]:
    return [n for k, n in _registry if k == kind]


def resolve(kind: str, name: str = "auto") -> Callable[[], Scorer] | None:
    """The maker of a scorer; None for `off`. auto tries the known order, going on when one can't load."""
    if name == "off":
        return None
    if name != "auto":
        if (kind, name) not in _registry:
            raise ValueError(f"unknown {kind} scorer {name!r}; registered: {', '.join(names(kind)) or 'none'}")
        return _registry[kind, name]
    for option in (*_order.get(kind, ()), *names(kind)):
        if (kind, option) in _registry:
            try:
                _registry[kind, option]()
            except RuntimeError:
                continue
            return _registry[kind, option]
    raise ValueError(f"no {kind} scorer is registered")


def apply_scorer(assets: DataFrame, make: Callable[[], Scorer], column: str, kind: str, batch: int = 32, fail_open: bool = False) -> DataFrame:
    """assets(..., content) with `column`, and `<column>_error` for batches that failed.

    A failed batch gives null scores (or false ones with fail_open) and its message, never a silent pass."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in assets.schema)}, `{column}` {kind}, `{column}_error` string"
    target = pa.bool_() if kind == "boolean" else pa.float64() if kind == "double" else pa.list_(pa.float32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make()
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                content = part.column(part.schema.get_field_index("content")).to_pylist()
                try:
                    values, error = scorer(content), None
                except Exception as e:  # a model's own failure is data here
                    values, error = [False if fail_open and kind == "boolean" else None] * len(content), f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, target), pa.array([error] * len(content), pa.string())], [*part.schema.names, column, f"{column}_error"])

    return assets.mapInArrow(run, schema)
