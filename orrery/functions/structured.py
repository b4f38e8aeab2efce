"""Nested JSON: flattening to paths and depth, for values of any schema.

The shape of each value is its own, so this is a per-batch Arrow function; with a
known schema, use ``from_json`` and struct fields instead.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _leaves(value: Any, path: str = "") -> Iterator[tuple[str, Any]]:
    """Paths such as ``a.b[0]`` with their scalars; empty objects and arrays have none."""
    if isinstance(value, dict):
        for key, inner in value.items():
            yield from _leaves(inner, f"{path}.{key}" if path else str(key))
    elif isinstance(value, list):
        for i, inner in enumerate(value):
            yield from _leaves(inner, f"{path}[{i}]")
    else:
        yield path, value


def _levels(value: Any) -> int:
    inner = list(value.values()) if isinstance(value, dict) else value if isinstance(value, list) else []
    return 1 + max((_levels(x) for x in inner), default=0)


def _load(text: str | None) -> Any:
    try:
        return None if text is None else json.loads(text)
    except ValueError:
        return None


#: Types are objects, not text, as no session runs when this module is read.
PAIRS = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())]))


@F.pandas_udf(PAIRS)
def flatten_json(texts: pd.Series) -> pd.Series:
    """(path, value as text) of each scalar, in document order; invalid JSON gives null."""

    def one(text: str | None) -> list[dict[str, str]] | None:
        value = _load(text)
        return None if value is None else [{"path": k, "value": str(v)} for k, v in _leaves(value)]

    return texts.map(one)


@F.pandas_udf(T.IntegerType())
def json_depth(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> int | None:
        value = _load(text)
        return None if value is None else _levels(value)

    return texts.map(one).astype("Int32")
