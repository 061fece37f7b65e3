"""JSON values as the text that Python's str() gives of them, with their members in the order of the record."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType


def _unique(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("repeated key")
    return out


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def _said(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        value = json.loads(text, object_pairs_hook=_unique, parse_constant=_no_constant)
        return None if value is None else str(value)
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def _python_text(texts: pd.Series) -> pd.Series:
    return texts.map(_said, na_action="ignore").astype(object)


def python_text(text: Column) -> Column:
    """text: one JSON value. A string is itself; numbers, booleans, lists and objects are as Python writes them. NULL for a
    JSON null and for what is not strict JSON. Strings are read in the JVM, so only other values go to Python."""
    string = F.coalesce(F.ltrim(text).startswith('"'), F.lit(False))
    own = F.try_variant_get(F.try_parse_json(F.when(string, text)), "$", "string")
    return F.when(string, own).otherwise(_python_text(F.when(~string, text)))
