"""Profiles as JSON: merged from several sources, the earlier ones first."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EMPTY = (None, "", [], {})


def distinct_values(values: list) -> list:
    """The values in order, each once by its canonical JSON."""
    first: dict[str, object] = {}
    for v in values:
        first.setdefault(json.dumps(v, ensure_ascii=False, sort_keys=True), v)
    return list(first.values())


def merged(left: dict, right: dict) -> dict:
    """Two profiles as one: objects merge field by field, lists and differing values become lists of distinct values, empty values give way."""
    out = dict(left)
    listed = lambda v: [] if v in _EMPTY else v if isinstance(v, list) else [v]
    for key, new in right.items():
        old = out.get(key)
        if new in _EMPTY:
            continue
        if isinstance(old, dict) and isinstance(new, dict):
            out[key] = merged(old, new)
        elif old in _EMPTY and not isinstance(new, list):
            out[key] = new
        elif isinstance(old, list) or isinstance(new, list) or old != new:
            out[key] = distinct_values([*listed(old), *listed(new)])
    return out


@F.pandas_udf(T.StringType())
def merge_profiles(profiles: pd.Series) -> pd.Series:
    """The merged object of a list of JSON texts, in order; texts that are no objects are skipped."""

    def one(texts) -> str:
        out: dict = {}
        for t in texts if texts is not None else ():
            try:
                value = json.loads(t) if t else None
            except json.JSONDecodeError:
                continue
            if isinstance(value, dict):
                out = merged(out, value)
        return json.dumps(out, ensure_ascii=False)

    return pd.Series([one(x) for x in profiles])


@F.pandas_udf(T.StringType())
def merge_lists(lists: pd.Series) -> pd.Series:
    """The distinct values of a list of JSON texts as a JSON list: lists give their members, empty values go."""

    def one(texts) -> str:
        out: list = []
        for t in texts if texts is not None else ():
            value = json.loads(t) if t else None
            out += [v for v in (value if isinstance(value, list) else [value]) if v not in _EMPTY]
        return json.dumps(distinct_values(out), ensure_ascii=False)

    return pd.Series([one(x) for x in lists])
