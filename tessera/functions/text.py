"""Text functions without a built-in equal, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import functools
import html
import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F, types as T

_HIDDEN = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)


@functools.lru_cache(1 << 16)
def similarity(left: str | None, right: str | None) -> float:
    """1 for equal, 0.9 for contained, else the ratio of matching blocks; 0 where one is empty."""
    if not left or not right:
        return 0.0
    if left == right:
        return 1.0
    return 0.9 if left in right or right in left else SequenceMatcher(None, left, right).ratio()


def visible(raw: str | None) -> str:
    """Text of HTML without scripts and styles, entities decoded, white space collapsed."""
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", _HIDDEN.sub(" ", raw or ""))).split())


def natural(value: str | None) -> str:
    """A key that sorts digits by number."""
    return re.sub(r"\d+", lambda m: m[0].lstrip("0").rjust(20, "0"), (value or "").lower())


@F.pandas_udf(T.DoubleType())
def name_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([similarity(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def visible_text(raw: pd.Series) -> pd.Series:
    return raw.map(visible)


@F.pandas_udf(T.StringType())
def natural_key(value: pd.Series) -> pd.Series:
    return value.map(natural)
