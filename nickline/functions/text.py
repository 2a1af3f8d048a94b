"""Columns that read the commands' short notations; null where a text isn't one."""

from __future__ import annotations

from pyspark.sql import functions as F

_NUMBER = r"\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*"


def _parts(text, pattern: str, names: tuple, kinds: tuple):
    got = [F.trim(F.regexp_extract(text, f"^{pattern}$", i + 1)).cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds))]
    return F.when(F.regexp_like(text, F.lit(f"^{pattern}$")), F.struct(*got))


def landmark(text):
    """`NAME=x,y` with x and y from 0 to 1: (name, x, y)."""
    found = _parts(text, f"([^=]*)={_NUMBER},{_NUMBER}", ("name", "x", "y"), ("string", "double", "double"))
    return F.when(found["x"].between(0, 1) & found["y"].between(0, 1), found)


def player(text):
    """`SLOT=x,y@SECONDS`, slots from 1: (slot from 0, x, y, time_s)."""
    found = _parts(text, rf"\s*([+-]?[0-9]+)\s*={_NUMBER},{_NUMBER}@{_NUMBER}", ("slot", "x", "y", "time_s"), ("int", "double", "double", "double"))
    return F.when(found.isNotNull(), found.withField("slot", found["slot"] - 1))


def place(text):
    """`x,y@SECONDS`: (x, y, time_s)."""
    return _parts(text, f"{_NUMBER},{_NUMBER}@{_NUMBER}", ("x", "y", "time_s"), ("double",) * 3)


def box(text):
    """`x0,y0,x1,y1`."""
    return _parts(text, ",".join([_NUMBER] * 4), ("x0", "y0", "x1", "y1"), ("double",) * 4)
