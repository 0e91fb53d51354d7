"""Feature policies: what becomes of missing, invalid and outlying values.

A feature is a mapping with, all optional:

* ``missing``: ``propagate`` (default), ``as_value`` or ``as_invalid``, for
  NULL and the listed ``missing_values``; ``missing_value`` replaces;
* ``valid`` and ``invalid``: value lists; ``on_invalid``: ``return_invalid``
  (default: missing, no error), ``as_is``, ``as_missing`` or ``as_value`` with
  ``invalid_value``;
* ``intervals``: of ``lo``, ``hi`` (None: unbounded) and ``closure``, two
  letters of c(losed) and o(pen), default ``cc``; ``outlier``: ``as_is``
  (default), ``as_missing`` or ``as_extreme``, the nearest bound; an open one
  is moved by one ulp into the interval.

Replacements are final. Strings pass unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import GraphError
from .values import holds, missing


def _inside(x: Column, i: Mapping) -> Column:
    lo, hi, closure = i.get("lo"), i.get("hi"), i.get("closure", "cc")
    out = F.lit(True)
    if lo is not None:
        out = out & (x >= float(lo) if closure[0] == "c" else x > float(lo))
    if hi is not None:
        out = out & (x <= float(hi) if closure[1] == "c" else x < float(hi))
    return out


def _bounds(intervals: list[Mapping]) -> list[float]:
    out = []
    for i in intervals:
        closure = i.get("closure", "cc")
        if i.get("lo") is not None:
            out.append(float(i["lo"]) if closure[0] == "c" else math.nextafter(float(i["lo"]), math.inf))
        if i.get("hi") is not None:
            out.append(float(i["hi"]) if closure[1] == "c" else math.nextafter(float(i["hi"]), -math.inf))
    return sorted(set(out))


def _choice(name: str, feature: Mapping, default: str, known: tuple[str, ...]) -> str:
    got = feature.get(name, default)
    if got not in known:
        raise GraphError(f"{name}: {got} is none of {', '.join(known)}")
    return got


def apply_policy(x: Column, feature: Mapping) -> Column:
    """The feature's value after its policies; x is a number with NULL for missing."""
    on_missing = _choice("missing", feature, "propagate", ("propagate", "as_value", "as_invalid"))
    on_invalid = _choice("on_invalid", feature, "return_invalid", ("return_invalid", "as_is", "as_missing", "as_value"))
    on_outlier = _choice("outlier", feature, "as_is", ("as_is", "as_missing", "as_extreme"))
    replace = F.lit(float(feature["missing_value"])) if feature.get("missing_value") is not None else missing()
    invalid_value = F.lit(float(feature["invalid_value"])) if feature.get("invalid_value") is not None else missing()

    invalid = {"return_invalid": missing(), "as_is": x, "as_missing": missing(), "as_value": invalid_value}[on_invalid]
    absent = {"propagate": missing(), "as_value": replace, "as_invalid": invalid}[on_missing]

    value = x
    if intervals := list(feature.get("intervals", ())):
        inside = F.lit(False)
        for i in intervals:
            inside = inside | _inside(x, i)
        bounds = _bounds(intervals)
        nearest = F.lit(bounds[0]) if bounds else x
        for lo, hi in zip(bounds, bounds[1:]):
            nearest = F.when(x - lo > hi - x, F.lit(hi)).otherwise(nearest)
        outside = {"as_is": x, "as_missing": missing(), "as_extreme": nearest}[on_outlier]
        value = F.when(inside, x).otherwise(outside)
    bad = F.lit(False)
    if feature.get("invalid"):
        bad = bad | x.isin([float(v) for v in feature["invalid"]])
    if feature.get("valid"):
        bad = bad | ~x.isin([float(v) for v in feature["valid"]])
    gone = x.isNull()
    if feature.get("missing_values"):
        gone = gone | holds(x.isin([float(v) for v in feature["missing_values"]]))
    return F.when(gone, absent).when(bad, invalid).otherwise(value)
