"""Price catalogs. The engine brings no prices; a catalog is data of the user."""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from tallywise.operators.pricing import PRICES

_FIELDS = ("inputCostPerToken", "outputCostPerToken", "cacheCreationCostPerToken", "cacheReadCostPerToken")
_LIVE = ("input_cost_per_token", "output_cost_per_token", "cache_creation_input_token_cost", "cache_read_input_token_cost")
SCHEMA = "model string, " + ", ".join(f"{p} double" for p in PRICES)


def _frame(spark: SparkSession, models: Mapping[str, Sequence[float]]) -> DataFrame:
    return spark.createDataFrame([(k, *map(float, v)) for k, v in sorted(models.items())], SCHEMA)


def load_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(catalog, when it was fetched or '') from a JSON file ``{fetchedAt, models: {name: prices}}``; missing prices are 0."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    return _frame(spark, {k: [v.get(x) or 0 for x in _FIELDS] for k, v in (d.get("models") or {}).items()}), d.get("fetchedAt") or ""


def normalise_live(entries: Mapping[str, object], providers: Sequence[str]) -> dict[str, list[float]]:
    """Prices by plain model name from a list that names models ``provider/model``.

    Keeps the given providers (prefixes that end in ``/`` or ``.``), strips them and a
    version suffix, puts ``-`` for ``@``, asks for a numeric input price, and takes the
    first entry of a name in the order of the full names.
    """
    out: dict[str, list[float]] = {}
    for full in sorted(entries):
        x = entries[full]
        p = next((p for p in providers if full.startswith(p)), None)
        if p is None or not isinstance(x, Mapping) or not isinstance(x.get(_LIVE[0]), int | float):
            continue
        name = re.sub(r"-v\d+(?::\d+)?$", "", full[len(p) :]).replace("@", "-")
        out.setdefault(name, [v if isinstance(v := x.get(f), int | float) else 0.0 for f in _LIVE])
    return out


def fetch_catalog(spark: SparkSession, url: str, providers: Sequence[str], timeout: float = 30) -> DataFrame:
    """A catalog over HTTP (driver only)."""
    with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
        return _frame(spark, normalise_live(json.load(r), providers))
