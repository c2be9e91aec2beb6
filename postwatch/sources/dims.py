"""Employer and target dimensions from YAML parameter files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from postwatch.functions.text import normalize_py
from postwatch.plans import defaults
from postwatch.schema import EMPLOYERS, names


def _read_yaml(path: str | Path) -> dict:
    import yaml  # only needed for YAML parameter files

    try:
        data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except (FileNotFoundError, yaml.YAMLError):
        return {}
    return data if isinstance(data, dict) else {}


def load_employers(spark: SparkSession, path: str | Path) -> DataFrame:
    """employers: [{name, tier, sector, careers_url, aliases, ats, link_pattern}].  ord is the
    position in the file and decides between several matches.  No or bad file: no rows."""
    entries = _read_yaml(path).get("employers") or []
    fields = names(EMPLOYERS)[1:]
    rows = [
        (i, *[e.get(f, [] if f == "aliases" else None) for f in fields])
        for i, e in enumerate(entries)
    ]
    for _, name, tier, *_ in rows:
        if not name or tier not in defaults.TIER_SCORES:
            raise ValueError(f"employer {name!r}: name missing or tier {tier!r} not known")
    return spark.createDataFrame(rows, EMPLOYERS)


def load_targets(path: str | Path, default: list[str] = defaults.TARGET_TITLES) -> list[str]:
    """titles: [...], normalized; the default list when the file gives none."""
    titles = [t for t in _read_yaml(path).get("titles") or [] if isinstance(t, str)]
    return [normalize_py(t) for t in titles or default]
