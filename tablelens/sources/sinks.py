"""Sinks: profile tables written per dataset with a timestamped name, one by one or all together."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame

from tablelens.session import scratch_path


def write_profile(summary: DataFrame, dataset: str, base: str | None = None,
                  fmt: str = "parquet", when: _dt.datetime | None = None) -> str:
    """Write a profile table to ``<base>/<dataset>_<yyyymmdd_HHMMSS>`` and
    return the path.  ``base`` defaults to a folder under the session's
    shared checkpoint directory."""
    stamp = (when or _dt.datetime.now(_dt.timezone.utc)).strftime("%Y%m%d_%H%M%S")
    root = base or scratch_path(summary.sparkSession, "profiles")
    path = f"{root.rstrip('/')}/{dataset}_{stamp}"
    summary.write.mode("overwrite").format(fmt).save(path)
    return path


#: Tables of a whole profile.
PROFILE_TABLES = ("schema", "summary", "describe", "top_values", "missing", "numeric", "strings", "alerts")


def write_profiles(df: DataFrame, dataset: str, base: str | None = None, fmt: str = "parquet", when: _dt.datetime | None = None) -> str:
    """Write the whole profile of ``df``, a table per part under ``<base>/<dataset>_<yyyymmdd_HHMMSS>``: schema
    and shape, column summary, describe, top values, missing values, numeric and string profiles, quality alerts.
    Returns that path; a rerun with the same ``when`` replaces the tables."""
    from tablelens.operators import profile

    stamp = (when or _dt.datetime.now(_dt.timezone.utc)).strftime("%Y%m%d_%H%M%S")
    root = f"{(base or scratch_path(df.sparkSession, 'profiles')).rstrip('/')}/{dataset}_{stamp}"
    parts = (profile.schema_profile, profile.column_summary, profile.describe, profile.top_values, profile.missing_report,
             profile.profile_numeric, profile.profile_string, profile.quality_alerts)
    for name, part in zip(PROFILE_TABLES, parts, strict=True):
        part(df).write.mode("overwrite").format(fmt).save(f"{root}/{name}")
    return root


def read_profiles(spark, path: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """The tables that ``write_profiles`` wrote, by name."""
    return {name: spark.read.format(fmt).load(f"{path}/{name}") for name in PROFILE_TABLES}
