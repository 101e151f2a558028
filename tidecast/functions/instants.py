"""Instants: every time value in the library is a UTC instant.

Literals are built with an explicit ``Z`` so they mean the same instant
whatever the session or driver time zone; rendering (``date_format``)
follows the session zone, which ``ensure_utc`` pins to UTC.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def utc_instant(v) -> Column:
    """A Column, a ``datetime`` (naive = UTC) or a ``'yyyy-MM-dd HH:mm:ss'``
    string (UTC) as a timestamp Column."""
    if isinstance(v, Column):
        return v
    if isinstance(v, datetime):
        if v.tzinfo is not None:
            v = v.astimezone(timezone.utc).replace(tzinfo=None)
        v = v.isoformat(sep=" ")
    s = str(v)
    return F.lit(s if s.endswith("Z") else s + "Z").cast("timestamp")


def ensure_utc(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
