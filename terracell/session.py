"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ANSI errors stay on; calendar logic runs on TIMESTAMP_NTZ, so the zone only matters for stamps.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(name: str = "terracell", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    for k, v in (DEFAULTS | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
