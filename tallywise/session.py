"""SparkSession factory."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "tallywise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, AQE, Arrow.

    Without ``master`` the cluster's own setting is kept. Keyword arguments are
    extra settings with ``__`` for ``.``.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
