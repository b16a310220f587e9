"""SparkSession factory used by the bench, the tests and the examples."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "plumbline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and Arrow on; an active session is reused."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
