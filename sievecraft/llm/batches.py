"""Size of the Arrow batches in which whole texts reach Python."""

from __future__ import annotations

from pyspark.sql import DataFrame

SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(df: DataFrame, rows: int = 2048) -> DataFrame:
    """``df`` itself; its session's Arrow batches are cut to ``rows`` rows where they were longer.

    A batch is held several times over (in the JVM, as Arrow and as Python objects), and rows here are whole texts.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(SETTING, "10000")) <= rows:
        conf.set(SETTING, str(rows))
    return df
