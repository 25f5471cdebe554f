"""Result sink: summary and detail tables with their provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions.cells import format_ts


def write_results(summary: DataFrame, detail: DataFrame, path: str, command: str, notes: str = "", fmt: str = "parquet") -> None:
    """Write ``path/summary`` and ``path/detail``; both carry command, timestamp and notes."""
    for name, df in (("summary", summary), ("detail", detail)):
        df.withColumns({
            "command": F.lit(command),
            "timestamp": format_ts(F.current_timestamp()),
            "notes": F.lit(notes),
        }).write.mode("overwrite").format(fmt).save(f"{path}/{name}")
