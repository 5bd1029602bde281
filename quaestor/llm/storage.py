"""Tables written between jobs, in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quaestor.sources import shared
from quaestor.sources.shared import discard, release, shared_dir

__all__ = ["discard", "release", "shared_dir", "written"]


def written(df: DataFrame, release: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, has a known size.

    release: also lets go of shuffle files of tables that aren't needed any more (the caller may hold this one's for a moment).
    """
    table = shared.written(df, shared_dir(df.sparkSession))
    if release:
        del df
        shared.release(table.sparkSession)
    return table
