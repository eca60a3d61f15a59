"""Cutting lineage in the folder that all executors share."""

from pyspark.sql import DataFrame

from lineloom.operators.saved import shared_folder


def saved(frame: DataFrame) -> DataFrame:
    """The rows of a frame, computed once and stored reliably, so that a lost executor costs one read."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()
