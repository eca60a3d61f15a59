"""The positional text index: one row per token of content and path."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.functions.text import tokens


def build_postings(files: DataFrame, fold_accents: bool = True) -> DataFrame:
    """``(file_id, project, field, term, pos)``, positions from 0 within each field.

    A narrow job: no shuffle until somebody groups or writes it.
    """
    fields = F.array(
        *[
            F.struct(F.lit(name).alias("field"), tokens(F.col(name), fold_accents).alias("terms"))
            for name in ("content", "path")
        ]
    )
    return files.select("file_id", "project", F.inline(fields)).select(
        "file_id", "project", "field", F.posexplode("terms").alias("pos", "term")
    ).select("file_id", "project", "field", "term", "pos")
