import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lineloom.operators.corpus import index_files  # noqa: E402
from lineloom.schemas import CORPUS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        # Tiny inputs: compiling each plan would take far longer than running it.
        .config("spark.sql.codegen.wholeStage", "false")
        .config("spark.sql.codegen.factoryMode", "NO_CODEGEN")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def corpus(spark):
    """Builds a corpus from ``(project, path, content[, time])`` rows."""
    from datetime import datetime

    def build(*rows):
        full = [
            (p, path, text, more[0] if more else datetime(2024, 1, 1), len(text.encode()))
            for p, path, text, *more in rows
        ]
        return spark.createDataFrame(full, CORPUS)

    return build


@pytest.fixture(scope="session")
def files(corpus):
    return lambda *rows: index_files(corpus(*rows))
