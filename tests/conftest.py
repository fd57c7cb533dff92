import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from factorframe import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "factorframe-tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def frame(spark, schema, rows):
    """Rows with ISO text for date columns, as a DataFrame."""
    import datetime

    kinds = [part.strip().split()[-1] for part in schema.split(",")]
    typed = [
        tuple(datetime.date.fromisoformat(v) if k == "date" and isinstance(v, str) else v for v, k in zip(row, kinds)) for row in rows
    ]
    return spark.createDataFrame(typed, schema)


def days(n, start="2020-01-01"):
    import datetime

    first = datetime.date.fromisoformat(start)
    return [(first + datetime.timedelta(days=i)).isoformat() for i in range(n)]
