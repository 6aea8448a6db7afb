import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from symgraph.core import build_session

    at = tmp_path_factory.mktemp("spark")
    s = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(at / "shared"),
            "spark.sql.warehouse.dir": str(at / "warehouse"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows(df, *cols):
    """The rows of a frame as a sorted list of tuples."""
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=repr)
