import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from parley.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g",
                               "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    return s


def rows(df, *order):
    """Rows as tuples in a fixed order."""
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
