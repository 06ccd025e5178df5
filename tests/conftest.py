from __future__ import annotations

import sys
from pathlib import Path

import pytest

for folder in (Path(__file__).resolve().parent, Path(__file__).resolve().parent.parent):
    sys.path.insert(0, str(folder))

from demandry.session import build  # noqa: E402
from helpers import SF  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build(
        "tests", "local[*]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
