from __future__ import annotations

import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from relata.session import build_session  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]",
        "tests",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="relata-tests-"),
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not Path(DATA).is_dir():
        pytest.skip(f"no tables in {DATA}")
    return DATA


def rows(df):
    """Rows as a sorted list of tuples, nulls first."""

    def key(row):
        return [(value is not None, str(type(value)), value) for value in row]

    return sorted((tuple(r) for r in df.collect()), key=key)
