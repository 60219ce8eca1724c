from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from taxoflow.session import local_session

    session = local_session("4", 4, "4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """rows(df): its rows as tuples in order, nulls first."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=lambda t: [(x is not None, "" if x is None else x) for x in t])
