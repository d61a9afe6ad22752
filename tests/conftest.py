"""One local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from textmill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, **{"spark.checkpoint.dir": "/tmp/textmill-tests"})


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
