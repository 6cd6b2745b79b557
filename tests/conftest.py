from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from resamplia.session import local_session

    return local_session(4, memory="6g")


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
