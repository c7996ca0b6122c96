from __future__ import annotations

import pytest

from tessera.plans.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=4, partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
