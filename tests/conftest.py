import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from cairn.session import local_session

    return local_session(4, "4g", spark__sql__shuffle__partitions="4")


@pytest.fixture(scope="session")
def small():
    if not (DATA / "sf0.001").exists():
        pytest.skip("no test tables")
    return str(DATA / "sf0.001")
