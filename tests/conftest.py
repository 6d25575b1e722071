import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from driftloom.session import local_session

# Columns in module scope and parameter lists need a session at collection time.
SESSION = local_session("driftloom-tests", cores=4, partitions=4)


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
