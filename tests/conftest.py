import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ.setdefault("COHORTRY_SHUFFLE", "3")  # small tables: more partitions only cost tasks


@pytest.fixture(scope="session")
def spark():
    from cohortry.session import local_session

    s = local_session(os.environ.get("TEST_CPUS", "4"), "tests", "6g")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
