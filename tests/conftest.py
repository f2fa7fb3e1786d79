import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Python workers look for the package here, wherever the tests are started.
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

from scriptsift.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "8g", "scriptsift-tests", **{"spark.sql.shuffle.partitions": "4"})
