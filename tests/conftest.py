import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import local_session  # noqa: E402
from hostweave.session import prepare_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return prepare_session(local_session("hostweave-tests", "4"))
