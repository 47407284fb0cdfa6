import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from palimpsest.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", cores=8, memory="6g", shuffle=4)
