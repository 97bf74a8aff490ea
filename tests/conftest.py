import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for p in (ROOT, os.path.join(ROOT, "tests")):
    if p not in sys.path:
        sys.path.insert(0, p)


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("CRIBRA_DRIVER_MEMORY", "4g")
    from cribra.session import checkpoint_dir, local_session

    s = local_session(4, 4, app="cribra-tests")
    checkpoint_dir(s)
    yield s
    s.stop()
