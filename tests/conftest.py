import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from lemmata.session import build_session, ensure_importable

    session = ensure_importable(build_session("tests", 8, 4))
    session.sparkContext.setLogLevel("ERROR")
    return session
