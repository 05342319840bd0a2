import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from phrasewell.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    yield session
    session.stop()


@pytest.fixture
def path(spark, request):
    from phrasewell.session import new_path

    return new_path(spark, request.node.name.replace("[", "_").replace("]", ""))
