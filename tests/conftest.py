import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lodestone.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", spark__driver__memory="6g")
    ship(session)
    return session
