import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.session import make_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = make_session(4)
    yield session
    session.stop()


@pytest.fixture
def write_lines(tmp_path):
    """Write text files below one folder and return the folder."""

    def write(**files):
        folder = tmp_path / "source"
        folder.mkdir(exist_ok=True)
        for name, lines in files.items():
            (folder / f"{name}.csv").write_text("".join(line + "\n" for line in lines))
        return str(folder)

    return write
