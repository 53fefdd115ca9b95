import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabloom import default_lexicon  # noqa: E402
from tabloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tabloom-tests", "4", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lexicon():
    return default_lexicon()


@pytest.fixture(scope="session")
def grid_of(spark):
    def make(files):
        rows = [(name, i, cells) for name, grid in files.items() for i, cells in enumerate(grid)]
        return spark.createDataFrame(rows, "file_id string, row_idx long, cells array<string>")
    return make


@pytest.fixture(scope="session")
def header_rows(spark):
    def make(files):
        rows = [(name, i, source) for name, names in files.items() for i, source in enumerate(names)]
        return spark.createDataFrame(rows, "file_id string, src_pos long, source string")
    return make
