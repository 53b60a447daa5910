import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablegov.session import get_spark  # noqa: E402
from tablegov.streaming.streams import ROCKSDB  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark(
        "tablegov-tests", "8", spark__sql__shuffle__partitions="4", spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false", spark__sql__streaming__stateStore__providerClass=ROCKSDB)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Sorted tuples of a frame."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
