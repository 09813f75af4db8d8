import pytest

from weftline.session import get_spark


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
