import pytest

from quarryline.runtime import build_session, ship_package


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    ship_package()
    folder = tmp_path_factory.mktemp("shared")
    session = build_session(master="local[4]", spark__sql__shuffle__partitions="4", spark__checkpoint__dir=f"file://{folder}", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")), spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
