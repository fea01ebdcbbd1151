import pytest

from siltstone.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = build_session("tests", {
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g",
        "spark.checkpoint.dir": str(base / "checkpoint"), "spark.sql.warehouse.dir": str(base / "warehouse"),
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def namespace(spark):
    from siltstone.session import fresh_namespace
    return fresh_namespace(spark, "test")
