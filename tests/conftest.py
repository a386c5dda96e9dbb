import pytest

from limpid.session import build_session, release_stages


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("limpid-tests", "local[8]", **{
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
    })
    s.sparkContext.setLogLevel("OFF")
    yield s
    release_stages(s)
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
