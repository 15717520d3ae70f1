import os

import pytest

from newsflow.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    cpus = os.environ.get("TEST_CPUS", "8")
    session = build_session(
        "newsflow-tests", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
