import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tallgrass.session import session

    settings = {
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    made = session("tests", **settings)
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
