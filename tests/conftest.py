import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[4]")
         .appName("podium-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.environment.setdefault("PYTHONPATH", ROOT)  # Python workers import the package too
    if not s.sparkContext.getCheckpointDir():
        conf_dir = s.sparkContext.getConf().get("spark.checkpoint.dir", None)
        s.sparkContext.setCheckpointDir(conf_dir or tempfile.mkdtemp(prefix="podium-test-ckpt-"))
    yield s
    s.stop()
