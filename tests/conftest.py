import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from scanlake.session import local_session
    s = local_session(8, "tests")
    s.conf.set("spark.sql.shuffle.partitions", "2")  # tiny fixtures: task start-up is the cost
    s.conf.set("spark.sql.codegen.wholeStage", "false")  # compiling costs more than running here; tools/check.py runs compiled
    s.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    s.conf.set("spark.sql.adaptive.enabled", "false")
    return s


@pytest.fixture(scope="session")
def corpus(spark):
    def make(files: dict, scan_id: str = "s"):
        rows = [(scan_id, p, c) for p, c in files.items()]
        return spark.createDataFrame(rows, "scan_id string, path string, content string").coalesce(1)
    return make
