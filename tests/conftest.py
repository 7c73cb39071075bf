import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pursewise.session import build_session

    root = tmp_path_factory.mktemp("spark")
    s = build_session(master="local[*]", shuffle_partitions=8, extra_conf={
        "spark.checkpoint.dir": f"{root}/shared", "spark.sql.warehouse.dir": f"{root}/warehouse"})
    yield s
    s.stop()
