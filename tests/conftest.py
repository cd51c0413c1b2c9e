import tempfile

import pytest

from trainscope.session import builder, clear_work


@pytest.fixture(scope="session")
def spark():
    session = (builder("trainscope-tests").master("local[8]")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false")
               .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="trainscope-tests-"))
               .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="trainscope-wh-"))
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_work(session)
    session.stop()
