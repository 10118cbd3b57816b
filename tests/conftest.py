import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from marginalia.session import local_session

    session = local_session("tests", 4)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    # Tests run many large plans over few rows: compiling them takes longer than running them.
    # `python tests/oracle.py 0.01` runs the catalog with generated code.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield session
    session.stop()
