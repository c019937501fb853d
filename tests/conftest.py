import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docmill.session import clean_work_dirs, local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clean_work_dirs(session)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def decorated(spark, sf):
    """``(doc_id, text)`` of every document, with the suffix the queries use."""
    from workload.registry import documents

    return documents(spark, sf).select("doc_id", "text").collect()
