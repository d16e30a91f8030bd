import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from docweave.session import local_session

    session = local_session("4", 4, "4g")
    yield session
    session.stop()


@pytest.fixture
def shred(spark):
    from docweave.operators import html

    def run(*pages, url="/p"):
        rows = [(i, f"{url}{i}" if i else url, page) for i, page in enumerate(pages)]
        return html.shred_html(spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING"))

    return run
