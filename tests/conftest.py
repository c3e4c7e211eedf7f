import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from twinspan.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 8)
    yield session
    session.stop()


@pytest.fixture
def sources(spark):
    """Build source files from (file, content) pairs of one job."""
    from pyspark.sql import functions as F

    from twinspan.sources.tables import from_table

    def build(*files, job="job"):
        rows = [(job, i, f, c) for i, (f, c) in enumerate(files)]
        df = spark.createDataFrame(rows, "job STRING, n INT, file STRING, content STRING")
        return from_table(df, "file", "content", file_ord="n", job_id=F.col("job"))

    return build
