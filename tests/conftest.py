import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lintlake.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]",
        "lintlake-tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="lintlake-tests-"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture
def files(spark):
    """Makes a (path, text) table from keyword-free pairs."""

    def make(*pairs):
        return spark.createDataFrame(list(pairs), "path string, text string")

    return make


@pytest.fixture
def scan(files):
    """Scans the given files and returns (type, line, severity) per finding, sorted."""
    from lintlake.plans.scan import scan_all

    def run(*pairs, **options):
        rows = scan_all(files(*pairs), **options).collect()
        return sorted((r.violation_type, r.line_num, r.severity) for r in rows)

    return run


@pytest.fixture
def plan():
    """The formatted physical plan as text."""

    def show(df):
        mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        return df._jdf.queryExecution().explainString(mode)

    return show
