import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def corpus(spark):
    """``corpus({path: text})`` or ``corpus({(repo, path): text})`` as the files table."""
    def build(files):
        rows = []
        for key, content in files.items():
            repo, path = key if isinstance(key, tuple) else ("r", key)
            rows.append((repo, path, content.encode() if isinstance(content, str) else content))
        return spark.createDataFrame(rows, "repo string, path string, content binary")
    return build


@pytest.fixture(scope="session")
def make_findings(spark):
    """Raw findings from partial dicts."""
    def build(*rows):
        base = {"repo": "r", "path": "src/auth.py", "line_number": 10, "matched_text": "RSA",
                "algorithm_id": "RSA", "source": "source_code", "line_text": "key = RSA",
                "ord_a": 10, "ord_b": 0}
        schema = ("repo string, path string, line_number int, matched_text string, "
                  "algorithm_id string, source string, line_text string, ord_a int, ord_b int")
        return spark.createDataFrame(
            [tuple({**base, **r}.values()) for r in rows], schema)
    return build
