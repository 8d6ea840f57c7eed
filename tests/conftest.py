import gzip
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from traitloom.session import session  # noqa: E402

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    built = session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
        },
    )
    built.sparkContext.setLogLevel("ERROR")
    yield built
    built.stop()


@pytest.fixture
def no_broadcast(spark):
    """Spark may not broadcast, so that joins shuffle and hot keys are salted."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "-1")
    yield
    for key in keys:
        spark.conf.unset(key)


@pytest.fixture
def write(tmp_path):
    """Write lines to a file, gzipped where the name says so; cells may be tuples."""

    def writer(name, lines):
        text = "".join(("\t".join(x) if isinstance(x, tuple) else x) + "\n" for x in lines)
        path = tmp_path / name
        path.write_bytes(gzip.compress(text.encode()) if name.endswith(".gz") else text.encode())
        return str(path)

    return writer


def tuples(df, *columns):
    """The rows as a sorted list of tuples."""
    return sorted(tuple(row) for row in (df.select(*columns) if columns else df).collect())


def written_lines(folder):
    """All lines of a written folder in the order of its parts."""
    return [
        line
        for part in sorted(Path(folder).glob("part-*"))
        for line in part.read_text().splitlines()
    ]
