import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="frameloom-tests-")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rounded(value):
    if isinstance(value, float):
        return round(value, 9)
    return tuple(map(rounded, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Compare a query with its SQL on the smallest tables."""
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for p in Path(folder).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")

    def compare(query, sql):
        df = query(spark, folder)
        names = sorted(df.columns)
        ours = sorted((tuple(rounded(r[c]) for c in names) for r in df.collect()), key=repr)
        found = con.execute(sql)
        columns = [d[0] for d in found.description]
        assert sorted(columns) == names
        theirs = sorted((tuple(rounded(r[columns.index(c)]) for c in names) for r in found.fetchall()), key=repr)
        assert set(ours) == set(theirs)
        assert ours == theirs

    return compare
