import datetime
import os

from frameloom.llm import leaderboard
from tests.llm.test_bands_ladders_tries import LINES


def open_stores(spark):
    """Locks of state stores that the session's JVM holds."""
    fds = f"/proc/{spark._jvm.java.lang.ProcessHandle.current().pid()}/fd"
    found = set()
    for fd in os.listdir(fds):
        try:
            path = os.readlink(f"{fds}/{fd}")
        except OSError:
            continue
        if path.endswith("/LOCK"):
            found.add(path)
    return found


def test_ladder_leaves_no_store_open(spark):
    """Each start of the stream opens as many stores as there are partitions; they must not add up over the starts."""
    day = datetime.datetime(2024, 1, 1)
    lines = [(k, 0, k % 20, 1, 1, 2.0, "kept", day + datetime.timedelta(days=k % 140)) for k in range(300)]
    frames = spark.createDataFrame(lines, LINES), spark.createDataFrame([(1, 7)], "vendor_id long, nation_id int"), spark.createDataFrame([(i, 1.0) for i in range(20)], "item_id long, price double")
    before = open_stores(spark)
    assert leaderboard.change_feed(spark, *frames, items_per_key=4).count() > 20
    assert open_stores(spark) <= before
