import datetime

import pytest

from frameloom.llm import leaderboard
from tests.llm.test_bands_ladders_tries import LINES


def test_failed_start_is_repeated(spark, tmp_path, monkeypatch):
    """A start that fails once is made again from its checkpoint, and changes no board."""
    day = datetime.datetime(2024, 1, 1)
    lines = [(k, 0, k % 20, 1, 1, 2.0, "kept", day + datetime.timedelta(days=k % 140)) for k in range(300)]
    frames = spark.createDataFrame(lines, LINES), spark.createDataFrame([(1, 7)], "vendor_id long, nation_id int"), spark.createDataFrame([(i, 1.0) for i in range(20)], "item_id long, price double")
    want = sorted(map(tuple, leaderboard.change_feed(spark, *frames, items_per_key=4).collect()), key=repr)
    flag = str(tmp_path / "failed")

    class Failing(leaderboard.Ladder):  # local, so that workers get it by value
        """Fails where its file is missing, and leaves it, so that only one task of one start fails."""

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802
            found = list(super().handleInputRows(key, rows, timerValues))
            try:
                open(flag, "x").close()  # noqa: SIM115
            except FileExistsError:
                yield from found
            else:
                raise RuntimeError("one task fails")

    monkeypatch.setattr(leaderboard, "Ladder", lambda top: Failing(top))
    assert sorted(map(tuple, leaderboard.change_feed(spark, *frames, items_per_key=4).collect()), key=repr) == want
    assert (tmp_path / "failed").exists() and len(want) > 20


def test_lasting_error_is_raised(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(leaderboard, "ATTEMPTS", 2)
    made = []

    class Broken:
        def __getattr__(self, name):
            return lambda *a, **b: self

        def awaitTermination(self):  # noqa: N802
            made.append(1)
            raise leaderboard.StreamingQueryException("broken")

    with pytest.raises(leaderboard.StreamingQueryException):
        leaderboard._run(type("Boards", (), {"writeStream": Broken()})(), str(tmp_path))
    assert len(made) == 2
