import random
import re

import pytest

from frameloom.operators import similarity as S
from frameloom.plans import registry


def test_keys_are_dealt_by_their_number(spark, monkeypatch):
    """Four times the frames, four times the tasks that sort their keys; the pairs stay those of comparing all."""
    monkeypatch.setattr(S, "KEYS_A_TASK", 500, raising=False)
    rng, parts = random.Random(3), {}
    for n in (40, 160):
        rows = [(i, [rng.getrandbits(63) for _ in range(5)]) for i in range(n)]
        rows += [(1000 + i, [h ^ (1 << rng.randrange(63)) for h in hashes]) for i, hashes in rows[: n // 2]]
        found = S.close_pairs(spark.createDataFrame(rows, "video_id long, hashes array<long>"), 7)
        plan = found._jdf.queryExecution().executedPlan().toString()
        parts[n] = {int(x) for x in re.findall(r"hashpartitioning\(key#\d+L?, (\d+)\)", plan)}
        near = {(a, b) for a, x in rows for b, y in rows if a < b and any((x[k] ^ y[k]).bit_count() <= 7 for k in (1, 2, 3))}
        assert {tuple(r) for r in found.collect()} == near
        assert len(near) >= n // 2
    assert len(parts[40]) == len(parts[160]) == 1
    assert max(parts[160]) >= 3.9 * max(parts[40]) > 4


@pytest.mark.parametrize("name", ["mad_outlier_filter", "frame_zip_similarity", "top_duplicates"])
def test_pairs_equal_sql(name, same_as_sql):
    same_as_sql(registry.QUERIES[name], registry.ORACLES[name])
