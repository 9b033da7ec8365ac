"""Vectors with null components have hashes, and so pairs."""

import random

import duckdb
import pytest

from frameloom.plans import registry


@pytest.mark.parametrize("name", ["frame_hash_bits", "frame_zip_similarity"])
def test_null_components(spark, tmp_path, name):
    rng = random.Random(4)
    rows = [(i, [None if i % 13 == 1 and k < i % 4 + 1 or i == 7 else rng.gauss(0, 1) for k in range(64)]) for i in range(60)] + [(60, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = con.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    want = sorted(found.fetchall(), key=repr)
    assert len(want) > 30
    assert sorted((tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).select(*names).collect()), key=repr) == want
