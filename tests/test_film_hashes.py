"""Hashes of films whose middle coefficients lie close together."""

import duckdb
import pytest

from frameloom.plans import registry

#: A vector's shades; in frame 8 of its film (20195), the two middle coefficients are 7e-9 apart.
SHADES = [124, 139, 124, 128, 121, 133, 129, 130, 132, 126, 127, 122, 125, 126, 127, 133, 127, 127, 131, 119, 129, 127, 129, 128, 132, 131, 131, 124, 133, 126, 133, 121, 131, 120, 124, 127, 120, 125, 121, 129, 124, 128, 129, 131, 125, 128, 123, 131, 132, 128, 122, 125, 141, 139, 136, 117, 128, 134, 120, 131, 122, 125, 122, 121]


@pytest.mark.parametrize("name", ["film_frame_hashes", "hash_cache_aside"])
def test_middle_coefficients_stay_apart(spark, tmp_path, name):
    rows = [(20195, [(s - 127.5) / 40 for s in SHADES])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = registry.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = con.execute(registry.ORACLES[name])
    want = [tuple(r) for r in found.fetchall()]
    assert len(want) == 5 and {tuple(r) for r in got.select(*[d[0] for d in found.description]).collect()} == set(want)
