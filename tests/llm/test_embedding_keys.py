"""Keys of the embedding operator, and its query's SQL."""

import math

import duckdb
import numpy as np
import pytest

from logloom.llm import embed_dedup, queries
from logloom.ship import ship


def test_keys_follow_the_rows():
    assert [embed_dedup.key_bits(n) for n in (0, 1, 51_282, 16 << 12, (16 << 12) + 1, 16 << 20, 1 << 62)] == [12, 12, 12, 12, 13, 20, 30]
    assert embed_dedup.table_count(0.93, 12) == 34
    p = 1 - math.acos(0.93) / math.pi
    for bits in (1, 12, 20, 30):
        tables = embed_dedup.table_count(0.93, bits)
        assert (1 - p**bits) ** tables <= embed_dedup.MISSED < (1 - p**bits) ** (tables - 1)


@pytest.mark.parametrize("bits", [None, 16])
def test_query_against_its_sql(spark, tmp_path, bits):
    ship(spark)
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((40, 24))
    rows = []
    for i in range(400):
        v = centres[i % 40] + rng.standard_normal(24) * rng.choice([0.0, 0.15, 0.3])
        rows.append((i, v.astype(np.float32).tolist(), int(i % 2) if i % 29 else None))
    rows += [(900, [0.0] * 24, 1), (901, None, 1), (902, [float("nan")] + [1.0] * 23, 1), (903, [None] + [1.0] * 23, 0), (904, [], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = queries.op1_embedding_near_dedup(spark, str(tmp_path)) if bits is None else embed_dedup.near_duplicates(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), bits=bits)
    got = sorted(map(tuple, df.select("vec_id", "n_links", "component_id", "kept").collect()))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
        want = sorted(db.sql(queries.OP1_SQL).fetchall())
    assert sum(r[1] for r in want) > 500
    assert got == want
