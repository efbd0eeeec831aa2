"""Vectors whose digits round apart, against the queries' SQL, to the last bit."""

from __future__ import annotations

import struct

import duckdb
import numpy as np
import pytest

from corpusmill.plans.search_queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("vectors"))
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(size=64) * scale], k % 10) for k, scale in enumerate(np.repeat([1.0, 1e-3, 1e-5, 1e-8, 1e4], 40))]
    rows += [(1000, [1.0, -1e-9, 1e-9, -4e-10] + [0.0] * 60, 0), (1001, [0.0] * 64, 3), (1002, [-0.0, 2.5e-9] + [1.0] * 62, 1), (1003, None, 1), (1004, [], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.mark.parametrize("name", ["e5_l2_normalize", "e6_quantize_vector"])
def test_rounds_as_its_sql(spark, vectors, name):
    bits = lambda v: None if v is None else [None if x is None else struct.pack("<d", x) for x in v]
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{vectors}/embeddings.parquet/*.parquet')")
        wanted = {k: bits(v) for k, v in con.execute(ORACLES[name]).fetchall()}
    assert {r[0]: bits(r[1]) for r in QUERIES[name](spark, vectors).collect()} == wanted
