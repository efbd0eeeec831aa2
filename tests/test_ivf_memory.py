"""What a search over inverted lists sends to its tasks stays small, and its scores are those of the codes."""

from __future__ import annotations

import pickle

import numpy as np

from corpusmill.operators import ann


def test_tasks_get_a_bit_for_each_list_and_question(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16)) * 2
    v = centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 16)) * 0.3
    c = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "chunk_id long, embedding array<float>").repartition(4)
    q = c.where("chunk_id % 3 = 0").withColumnRenamed("chunk_id", "query_id")
    index = ann.build_ivf(c, str(tmp_path / "i"), 5)
    sent, one = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: sent.append(len(pickle.dumps(x[2]))) or one(x))
    monkeypatch.setattr(ann, "WAITING", 700)
    got = ann.ivf_topk(q, index, 5, again=60).collect()  # more than a cluster holds
    assert sent == sent[:1] and sent[0] < index.model["sizes"].size * 1000 / 8 + 500
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    true = np.argsort(-(unit[::3] @ unit.T), axis=1)[:, :5]
    assert np.mean([r.chunk_id in true[r.query_id // 3] for r in got]) >= 0.9 and len(got) == 5 * 1000
