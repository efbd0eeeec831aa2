"""The weights of op12's gates come from every row that the tables leave out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusmill.llm import op12_mixing as M
from corpusmill.llm import textvec as tv


def test_gates_are_fitted_on_all_rows_left_out(spark, monkeypatch):
    monkeypatch.setattr(M, "CALIBRATION_SHARE", 2)
    rng = np.random.default_rng(3)
    words = np.array([f"w{k}" for k in range(60)])
    rows = [(k, " ".join(words[np.minimum(rng.geometric(0.08, 6), 60) - 1])) for k in range(2600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = M.fit(df)
    said, got = model.mixer.value
    held = [r.text for r in df.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(2)) == 0).collect()]
    assert len(held) > 1200  # more than the 1000 that were once looked at
    s = model.coder.value.stream(*tv.text_views(pa.array(held)), left_out=True)
    x, gate = M.inputs(s, said)
    start = np.array([1.0, 0, 0, 0, 0])
    for g in range(M.GATES):
        a, y, w = x[gate == g].astype(float), s["bit"][gate == g], start.copy()
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -20, 20)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 20 * np.eye(5), a.T @ (p - y) + 20 * (w - start))
            w -= step * min(1.0, 1.0 / (np.abs(step).max() + 1e-12))
        assert np.abs(w - got[g]).max() < 2e-4
