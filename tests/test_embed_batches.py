"""A model gets texts in batches that are bounded in bytes and rows (finding F16)."""

import numpy as np

from corvane.operators import embedding


def test_long_texts_do_not_add_up(spark, tmp_path):
    def model(given):
        if sum(map(len, given)) > 3 << 20 or len(given) > 1024:
            raise MemoryError("too much at once")
        return np.array([[len(t), len(given)] for t in given], float)

    rows = [(f"a{i}", "x" * 50_000) for i in range(200)] + [(f"b{i}", "y") for i in range(3000)] + [("null", None), ("long", "z" * (3 << 20))]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string").coalesce(1)
    found = embedding.embed(chunks, embedding.Spec("m", 2, 10), lambda t: 1, model).collect()
    assert [r.chunk_id for r in found] == [i for i, _ in rows]
    assert {r.chunk_id: r.error for r in found if r.error} == {"null": "empty input"}
    together = {r.chunk_id: round(len(t) * r.vector[1] / r.vector[0]) for r, (_, t) in zip(found, rows, strict=True) if t}
    assert 1 < together["a0"] <= 42 and together["b2500"] == 1024 and together["long"] == 1  # before: 200 long texts and 3,000 short ones together
    assert sum(1 / n for n in together.values()) < 15
