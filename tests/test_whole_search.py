"""Candidates come from all vectors."""

import numpy as np

from lodestone.operators.variants import select_greedy
from lodestone.plans import catalogue


def test_submodular_select_searches_all_vectors(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(307, 8)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.query_id: (r.original, r.variants) for r in catalogue.QUERIES["submodular_select"](spark, str(tmp_path)).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = {}
    for q in range(0, 307, 100):
        near = [i for i in np.argsort(-(u @ u[q]), kind="stable") if i != q][:10]
        want[q // 100] = (str(q), ",".join(str(near[i]) for i in select_greedy([x[i].tolist() for i in near], x[q].tolist(), 3, 0.3)))
    assert got == want
