import numpy as np

from lodex.llm import ann


def test_repeated_ids_do_not_push_out_others(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=16)
    rows = [(0, base.tolist())] + [(1 + k, (base + 0.01 * (k + 1) * rng.normal(size=16)).tolist()) for k in range(8)]
    df = spark.createDataFrame([r for r in rows for _ in range(7)], "vec_id long, embedding array<double>")
    got = [r.vec_id for r in ann.search(df.where("vec_id = 0").limit(1), df, k=5).orderBy("rank").collect()]
    v = np.array([r[1] for r in rows])
    cosine = v @ v[0] / np.linalg.norm(v, axis=1)
    assert got == [k for k in np.argsort(-cosine).tolist() if k][:5]
