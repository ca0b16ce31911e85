import numpy as np

from strandspark.operators import ann, retrieval


def test_all_cells_are_exact_and_more_probes_find_more(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8))
    rows = [(i, i % 7, v.tolist()) for i, v in enumerate(x)] + [(900, 1, None), (None, 1, [1.0] * 8)]
    data = spark.createDataFrame(rows, "id long, grp long, vector array<double>")
    asked = data.where("id % 40 = 0")
    exact = {(r.query_id, r["rank"], r.id) for r in retrieval.batch_top_k(data, asked, 4).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 400, 40):
        s = np.round(unit @ unit[q], 9)
        s[q] = -2
        assert {(q, n + 1, int(i)) for n, i in enumerate(np.lexsort((np.arange(400), -s))[:4])} <= exact
    found = lambda p: {(r.query_id, r["rank"], r.id) for r in ann.probed_top_k(data.select("id", "vector"), asked.select("id", "vector"), 4, p, cells=16).collect()}
    assert found(16) == exact
    assert len({(q, i) for q, _, i in found(8)} & {(q, i) for q, _, i in exact}) >= len({(q, i) for q, _, i in found(1)} & {(q, i) for q, _, i in exact})
    assert retrieval.batch_top_k(data.where("id < 0"), asked, 4).count() == 0
