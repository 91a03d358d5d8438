import hashlib
import math
import random

import numpy as np

from assayline.llm import centroids as C, queries


def _plain(rows, p):
    """Rounds of plain assignment over all pairs, as ``{position: (cluster, distance)}``, and the centroids."""
    kept = [(i, [max(min(math.floor(p.scale * x), 1 << 27), -(1 << 27)) for x in v]) for i, v in rows if v is not None and len(v) == p.dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{p.seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or 0, r[1]))
    centroids = [v for _, v in order[: p.centroids]]
    for turn in range(p.rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids)) for _, v in kept]
        if turn < p.rounds:
            for k in range(len(centroids)):
                mine = [v for (_, v), (_, c) in zip(kept, near) if c == k]
                if mine:
                    centroids[k] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted((str(i), c, d) for (i, _), (d, c) in zip(kept, near)), centroids


def _rows(rng, n, dims, spread):
    return [(i, [rng.choice(spread) * rng.random() for _ in range(dims)]) for i in range(n)]


def test_equals_plain(spark):
    rng = random.Random(2)
    for dims, k, n, spread in ((3, 5, 200, [1.0, -1.0]), (2, 16, 300, [0.1]), (64, 4, 40, [0.5, -0.5, 9.0]), (1, 7, 5, [1.0])):
        p = C.ShallotParams(centroids=k, dims=dims, rounds=3)
        rows = _rows(rng, n, dims, spread)
        rows += [rows[0], (None, rows[1][1]), (None, rows[2][1]), (7, None), (8, []), (9, [1.0] * (dims + 1)), (10, [None] * dims), (11, [float("nan")] * dims), (12, [float("-inf")] * dims)]
        rows += [(13, [1e30] * dims), (14, [-3e6] * dims)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as v", "2 as cluster").repartition(3)
        done, centroids = C.shallot(df, p)
        expected, means = _plain(rows, p)
        assert centroids == means
        assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in done.collect()) == expected


def test_search_prunes_and_is_exact():
    """Passes over moving centroids, ties included, against all distances; most vectors need no search."""
    rng = np.random.default_rng(5)
    blobs = rng.integers(-300, 300, (16, 8))
    v = (blobs[rng.integers(0, 16, 4000)] + rng.integers(-6, 7, (4000, 8))).astype(np.int32)
    v[:50] = v[50:100]
    centroids, before = v[:16].astype(np.int64), None
    held = np.zeros(4000, np.int32), np.ones(4000, np.int32), np.full(4000, np.inf), np.zeros(4000)
    measured = []
    for _ in range(8):
        search = C.Search(centroids, before)
        count, plain = [0], C.exact
        C.exact = lambda a, b: count.__setitem__(0, count[0] + len(a)) or plain(a, b)
        try:
            held = search.assign(v, *held)
        finally:
            C.exact = plain
        measured.append(count[0])
        every = ((v[:, None, :].astype(np.int64) - centroids[None]) ** 2).sum(axis=2)
        assert (held[0] == every.argmin(axis=1)).all()
        before, centroids = centroids, np.array([v[held[0] == c].sum(axis=0) // max((held[0] == c).sum(), 1) if (held[0] == c).any() else centroids[c] for c in range(16)])
    assert measured[0] < 4000 * 16 and measured[-1] < measured[0] / 2


def test_query_and_empty(spark, tmp_path):
    rng = random.Random(3)
    rows = _rows(rng, 150, 64, [0.3, -0.3])
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_centroids(spark, str(tmp_path)).toPandas()
    plain = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    expected, means = _plain(plain, C.ShallotParams())
    assert sorted(zip(map(str, got["vec_id"]), got["cluster"], got["distance"])) == expected
    assert set(got["inertia"]) == {sum(d for *_, d in expected)}
    for c, group in got.groupby("cluster"):
        assert set(group["cluster_inertia"]) == {group["distance"].sum()}
        assert set(group["centroid_sha256"]) == {hashlib.sha256(",".join(map(str, means[c])).encode()).hexdigest()}
    empty = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert C.with_clusters(*C.shallot(empty)).count() == 0
