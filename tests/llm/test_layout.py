import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayline.llm import fingerprints as FP, mixing, packing, sharding


def _docs(n=120):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(90)]
    docs = [(i * 3, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))), rng.choice(["a", "a", "b", "c", None])) for i in range(n)]
    docs += [(1000, None, "b"), (1001, "", "a"), (1002, "same text " * 40, "a"), (1003, "same text " * 40, "b"), (1004, "long " * 5000, "c"), (1004, "long " * 5000, "c")]
    return docs


def _frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string, source string")


def test_shards_are_exact(spark):
    df = _frame(spark, [*_docs(), (None, "x", "a")]).selectExpr("*", "7 as shard", "1 as _x").repartition(5)
    p = sharding.ShardParams(shards=7, cells=4)
    got = sharding.shuffle_into_shards(df, p).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == df.count() and sizes.max() - sizes.min() <= 1 and len(sizes) == 7
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert sharding.shuffle_into_shards(df.limit(0), p).count() == 0


def test_matrix_is_uniform():
    hits = np.zeros((2, 3))
    for seed in range(4000):
        m = np.array([sent for _, sent in sharding.matrix_rows({0: 4, 1: 5}, 3, seed)])
        assert m.sum(axis=1).tolist() == [4, 5] and m.sum(axis=0).tolist() == [3, 3, 3]
        hits += m
    assert np.abs(hits / 4000 - np.array([[4 / 3] * 3, [5 / 3] * 3])).max() < 0.05
    rng = np.random.default_rng(1)
    draws = [sharding.hypergeometric(rng, 10**10, 3 * 10**10, 10**6) for _ in range(200)]
    assert abs(np.mean(draws) - 250_000) < 5 * 433 / 200**0.5 and 300 < np.std(draws) < 600


def _sketch(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_fingerprints(spark):
    docs = [(i, t) for i, t, _ in dict(zip([d[0] for d in _docs()], _docs())).values()]
    df = _frame(spark, [(i, t, "a") for i, t in docs]).selectExpr("*", "1 as kept", "2 as next_text", "3 as _cell").repartition(3)
    p = FP.FingerprintParams(cell_rows=10)
    got = {r["doc_id"]: r for r in FP.fingerprints(df, p).collect()}
    order = sorted(docs, reverse=True)
    for k, (i, t) in enumerate(order):
        a, b = t or "", order[(k + 1) % len(order)][1] or ""
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(a), hashlib.sha256(edited.encode()).hexdigest())
    assert got[1002]["fingerprint"] == got[1003]["fingerprint"] and got[1003]["near_next"] == 1.0
    assert got[1001]["fingerprint"] == "" and got[1001]["near_next"] == 1.0  # null text follows empty text
    assert FP.fingerprints(df.limit(0), p).count() == 0
    (lone,) = FP.fingerprints(df.where("doc_id = 1002"), p).collect()
    assert lone["near_next"] == 1.0
    ties = FP.fingerprints(_frame(spark, [(1, "a", "s"), (1, "b", "s"), (None, "c", "s")]), p).collect()
    assert len(ties) == 3


def test_plan_does_not_grow_with_cells(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    few, many = (FP.with_next(df, ["text"], FP.FingerprintParams(cell_rows=n)) for n in (3000, 10))
    sizes = [len(x._jdf.queryExecution().optimizedPlan().toString()) for x in (few, many)]
    assert sizes[1] < 1.1 * sizes[0] + 2000
    assert many.where("doc_id > 0 and next_text <> concat('t', doc_id - 1) or doc_id = 0 and next_text <> 't29999'").count() == 0 and many.count() == 30_000


def test_sketches_estimate_jaccard(spark):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(4000)]
    other = base[:2000] + [rng.choice(words) for _ in range(2000)]
    df = spark.createDataFrame([(" ".join(base), " ".join(other), " ".join(base[:300]))], "a string, b string, c string")
    a, b, c = (FP.sketch(df[x]) for x in "abc")
    row = df.select(FP.resemblance(a, b).alias("j"), FP.containment(c, a).alias("in_"), FP.merged(a, b).alias("m"), FP.sketch(FP.F.concat_ws(" ", "a", "b")).alias("s")).first()
    x, y = _sketch(" ".join(base)), _sketch(" ".join(other))
    assert row["j"] == pytest.approx(len(x & y) / len(x | y), abs=0.06) and row["in_"] == 1.0
    assert set(row["m"]) <= set(row["s"])


def test_mix(spark):
    docs = _docs(300)
    df = _frame(spark, docs).selectExpr("*", "1 as size", "2 as copies", "3 as shard").repartition(3)
    p = mixing.MixParams(shards=5, block_words=50, cells=8)
    plan = mixing.mix_plan(df, p).toPandas()
    size = {i: len((t or "").split()) for i, t, _ in docs}
    names = sorted({s for _, _, s in docs if s}) + [None]
    total = {n: sum(len((t or "").split()) for _, t, s in docs if s == n) for n in names}
    weight = {n: [1, 2, 3][k % 3] for k, n in enumerate(names)}
    goal = dict(zip(names, mixing.targets([total[n] for n in names], [weight[n] for n in names], 3)))
    assert sum(goal.values()) == pytest.approx(sum(total.values())) and all(goal[n] <= 3 * total[n] for n in names)
    for n in names:
        own = plan[plan["source"].isna() if n is None else plan["source"] == n]
        assert (own["size"].tolist() == [size[i] for i in own["doc_id"]]) and set(own["source_size"]) == {total[n]}
        taken = (own["size"] * own["copies"].map(len)).sum()
        assert abs(taken - goal[n]) <= max(own["size"]) and own["copies"].map(len).max() <= 3
    again = mixing.mix_plan(df.repartition(4), p).toPandas()
    key = lambda f: sorted((r.doc_id, r.n, str([tuple(c) for c in r.copies])) for r in f.rename(columns={"size": "n"}).itertuples())
    assert key(plan) == key(again)
    mixed = mixing.mix(df, p)
    assert mixed.count() == plan["copies"].map(len).sum() and mixing.mix(df.limit(0), p).count() == 0


def _plain_taken(rows, goal, most=3):
    """How often each row of one source is taken: ``rows`` of ``(hash, doc_id, size)``, whole passes first, then the front of the order, then one filler."""
    total = sum(n for *_, n in rows)
    passes = int(goal // total) if total else 0
    rest = goal - passes * total
    order = sorted(range(len(rows)), key=lambda i: (rows[i][2] * 16 <= rest, rows[i][0], rows[i][1]))
    extra, place, lost, past = [0] * len(rows), 0, 0, []
    for i in order:
        n = rows[i][2]
        long_ = n * 16 > rest
        end = place + n
        if (end if long_ else end - lost) <= rest:
            extra[i] = 1
        else:
            past.append((i, place))
            lost += n if long_ else 0
        place = end
    gap = rest - sum(rows[i][2] for i in order if extra[i])
    off = [(abs(gap - rows[i][2]), k, i) for k, (i, _) in enumerate(past) if rows[i][2] > 0 and abs(gap - rows[i][2]) < gap]
    if off:
        extra[min(off)[2]] = 1
    return [0 if n == 0 else min(passes, most) + e for e, (*_, n) in zip(extra, rows)]


def test_mix_takes_the_rows_of_plain_python(spark):
    rng = random.Random(12)
    docs = [(i, " ".join(["w"] * rng.randrange(0, 40)) + f" x{i}", rng.choice(["a", "b", "b", "b", "c", None])) for i in range(150)]
    docs += [(500, "nine words of one text that stands here often", "d")] * 50 + [(501, "other words", "d"), (502, "long " * 700, "a"), (503, "", "b"), (504, None, "c")]
    df = _frame(spark, docs).repartition(4)
    p = mixing.MixParams(shards=3, block_words=20, cells=4)
    plan = mixing.mix_plan(df, p)
    h = mixing.F.xxhash64(mixing.F.lit(p.seed), "doc_id", "text").bitwiseAND(mixing.F.lit((1 << 62) - 1))
    got = plan.select("*", h.alias("h"), mixing.F.size("copies").alias("n")).toPandas()
    for _, own in got.groupby("source", dropna=False):
        rows = list(zip(own["h"], own["doc_id"], own["size"]))
        want = _plain_taken(rows, own["target"].iloc[0])
        # Rows that repeat are interchangeable.
        assert sorted(zip(own["doc_id"], own["n"])) == sorted(zip(own["doc_id"], want))
        assert abs((own["size"] * own["n"]).sum() - own["target"].iloc[0]) <= 9 or own["source"].iloc[0] != "d"


def test_targets_of_many_sources():
    sizes = [1 + i % 7 for i in range(30_000)]
    weights = [float(1 + i % 50) for i in range(30_000)]
    goal = mixing.targets(sizes, weights, 3)
    assert sum(goal) == pytest.approx(sum(sizes)) and all(g <= 3 * n for g, n in zip(goal, sizes))


def test_tree_gives_exact_shards():
    tree = mixing.splitting_tree([10, 0, 25, 7], 6, 1)
    assert tree.sum(axis=0).tolist() == [10, 0, 25, 7] and tree.sum(axis=1).max() - tree.sum(axis=1).min() <= 1
    assert mixing.targets([10, 1000], [3, 1], 3) == [30.0, 980.0] and mixing.targets([], [], 3) == []


def test_packing(spark):
    docs = _docs(200)
    df = _frame(spark, docs).selectExpr("*", "1 as n", "2 as g", "3 as cluster").repartition(3)
    p = packing.PackParams(capacity=64, group_rows=50)
    got = packing.pack(df, p).toPandas()
    assert got["size"].sum() == sum(len((t or "").split()) for _, t, _ in docs)
    bins = got.groupby("bin_id")
    assert bins["size"].sum().max() <= 64 and (bins["size"].transform("sum") == got["bin_fill"]).all()
    assert not got.duplicated(["bin_id", "source"]).any() and not got.duplicated(["bin_id", "cluster"]).any()
    assert packing.pack(df.limit(0), p).count() == 0


def test_best_fit_is_tightest():
    rng = np.random.default_rng(2)
    sizes = np.sort(rng.integers(1, 40, 300))[::-1]
    sources, clusters = rng.integers(0, 6, 300), rng.integers(-1, 20, 300)
    got = packing.best_fit(sizes, sources, clusters, 100)
    bins = []  # [left, sources, clusters]
    for n, s, c, b in zip(sizes, sources, clusters, got):
        fits = [(x[0], k) for k, x in enumerate(bins) if x[0] >= n and s not in x[1] and (c < 0 or c not in x[2])]
        want = min(fits)[1] if fits else len(bins)
        assert b == want
        if want == len(bins):
            bins.append([100, set(), set()])
        bins[want][0] -= n
        bins[want][1].add(s)
        bins[want][2].add(c)
