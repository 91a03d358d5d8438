"""Clashing names, odd ids, empty tables and repeated rows for the operators and the pipeline's stages."""

import importlib
import random
import zlib

import pytest
import xxhash

from assayline.llm import fingerprints as FP, mixing, sharding
from assayline.llm.near_dup import drop_near_duplicates, near_duplicates


def test_sharding_keeps_every_row_and_column(spark):
    rows = [(i, f"t{i % 7}" * (i % 5), 7, 8, 9) for i in range(200)] + [(None, None, 1, 1, 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, _r int, _one int, _cell int").repartition(4)
    got = sharding.shuffle_into_shards(df, sharding.ShardParams(shards=6, cells=4))
    assert got.columns == [*df.columns, "shard", "slot"]
    assert sorted(map(str, (tuple(r)[:5] for r in got.collect()))) == sorted(map(str, rows))


def test_op3_query_against_plain_python(spark):
    from assayline.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = QUERIES["op3_sharding"](spark, sf_dir).collect()
    data = {r["doc_id"]: (r["text"] or "").encode() for r in docs}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len(t) + 16, zlib.crc32(t)) for i, t in data.items()}
    sizes = [sum(r["shard"] == s for r in got) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1 and {r["law"] for r in got} == {"rows"}
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in enumerate(sizes))


def _long(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def _hash(data: bytes, seed: int = 42) -> int:
    return xxhash.xxh64(data, seed=seed).intdigest()


def _sketch(text, scale=8):
    words = [w for w in (text or "").lower().replace("\n", " ").split(" ") if w]
    hashes = [_hash(w.encode()) for w in words]

    def together(run):
        seed = 42
        for h in run:
            seed = _hash(h.to_bytes(8, "little"), seed)
        return seed & ((1 << 63) - 1)

    every = {together(hashes[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {together(hashes)} if words else set()
    return {h for h in every if h <= (1 << 63) // scale - 1 or h == min(every)}


def test_fingerprints_against_plain_python(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    big = (1 << 63) - 1
    ids = [*range(0, 400, 3), big, -big - 1, -5]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 90)))) for i in ids]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in FP.fingerprints(df, FP.FingerprintParams(cell_rows=10)).collect()}
    order = sorted(docs, reverse=True)
    alike = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = _sketch(t), _sketch(edited), _sketch(after)
        assert got[i]["fingerprint"] == "".join(f"{h:016x}" for h in sorted(a))
        assert got[i]["edited_fingerprint"] == "".join(f"{h:016x}" for h in sorted(b))
        assert got[i]["near_edited"] == pytest.approx(alike(a, b)) and got[i]["near_next"] == pytest.approx(alike(a, c))


def test_next_rows_with_repeated_and_outlying_ids(spark):
    rows = [(i % 3, f"t{i:03d}", 5) for i in range(120)] + [(None, f"n{i:03d}", 5) for i in range(80)] + [(10**17, "far", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _cell int").repartition(3)
    got = FP.with_next(df, ["doc_id", "text"], FP.FingerprintParams(cell_rows=5)).collect()
    assert len(got) == len(rows) and {r["_cell"] for r in got} == {5}
    hops = {(r["doc_id"], r["text"]): (r["next_doc_id"], r["next_text"]) for r in got}
    assert len(set(hops.values())) == len(rows)  # one cycle through all rows
    at, seen = (10**17, "far"), []
    for _ in rows:
        seen.append(at[0])
        at = hops[at]
    assert at == (10**17, "far") and seen == sorted(seen, key=lambda i: (i is not None, i or 0), reverse=True)


def test_mix_keeps_clashing_columns(spark):
    rows = [(i, "a b c d " * (1 + i % 4), "ab"[i % 2], 1, 2, 3) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _s int, _r int, size int")
    got = mixing.mix_plan(df).collect()
    assert {(r["_s"], r["_r"]) for r in got} == {(1, 2)} and len(got) == 60
    taken = mixing.taken_rows(df)
    assert taken.columns == df.columns and {r["size"] for r in taken.collect()} == {3}


def test_long_rows_leave_a_target_reachable(spark):
    rows = [(0, "x " * 6000, "a")] + [(i, "y " * 10, "a") for i in range(1, 700)] + [(1000 + i, "z " * 40, "b") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_plan(df).selectExpr("source", "target", "size * size(copies) as taken").groupBy("source", "target").sum("taken").collect()
    assert all(abs(r["sum(taken)"] - r["target"]) <= 0.02 * r["target"] for r in got), got


def test_a_repeated_id_is_one_node(spark):
    a, b = "one two three four five six seven", "red green blue white black grey pink"
    rows = [(3, a), (3, b), (1, a), (2, b), (7, "alone in the whole wide world"), (None, a), (None, a), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in near_duplicates(df).where("doc_id is not null").collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (7, 7), (9, 9)}
    kept = spark.createDataFrame([(*r, 1, 2) for r in [*rows, (1, a), (1, b)]], "doc_id long, text string, _id int, kept int")
    left = drop_near_duplicates(kept)
    assert left.columns == kept.columns
    assert sorted(map(str, (tuple(r) for r in left.collect()))) == sorted(map(str, [(1, a, 1, 2), (7, rows[4][1], 1, 2), (9, None, 1, 2), (None, a, 1, 2), (None, a, 1, 2)]))


def test_stages_on_odd_tables(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"{good} {'vile scum ' * 6 * (i % 4 == 0)} u{i} v{i} x{i} y{i} " + " ".join(f"q{i}r{j}" for j in range(60)), "s") for i in range(40)]
    rows += [(None, good, None), (50, None, "s"), (51, "", None), (52, "z " * 20000, "t"), (53, good, "t"), (53, good, "t")]
    names = "doc_id long, text string, source string"
    clash = "kept int, n_words int, _id int, _none int, _score double, _host string, size int, copies int, shard int, `a.b` int"
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5.0, "h", 6, 7, 8, 9) for r in rows], f"{names}, {clash}")
    for name, stage in pipeline.STAGES[:-1]:
        got = pipeline.written(stage(spark, df, str(tmp_path)), name)
        assert got.columns == df.columns and {tuple(r)[3:] for r in got.collect()} <= {(1, 2, 3, 4, 5.0, "h", 6, 7, 8, 9)}
        assert got.count() > 0 and stage(spark, df.limit(0), str(tmp_path)).count() == 0
    assert pipeline.STAGES[-1][1](spark, df, str(tmp_path)).count() > 0
