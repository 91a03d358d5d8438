import hashlib
import random
import zlib

from pyspark.sql import functions as F

from assayline.llm import merkle as M, queries


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, text):
    values = [row[0], row[3], row[2], row[4], text]
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def _tree(nodes):
    """The root and, for each node, its siblings from below upwards, as ``(at, others)``."""
    paths = [[] for _ in nodes]
    held = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, up_held = [], []
        for at in range(0, len(nodes), 8):
            run = nodes[at : at + 8]
            for k in range(len(run)):
                for i in held[at + k]:
                    paths[i].append((k, run[:k] + run[k + 1 :]))
            up.append(_h(*run))
            up_held.append([i for k in range(len(run)) for i in held[at + k]])
        nodes, held = up, up_held
    return nodes[0], paths


def _plain(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r, r[1]))) for x in langs}
    built = {x: _tree([_leaf(r, r[1]) for r in trees[x]]) for x in langs}
    root, above = _tree([built[x][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for r, below in zip(trees[x], built[x][1]):
            path = below + above[k]
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = _leaf(r, text)
            for at, others in path:
                node = _h(*others[:at], node, *others[at:])
            proof = _h(*[o for _, others in path for o in others])
            out.append((r[0], _leaf(r, r[1]), built[x][0], root, proof, node, node == root))
    return out


def _rows(rng, counts):
    rows, i = [], 0
    for lang, n in counts:
        for _ in range(n):
            i += rng.randint(1, 3)
            rows.append((i, rng.choice(["Some Text", "plain", "ÉÀ Zz", "", None, "日本 A"]), lang, rng.choice(["s", None, "web é"]), rng.choice([None, 5, 12])))
    rng.shuffle(rows)
    return rows


_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _check(spark, rows, tmp_path, name):
    df = spark.createDataFrame(rows, _SCHEMA).selectExpr("*", "1 as place", "'x' as tree", "2 as n", "3 as _part", "4 as digest")
    df.repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    got = [tuple(r) for r in queries.op12_manifest(spark, f"{tmp_path}/{name}").collect()]
    assert sorted(got, key=str) == sorted(_plain(rows), key=str)


def test_equals_plain(spark, tmp_path):
    rng = random.Random(1)
    rows = _rows(rng, [("en", 150), (None, 9), ("de", 8), ("zz", 1), ("", 2), ("é", 65)])
    rows += [rows[0], rows[0], (None, "null id Aa", "en", None, None), (None, "null id Aa", "en", None, None), (rows[1][0], "same id, Other", rows[1][2], "s", 1)]
    rows.append((10_000, "Long Text " * 100_000, "en", "s", 1_000_000))
    _check(spark, rows, tmp_path, "mixed")


def test_many_languages_and_one(spark, tmp_path):
    rng = random.Random(2)
    _check(spark, _rows(rng, [(f"l{i}", rng.randint(1, 10)) for i in range(11)]), tmp_path, "many")
    _check(spark, _rows(rng, [("en", 1)]), tmp_path, "one")
    # A third of all rows are equal.
    rows = _rows(rng, [("en", 60)])
    _check(spark, rows + [rows[0]] * 30, tmp_path, "copies")


def test_empty_and_some_requests(spark):
    empty = spark.createDataFrame([], _SCHEMA)
    assert M.manifest(empty).count() == 0
    p = M.ManifestParams(fan_out=2)
    leaves = spark.range(11).select(F.lit(4).cast("long").alias("tree"), F.col("id").alias("place"), F.lit(11).cast("long").alias("n"), M.digest(F.col("id").cast("string")).alias("digest"))
    store = M.levels(leaves, p)
    assert len(store) == 4
    start = M.tops(leaves, store).withColumn("path", F.array().cast(M._PATH))
    asked = spark.createDataFrame([(4, 0, "a"), (4, 10, "b"), (4, 10, "c"), (4, 11, "none"), (5, 0, "none")], "tree long, place long, who string")
    found = M.descend(start, store, asked, p)
    root = start.first()["digest"]
    got = {r["who"]: r for r in found.withColumn("up", M.folded(F.col("digest"), F.col("path"))).collect()}
    assert set(got) == {"a", "b", "c"} and all(r["up"] == root for r in got.values())
    assert got["a"]["digest"] == _h("0") and len(got["a"]["path"]) == 4
