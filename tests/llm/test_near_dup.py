import itertools
import random
import re

from pyspark.sql import functions as F

from assayline.llm.near_dup import NearDupParams, near_duplicates


def _sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) >= 5:
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    return {tuple(words)} if words else set()


def _brute(docs):
    sets = {i: _sets(t) for i, t in docs}
    comp = {i: i for i in sets}

    def find(a):
        while comp[a] != a:
            a = comp[a]
        return a

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        both = len(x & y)
        if x and y and 100 * both >= 75 * (len(x) + len(y) - both):
            lo, hi = sorted((find(a), find(b)))
            comp[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in sets}


def _documents():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    docs = []
    for i in range(90):  # one large group of copies with edits, some of which link only through others
        own = list(base)
        for _ in range(i % 9):
            own[rng.randrange(len(own))] = rng.choice(words)
        docs.append(" ".join(own))
    passage = " ".join(rng.choice(words) for _ in range(60))
    docs += [passage + " " + " ".join(rng.choice(words) for _ in range(60)) for _ in range(40)]
    docs += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(40)]
    docs += ["", "  \n", None, "one two", "One  TWO", "one two three four five", "x " * 3000, "X " * 2999, docs[3], docs[3].upper()]
    rng.shuffle(docs)
    return list(enumerate(docs, 10))


def test_against_all_pairs(spark):
    docs = _documents()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for params in (NearDupParams(), NearDupParams(block=16)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, params).collect()}
        assert got == _brute(docs)


def test_nulls_ties_and_extra_columns(spark):
    rows = [(None, "a b c d e", 1, 1), (5, "a b c d e", 1, 1), (7, "A B c d e", 1, 1), (7, "A B c d e", 1, 1), (9, None, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles int, rep int")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 5, True), (7, 5, False), (7, 5, False), (9, 9, True), (None, None, True)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0


def test_pairs_whose_stars_point_elsewhere(spark):
    """Pairs (a, b) that only buckets of two hold, where b shares single bands with unrelated lower ids."""
    rng = random.Random(8)

    def some(n):
        return [f"v{rng.randrange(100000)}" for _ in range(n)]

    ids = [r[0] for r in spark.range(100, 4000).orderBy(F.xxhash64("id")).collect()]
    docs, free = [], iter(range(0, 3900, 3))
    for k in free:
        if len(docs) >= 600:
            break
        c, a, b = ids[k : k + 3]
        if not c < a < b:
            continue
        body, passage = some(140), some(26)
        docs += [(c, " ".join(passage + some(8))), (a, " ".join(body)), (b, " ".join(body + passage))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = _brute(docs)
    assert sum(component != i for i, (_, component) in want.items()) == len(docs) // 3
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df).collect()} == want
