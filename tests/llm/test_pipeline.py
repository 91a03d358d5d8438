"""Each stage of the pipeline on its own input, against plain Python."""

import collections
import importlib
import random
import re

from .plain import brute_components, kn_ratios, logistic_cut, rule_counts


def _documents():
    """Clean, toxic, junk and near-copied documents of good hosts, and of one host that is mostly junk."""
    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in "bdfgklmp" for b in "aeiou" for c in "lmnrst"]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    docs, toxic = [], {}
    for i in range(700):
        text = some(rng.randrange(40, 120))
        toxic[i] = int(i % 7 == 0)
        for _ in range(5 * toxic[i]):
            text.insert(rng.randrange(len(text)), rng.choice(["vile", "scummy", "rotten"]))
        docs.append((i, " ".join(text), f"h{i % 4}"))
    for i in range(700, 760):
        docs.append((i, "buy now cheap pills " * 12 if i % 5 else " ".join(some(60)), "junk"))
    for i in range(760, 800):
        text = docs[i - 700][1].split()
        text[rng.randrange(len(text))] = "changed"
        docs.append((i, " ".join(text), "h1"))
    docs += [(800, None, "h2"), (801, "", "h2"), (802, docs[5][1], "h3"), (803, "short text", None)]
    return docs, toxic


def test_stages_against_plain_python(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    from assayline.llm.mixing import targets

    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "mixing", "packing"]
    docs, toxic = _documents()
    labels = [(i, t) for i, t in toxic.items() if i % 3]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    got = {}
    for name, stage in pipeline.STAGES[:-1]:
        before = {r["doc_id"]: (r["text"], r["source"]) for r in now.collect()}
        now = pipeline.written(stage(spark, now, str(tmp_path)), name)
        got[name] = before, collections.Counter(r["doc_id"] for r in now.collect())

    before, kept = got["toxicity"]
    scores = kn_ratios({i: t for i, (t, _) in before.items()}, dict(labels))
    rejected = logistic_cut(scores, dict(labels))
    assert set(kept) == {i for i in before if not rejected(i)}
    assert set(kept) == {i for i, (t, _) in before.items() if not re.search("vile|scummy|rotten", t or "")}

    before, kept = got["quality"]
    counts = {i: rule_counts(t) for i, (t, _) in before.items()}
    failed = {i: c[0] < 10 or 100 * c[4] > 20 * c[0] for i, c in counts.items()}
    hosts = collections.defaultdict(list)
    for i, (_, s) in before.items():
        hosts[s].append(failed[i])
    rates = {s: sum(v) / len(v) for s, v in hosts.items()}
    m = sum(failed.values()) / len(failed)
    v = sum((r - sum(rates.values()) / len(rates)) ** 2 for r in rates.values()) / len(rates)
    strength = min(1000, max(1, m * (1 - m) / v - 1))
    ok = {s: (sum(v) + m * strength) / (len(v) + strength) <= 0.5 for s, v in hosts.items()}
    assert set(kept) == {i for i in before if not failed[i] and ok[before[i][1]]} and not ok["junk"]

    before, kept = got["near_duplicates"]
    assert kept == collections.Counter(i for i, (_, c) in brute_components([(i, t) for i, (t, _) in before.items()]).items() if i == c)

    before, kept = got["mixing"]
    sizes = {i: rule_counts(t)[0] for i, (t, _) in before.items()}
    sources = sorted({s for _, s in before.values() if s is not None}) + [None] * any(s is None for _, s in before.values())
    held = [sum(sizes[i] for i, (_, x) in before.items() if x == s) for s in sources]
    goal = targets(held, [1 + k % 3 for k in range(len(sources))], 3)
    for s, g in zip(sources, goal):
        taken = sum(n * sizes[i] for i, n in kept.items() if before[i][1] == s)
        assert abs(taken - g) <= 0.02 * g and max(n for i, n in kept.items() if before[i][1] == s) <= 3

    packed = pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert sum(r["size"] for r in packed) == sum(n * sizes[i] for i, n in kept.items())
    bins = collections.defaultdict(list)
    for r in packed:
        bins[r["bin_id"]].append(r)
    for rows in bins.values():
        assert sum(r["size"] for r in rows) == rows[0]["bin_fill"] <= 2048
        assert len({r["source"] for r in rows}) == len({r["cluster"] for r in rows}) == len(rows)


def test_run_on_given_tables(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    assert pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
