import collections
import random
import re
import zlib

import pytest

from assayline.llm.host_rules import COUNTS, HostRuleParams, host_rules
from assayline.llm.toxicity import toxicity

WORD = r"[^\x20\x09-\x0D]+"


def _counts(text):
    text = text or ""
    words = re.findall(WORD, text)
    seen = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))


def test_counts_and_verdicts(spark):
    texts = ["", None, "a b\n a b\na b\n\n \n", "é ñ <b> # 漢字 x", "one two three four five six " * 3, "z " * 5000, "a\x0bb\x0cc\rd\te", "\x85 \xa0x"]
    rng = random.Random(1)
    texts += [" ".join(rng.choice("abcde") for _ in range(60)) for _ in range(20)]
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, t, "mixed") for i, t in enumerate(texts)] + [(100 + i, good, "good") for i in range(20)] + [(200 + i, "bad", "bad") for i in range(50)]
    rows += [(300 + i, good, "bad") for i in range(3)] + [(400, good, None), (401, good, ""), (None, good, "good"), (100, good, "good")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as n_words", "2 as kept")
    got = host_rules(df).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, t, _ in rows:
        if i is not None:
            assert tuple(by_id[i][c] for c in COUNTS) == _counts(t), (i, t)
            n = _counts(t)
            assert by_id[i]["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0])
    assert by_id[101]["kept"] and by_id[400]["kept"] and not by_id[301]["kept"] and by_id[301]["host_rate"] > 0.5
    fails = {s: [n for n in rows if n[2] == s] for s in ("good", "bad", "mixed", None, "")}
    rates = [sum(_counts(r[1])[0] < 10 or 100 * _counts(r[1])[4] > 20 * _counts(r[1])[0] for r in v) for v in fails.values()]
    m, each = sum(rates) / len(rows), [f / len(v) for f, v in zip(rates, fails.values())]
    v = sum((x - sum(each) / 5) ** 2 for x in each) / 5
    strength = min(1000, max(1, m * (1 - m) / v - 1))
    assert by_id[301]["host_rate"] == pytest.approx((rates[1] + m * strength) / (len(fails["bad"]) + strength))
    assert host_rules(df.limit(0)).count() == 0
    assert host_rules(df, HostRuleParams(max_host_rate=1.0)).where("doc_id = 301 and kept").count() == 1


def _corpus(n=1500):
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    bad = ["vile", "scummy", "rotten"]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        toxic = int(i % 6 == 0)
        for _ in range(4 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        docs.append((i, " ".join(text)))
        labels.append((i, toxic))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = _corpus()
    df = spark.createDataFrame([*docs, (9001, ""), (9002, None), (None, "vile rotten vile")], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (9003, None)], "doc_id long, toxic int")
    got = toxicity(df, lab).collect()
    assert len(got) == len(docs) + 3 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert {r["doc_id"]: r for r in got}[9001]["predicted"] == 0


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [r["score"] for r in toxicity(df, spark.createDataFrame([], "doc_id long, toxic int")).collect()] == [0.0, 0.0]
    assert {r["score"] for r in toxicity(df, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")).collect()} <= {0.0, 1.0}
    assert toxicity(df.limit(0), spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")).count() == 0
