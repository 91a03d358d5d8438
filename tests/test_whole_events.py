"""The label and score views against plain Python over every row of their tables."""

from collections import Counter, defaultdict

from assayline.operators.labels import PRECEDENCE
from assayline.plans import index_queries as IQ, model_queries as MQ, ranking_queries as RQ

SF = "/root/testdata/sf0.001"
CODES = {"signup": "V3", "purchase": "V2", "error": "F0", "click": "V1"}


def _events(spark):
    for r in spark.read.parquet(f"{SF}/events.parquet").collect():
        gene = None if r["user_id"] % 11 == 0 else f"GENE{r['user_id']}"
        direction = "sensitization" if r["event_id"] % 2 else "resistance"
        yield f"SC{r['user_id'] % 4}", f"C{r['user_id'] % 2}", gene, direction, CODES.get(r["event_type"], "T")


def _resolved(codes):
    if codes & {"V2", "V3"} and codes & {"F0", "D"}:
        return "A"
    return next(c for c in PRECEDENCE if c in codes)


def test_labels_of_all_events(spark):
    events = list(_events(spark))
    by_screen, by_key = defaultdict(set), defaultdict(list)
    for s, c, g, d, code in events:
        by_screen[s].add(code)
        if g is not None:
            by_key[s, c, g, d].append(code)
    assert {tuple(r) for r in RQ.al1_resolve_labels(spark, SF).collect()} == {(s, _resolved(v)) for s, v in by_screen.items()}
    got = {tuple(r[k] for k in ("screen_id", "contrast_id", "gene_symbol", "phenotype_direction")): (r["label_code"], r["n_events"]) for r in RQ.al2_adjudicate(spark, SF).collect()}
    assert got == {k: (_resolved(set(v)), len(v)) for k, v in by_key.items()}
    target = {"V2": 1, "V3": 1, "F0": 0}
    assert {tuple(r) for r in RQ.p08_model_target(spark, SF).collect()} == {(c, n, target.get(c)) for c, n in Counter(e[4] for e in events).items()}


def test_recurrence_of_all_events(spark):
    per = {}
    for _, _, g, d, code in _events(spark):
        if g is not None:
            per[g, code] = max(d, per.get((g, code), d))
    groups, alike = Counter(g for g, _ in per), Counter((g, d) for (g, _), d in per.items())
    want = {(g, c): (groups[g] - 1, round((alike[g, d] - 1) / (groups[g] - 1), 6) if groups[g] > 1 else None) for (g, c), d in per.items()}
    assert {(r[0], r[1]): (r[2], r[3]) for r in MQ.d03_recurrence(spark, SF).collect()} == want


def test_score_metadata_of_all_suppliers(spark):
    keys = {r["s_suppkey"] for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()}
    rows = {int(r[0]): tuple(r)[1:] for r in IQ.score_meta(spark, SF).collect()}
    assert rows.keys() == keys
    assert all((v == (None, None, None)) == (k % 10 == 0) for k, v in rows.items())
