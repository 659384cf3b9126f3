"""Ranking beyond one block of cases, and with ids that a double can't hold."""

from helixframe.operators import ranking


def test_large_ids_and_several_blocks(spark, monkeypatch):
    big = (1 << 62) + 12345
    closed = spark.createDataFrame([(t, a) for t in "ab" for a in (t, "root")], "term string, ancestor string")
    ic = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("root", 0.0)], "ancestor string, ic double")
    rows = [(big + i, a, 1.0) for i in range(5) for a in ("a", "root")] + [(-7, "a", 1.0), (3, "b", 1.0)]
    carried = spark.createDataFrame(rows, "disease long, ancestor string, freq double")
    cases = spark.createDataFrame([(f"c{i}", "ab"[i % 2], "present") for i in range(20)], "case_id string, term string, status string")
    one = {(r.case_id, r["rank"]): (r.disease, r.score, r.tied) for r in ranking.rank(cases, closed, carried, ic, 4).collect()}
    assert [one["c0", k][0] for k in range(1, 5)] == [big + 4, big + 3, big + 2, big + 1] and one["c0", 1][2] == 6 and one["c1", 1][0] == 3
    monkeypatch.setattr(ranking, "CASES", 6)
    assert {(r.case_id, r["rank"]): (r.disease, r.score, r.tied) for r in ranking.rank(cases, closed, carried, ic, 4).collect()} == one


def test_a_case_costs_its_own_ancestors_and_not_all_of_the_block(monkeypatch):
    import numpy as np
    from pyspark.sql import Row

    up = lambda t: [Row(ancestor=t, ic=2.0), Row(ancestor="root", ic=0.5)]
    block = ranking.Block([Row(case_id=f"c{i}", term=f"t{i}", status="present", up=up(f"t{i}")) for i in range(50)])
    carried, absent = np.full((3, len(block.names)), np.nan), np.zeros((3, len(block.names)), bool)
    carried[0, block.own[0]], carried[1, block.names.index("root")], absent[2, block.own[0]] = 0.5, 0.25, True
    seen, log = [], np.log
    monkeypatch.setattr(ranking.np, "log", lambda x: seen.append(np.size(x)) or log(x))
    ic, exact, freq = block.best(carried)
    got = ranking.likelihood_with_penalties(block, 0, ic[[0]], exact[[0]], freq[[0]], carried, absent)
    assert np.allclose(got, [2 + log(0.5), 0.5 + log(0.25), ranking.ABSENT]) and sum(seen) <= 12  # 153 for all ancestors of the block


def test_once_a_case_has_its_top_only_what_reaches_it_is_looked_at(monkeypatch):
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import Row

    rng = np.random.default_rng(7)
    names = [f"a{i}" for i in range(12)]
    ic = {n: float(rng.integers(0, 4)) / 2 for n in names}  # with ties, and ancestors that say more than what is below them
    up = {t: [Row(ancestor=a, ic=ic[a]) for a in sorted({t, *rng.choice(names, 4)}) if ic[a] > 0] for t in names}
    rows = [Row(case_id=f"c{c}", term=t, status="present", up=up[t]) for c in range(3) for t in sorted(rng.choice(names, 4, replace=False))]
    sets = [sorted(rng.choice(names, rng.integers(1, 6), replace=False)) for _ in range(3000)]
    freqs = [[float(x) / 8 for x in rng.integers(1, 9, len(s))] for s in sets]
    seen, add = [], ranking._Best.add
    monkeypatch.setattr(ranking._Best, "add", lambda self, r: seen.append(len(r)) or add(self, r))
    monkeypatch.setattr(ranking, "MOST_ROWS", 256)
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array(sets), pa.array(freqs)], ["disease", "ancestors", "freqs"])
    shared = type("Shared", (), {"value": rows})  # what is sent are plain rows, which a worker reads without this package
    for score in (ranking.resnik, ranking.likelihood(0.01)):
        got = {}
        for b in ranking._scorer(shared, 5, score)(iter([batch])):
            for r in b.to_pylist():
                got.setdefault(r["case_id"], []).append((r["score"], r["exact"], r["specificity"], r["disease"], r["same"]))
        for case in ("c0", "c1", "c2"):
            mine, every = [r for r in rows if r.case_id == case], []
            for d, (s, f) in enumerate(zip(sets, freqs, strict=True)):
                has = dict(zip(s, f, strict=True))
                met = [max((x.ic, int(x.ancestor == r.term), has[x.ancestor]) for x in r.up if x.ancestor in has) for r in mine if any(x.ancestor in has for x in r.up)]
                if met:
                    total = sum(m[0] for m in met) / len(mine) if score is ranking.resnik else sum(max(0.0, m[0] + np.log(m[2])) for m in met)
                    every.append((round(total, 6), sum(m[1] for m in met), round(sum(m[0] for m in met) / len(met), 6), d))
            best = sorted(every, reverse=True)[:5]
            assert [tuple(np.round(g[:4], 6)) for g in got[case]] == [tuple(np.round(b, 6)) for b in best]
            first = {g[0]: g[4] for g in reversed(got[case])}
            assert all(first[v] == sum(abs(e[0] - v) < 1e-9 for e in every) for v in first)
    assert sum(seen) < 2 * 3 * 3000 / 4  # all of them before


def test_annotations_of_a_disease_are_carried_up_where_they_lie(spark):
    import re

    from helixframe.operators import ontology
    from helixframe.plans import projections as P

    sf = "/root/testdata/sf0.001"
    diseases = ranking.by_disease(ontology.disease_closure(P.annotations(spark, sf), ontology.closure(P.ontology_edges(spark, sf))))
    plan = diseases._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(disease", plan)) <= 1  # that of `spread`, a single partition on small tables
