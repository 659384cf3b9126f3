"""Partners of compound heterozygotes against all pairs."""

import random

from helixframe.operators import triage


def test_partners_against_all_pairs(spark):
    random.seed(8)
    rows = []
    for gene in range(5):
        for pos in random.sample(range(1, 2_000_000), 60):
            ps = random.choice([None, 1, 2, 3])
            rows.append((gene, pos if ps != 3 else pos % 100_000 + 100_000 * gene, random.choice(["inherited_het"] * 6 + ["hom_alt"]), random.choice(["mat", "pat", None, None]), ps, random.randint(0, 1), random.choice([0.01, 0.05, 0.2])))
    rows = list({(r[0], r[1]): r for r in rows}.values())
    v = spark.createDataFrame(rows, "gene int, pos long, cls string, origin string, phase_set int, hap int, af double")
    got = {(r.gene, r.pos): (r.n_trans, r.first_trans, r.last_trans, r.n_unknown) for r in triage.partners(v).collect()}
    het = [r for r in rows if r[2] == "inherited_het" and r[6] <= triage.RECESSIVE_AF]
    trusted = {}
    for g, p, _, _, ps, _, _ in het:
        low, high = trusted.get((g, ps), (p, p))
        trusted[g, ps] = min(low, p), max(high, p)
    want = {}
    for a in het:
        trans, unknown = [], 0
        for b in het:
            if a[0] != b[0] or a[1] == b[1]:
                continue
            low, high = trusted[a[0], a[4]]
            if a[3] and b[3]:
                trans += [b[1]] * (a[3] != b[3])
            elif a[4] is not None and a[4] == b[4] and high - low <= triage.TRUSTED:
                trans += [b[1]] * (a[5] != b[5])
            else:
                unknown += 1
        want[a[0], a[1]] = (len(trans), min(trans, default=None), max(trans, default=None), unknown)
    assert got == want and sum(t[3] > 0 for t in want.values()) > 20 and any(high - low > triage.TRUSTED for low, high in trusted.values())


def test_partners_are_looked_up_in_two_tables(spark):
    rows = [(1, 10, "inherited_het", "mat", None, 0, 0.0), (1, 20, "inherited_het", "pat", 5, 1, 0.0), (1, 30, "inherited_het", None, 5, 0, 0.0), (1, 40, "hom_alt", "mat", 5, 1, 0.0), (1, 50, "inherited_het", "pat", 5, 1, 0.5)]
    v = spark.createDataFrame(rows, "gene long, pos long, cls string, origin string, phase_set long, hap long, af double")
    df = triage.partners(v)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2  # none by position, and none for each kind of count
    assert sorted(map(tuple, df.collect())) == [(1, 10, 1, 20, 20, 1), (1, 20, 2, 10, 30, 0), (1, 30, 1, 20, 20, 1)]
    assert triage.partnered(v).where("n_trans IS NULL").count() == 2
