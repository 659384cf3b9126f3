"""Envelopes under a budget: valid, never too long, cut where they should be."""

import json
import math

import pytest
from pyspark.sql import functions as F

from helixframe.sources import envelopes

SCHEMA = "id int, query string, sources array<struct<name:string,url:string>>, result struct<score:double,genes:array<struct<gene:string,af:double>>,more:struct<tags:array<string>,note:string>>"


def made(i, genes, tags, sources, query="q", note="n"):
    return (i, query, [(f"source {k}", f"https://x.org/{k}") for k in range(sources)], (1.5 if i % 2 else math.nan, [(f"G{k}é", math.inf if k == 1 else k / 7) for k in range(genes)], ([f"tag {k} \"quoted\"" for k in range(tags)], note)))


ROWS = [made(0, 3, 2, 2), made(1, 60, 20, 3), made(2, 5, 90, 3), made(3, 40, 40, 60), made(4, 0, 0, 200), made(5, 2, 2, 2, query="x" * 5000), made(6, 2, 2, 1, note="y" * 9000), (7, None, None, None), (8, "q", [], (None, None, (["a" * 4000], None)))]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return {b: {r.id: r for r in envelopes.enveloped(df, F.lit(b)).collect()} for b in (400, 1500, 100_000)}


def test_valid_and_never_over_budget(found):
    for budget, rows in found.items():
        assert len(rows) == len(ROWS)
        for r in rows.values():
            assert len(r.json.encode()) <= budget
            assert set(json.loads(r.json)) == {"query", "warnings", "sources", "result"}


def test_nothing_is_cut_that_fits_and_numbers_are_finite(found):
    for i, r in found[100_000].items():
        j = json.loads(r.json)
        assert j["warnings"] == [] and j["query"] == ROWS[i][1]
        if ROWS[i][3] and ROWS[i][3][1]:
            assert len(j["result"]["genes"]) == len(ROWS[i][3][1]) and all(g["af"] is None or math.isfinite(g["af"]) for g in j["result"]["genes"])
    assert json.loads(found[100_000][0].json)["result"]["score"] is None


def test_the_longest_list_goes_first_and_as_little_as_needed(found):
    one, two = json.loads(found[1500][1].json), json.loads(found[1500][2].json)
    assert 0 < len(one["result"]["genes"]) < 60 and len(one["result"]["more"]["tags"]) == 20 and len(one["sources"]) == 3
    assert 0 < len(two["result"]["more"]["tags"]) < 90 and len(two["result"]["genes"]) == 5
    assert two["warnings"] == [f"result.more.tags: {90 - len(two['result']['more']['tags'])} of 90 items dropped"]
    two["result"]["more"]["tags"].append("tag 99 \"quoted\"")
    assert len(json.dumps(two, separators=(",", ":"), ensure_ascii=False).encode()) + 4 > 1500


def test_provenance_goes_last_or_where_it_is_most(found):
    alone, both = json.loads(found[1500][4].json), json.loads(found[1500][3].json)
    assert 0 < len(alone["sources"]) < 200 and alone["result"] is not None
    assert len(both["sources"]) < 60  # it took more than half the budget, and more than any list
    assert len(json.loads(found[1500][1].json)["sources"]) == 3


def test_what_has_no_list_to_cut(found):
    assert json.loads(found[1500][5].json)["query"] == "x" * (1500 // 16)
    assert json.loads(found[1500][6].json)["result"] is None and json.loads(found[1500][6].json)["warnings"] == ["result dropped"]
    assert json.loads(found[1500][7].json) == {"query": None, "warnings": [], "sources": None, "result": None}
    assert json.loads(found[1500][8].json)["result"]["more"]["tags"] == []
