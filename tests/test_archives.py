"""Archives written here, with broken members among them."""

import json
import zipfile

import pytest

from helixframe.sources import archives


def packet(i, present=("HP:0000001",), disease=True):
    out = {"id": f"p{i}", "subject": {"id": "x"}, "phenotypicFeatures": [{"type": {"id": t}} for t in present] + [{"type": {"id": "HP:0000009"}, "excluded": True}]}
    return json.dumps(out | ({"diseases": [{"term": {"id": f"OMIM:{i}"}}]} if disease else {}))


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("archive") / "all.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(50):
            z.writestr(f"top/cohort/{i}.json", packet(i, present=(f"HP:{i:07d}", "HP:0000001")))
        z.writestr("top/none.json", packet(900, disease=False))
        z.writestr("top/absent.json", packet(901, present=()))
        z.writestr("top/text.json", "{no json")
        z.writestr("top/latin.json", b'{"a": "\xff"}')
        z.writestr("top/other.json", '{"a": 1}')
        z.writestr("top/broken.json", packet(902) + " " * 5000)
        z.writestr("top/notes.txt", "not a packet")
        z.writestr("top/empty.json", "")
        z.writestr("top/large.json", packet(903) + " " * 300_000)
        at = z.getinfo("top/broken.json")
    with open(path, "r+b") as f:  # spoil the middle of the member's data
        f.seek(at.header_offset + 30 + len(at.filename) + at.compress_size // 2)
        f.write(b"\xff" * 8)
    return path


def test_members_are_rows_in_partitions(spark, archive):
    m = archives.read_members(spark, archive, ".json", 2_000)
    assert m.rdd.getNumPartitions() > 3
    rows = {r.member: r for r in m.collect()}
    assert len(rows) == 58 and rows["top/cohort/7.json"].value == packet(7, present=("HP:0000007", "HP:0000001")) and rows["top/cohort/7.json"].archive == archive
    assert rows["top/broken.json"].why == "broken member" and rows["top/broken.json"].value is None and rows["top/latin.json"].why == "not UTF-8"
    assert archives.read_members(spark, f"file://{archive}", ".txt").collect()[0].value == "not a packet"


def test_cases_and_reasons(spark, archive):
    found = archives.cases(archives.read_members(spark, archive, ".json"))
    good = {r.case: r for r in found.where("why IS NULL").collect()}
    assert len(good) == 51 and good["cohort/7.json"].disease == "OMIM:7" and good["cohort/7.json"].present == ["HP:0000007", "HP:0000001"] and good["cohort/7.json"].excluded == ["HP:0000009"]
    assert good["large.json"].n_present == 1
    assert {r.why: r.n for r in archives.skipped(found).collect()} == {"broken member": 1, "not UTF-8": 1, "not JSON": 2, "no diagnosis": 1, "no present term": 1, "not a phenopacket": 1}


def test_runs_of_members():
    assert archives.dealt([("a", 3), ("b", 3), ("c", 9), ("d", 1), ("e", 1)], 6) == [["a", "b"], ["c"], ["d", "e"]]
    assert archives.dealt([], 6) == []


def test_not_an_archive(spark, tmp_path):
    (tmp_path / "x.zip").write_bytes(b"no zip")
    with pytest.raises(Exception, match="zip"):
        archives.read_members(spark, str(tmp_path / "x.zip")).collect()
