"""Archives by ranges of bytes, larger than 2 GB, and the five-choice tasks in them."""

import io
import json
import zipfile

import pytest

from setweave.sources import archives, tasks


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    path = tmp_path_factory.mktemp("zip") / "many.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(400):
            z.writestr(f"d{i % 7}/f{i}.{'json' if i % 2 else 'bin'}", json.dumps({"i": i}) if i % 2 else bytes([i % 256]) * (i * 11))
    return str(path)


def test_many_tasks_share_an_archive(spark, archive):
    with zipfile.ZipFile(archive) as z:
        want = {i.filename: (i.CRC, i.file_size, z.read(i)) for i in z.infolist()}
    got = archives.contents(spark, archive, range_bytes=2000)
    assert got.rdd.getNumPartitions() > 5
    rows = got.collect()
    assert len(rows) == 400 and {r["entry"]: (r["crc32"], r["size"], bytes(r["content"])) for r in rows} == want and all(r["problem"] is None for r in rows)
    listed = archives.members(spark, archive, range_bytes=3000)
    assert {(r["entry"], r["crc32"]) for r in listed.collect()} == {(k, v[0]) for k, v in want.items()} and listed.columns == ["archive", "entry", "basename", "crc32", "size"]
    j = archives.json_members(spark, archive, "i int")
    assert sorted(r["data"]["i"] for r in j.collect()) == list(range(1, 400, 2))
    assert archives.contents(spark, archive, ".json", range_bytes=1500).count() == 200


def test_an_archive_above_two_gigabytes(spark, tmp_path):
    """A sparse file with the members at its end."""
    path = tmp_path / "large.zip"
    with open(path, "wb") as f:
        f.truncate(3 << 30)
    with zipfile.ZipFile(path, "a") as z:
        z.writestr("a/x.bin", b"x" * 1000)
        z.writestr("b/y.bin", b"y" * 2000)
    got = {r["entry"]: bytes(r["content"]) for r in archives.contents(spark, str(path), range_bytes=1 << 29).collect()}
    assert got == {"a/x.bin": b"x" * 1000, "b/y.bin": b"y" * 2000}


def test_folders_damage_and_other_files(spark, archive, tmp_path):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("good.txt", b"good" * 50)
        z.writestr("bad.txt", b"badbad" * 50)
    data = held.getvalue().replace(b"badbadbad", b"badBADbad", 1)
    (tmp_path / "one.zip").write_bytes(data)
    (tmp_path / "two.zip").write_bytes(open(archive, "rb").read())
    (tmp_path / "_SUCCESS").write_bytes(b"")
    rows = archives.contents(spark, str(tmp_path), range_bytes=100).where("archive like '%one.zip'").collect()
    told = {r["entry"]: (r["content"] is None, r["problem"]) for r in rows}
    assert told == {"good.txt": (False, None), "bad.txt": (True, "unreadable member: BadZipFile")}
    assert archives.members(spark, str(tmp_path)).count() == 402
    (tmp_path / "one.zip").write_bytes(b"no archive")
    for path in (str(tmp_path / "one.zip"), str(tmp_path / "none.zip")):
        with pytest.raises(Exception, match="BadZipFile|not a zip|none.zip"):
            archives.members(spark, path).collect()


def test_a_store_that_only_spark_reads(spark, archive, monkeypatch):
    def unknown(path):
        raise OSError("no such store")

    want = {r["entry"]: bytes(r["content"]) for r in archives.contents(spark, archive).collect()}
    monkeypatch.setattr(archives, "opened", unknown)
    assert {r["entry"]: bytes(r["content"]) for r in archives.contents(spark, archive).collect()} == want
    assert archives.members(spark, archive).count() == 400


def task_archive(path, lat, aat, pictures):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("top/LAT/label/LAT.json", json.dumps(lat))
        z.writestr("top/AAT/label/AAT.json", json.dumps(aat))
        z.writestr("__MACOSX/top/LAT/label/LAT.json", "junk")
        for p in pictures:
            z.writestr(p, b"picture")
    return str(path)


LAT = [{"quesion_num": 1, "question": ["s/9_a_1"], "answers": [f"s/9_b_{i}" for i in range(5)], "gt": 3, "gt_distribution": [0.1, 0.4, 0.1, 0.4, 0.0]}]
AAT = [{"quesion_num": "33", "question": ["q_x_7"], "answers": [f"q_x_{i}" for i in range(5)], "gt": "1"}]
PICTURES = ["top/LAT/image/a_1.jpg", *[f"top/LAT/image/b_{i}.jpg" for i in range(5)], "top/AAT/image/7.JPG", *[f"top/AAT/image/{i}.jpg" for i in range(5)]]


def test_tasks_are_read(spark, tmp_path):
    path = task_archive(tmp_path / "t.zip", LAT, AAT, [*PICTURES, "top/AAT/image/7.jpg"])
    lat = tasks.read_task(spark, path, "LAT").first()
    assert lat["question"] == ["LAT_a_1"] and lat["answers"][4] == "LAT_b_4" and (lat["archive_gt_index"], lat["majority_gt_index"], lat["dimension"]) == (2, 1, None)
    aat = tasks.read_task(spark, path, "AAT").first()
    assert aat["question"] == ["AAT_7"] and (aat["question_num"], aat["archive_gt_index"], aat["dimension"], aat["majority_gt_index"], aat["gt_distribution"]) == (33, 0, "Style", None, None)


def test_tasks_that_are_not_whole_are_errors(spark, tmp_path):
    bad = dict(LAT[0], gt_distribution=[0.5, 0.4, 0.0, 0.0, 0.0])
    for name, lat, pictures, why in (("m", LAT, PICTURES[1:], "lacks a_1.jpg"), ("d", [bad], PICTURES, "no distribution"), ("n", [dict(LAT[0], gt_distribution=None)], PICTURES, "no distribution")):
        path = task_archive(tmp_path / f"{name}.zip", lat, AAT, pictures)
        with pytest.raises(Exception, match=why):
            tasks.read_task(spark, path, "LAT").collect()
    with pytest.raises(ValueError):
        tasks.read_task(spark, path, "XAT")
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("x", b"")
    with pytest.raises(ValueError, match="0 lists"):
        tasks.read_task(spark, str(tmp_path / "e.zip"), "LAT")
