import os
import zipfile

import pytest

from textloom.sources import fetch


def test_files_come_once_and_whole(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a" * 3_000_000)
    rows = [(f"file://{tmp_path}/a.txt", "a.txt"), (f"file://{tmp_path}/gone.txt", "gone.txt")]
    files = spark.createDataFrame(rows, "url string, name string")
    out = tmp_path / "out"
    first = {r.name: r for r in fetch.fetch(files, f"file://{out}", attempts=2, wait=0.01).collect()}
    assert (first["a.txt"].bytes, first["a.txt"].skipped, first["a.txt"].error) == (3_000_000, False, None)
    assert first["gone.txt"].bytes is None and "gone" in first["gone.txt"].error
    assert os.listdir(out) == ["a.txt"]  # no part is left
    (tmp_path / "a.txt").write_text("changed")
    again = {r.name: r for r in fetch.fetch(files, f"file://{out}", attempts=1, wait=0.01).collect()}
    assert again["a.txt"].skipped and (out / "a.txt").stat().st_size == 3_000_000


def test_archives_stay_in_their_folder(spark, tmp_path):
    for name, names in (("good", ["x/y.txt", "z.txt"]), ("bad", ["../out.txt"])):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for n in names:
                z.writestr(n, n)
    assert fetch.unpack(spark, f"file://{tmp_path}/good.zip", f"file://{tmp_path}/good") == ["x/y.txt", "z.txt"]
    assert (tmp_path / "good/x/y.txt").read_text() == "x/y.txt"
    with pytest.raises(ValueError):
        fetch.unpack(spark, f"file://{tmp_path}/bad.zip", f"file://{tmp_path}/bad")
