from textloom.__main__ import main
from textloom.operators import checkpoints
from textloom.sources import suites


def test_numbers_of_files(spark):
    df = spark.createDataFrame([("a_9.pt",), ("a_10.pt",), ("odd",)], "p string")
    r = checkpoints.latest(df, "p").first()
    assert (r.path, r.step) == ("a_10.pt", 10)
    assert checkpoints.latest(df.where("p = 'odd'"), "p").first().step == -1
    assert checkpoints.flops_per_token(100, 10, 2, 3, 4, 5) == 6 * 90 + 12 * 120


def test_suites(spark):
    assert suites.completions(spark).count() and suites.knowledge(spark).count() and suites.conversations(spark).count()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "c.json").write_text('[{"messages": [["u", "a"], ["a", "b"]]}, {"messages": []}]')
    main(["ingest", f"{tmp_path}/c.json", f"{tmp_path}/out"])
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1
    main(["calculator", "20", f"{tmp_path}/calc"])
    assert spark.read.parquet(f"{tmp_path}/calc").count() == 20
    main(["list"])
    assert "pack_linear" in capsys.readouterr().out
