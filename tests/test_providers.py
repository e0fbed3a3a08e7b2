import pytest
from pyspark.sql import functions as F

from spanwise.sources import providers


def test_render(spark):
    df = spark.createDataFrame([("a {b}", None)], "x string, y string")
    assert df.select(providers.render("Q: {p} / {q}", p=F.col("x"), q=F.col("y"))).first()[0] == "Q: a {b} / "
    with pytest.raises(ValueError):
        providers.render("{p}", q=F.col("x"))
    assert providers.chosen_template({"k": "t"}, "k", "D") == "t" and providers.chosen_template({}, "see {D}", "D") == "see {D}"
    with pytest.raises(ValueError):
        providers.chosen_template({}, "none", "D")


def test_replay_and_calls(spark):
    prompts = spark.createDataFrame([(1, "p"), (2, "q"), (3, None)], "id long, prompt string")
    stored = spark.createDataFrame([("p", "late", 2), ("p", "first", 1)], "prompt string, answer string, at int")
    assert {r["id"]: r["answer"] for r in providers.replayed(prompts, stored).collect()} == {1: "first", 2: None, 3: None}

    def call(p):
        if p != "p":
            raise RuntimeError("Bearer secret")
        return p.upper()

    got = {r["id"]: (r["answer"], r["status"]) for r in providers.answered(prompts, call).collect()}
    assert got[1] == ("P", "ok") and got[2] == (None, "api_error: Bearer [REDACTED]")


def test_command_line(spark, small, tmp_path, capsys, monkeypatch):
    import cli

    cli.main(["list"])
    assert "slex_items" in capsys.readouterr().out
    cli.main(["run", "source_counts", small, str(tmp_path / "out"), "--format", "csv"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() > 0
