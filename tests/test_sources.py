import json
import zipfile

from pyspark.sql import functions as F

from spanwise.sources import readers

GOOD = "the council of the town said that it would open the new bridge in the spring of next year"


def test_lines_of_tables_and_texts(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f'id,summary\n1,"{GOOD}, ""quoted"""\n2,\n')
    (tmp_path / "b.txt").write_text(f"{GOOD}\n\n  \nother\n")
    (tmp_path / "c.tsv").write_text("x\ty\nfirst\tsecond\n")
    assert [r["line"] for r in readers.corpus_lines(spark, str(tmp_path / "a.csv")).collect()] == [f'{GOOD}, "quoted"']
    assert [r["line"] for r in readers.corpus_lines(spark, str(tmp_path / "b.txt")).collect()] == [GOOD, "other"]
    assert [r["line"] for r in readers.corpus_lines(spark, str(tmp_path / "c.tsv"), "y").collect()] == ["second"]
    assert readers.corpus_lines(spark, str(tmp_path / "b.txt"), most=1).count() == 1


def test_structured_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("summary_ref,extra,xsum_id\ns,1,9\n")
    df = readers.structured_rows(spark, str(tmp_path / "a.csv"))
    assert df.columns == list(readers.CORPUS_COLUMNS) and df.first()["xsum_id"] == "9" and df.first()["document"] is None
    assert readers.structured_rows(spark, str(tmp_path / "none.csv")).count() == 0


def test_extraction_by_kind(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text("\n".join([json.dumps({"xsum_id": "1", "summary": GOOD + " one"}), json.dumps({"summary": GOOD + " none"}), "{broken", ""]))
    (tmp_path / "in/b.csv").write_text(f"id,pred_text\n1,{GOOD} two\n2,{GOOD} two\n")
    (tmp_path / "in/c.txt").write_text(f"{GOOD} three\nshort\n")
    (tmp_path / "in/e.txt").write_text("")
    with zipfile.ZipFile(tmp_path / "in/d.zip", "w") as z:
        z.writestr("x/f.txt", f"{GOOD} four\n")
    files = readers.raw_files(spark, str(tmp_path / "in"))
    got = {r["line"].rsplit(" ", 1)[1] for r in readers.extract(files, require=("xsum_id",)).collect()}
    assert got == {"one", "two", "three", "four"}
    assert {r["category"] for r in readers.artefacts(spark, str(tmp_path)).collect()} == {"in"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("m", 1), ("n", 2)], "model_id string, x long")
    readers.write_rows(df, str(tmp_path / "run"))
    readers.write_rows(df.where("model_id = 'n'").withColumn("x", F.lit(5).cast("long")), str(tmp_path / "run"))
    assert {(r["model_id"], r["x"]) for r in spark.read.parquet(str(tmp_path / "run")).collect()} == {("m", 1), ("n", 5)}
    readers.write_journal(df, str(tmp_path / "log"))
    readers.write_journal(df, str(tmp_path / "log"))
    assert readers.summaries(spark, str(tmp_path / "log"), "model_id string, x long").count() == 4
    assert readers.summaries(spark, str(tmp_path / "missing"), "x long").count() == 0
    readers.write_csv(df, str(tmp_path / "csv"), ["x"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["x"]
    assert [r["model_id"] for r in readers.unscored(df, df.where("x = 1"), ["model_id"]).collect()] == ["n"]
