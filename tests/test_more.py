"""Records, samples, detectors, reports, tokenizers, settings and readers on cases made by hand."""

import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from spanwise.functions import report, rubrics, tokenizers
from spanwise.functions import text as tx
from spanwise.operators import corpus, detectors, records, sampling
from spanwise.plans import config
from spanwise.sources import providers, readers
from spanwise.streaming import journal

GOOD = "the council of the town said that it would open the new bridge in the spring of next year"


def col(spark, values, kind="string"):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k long, x {kind}")


def test_records_of_many_names(spark):
    raw = [
        '{"article": ["a", "b"], "tgt": "s", "bbcid": 7, "set": "TEST"}', '{"document": {"x": 1}, "text": " d ", "summary": "", "target": 3.5, "id": 0, "item_id": "i",}',
        '{"document": "about 12345678.", "summary": "s"}', '{"document": "d"}', "[1]", "{broken", "", None, '{"document": "xsum_id: 1234567 and", "summary": "s"}',
    ]
    got = {r["k"]: (r["document"], r["summary"], r["id"], r["split"]) for r in records.structured(col(spark, raw), ["k"], "x").collect()}
    assert got == {0: ("a b", "s", "7", "test"), 1: ("d", "3.5", "i", None), 2: ("about 12345678.", "s", "12345678", None), 8: ("xsum_id: 1234567 and", "s", "1234567", None)}
    assert records.structured(col(spark, raw).limit(0), ["k"], "x").count() == 0
    items = spark.createDataFrame([("7", "train"), ("i", "test")], "xsum_id string, split string")
    rows = records.with_known_split(records.structured(col(spark, raw), ["k"], "x"), items)
    assert {r["k"]: r["split"] for r in rows.collect()} == {0: "test", 1: "test", 2: None, 8: None}


def test_ids_in_texts(spark):
    texts = ["xsum_id: 1234567", "'id' = 123456789", "in 12345678 of", "123456789", None, "XSUM_ID=5"]
    got = [r[0] for r in col(spark, texts).select(corpus.record_id(F.col("x"))).collect()]
    assert got == ["1234567", "12345678", "12345678", None, None, "5"]


def test_table_rows(spark):
    df = spark.createDataFrame([(" d ", "A  summary—é", " 9 "), (None, " ", "1"), ("e", None, "2"), ("e", "x", None)], "document string, summary string, id string")
    got = records.table_rows(df, F.lit("github"), F.lit("dir/xsum_val.csv"), hinted_ids=F.array(F.lit("h"))).collect()
    assert [(r["xsum_id"], r["split"], r["document"], r["summary_ref"]) for r in got] == [("9", "validation", "d", "a summary"), ("h", "validation", "e", "x")]
    assert all(r["item_id"].startswith("gi_") and len(r["item_id"]) == 15 for r in got)
    assert records.first_text(["a", "b"]) is not None
    two = spark.createDataFrame([(" ", "t"), (None, None), ("a", "b")], "a string, b string")
    assert [r[0] for r in two.select(records.first_text(["a", "b"])).collect()] == ["t", "", "a"]


def test_hints(spark):
    ids = col(spark, ["123", "ab", ""])
    hints = col(spark, ["split of test 123", 'see id: "1234', "x123 ab_", None, "AB and 123"])
    got = {r["k"]: (r["has_split_test"], r["has_id"], r["ids"]) for r in records.hint_signals(hints, "k", "x", ids.select("x").withColumnRenamed("x", "xsum_id"), "xsum_id").collect()}
    assert got == {0: (True, True, ["123"]), 1: (False, True, ["123"]), 2: (False, False, []), 3: (False, False, []), 4: (False, True, ["123", "ab"])}


def test_samples_and_limits(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("k"))
    a, b = sampling.sample(df, "k", 10).collect(), sampling.sample(df.repartition(7), "k", 10).collect()
    assert {r["k"] for r in a} == {r["k"] for r in b} and len(a) == 10
    assert sampling.sample(df, "k", 10, seed=1).collect() != a
    assert sampling.limited(df, ["k"], None).count() == 50
    assert [r["k"] for r in sampling.limited_unscored(df, df.where("k <> '3'"), "k", 5).collect()] == ["3"]
    s = spark.createDataFrame([("i", n, str(n)) for n in range(8)] + [("j", n, "x") for n in range(3)], "item string, idx int, v string")
    every = sampling.pairs(s, ["item"], "idx", "v")
    assert {r["item"]: r["count"] for r in every.groupBy("item").count().collect()} == {"i": 28, "j": 3}
    assert {r["item"]: r["count"] for r in sampling.sampled_pairs(every, ["item"], 5).groupBy("item").count().collect()} == {"i": 5, "j": 3}
    order = [(i, j) for i in range(8) for j in range(i + 1, 8)]
    got = sorted((r["i"], r["j"]) for r in sampling.strided_pairs(every, ["item"], 10).where("item = 'i'").collect())
    assert got == order[:: 28 // 10][:10]


def test_detectors(spark):
    lex = spark.createDataFrame([("a", 1), ("b", 2)], "item string, slex int")
    other = spark.createDataFrame([("a", 3)], "item string, ssem int")
    out = detectors.joined(lex, [other], ["item"])
    assert {r["item"]: r["ssem"] for r in out.collect()} == {"a": 3, "b": None}
    assert detectors.missing_rates(out, ["slex", "ssem"]).first().asDict() == {"slex_missing": 0.0, "ssem_missing": 0.5}
    df = spark.createDataFrame([(1, None, None, 0.0), (0, None, None, 0.1), (0, 0, None, 0.2), (None, None, None, 0.3), (0, None, 2, None)], "exact int, near int, smem int, distance double")
    got = [(r["near"], r["smem"], r["smem_backfilled"]) for r in detectors.backfilled(df).collect()]
    assert got == [(1, 3, True), (1, 2, True), (0, 1, True), (None, None, False), (None, 2, False)]
    levels = df.select(detectors.smem_derived(F.col("exact"), F.col("distance"), False), detectors.smem_derived(F.col("exact"), F.col("near"), True)).collect()
    assert [tuple(r) for r in levels] == [(3, 3), (2, None), (1, 0), (0, None), (None, None)]
    t = spark.createDataFrame([("a b c", "a"), ("a b c", "x"), ("a", "")], "r string, p string")
    assert [r[0] for r in t.select(detectors.control_target(F.col("r"), F.col("p"))).collect()] == ["b c", "a b c", "a"]
    stored = spark.createDataFrame([("m", "B"), ("n", "A"), ("n", "C"), ("o", "E")], "model_id string, least_slot string")
    fresh = spark.createDataFrame([(x, "D") for x in "mnop"], "model_id string, least_slot string")
    assert {r["model_id"]: (r["least_slot"], r["frozen"]) for r in detectors.frozen(stored, fresh).collect()} == {"m": ("B", True), "n": ("D", False), "o": ("D", False), "p": ("D", False)}
    with pytest.raises(Exception, match="too few valid answers"):
        detectors.require_valid(spark.createDataFrame([("m", 3, "A")], "model_id string, n_valid int, least_slot string")).collect()
    with pytest.raises(Exception, match="out of range"):
        col(spark, [1.0, 4.0], "double").select(detectors.in_range(F.col("x"), "slex")).collect()
    assert {r["model_id"] for r in detectors.all_models(stored, fresh, excluded=("o",)).collect()} == {"m", "n", "p"}
    assert detectors.reused(stored, fresh.where("model_id = 'm'")).where("model_id = 'm'").first()["least_slot"] == "D"


def test_capped_level(spark):
    rows = [(0.1, 0.5, 0.3, 0.5), (0.1, 0.5, 0.15, 0.5), (0.1, 0.5, None, None), (0.0, 0.5, 0.1, 0.1), (0.7, 0.3, 1.0, 1.0), (0.5, 0.2, 1.0, 1.0), (0.3, 0.3, 1.0, 1.0), (0.5, 0.5, 1.0, 1.0), (None, 0.1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "u double, m double, uc double, mc double")
    level, met = rubrics.sprob_capped(*[F.col(c) for c in ("u", "m", "uc", "mc")])
    assert [tuple(r) for r in df.select(level, met).collect()] == [(3, True), (2, False), (2, False), (3, True), (0, False), (1, False), (2, False), (1, False), (0, False)]
    assert [r[0] for r in col(spark, [None, 0.2, 0.3, 0.5, 0.7], "double").select(rubrics.ssem_from_cps(F.col("x"))).collect()][1:] == [0, 1, 2, 3]


def test_report_values(spark):
    numbers = [0.5, 1.0, 0.00006, 12.34567, None, -0.25, 100.0]
    assert [r[0] for r in col(spark, numbers, "double").select(report.fmt(F.col("x"))).collect()] == ["" if x is None else str(round(x, 4)) if round(x, 4) != 1e-4 else "0.0001" for x in numbers]
    assert [r[0] for r in col(spark, [0.5, 1.5, 2.5, None], "double").select(report.fmt(F.col("x"), 0)).collect()] == ["0", "2", "2", ""]
    doc = col(spark, ['{"a": {"b": "x", "c": ""}}', "{}", None, "no"])
    assert [tuple(r) for r in doc.select(report.safe(F.col("x"), "a", "b"), report.safe(F.col("x"), "a", "c", default="-")).collect()] == [("x", "-"), ("", "-"), ("", "-"), ("", "-")]
    names = col(spark, ["d/proxy_github_x.csv", "kaggle.csv", "some_file.v2.csv", "plain"]).select(report.source_name(F.col("x")))
    assert [r[0] for r in names.collect()] == ["GitHub", "Kaggle", "Some File.v2", "Plain"]
    lists = spark.createDataFrame([(["a", "b", "a", "c"],), (["a"],), ([],), ([None, "z"],)], "x array<string>")
    assert [r[0] for r in lists.select(report.listed(F.col("x"))).collect()] == ["a, b and c", "a", "", "z"]
    assert [r[0] for r in col(spark, ["3", "2.9", "x", None]).select(report.whole(F.col("x"), 7)).collect()] == [3, 2, 7, 7]
    one = spark.range(1).select(report.rate(F.lit(3), F.lit(4)), report.rate(F.lit(0), F.lit(0)), report.pct(F.lit(1), F.lit(8)), report.pct(F.lit(1), F.lit(0)), report.confidence_score(F.lit(1), F.lit(1), F.lit(2)), report.confidence_label(F.lit(45.0)), report.lexical_strength(F.lit(1), F.lit(3), F.lit(5))).first()
    assert tuple(one) == ("25.00%", "0%", "12", "", 65.0, "Medium", "Strong")
    assert [report.prefixed("SLex", p) for p in (None, "", "web", "web__")] == ["SLex", "SLex", "SLex_web", "SLex_web"]


TEXTS = ["Ａ “b” c ﬁ…", None, "", "plain", "éx 10 %", "“q” – don’t", "x²"]


def test_text_forms(spark):
    df = col(spark, TEXTS)
    plain = lambda x: " ".join(unicodedata.normalize("NFKC", x or "").split())
    prompt = lambda x: plain(x).translate(str.maketrans("–—‘’“”", "--''\"\""))
    assert [r[0] for r in df.select(tx.normalize_text(F.col("x"))).collect()] == [plain(x) for x in TEXTS]
    assert [r[0] for r in df.select(tx.for_prompt(F.col("x"))).collect()] == [prompt(x) for x in TEXTS]
    import re

    assert [r[0] for r in df.select(tx.word_tokens(F.col("x"))).collect()] == [re.findall(r"\w+|[^\w\s]", (x or "").lower()) for x in TEXTS]
    assert [r[0] for r in df.select(tx.changed_characters(F.col("x"))).collect()] == [None if x is None else sum(unicodedata.normalize("NFKC", c) != c for c in x) for x in TEXTS]
    assert [r[0] for r in col(spark, ["my split: TEST", "test", "split val", None]).select(tx.detected_split(F.col("x"))).collect()] == ["test", None, "validation", None]
    assert [r[0] for r in col(spark, ["1. a\n\n2) b\n- c\n• d\ne", "a\nb"]).select(tx.four_lines(F.col("x"))).collect()] == [["a", "b", "c", "d"], None]
    assert [r[0] for r in col(spark, ["a.b.", "a.b.c."]).select(tx.is_one_sentence(F.col("x"))).collect()] == [True, False]
    assert [r[0] for r in col(spark, ["Bearer x.y z", "key sk-abc.def_1-2 end"]).select(tx.redact(F.col("x"))).collect()] == ["Bearer [REDACTED] z", "key sk-[REDACTED] end"]
    long = "a" * 20 + "b" * 20
    assert [r[0] for r in col(spark, [long, "short"]).select(corpus.head_and_tail(F.col("x"), 5)).collect()] == ["aaaaa\n\n---TAIL---\n\nbbbbb", "short"]


def test_tokenizers(spark, tmp_path):
    df = col(spark, ["Hello, world", None, ""])
    assert [r[0] for r in df.select(tokenizers.selected()(F.col("x"))).collect()] == [["hello", ",", "world"], [], []]
    path = tmp_path / "v.tiktoken"
    import base64

    path.write_text("".join(f"{base64.b64encode(bytes([b])).decode()} {b}\n" for b in range(256)))
    got = [r[0] for r in df.select(tokenizers.selected("tiktoken", str(path))(F.col("x"))).collect()]
    assert got == [[str(b) for b in b"hello, world"], [], []]
    assert tokenizers.selected("auto", str(tmp_path / "none")) is not None
    with pytest.raises(ValueError):
        tokenizers.selected("other")
    with pytest.raises(ValueError):
        tokenizers.selected("hf")


def test_settings(spark, tmp_path):
    (tmp_path / "m").write_text("")
    good = {"project": {"frozen_master_table_path": str(tmp_path / "m")}, "proxy_builder": {"github": {"enabled": True, "max_file_bytes": 2_700_000, "rate_limit_threshold": "10"}, "id_query_cap": 40, "keywords": ["Split Test "]}}
    assert len(config.validated(good, {"GITHUB_TOKEN": "t"})) == 3
    for bad in ({}, {"project": {}, "proxy_builder": {}}, {"project": {"frozen_master_table_path": "/none"}, "proxy_builder": {}}, good):
        with pytest.raises(ValueError):
            config.validated(bad, {})
    items = spark.createDataFrame([tuple("x" for _ in config.REQUIRED)], ", ".join(f"{c} string" for c in config.REQUIRED))
    assert config.validated_items(items).count() == 1
    with pytest.raises(ValueError):
        config.validated_items(items.drop("split"))
    with pytest.raises(ValueError):
        config.validated_items(items.withColumn("dcq_e_para4", F.lit(" ")))


def test_registry_and_waits(spark):
    r = providers.Registry()
    r.register("Echo", lambda settings: lambda p: p + settings["end"])
    assert r.select({"provider": "echo", "end": "!"})("a") == "a!"
    for bad in ({"provider": "none"}, {"provider": "echo", "env": {"api_key_var": "K"}}):
        with pytest.raises(ValueError):
            r.select(bad, {})

    def call(p):
        raise RuntimeError("down")

    df = spark.createDataFrame([(1, "p")], "id long, prompt string")
    assert providers.answered(df, call, retries=2, waits=(0.01,)).first()["status"] == "api_error: down"


def test_tables_and_structured_files(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.csv").write_text("name,note\n" + "".join(f'{GOOD} {k},short\n' for k in ("one", "two")))
    (d / "b.csv").write_text(f"Prediction,note\nx,{GOOD} three\n{GOOD} four,y\n")
    (d / "c.jsonl").write_text("\n".join([json.dumps({"xsum_id": "1", "summary": GOOD + " five"}), "{broken"]))
    (d / "xsum_test.csv").write_text(f'ID,Document,Summary\n7," doc ","{GOOD} six"\n8,,\n')
    (d / "other.csv").write_text(f"document, summary, id\nd,{GOOD} seven,9\n")
    (d / "xsum_val.csv").write_text("a,b\n1,2\n")
    files = readers.raw_files(spark, str(d))
    lines = {r["line"].rsplit(" ", 1)[1] for r in readers.extract(files).collect()}
    assert {"one", "two", "four", "five"} <= lines and "three" not in lines and "six" not in lines
    counts = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["n_values"], r["n_kept"], r["n_errors"]) for r in readers.extract_counts(files).collect()}
    assert counts["c.jsonl"] == ("jsonl", 1, 1, 1) and counts["a.csv"] == ("tabular", 4, 2, 0)
    got = {r["source_detail"].rsplit("/", 1)[1]: r for r in readers.structured_files(files, "github").where("summary_ref is not null").collect()}
    assert set(got) == {"xsum_test.csv"} or set(got) == {"xsum_test.csv", "other.csv"}
    one = got["xsum_test.csv"]
    assert (one["xsum_id"], one["document"], one["split"], len(one["source_sha256"])) == ("7", "doc", "test", 64)
    assert [r["error"] for r in readers.structured_files(files, "github").where("error is not null").collect()][:1] == ["missing_required_columns"]
    import hashlib

    digest = hashlib.sha256((d / "a.csv").read_bytes()).hexdigest().upper()
    manifest = spark.sql(f"select 'github_download_ok' type, '{digest}' sha256, timestamp'2024-01-02' ts, 2L event_id union all select 'github_download_ok', '{digest}', timestamp'2024-01-01', 1L union all select 'github_hit', null, timestamp'2024-01-01', 3L")
    assert [(r["path"].rsplit("/", 1)[1], r["event_id"]) for r in readers.verified(files, manifest).collect()] == [("a.csv", 1)]
    assert readers.artefact_counts(spark, str(tmp_path)).first()["n"] == 6
    (tmp_path / "s").mkdir()
    (tmp_path / "s/v4_a.json").write_text('{"model_id": " m ",\n "x": 1}')
    got = readers.stage_summaries(spark, str(tmp_path / "s/v4_*.json"), "model_id string, x long").first()
    assert got["model_id"] == "m" and got["summary_path"].endswith("v4_a.json")
    (tmp_path / "s/v4_b.json").write_text('{"x": 1}')
    with pytest.raises(Exception, match="has no model_id"):
        readers.stage_summaries(spark, str(tmp_path / "s/v4_*.json"), "model_id string, x long").collect()


def test_latest_rows_by_bucket(spark, tmp_path):
    for n, rows in enumerate(["select 'k' id, timestamp'2024-01-02' ts, 2 v union all select 'j', timestamp'2024-01-01', 5", "select 'k' id, timestamp'2024-01-03' ts, 3 v", "select 'k' id, timestamp'2024-01-01' ts, 1 v union all select 'm', timestamp'2024-01-01', 9"]):
        spark.sql(rows).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id string, ts timestamp, v int").parquet(str(tmp_path / "in"))
        journal.latest_per_key(stream, "id", "ts", str(tmp_path / "t"), str(tmp_path / "cp"), buckets=8).awaitTermination()
        got = {r["id"]: r["v"] for r in journal.latest_rows(spark, str(tmp_path / "t"), n).collect()}
        assert got == [{"k": 2, "j": 5}, {"k": 3, "j": 5}, {"k": 3, "j": 5, "m": 9}][n]
    assert journal.latest_rows(spark, str(tmp_path / "t"), -1) is None


def test_sessions(spark):
    rows = [(1, "2024-01-01 00:00:00", "a"), (2, "2024-01-01 00:20:00", "a"), (2, "2024-01-01 00:20:00", "a"), (3, "2024-01-01 01:00:00", "a"), (4, "2024-01-01 00:10:00", "b")]
    df = spark.createDataFrame(rows, "event_id long, at string, kind string").withColumn("ts", F.to_timestamp("at"))
    assert sorted((r["kind"], r["n"]) for r in journal.sessions(df, "ts", "kind").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_stages_of_the_command_line(spark, small, tmp_path):
    import cli

    def run(*args):
        cli.main([*args[:1], small if args[0] != "artefacts" else str(tmp_path), str(tmp_path / args[0]), *args[1:]])
        return spark.read.parquet(str(tmp_path / args[0]))

    assert run("lexical", "--limit", "3", "--prefix", "web").columns == ["item", "max_span_len_web", "ngram_hits_web", "proxy_count_web", "slex_web"]
    assert run("quiz", "--model-id", "model_a").count() == 1
    assert run("memory", "--control-only").count() == 3
    assert run("stability", "--max-pairs", "4", "--limit", "5").select("item").distinct().count() == 5
    assert run("merge", "--dedupe-mode", "none").count() == spark.read.parquet(f"{small}/proxy_structured_merged.parquet").count()
    assert run("risk").count() == 3 and run("build", "--queries").count() == 90
    assert run("artefacts").count() > 0
    cli.main(["report", small, str(tmp_path / "none"), "--dry-run"])
    assert not (tmp_path / "none").exists()
