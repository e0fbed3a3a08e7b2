from pyspark.sql import functions as F

from spanwise.operators import corpus, fusion, lexical, probes


def test_exposure_measures_candidates_only(spark):
    base = " ".join(f"word{i}" for i in range(30))
    items = spark.createDataFrame([("a", base), ("b", "short text"), ("c", "")], "item string, text string")
    lines = spark.createDataFrame([(1, "x y " + " ".join(base.split()[3:20])), (2, base[:60]), (3, "short text")], "line long, text string")
    got = {r["item"]: tuple(r)[1:] for r in lexical.exposure(items, lines).collect()}
    assert got["a"] == (len(" " + " ".join(base.split()[3:20])), 5, 1, 3)
    assert got["b"] == got["c"] == (0, 0, 0, 0)
    assert lexical.exposure(items, lines.limit(0)).where("slex > 0").count() == 0
    empty = lexical.aggregate(lexical.exposure(items.limit(0), lines)).first()
    assert empty["n_items"] == 0 and empty["slex_aggregate"] == 0


def test_candidates_keep_the_best(spark):
    text = " ".join(f"w{i}" for i in range(20))
    items = spark.createDataFrame([("a", text)], "item string, text string")
    lines = spark.createDataFrame([(k, " ".join(text.split()[: 13 + k % 3])) for k in range(9)], "line long, text string")
    got = lexical.candidates(items, lines, most=4).orderBy(F.desc("hits"), "line").collect()
    assert [(r["line"], r["hits"]) for r in got] == [(2, 3), (5, 3), (8, 3), (1, 2)]


def test_keep_first_modes(spark):
    df = spark.createDataFrame([(1, None, "A  b", "s"), (2, "d", "a B", "s"), (3, None, None, None), (4, None, " ", None), (5, "d", "a B", "s"), (6, "d", "a B", "t")], "row_id long, document string, summary_ref string, source_sha256 string").withColumn("extra", F.lit(1))
    ids = lambda mode: [r["row_id"] for r in corpus.keep_first(df, mode, ("row_id",)).orderBy("row_id").collect()]
    assert ids("none") == [1, 2, 3, 4, 5, 6]
    assert ids("summary_norm") == [1, 3]
    assert ids("doc_summary_hash") == [1, 2, 3, 4]
    assert ids("source") == [1, 2, 3, 4, 6]
    s = corpus.merge_stats(df, corpus.keep_first(df, "summary_norm", ("row_id",))).first()
    assert (s["rows_before"], s["rows_after"], s["rows_removed"], s["rows_empty_summary"]) == (6, 2, 4, 2)
    assert corpus.merge_stats(df.limit(0), df.limit(0)).first()["pct_with_sha256"] is None


def test_merge_pads_missing_columns(spark):
    a, b = spark.createDataFrame([(1, "x")], "row_id long, document string"), spark.createDataFrame([(2,)], "row_id long")
    assert [tuple(r) for r in corpus.merge(a, b).orderBy("row_id").collect()] == [(1, "x", 0), (2, None, 1)]


def test_json_values_skip_the_broken(spark):
    good = '{"xsum_id": "1", "summary": "s", "text": {"a": 1}, "target": null, "output": 5}'
    df = spark.createDataFrame([("p", good), ("p", "{broken"), ("p", None), ("p", "[1]"), ("p", ""), ("p", '{"summary": "no id"}')], "path string, raw string")
    assert sorted(tuple(r) for r in corpus.json_values(df, ["path"], "raw", ("xsum_id",)).collect()) == [("p", "output", "5"), ("p", "summary", "s")]


def test_cache_age(spark):
    q = spark.createDataFrame([("a",), ("b",)], "query string")
    cache = spark.sql("select 'a' query, timestamp'2024-01-01 10:00:00' ts union all select 'b', timestamp'2023-12-01 10:00:00'")
    got = {r["query"]: r["hit"] for r in corpus.cached(q, cache, "query", "ts", F.lit("2024-01-02 09:00:00").cast("timestamp"), 24).collect()}
    assert got == {"a": True, "b": False}


def test_retry_status(spark):
    df = spark.createDataFrame([("A", None), ("?", "B"), ("?", "?"), (None, None)], "a string, b string")
    from spanwise.functions.text import parse_choice

    c, s = probes.first_choice(F.col("a"), F.col("b"), parse_choice)
    assert [tuple(r) for r in df.select(c, s).collect()] == [("A", "ok"), ("B", "ok_after_retry"), ("", "parse_failed"), ("", "api_error")]


def test_quiz_bias_of_published_counts(spark):
    counts = {"A": 46, "B": 113, "C": 95, "D": 31, "E": 11}
    rows = [("m", c) for c, n in counts.items() for _ in range(n)] + [("m", "")]
    bias = probes.position_bias(spark.createDataFrame(rows, "model_id string, choice string"))
    b = bias.first()
    assert b["least_slot"] == "D" and abs(b["pe"] - 31 / 296) < 1e-12
    answers = spark.createDataFrame([("m", "D", "D")] * 95 + [("m", "A", "D")] * 201, "model_id string, choice string, target string")
    r = probes.quiz_scores(answers, bias).first()
    assert abs(r["kappa"] - 0.24150943396226415) < 1e-9 and r["ssem"] == 1


def test_samples(spark):
    rows = [("m", "i", k, t, t.split(), "a b c", ["a", "b", "c"]) for k, t in enumerate(["a b c", "a b c", "a b d", ""])] + [("m", "j", 0, "x", ["x"], "", [])]
    df = spark.createDataFrame(rows, "model_id string, item string, idx int, output string, tokens array<string>, anchor string, anchor_tokens array<string>")
    got = {r["item"]: r for r in probes.sample_scores(df).collect()}
    assert got["i"]["uar"] == 0.75 and abs(got["i"]["mned"] - (0 + 1 / 3 * 2 + 1 * 3) / 6) < 1e-9
    assert abs(got["i"]["anchor_mned"] - (0 + 0 + 1 / 3 + 1) / 4) < 1e-9 and got["i"]["peak_eps"] == 0.5
    assert got["j"]["mned"] is None and got["j"]["anchor_mned"] is None


def test_overlap(spark):
    df = spark.createDataFrame([("m1", 1), ("m1", 2), ("m2", 2), ("m2", 2), ("m3", 9)], "model string, item long")
    assert sorted(tuple(r) for r in fusion.overlap_pairs(df, "model", "item").collect()) == [("m1", "m2", 1, 2, 0.5), ("m1", "m3", 0, 3, 0.0), ("m2", "m3", 0, 2, 0.0)]
    assert {r["pattern"]: r["n"] for r in fusion.overlap_patterns(df, "model", "item").collect()} == {"m1": 1, "m1 + m2": 1, "m3": 1}
