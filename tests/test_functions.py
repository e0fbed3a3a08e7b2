import re
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanwise.functions import distance, rubrics
from spanwise.functions import text as tx


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def folded(s):
    for a, b in tx.LEXICAL_REPLACEMENTS:
        s = s.replace(a, b)
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", s.encode("ascii", "ignore").decode().lower()).strip()


TEXTS = ["", " ", "Café—“naïve” £5 €6", "ﬁne ｆｕｌｌ ½ … №", "tab\tand\nline end", "Ångström ø ß", "𝐚𝐛𝐜 x²"]


def test_canonical_is_the_folded_form(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "x string").select("x", tx.canonical(F.col("x")).alias("a"), tx.canonical_full(F.col("x")).alias("b"))
    for r in df.collect():
        assert r["a"] == r["b"] == folded(r["x"])
    assert one(spark, None, tx.canonical) == ""


def test_ngrams_of_short_and_long_texts(spark):
    for n, k, want in ((0, 13, 0), (12, 13, 0), (13, 13, 1), (20, 13, 8)):
        text = " ".join(f"w{i}" for i in range(n))
        assert len(one(spark, text, lambda c, k=k: tx.ngrams(tx.tokens(c), k))) == want
    assert one(spark, "a b c d", lambda c: tx.ngrams(tx.tokens(c), 2, 2)) == ["a b", "b c"]


def test_choice_parser(spark):
    for text, want in (("B", "B"), (" c) because", "C"), ("The answer is: d", "D"), ("Option E", "E"), ("I choose (a) here", "A"), ("none", ""), (None, ""), ("A bird", "A"), ("it must be B", "B")):
        assert one(spark, text, tx.parse_choice) == want, text


def test_summary_lines(spark):
    for text, want in (("one " * 11, False), ("one " * 12, True), ("1 " * 12, False), ("one two. " * 5 + "a b c", False), ("word " * 141, False)):
        assert one(spark, text.strip(), tx.looks_like_summary) is want


def test_prefix_and_suffix(spark):
    text = " ".join(f"w{i}" for i in range(40))
    prefix = one(spark, text, tx.make_prefix)
    assert prefix == " ".join(f"w{i}" for i in range(16))
    assert one(spark, text, lambda c: tx.gold_suffix(c, tx.make_prefix(c))) == " ".join(f"w{i}" for i in range(16, 40))
    assert one(spark, text, lambda c: tx.gold_suffix(c, F.lit("other"))) == ""


def test_redaction_and_names(spark):
    assert one(spark, "Bearer abc.def sk-123", tx.redact) == "Bearer [REDACTED] sk-[REDACTED]"
    assert [one(spark, n, tx.file_split) for n in ("a/test_x.csv", "b/train.csv", "c/val.csv", "d/x.csv")] == ["test", "train", "validation", None]


words = st.lists(st.sampled_from("abcd"), max_size=8)


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a):
        p, d[0] = d[0], i + 1
        for j, y in enumerate(b):
            p, d[j + 1] = d[j + 1], min(d[j + 1] + 1, d[j] + 1, p + (x != y))
    return d[-1]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(words, words), min_size=1, max_size=20))
def test_token_edits(spark, pairs):
    df = spark.createDataFrame([(a, b) for a, b in pairs], "a array<string>, b array<string>")
    got = df.select("a", "b", distance.token_edits(F.col("a"), F.col("b")).alias("jvm"), distance.token_distance("a", "b").alias("arrow")).collect()
    for r in got:
        want = edits(r["a"], r["b"])
        assert r["jvm"] == want
        assert abs(r["arrow"] - (want / max(len(r["a"]), len(r["b"])) if r["a"] != r["b"] else 0)) < 1e-12


@given(st.text("ab", max_size=30), st.text("ab", max_size=30))
def test_common_substring(a, b):
    want = max((n for n in range(len(a) + 1) if any(a[i : i + n] in b for i in range(len(a) - n + 1))), default=0)
    assert distance.lcs_length(a, b) == distance.lcs_length(b, a) == want


def values(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()


def test_published_scores(spark):
    lit = F.lit
    assert values(spark, rubrics.slex_aggregate(lit(296), lit(287), lit(287), lit(237)))[0] == 3
    r = values(spark, rubrics.ssem(lit(0.32094594594594594), lit(0.24150943396226415), lit(0.05)), rubrics.ssem(lit(None).cast("double"), lit(0.1), lit(0.0)))
    assert tuple(r[0]) == (1, "weak_cps_above_chance") and tuple(r[1]) == (None, "no_bcq_data")
    assert tuple(values(spark, *rubrics.wilson(lit(1), lit(296)))) == (0.000597, 0.018886)
    assert tuple(values(spark, *rubrics.wilson(lit(7), lit(296)))) == (0.011501, 0.048002)
    assert tuple(values(spark, *rubrics.wilson(lit(0), lit(0)))) == (0.0, 0.0)
    assert values(spark, rubrics.smem_aggregate(lit(0.00338), lit(0.00338), lit(0.0), lit(True), lit(1)))[0] == 1
    assert values(spark, rubrics.sprob_aggregate(lit(296), lit(57), lit(16), lit(4)))[0] == 3
    raw, final = rubrics.crs(lit(1), lit(1), lit(3))
    c = rubrics.confidence(lit(3), lit(1), lit(1), lit(3))
    r = values(spark, raw, final, rubrics.risk_level(final), c["confidence_pct"], c["confidence_level"], F.round(c["agreement"], 4))
    assert tuple(r) == (0.533333, 0.6, "HIGH", 90, "HIGH", 0.7037)


def test_bands_at_their_edges(spark):
    f = F.lit
    n = f(None).cast("double")
    assert tuple(values(spark, rubrics.band_absolute(f(0.1), f(0.2)), rubrics.band_absolute(f(0.7), f(0.05)), rubrics.band_absolute(n, f(0.1)), rubrics.band_absolute(f(0.3), f(0.3)))) == (1, 3, 1, 2)
    assert tuple(values(spark, rubrics.band_contrast(f(0.4), f(0.2), f(0.8), f(0.2)), rubrics.band_contrast(f(0.0), f(0.2), f(0.8), f(0.2)), rubrics.band_contrast(f(0.4), f(0.2), n, n))) == (3, 0, 0)
    assert tuple(values(spark, rubrics.slex_item(f(100), f(0)), rubrics.slex_item(f(99), f(0)), rubrics.slex_item(f(49), f(2)), rubrics.slex_item(f(29), f(0)))) == (3, 2, 1, 0)
    assert tuple(values(spark, rubrics.smem_item(f(1), f(0.0)), rubrics.smem_item(f(0), f(0.10)), rubrics.smem_item(f(0), f(0.25)), rubrics.smem_item(f(0), f(0.26)))) == (3, 2, 1, 0)
    raw, final = rubrics.crs(f(None).cast("int"), f(1), f(3))
    assert tuple(values(spark, raw, final)) == (None, None)
