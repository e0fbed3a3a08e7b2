"""Shared spans, near duplicates and layout duplicates against brute force."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.llm import best_record, layout_duplicates, near_duplicates, shared_spans
from spanwise.llm._components import components
from spanwise.llm._windows import window_hashes, window_minima

WORD = re.compile(r"[^\W_]+")


def test_window_hashes_and_minima():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 3, 40_000).astype(np.uint32)
    h = window_hashes(codes, 7)
    seen = {}
    for i in range(0, len(h), 5):
        assert seen.setdefault(tuple(codes[i : i + 7]), h[i]) == h[i]
    assert len(set(seen.values())) == len(seen)
    assert len(window_hashes(codes[:6], 7)) == 0
    v = rng.integers(0, 1000, 300).astype(np.uint64)
    for w in (1, 5, 300, 301):
        assert window_minima(v, w).tolist() == [min(v[i : i + w]) for i in range(len(v) - w + 1)]


def spans_by_hand(texts, n):
    places = {}
    for k, t in enumerate(texts):
        for i in range(len(t or "") - n + 1):
            places.setdefault(t[i : i + n], set()).add(k)
    out = {}
    for k, t in enumerate(texts):
        cover = {j for i in range(len(t or "") - n + 1) if len(places[t[i : i + n]]) > 1 for j in range(i, i + n)}
        if cover:
            out[k] = len(cover)
    return out


def test_shared_spans(spark):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefgh é𝐚") for _ in range(n))
    core, other = noise(100), noise(140)
    texts = [noise(30) + core + noise(20), core + noise(50), noise(10) + core[:99] + "!" + noise(40), other + noise(9), noise(3) + other[5:120] + noise(60) + core, None, "", noise(99), "x" * 250, "x" * 130, noise(150), noise(3000) + other]
    texts += [noise(120)] * 1 + [texts[10]] * 3
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "id long, text string, tid int")
    got = {r["id"]: r["n_shared"] for r in shared_spans.shared_spans(df, ("id",), "text", 100).collect()}
    assert got == spans_by_hand(texts, 100)
    assert shared_spans.shared_spans(df.limit(0), ("id",), "text", 100).count() == 0
    twice = df.where("id = 0").unionByName(df.where("id = 0"))
    assert {r["n_shared"] for r in shared_spans.shared_spans(twice, ("id",), "text", 100).collect()} == {150}


def test_shared_clusters(spark):
    rng = random.Random(15)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, b, c = noise(120), noise(110), noise(150)
    texts = [noise(20) + a, a + noise(30) + b, noise(5) + b, c, c, noise(300), None, "", noise(130)]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "id long, text string, tid int")
    got = {r["id"]: r["first_id"] for r in shared_spans.shared_clusters(df, ("id",), "text", 100).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}
    assert shared_spans.shared_clusters(df.limit(0), ("id",), "text", 100).count() == 0


def near_by_hand(rows, theta):
    sets = [(i, set(WORD.findall((t or "").lower()))) for i, t in rows]
    return {(min(a, b), max(a, b)) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and len(x & y) >= theta * len(x | y) - 1e-9}


@pytest.mark.parametrize("theta,rare,block", [(0.6, 8192, 65_536), (0.6, 2, 65_536), (0.8, 1, 40), (0.55, 0, 8), (0.6, 20, 5)])
def test_near_pairs(spark, theta, rare, block):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(60)] + ["the"] * 5
    rows = []
    for k in range(60):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 20, 40, 90]))]
        for _ in range(3):
            t = [w for w in base if rng.random() > 0.12] + [rng.choice(vocab) for _ in range(rng.randrange(3))]
            rows.append((len(rows), " ".join(t).title() if k % 2 else "  ".join(t) + "!"))
    rows += [(900, None), (901, ""), (902, " ... "), (903, rows[0][1]), (904, " ".join(f"v{i}" for i in range(5000))), (905, " ".join(f"v{i}" for i in range(4500)))]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "id long, text string, h string")
    got = [(r["row_a"], r["row_b"]) for r in near_duplicates.near_pairs(df, "id", ["text"], theta, rare, block).collect()]
    assert len(got) == len(set(got)) and set(got) == near_by_hand(rows, theta)
    assert near_duplicates.near_pairs(df.limit(0), "id", ["text"], theta).count() == 0


def test_keys_of_common_words_are_bounded():
    rng = np.random.default_rng(4)
    for n, rare in ((32, 0), (200, 0), (5000, 0), (5000, 50)):
        words = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        freq = near_duplicates.Frequencies(np.full(near_duplicates.CELLS, 100, np.int64), 120, 120 * n)
        key, _, _ = near_duplicates.prefix_keys(words, np.array([0, len(words)]), 0.6, freq, 0, rare)
        assert len(key) <= 32 * n


def test_groups_and_classes(spark):
    rng = random.Random(12)
    rows = []
    for k in range(12):
        words = [f"w{k}x{i}" for i in range(20)]
        for step in range(rng.randrange(1, 9)):  # a chain whose ends aren't alike
            rows.append((len(rows) + 1, " ".join(words[3 * step :] + [f"n{k}x{i}" for i in range(3 * step)])))
    rows += [(500, rows[3][1]), (400, rows[3][1].upper()), (600, "alone here"), (601, None), (602, "")]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "id long, text string, class_id string")
    pairs = near_by_hand(rows, 0.7)
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    linked = {i for p in pairs for i in p}
    got = {r["row_id"]: r["group_id"] for r in near_duplicates.near_groups(df, "id", ["text"], 0.7).collect()}
    assert got == {i: find(i) for i in linked}
    texts = {i: frozenset(WORD.findall((t or "").lower())) for i, t in rows}
    by_set = {}
    for i, t in sorted(texts.items()):
        by_set.setdefault(t, i)
    want = {i: (by_set[t], len({texts[x] for p in pairs for x in p if i in p} - {t})) for i, t in texts.items() if t}
    got = {r["row_id"]: (r["class_id"], r["n_links"]) for r in near_duplicates.near_classes(df, "id", ["text"], 0.7).collect()}
    assert got == want
    assert near_duplicates.near_groups(df.limit(0), "id", ["text"], 0.7).count() == 0
    assert near_duplicates.near_classes(df.limit(0), "id", ["text"], 0.7).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    v = spark.createDataFrame([(i,) for i in [*range(1, 41), *range(100, 160), 200, 201]], "v long")
    got = {r["v"]: r["component"] for r in components(v, df).collect()}
    assert got == {i: 1 if i < 41 else 100 if i < 160 else i for i in [*range(1, 41), *range(100, 160), 200, 201]}
    assert {r["v"] for r in components(v, df.limit(0)).collect()} == set(got)


def test_fields_that_hold_the_same_texts(spark):
    texts = [" ".join(f"w{k}x{i}" for i in range(12)) + end for k in range(40) for end in ("", " edited")]
    df = spark.createDataFrame([(k, t, t) for k, t in enumerate(texts)], "id long, summary string, document string")
    got = {(r["field_name"], r["row_a"], r["row_b"]) for r in near_duplicates.near_pairs(df, "id", ["summary", "document"], 0.6).collect()}
    assert got == {(f, a, b) for f in ("summary", "document") for a, b in near_by_hand(list(enumerate(texts)), 0.6)}


def test_keys_go_by_rounds(spark, monkeypatch):
    rng = random.Random(31)
    vocab = [f"w{i}" for i in range(150)]
    rows = []
    for n in (3, 4, 12, 30, 60, 90):
        for _ in range(25):
            base = [rng.choice(vocab) for _ in range(n)]
            rows += [(len(rows) + k, " ".join(w for w in base if k == 0 or rng.random() > 0.1)) for k in range(2)]
    df = spark.createDataFrame(rows, "id long, text string")
    rounds, one = [], near_duplicates._round

    def counted(*args):
        pairs, n = one(*args)
        rounds.append((args[-1], n))
        return pairs, n

    monkeypatch.setattr(near_duplicates, "_round", counted)
    monkeypatch.setattr(near_duplicates, "ROUND_BYTES", 0)
    monkeypatch.setattr(near_duplicates, "ROUND_LEAST", 150_000)
    got = [(r["row_a"], r["row_b"]) for r in near_duplicates.near_pairs(df, "id", ["text"], 0.6, 20).collect()]
    assert len(got) == len(set(got)) and set(got) == near_by_hand(rows, 0.6)
    # every unit once, and no round's shuffle far above its room
    assert len(rounds) > 2 and [u for units, _ in rounds for u in range(*units)] == list(range(near_duplicates.UNITS))
    assert all(n * (near_duplicates.KEY_BYTES + 8 * 3) <= 2 * 150_000 for _, n in rounds), rounds


def test_sketches_of_large_sets_rule_out_strangers():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**32, 150).astype(np.uint64)) for _ in range(400)]
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    sketch = near_duplicates._sketch(np.concatenate(sets), row, len(sets), True)
    packed = near_duplicates._packed(np.zeros(len(sets), np.uint64), 0, np.zeros(len(sets), np.int64), np.array([len(x) for x in sets]))
    order = np.argsort(packed, kind="stable")
    left, right = near_duplicates._group_pairs(packed[order], sketch[order], 0.6, True)
    assert len(left) < 10


def test_hot_class_is_cut_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "CLASS_BLOCK", 4)
    rows = [(k, "one two three four five six") for k in range(15)] + [(99, "one two three four five six seven")]
    df = spark.createDataFrame(rows, "id long, text string")
    assert {(r["row_a"], r["row_b"]) for r in near_duplicates.near_pairs(df, "id", ["text"], 0.8).collect()} == near_by_hand(rows, 0.8)


def test_layout_duplicates(spark):
    rows = [(1, "A b-C."), (2, "abc"), (3, " a\tB c "), (4, None), (5, "..."), (6, ""), (7, "ÀB"), (8, "àb"), (9, "abd"), (2, "abc")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "row_id long, t string, key string")
    key = layout_duplicates.text_key(F.col("t"))
    assert sorted(tuple(r) for r in layout_duplicates.copies(df, "row_id", key).collect()) == [(1, 2), (1, 2), (1, 3), (7, 8)]
    assert sorted(tuple(r) for r in layout_duplicates.collapse(df, "row_id", key).collect()) == [(1, 4), (7, 2), (9, 1)]
    assert layout_duplicates.copies(df.limit(0), "row_id", key).count() == 0


def test_hot_keys_are_salted(spark):
    text = F.when(F.col("id") % 3 == 0, "hot key").when(F.col("id") % 7 == 0, "warm key").otherwise(F.concat(F.lit("k"), F.floor(F.col("id") / 4).cast("string")))
    df = spark.range(1, 4001).select(F.col("id").alias("row_id"), text.alias("t"))
    key = layout_duplicates.text_key(F.col("t"))
    rows = layout_duplicates.keyed(df, "row_id", key)
    sizes = {r["key"]: (r["count"], r["first"]) for r in rows.groupBy("key").agg(F.count("*").alias("count"), F.min("id").alias("first")).collect()}
    for share in (2, 4, 12, 4096):
        hot = layout_duplicates.hot_keys(rows, share)
        assert {r["key"] for r in hot.collect()} == {k for k, (n, _) in sizes.items() if n > max(4000 / share, 1)}
        got = {r["key"]: (r["n"], r["first_id"]) for r in layout_duplicates.groups(rows, hot, 3).collect()}
        assert got == sizes
        out = layout_duplicates.members(df, "row_id", key, share)
        assert out.groupBy("first_id").count().where("first_id = 3").first()["count"] == 1333
        assert out.count() == sum(n for n, _ in sizes.values() if n > 1)
        assert sorted(r["copies"] for r in layout_duplicates.collapse(df, "row_id", key, share).collect()) == sorted(n for n, _ in sizes.values())


def test_bounded_counters_lose_no_hot_key(spark):
    rng = random.Random(8)
    keys = ["a"] * 400 + ["b"] * 300 + [f"x{i}" for i in range(3300)]
    rng.shuffle(keys)
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, key string").repartition(5)
    assert {r["key"] for r in layout_duplicates.hot_keys(rows, 20).collect()} == {"a", "b"}
    assert layout_duplicates._partial_counts(rows, 40).groupBy("key").count().count() <= 200


def test_json_lines(spark):
    rows = ['{"a": "X y", "B": 1}', '{"b":"1","A":"xY!"}', ' {"A": "xy", "b": 1.0}', '{"a": "xy"}', '{"a": "xy"', "[1]", "null", "", None, '{"a": NaN}', '{"a": {"c": [1, "D"]}}', '{"A": {"C": ["1", "d."]}}', '{"a": null}', "{'a': 1}"]
    df = spark.createDataFrame(list(enumerate(rows)), "raw_id long, raw string")
    got = sorted(tuple(r) for r in layout_duplicates.copies(df, "raw_id", layout_duplicates.json_key(F.col("raw"))).collect())
    assert got == [(0, 1), (10, 11)]
    assert json.loads(rows[2])["b"] == 1.0  # 1.0 has the digits 10


def test_best_rows_and_bundles(spark):
    rows = [("g", 1, 5, "d1", 1, "x1"), ("g", 2, 9, "d2", 1, "x2"), ("g", 3, 9, "d2", None, None), ("g", 4, None, None, 3, "x1"), ("h", 5, None, None, None, None), (None, 6, 1, "d", 1, "x")]
    df = spark.createDataFrame(rows, "key string, row_id long, chars int, doc string, trust int, xsum string")
    b = [best_record.Bundle("d", F.col("chars"), F.col("doc")), best_record.Bundle("x", F.col("trust"), F.col("xsum"))]
    free = {r["key"]: (r["n"], r["first_id"], r["d"], r["x"]) for r in best_record.best_bundles(df, "key", "row_id", b).collect()}
    assert free == {"g": (4, 1, 2, 4), "h": (1, 5, 0, 0)}
    tied = {r["key"]: (r["d"], r["x"]) for r in best_record.best_bundles(df, "key", "row_id", b, [("x", "d")]).collect()}
    # x1 was only seen with d1, x2 only with d2: the sums are 1/2 + 1 and 1 + 1/2, the first bundle's better candidate comes first
    assert tied == {"g": (2, 2), "h": (0, 0)}
    assert best_record.best_bundles(df.limit(0), "key", "row_id", b, [("x", "d")]).count() == 0


def test_large_groups_by_aggregation(spark):
    rng = random.Random(21)
    rows = [(f"g{g}", i + 100 * g, rng.choice([None, rng.randrange(5)]), rng.choice("de f".split()) + str(rng.randrange(3)), rng.choice([None, rng.randrange(3)]), f"x{rng.randrange(3)}") for g in range(40) for i in range(1, rng.randrange(3, 14))]
    df = spark.createDataFrame(rows, "key string, row_id long, chars int, doc string, trust int, xsum string")
    b = [best_record.Bundle("d", F.col("chars"), F.col("doc")), best_record.Bundle("x", F.col("trust"), F.col("xsum")), best_record.Bundle("z", F.col("chars"), F.col("xsum"))]
    for dependency in (("x", "d"), ("d", "x")):
        searched, joined = ({r["key"]: tuple(r) for r in best_record.best_bundles(df, "key", "row_id", b, [dependency], limit).select("key", "n", "first_id", "d", "x", "z").collect()} for limit in (10**6, 0))
        assert searched == joined and len(joined) == 40
    with pytest.raises(ValueError):
        best_record.best_bundles(df, "key", "row_id", b, [("x", "d"), ("d", "z")], 0).count()


def test_groups_without_dependencies_are_searched(spark):
    rng = random.Random(23)
    rows = [(f"g{g}", i + 100 * g, rng.choice([None, rng.randrange(4)]), f"d{rng.randrange(3)}", rng.choice([None, rng.randrange(2)]), f"x{rng.randrange(3)}") for g in range(40) for i in range(1, rng.randrange(2, 12))]
    rows += [("none", 9001, None, "d", None, None), ("none", 9002, None, None, None, "x")]
    df = spark.createDataFrame(rows, "key string, row_id long, chars int, doc string, trust int, xsum string")
    b = [best_record.Bundle("d", F.col("chars"), F.col("doc")), best_record.Bundle("x", F.col("trust"), F.col("xsum"))]
    want = {r["key"]: tuple(r) for r in best_record.best_rows(df, "key", "row_id", b).select("key", "n", "first_id", "d", "x").collect()}
    for limit in (10**6, 0):
        assert {r["key"]: tuple(r) for r in best_record.best_bundles(df, "key", "row_id", b, limit=limit).select("key", "n", "first_id", "d", "x").collect()} == want
    # the rows come from the search
    plan = best_record.best_bundles(df, "key", "row_id", b)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" in plan


def test_lookup_keeps_rows_without_a_key(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, "a")], "id long, k string")
    right = spark.createDataFrame([("a", 7), ("c", 8)], "k string, v int")
    assert {r["id"]: r["v"] for r in best_record.looked_up(left, right, "k").collect()} == {1: 7, 2: None, 3: None, 4: 7}
    assert best_record.looked_up(left.limit(0), right, "k").count() == 0


def test_built_records(spark):
    rows = spark.createDataFrame([("g", 1, "d1", "x1", "s1"), ("g", 2, "d2", None, "s2")], "key string, row_id long, document string, xsum string, source string")
    chosen = spark.createDataFrame([("g", 2, 1, 2, 1), ("h", 1, 9, 0, 0)], "key string, n long, first_id long, d long, x long")
    got = {r["key"]: tuple(r)[1:] for r in best_record.built(rows, "key", "row_id", chosen, {"d": ("document",), "x": ("xsum", "source")}).collect()}
    assert got == {"g": (2, 1, "d2", "x1", "s1"), "h": (1, 9, None, None, None)}


def test_search_is_optimal():
    rng = random.Random(3)
    for _ in range(200):
        cand = [sorted(((rng.random(), 10 * k + i, rng.choice("pqr")) for i in range(rng.randrange(4))), key=lambda c: (-c[0], c[1])) for k in range(3)]
        allowed = {(0, 1): {"p": {"q"}, "q": {"p", "r"}}, (1, 2): {"p": {"p"}}}
        ok = lambda pick: all(not (pick[a] and pick[b] and pick[a][2] in seen and pick[b][2] not in seen[pick[a][2]]) for (a, b), seen in allowed.items())
        every = [(x, y, z) for x in [None, *cand[0]] for y in [None, *cand[1]] for z in [None, *cand[2]]]
        best = max(sum(c[0] for c in p if c) for p in every if ok(p))
        found = best_record._search(cand, allowed)
        assert ok(found) and abs(sum(c[0] for c in found if c) - best) < 1e-12
