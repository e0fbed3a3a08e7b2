"""Look-alikes, encodings, leaks, packing and prose on cases made by hand."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanwise.llm import leaks, lookalikes, packing, page_prose, wrong_encoding
from spanwise.llm._fm_index import FMIndex

PLAIN = "The café’s “naïve” owner in Ålesund paid £5 – or €6…"


@pytest.mark.parametrize("encoding", ["cp1252", "latin-1", "cp1250", "mac_roman", "cp437", "cp850", "iso8859-15"])
def test_garbled_text_comes_back(encoding):
    wrong = "".join(wrong_encoding._decode(c.encode(), encoding) for c in PLAIN)
    assert wrong != PLAIN and wrong_encoding.repair(wrong)[0] == PLAIN
    twice = "".join(wrong_encoding._decode(c.encode(), encoding) for c in wrong)
    assert wrong_encoding.repair(twice)[0] == PLAIN
    assert wrong_encoding.repair(PLAIN + " — " + wrong)[0] == PLAIN + " — " + PLAIN


@pytest.mark.parametrize("text", [PLAIN, "", "plain", "SÃO PAULO, CHÂTEAU", "Юность и Жизнь", "Θάλασσα ψωμί", "«Заря» ß Ðarrow", "BRÅ’S BOARD", "10 ¢ © § ª º ¼ ½", "Рост Сын РОССИЯ"])
def test_correct_text_stays(text):
    assert wrong_encoding.repair(text) == (text, 0, 0)


OTHERS = ["on 😀 off", "go → on", "done ✓ now", "Nguyễn Việt", "日本語", "العربية", "Azərbaycan", "עברית", "full，stop"]


@pytest.mark.parametrize("text", OTHERS)
@pytest.mark.parametrize("encoding", ["cp1252", "latin-1", "mac_roman", "cp437"])
def test_characters_outside_the_repertoire_come_back(text, encoding):
    wrong = "".join(wrong_encoding._decode(c.encode(), encoding) for c in text)
    if (text, encoding) == ("Azərbaycan", "mac_roman"):
        text = wrong  # the one case left out: "…" before an accented letter is correct French
    assert wrong_encoding.repair(wrong)[0] == text


def test_two_encodings_one_after_the_other():
    for first, second in [("cp1252", "latin-1"), ("latin-1", "cp1252"), ("mac_roman", "cp1252"), ("cp437", "cp1252")]:
        wrong = wrong_encoding._decode(wrong_encoding._decode("é’ 😀".encode(), first).encode(), second)
        assert wrong_encoding.repair(wrong)[0] == "é’ 😀"


@pytest.mark.parametrize("garbled", ["ï¿½", "пїЅ", "ÔøΩ", "∩┐╜"])
def test_garbled_replacement_characters_are_found(spark, garbled):
    assert wrong_encoding.repair(f"caf{garbled} x") == (f"caf{garbled} x", 0, 1)
    df = spark.createDataFrame([(1, f"caf{garbled} x"), (2, "go â†’ on"), (3, "on ðŸ˜€"), (4, "plain é")], "row_id long, t string")
    assert {r["id"] for r in wrong_encoding.repair_fields(df, "row_id", ["t"]).collect()} == {1, 2, 3}


ALSO_CORRECT = ["«café»… “touché…” “fiancé”—he", "le «\u00a0café\u00a0»\u00a0–", "Spaß“ und groß… muß–", "«война»\u00a0— «НАТО»", "Італії ЦІНІ лінії НІЧІЇ", "zvlášť SZKÓŁ część", "l’été “École” «École» l’âge", "È\u00a0una É\u00a0um", "JOSÉ’S CAFÉ” «CAFÉ»", "3×² £5 €6 ¥7", "„Ü“ „Ö“"]


@pytest.mark.parametrize("text", ALSO_CORRECT)
def test_correct_text_with_the_structure_stays(text):
    assert wrong_encoding.repair(text) == (text, 0, 0)


@pytest.mark.parametrize("text", ["the café’s naïve £5", "Ålesund – “quoted”", "José said", "paid €6…", "a soirée in Paris", "Ñandú"])
def test_latin_text_read_as_windows_1251(spark, text):
    wrong = "".join(wrong_encoding._decode(c.encode(), "cp1251") for c in text)
    assert wrong_encoding.repair(wrong)[0] == text
    df = spark.createDataFrame([(1, wrong)], "row_id long, t string")
    assert [r["restored"] for r in wrong_encoding.repair_fields(df, "row_id", ["t"]).collect()] == [text]


@pytest.mark.parametrize("text", ["Вітаю із Еѕtate", "the Вig and Еіght", "О, ВЈЕРА", "ГДЕ „мы“ в„доме“ не", "Гданьск Де Вё", "в „доме“"])
def test_cyrillic_and_stand_ins_stay(text):
    assert wrong_encoding.repair(text) == (text, 0, 0)


def test_lost_characters_are_found():
    assert wrong_encoding.repair("caf� x") == ("caf� x", 0, 1)


def test_candidate_regex_misses_nothing(spark, middle):
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{middle}/proxy_structured_merged.parquet").select("row_id", "summary_ref", "document")
    got = {(r["id"], r["field_name"]) for r in wrong_encoding.repair_fields(df, "row_id", ["summary_ref", "document"]).collect()}
    want = {(r["row_id"], f) for r in df.collect() for f in ("summary_ref", "document") if r[f] and sum(wrong_encoding.repair(r[f])[1:])}
    assert got == want
    assert wrong_encoding.repair_fields(df.limit(0), "row_id", ["summary_ref"]).count() == 0
    clash = df.limit(3).select(F.col("row_id").alias("text"), F.lit("Ã©").alias("id"))
    assert [r["restored"] for r in wrong_encoding.repair_fields(clash, "text", ["id"]).collect()] == ["é"] * 3


CLEAN = ["plain text, “quoted” – so…", "naïve café", "Юность и «Заря»", "Θάλασσα ψωμί", "x² ½ ª €5 ™", "tab\tline\r\nend", "хор"]
ODD = {"ｆｕｌｌ ｗｉｄｔｈ １２": "full width 12", "cafe\u0301": "café", "zero\u200bwidth": "zerowidth", "no\u00a0break": "no break", "the trаwler": "the trawler", "ﬁne": "fine", "𝐛𝐨𝐥𝐝": "bold", "а bridge": "a bridge", "soft\u00adhyphen": "softhyphen", "wide，comma": "wide,comma"}


def test_one_form(spark):
    rows = [(f"c{k}", t) for k, t in enumerate(CLEAN)] + [(f"o{k}", t) for k, t in enumerate(ODD)] + [("n", None), ("e", ""), ("v", "a trawler and a bridge"), ("l", "word " * 50_000 + "\u200bend")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "id string, body string, text string")
    got = {r["id"]: r["canonical"] for r in lookalikes.canonical_fields(df, ("id",), "body").collect()}
    assert {k: v for k, v in got.items() if k != "l"} == {f"o{k}": v for k, v in enumerate(ODD.values())}
    assert got["l"] == "word " * 50_000 + "end"
    assert lookalikes.canonical_fields(df.limit(0), ("id",), "body").count() == 0


def test_letters_that_the_table_lacks_go_by_the_vocabulary(spark):
    odd = {"the booк": "the book", "тhe bridge": "the bridge", "noτhing": "nothing", "pӏace": "place", "booкs аnd": "books and", "briжge": "bridge", "eχit": "exit"}
    clean = ["5 kΩ and 3 μm", "the Δtemp", "Δt πr", "Москва", "booк", "cafГ©", "βcarotene", "мой xyzк"]
    rows = [(f"o{k}", t) for k, t in enumerate(odd)] + [(f"c{k}", t) for k, t in enumerate(clean)]
    df = spark.createDataFrame([*rows, ("v", "the book and books, nothing, a place, a bridge, an exit, cafe")], "id string, body string")
    got = {r["id"]: r["canonical"] for r in lookalikes.canonical_fields(df, ("id",), "body").collect()}
    assert got == {f"o{k}": v for k, v in enumerate(odd.values())} | {"c4": "book"}
    near = spark.createDataFrame([("a", "хouse"), ("v", "a mouse")], "id string, body string")
    assert {r["id"]: r["canonical"] for r in lookalikes.canonical_fields(near, ("id",), "body", limit=1.0).collect()} == {"a": "mouse"}


def test_edits_beside_look_alikes(spark):
    words = "a mouse and the trawler, a bridge, naïve plans"
    odd = {"хouse": "mouse", "trаwlr": "trawler", "bbrіdge": "bridge", "ｂridg": "bridge", "nаive": "naïve"}
    df = spark.createDataFrame([*enumerate(odd), (99, words)], "id long, body string")
    got = {r["id"]: r["canonical"] for r in lookalikes.canonical_fields(df, ("id",), "body", limit=1.0).collect()}
    assert got == dict(enumerate(odd.values()))


def test_trie_prefers_the_commonest_free_spelling():
    t = lookalikes.Trie({"cop": 3, "cap": 9, "café": 1, "cafe": 5})
    assert t.spell("сор") == "cop" and t.spell("ｃａｆｅ\u0301") == "café" and t.spell("cxp") is None
    assert t.spell("cxp", 1) == "cap"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=120), st.lists(st.lists(st.integers(1, 5), min_size=3, max_size=3), min_size=1, max_size=10))
def test_fm_index(seq, phrases):
    index = FMIndex(np.array(seq), sample=4)
    low, high = index.search(np.array(phrases))
    for p, a, b in zip(phrases, low, high, strict=True):
        want = [i for i in range(len(seq) - 2) if seq[i : i + 3] == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_leaks(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(50)]
    item = [rng.choice(words) for _ in range(40)]
    other = [rng.choice(words) for _ in range(30)]
    text = lambda w: " ".join(w)
    docs = [(1, "Intro, " + text(item[5:18]).upper() + "; end"), (2, text(item[5:17])), (3, text(other[:13] + ["new"] + item[20:40])), (4, None), (5, ""), (6, text(item[:13])), (7, "-- ".join(item[:14])), (8, text(["new"] * 100_000 + other))]
    items = [("a", "test", text(item), None), ("b", None, "", text(other)), ("c", "train", text(item), text(item)), ("d", " ", text(item[:13]), text(["w1"] * 5))]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item string")
    m = leaks.held_out(spark.createDataFrame(items, "xsum_id string, split string, s string, b string"))
    got = {(r["id"], r["item"]): (r["n_words"], [tuple(x) for x in r["spans"]]) for r in leaks.leaked(d, "doc_id", "text", m, "xsum_id", ("s", "b")).collect()}
    assert got == {(1, "a"): (13, [(1, 14)]), (3, "a"): (20, [(14, 34)]), (3, "b"): (13, [(0, 13)]), (6, "a"): (13, [(0, 13)]), (6, "d"): (13, [(0, 13)]), (7, "a"): (14, [(0, 14)]), (7, "d"): (13, [(0, 13)]), (8, "b"): (30, [(100_000, 100_030)])}
    assert leaks.leaked(d, "doc_id", "text", m.limit(0), "xsum_id", ("s", "b")).count() == 0
    assert leaks.leaked(d.limit(0), "doc_id", "text", m, "xsum_id", ("s", "b")).count() == 0


def test_leaks_in_blocks(spark):
    texts = [" ".join(f"t{k}w{i}" for i in range(30)) for k in range(12)]
    words = [t.split() for t in texts]
    # an item's two texts overlap in the document, so its span must come out merged, in whichever blocks the items are
    m = spark.createDataFrame([(str(k), " ".join(w[:15]), " ".join(w[2:])) for k, w in enumerate(words)], "xsum_id string, s string, b string")
    d = spark.createDataFrame([(k, t + " more") for k, t in enumerate(texts)], "doc_id long, text string")
    for block, shard in ((10**6, 10**6), (100, 50), (700, 10)):
        got = {(r["id"], r["item"]): [tuple(x) for x in r["spans"]] for r in leaks.leaked(d, "doc_id", "text", m, "xsum_id", ("s", "b"), block_chars=block, shard_words=shard).collect()}
        assert got == {(k, str(k)): [(0, 30)] for k in range(12)}


def test_packing_keeps_every_token(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    df = df.unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "long text " * 3000)], df.schema))
    rows = packing.pack(df, "doc_id", "text", [(1, 64), (2, 1024)]).collect()
    enc = packing.tokenizer(packing.TOKENIZER)
    want = {r["doc_id"]: len(enc.encode_ordinary(r["text"])) for r in df.collect() if r["text"]}
    for pack_id, capacity in ((1, 64), (2, 1024)):
        parts, boxes = {}, {}
        for r in rows:
            if r["pack_id"] == pack_id:
                parts.setdefault(r["id"], []).append((r["first_token"], r["n_tokens"]))
                boxes[r["container"]] = boxes.get(r["container"], 0) + r["n_tokens"]
        assert max(boxes.values()) <= capacity and set(parts) == set(want)
        for i, p in parts.items():
            p.sort()
            assert [a for a, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))] and sum(n for _, n in p) == want[i]
            assert len(p) == 1 or want[i] > capacity
    assert packing.pack(df.limit(0), "doc_id", "text", [(1, 8)]).count() == 0


def test_bm25_prefers_shared_rare_terms():
    docs = [np.array(x) for x in ([1, 2, 3, 9], [1, 2, 3, 8], [7, 7, 6], [3, 5, 5, 5], [])]
    index = packing.BM25(docs)
    near = index.neighbours(0).tolist()
    assert near[0] == 0 and near[1] == 1 and 2 not in near
    assert index.neighbours(4).tolist() == []


def test_bm25_sums_frequent_and_other_terms():
    rng = np.random.default_rng(6)
    docs = [rng.integers(0, 90, rng.integers(1, 60)) for _ in range(64)]
    index = packing.BM25(docs)
    sets = [set(x.tolist()) for x in docs]
    df = np.bincount([t for x in sets for t in x], minlength=90)
    mean = np.mean([len(x) for x in docs])

    def score(a, b):
        tf = np.bincount(docs[b], minlength=90)
        norm = packing.K1 * (1 - packing.B + packing.B * len(docs[b]) / mean)
        return sum(round(packing.STEPS * np.log1p((64 - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (packing.K1 + 1) / (tf[t] + norm)) for t in sets[a] & sets[b] if df[t] > 1)

    for a in range(0, 64, 7):
        want = sorted((b for b in range(64) if score(a, b)), key=lambda b: (-score(a, b), b))
        assert index.neighbours(a).tolist() == want
        mask = np.arange(64) % 3 == 0
        assert index.neighbours(a, mask).tolist() == [b for b in want if mask[b]]


def test_bm25_queries_have_every_term():
    docs = [np.arange(1, 31), np.arange(1, 30), np.array([30, 99])] + [np.array([200, 300 + k]) for k in range(30)]
    index = packing.BM25(docs)
    assert index.neighbours(0).tolist()[-1] == 2
    assert sorted(index.neighbours(3).tolist()) == list(range(3, 33))


def prose_model(spark, small):
    return page_prose.fit(spark.read.parquet(f"{small}/master_table_xsum_n300_seed42_v4_dcq4_frozen.parquet"), "document_norm")


def test_pages(spark, small):
    model = prose_model(spark, small)
    prose = "The council of the town opened a new bridge on Monday, and the mayor said that it would help trade in the region. "
    more = "A painter who had lived near the harbour for years told us that he was sorry to see the old crossing go. Nobody knows what will become of its iron railings. "
    french = "Le conseil a vendu le musée à Paris après un long débat. La mairie veut fermer une école sans attendre le rapport du tribunal. "
    good = [prose + more, "- " + prose + "\n- " + more, "Results\n" + "\n".join(f"Townham {i}-{i % 3} Cityford" for i in range(30)), prose + more + "\nTags: bridge, mayor, trade", "", None, "short", french, (prose + more).upper(), (more + prose) + "\nhttps://a.example/b"]
    bad = ["cheap boiler best boiler " * 40, "\n".join(f"https://shop-{i}.example/a/{i}.html" for i in range(20)), "\n".join(f"SKU {i}123 famous boiler ornate £{i}.99 add to basket" for i in range(20)), " ".join(f"#tag{i % 7}" for i in range(60)), "Looking for cheap sofa? Get cheap sofa here. Buy cheap sofa today. " * 20, prose + "online poker casino bonus " * 60]
    df = spark.createDataFrame([(k, t, 0.0) for k, t in enumerate(good + bad)], "id long, text string, share double")
    got = {r["id"] for r in page_prose.page_scores(df, "id", "text", model).where("share > 0.5").collect()}
    assert got == set(range(len(good), len(good + bad)))
    assert page_prose.page_scores(df.limit(0), "id", "text", model).count() == 0


def test_repeated_sentences_and_fragments_are_prose(spark, small):
    model = prose_model(spark, small)
    prose = "The council of the town opened a new bridge on Monday, and the mayor said that it would help trade in the region. "
    good = [prose * 3, "- " + prose + "\n- " + prose, prose * 4 + "\nTags: bridge, mayor, trade", "Le conseil a vendu le musée à Paris après un long débat. " * 2, (prose * 2).upper()]
    good += ["La tormenta vendió la tormenta en Janburg el lunes, Reis Louriackby. El concejo vendió la estación en Niabrisdale en otoño, Cogroth Tae.", "Die Schule schloss die Schule in Prien am Montag, Rolm Jesard. Das Gutachten schloss die Brücke in Loskus im Frühjahr, Vin Seisk."]
    words = prose.lower().replace(",", "").replace(".", "").split()
    good += [" ".join(words[a : a + n]) for n in range(1, 12) for a in range(0, len(words) - n, 3)]
    assert [t for t in good if model.share(t)[0] > 0.5] == []


def test_bounds_follow_the_number_of_tokens(spark, small):
    model = prose_model(spark, small)
    assert (np.diff(model.high) <= 0).all()
    words = "cheap boiler discount casino online poker bargain mattress offer sofa best heater outlet voucher free laptop".split()
    flagged = [model.share(" ".join(words[:n]))[0] > 0.5 for n in (1, 2, 3, 16)]
    assert flagged == [False, False, False, True]


def test_model_is_fitted_on_all_fragments(spark, small):
    rows = [r["document_norm"] for r in spark.read.parquet(f"{small}/master_table_xsum_n300_seed42_v4_dcq4_frozen.parquet").limit(12).collect()]
    df = spark.createDataFrame([(t,) for t in [*rows, None, ""]], "t string").repartition(3)
    model = page_prose.fit(df, "t", 0.01)
    low = [[] for _ in page_prose.SIZES]
    for t in filter(None, rows):
        for x in (t, " ".join(page_prose._PLAIN.findall(t.lower()))):
            tokens = page_prose._TOKEN.findall(x)
            own = [w.lower() for w, c in zip(tokens, page_prose._classes(tokens), strict=True) if page_prose._CACHED[c]]
            for k, n in enumerate(page_prose.SIZES):
                low[k] += [model._cached_costs(own[s : s + n])[0] for s in range(len(own) - n + 1)]
    assert np.allclose(model.low, [np.quantile(x, 0.01) for x in low])
    page_prose.fit(df.limit(0), "t")


def test_repeated_names_are_keywords(spark, small):
    model = prose_model(spark, small)
    results = "Results\n" + "\n".join(f"Townham {i}-{i % 3} Cityford" for i in range(30))
    bad = ["Cheap Flights Cheap Hotels " * 30, "Home Offers\nHome Deals\nHome Offers\nOffers Deals\n" * 20]
    assert [model.share(t)[0] > 0.5 for t in [results, *bad]] == [False, True, True]


def test_filter_lets_clean_texts_pass(spark):
    from pyspark.sql import functions as F

    rows = [(k, t) for k, t in enumerate([*CLEAN[:2], *CLEAN[3:6]])] + [(100 + k, t) for k, t in enumerate(ODD)]
    hits = spark.createDataFrame(rows, "id long, t string").where(F.col("t").rlike(lookalikes.candidate_pattern())).collect()
    assert {r["id"] for r in hits if r["id"] >= 100} == {100 + k for k in range(len(ODD))}
    assert {r["id"] for r in hits if r["id"] < 100} <= {2}  # Greek letters look alike, the token then tells
