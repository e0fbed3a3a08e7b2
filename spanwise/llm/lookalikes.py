"""Visually identical text in different characters, brought to one form (problem 2).

A stand-in is a wide, styled or joined form of a letter, digit or mark, an accent apart from its
letter, an invisible character, a space other than the ordinary one, or a letter of another script
in place of a Latin one. Typographic quotes and dashes, the ellipsis, composed accents and genuine
words of another script stay.

Tokens with a stand-in traverse tries of the corpus vocabulary with a weighted edit automaton, in
which look-alikes, styled forms and ignorable characters cost nothing; the commonest spelling
reached within the allowed cost is canonical. Tokens that reach none are normalised by table, but
one made of another script's letters throughout is then taken for a genuine word, and so is one whose
only odd letters aren't in the table (a unit such as kΩ). Garbled spans
(problem 6) are restored first, so that their odd characters aren't taken for stand-ins.

Plan: a regular expression filters in the JVM; the few affected fields are split into tokens in
Arrow batches. Distinct spellings that the table allows are joined with the vocabulary, which is
counted over all words of all fields (partial counts before the shuffle), and the pairs are matched
in shards of tries by hash, each bounded by its number of affected tokens. Tokens with letters that the
table lacks meet all words of their length that have one sure letter at the same place.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm.wrong_encoding import repair
from spanwise.runtime import materialize

# Letters of other scripts that look like Latin ones (both strings side by side).
_OTHER = "аеорсухѕіјһԁԛԝԍьАВЕКМНОРСТУХЅІЈԌԚԜҺ" + "οναρικυγΑΒΕΖΗΙΚΜΝΟΡΤΥΧϳϲ" + "օոսհցյզ"
_LATIN = "aeopcyxsijhdqwgbABEKMHOPCTYXSIJGQWh" + "ovapikuyABEZHIKMNOPTYXjc" + "onuhgjq"
LOOKALIKE = dict(zip(_OTHER, _LATIN, strict=True)) | {"Һ": "H"}
# Letters of other scripts that resemble Latin ones less, and count only if the vocabulary has the word.
_RESEMBLES = dict(zip("кмтнгпиӏӀвѡ" + "τηχωεβςπ", "kmthrnulIbw" + "tnxweBcn", strict=True))
#: Cost of a letter that resembles less, and of any other letter of another script inside a Latin word.
_NEAR, _FAR = 0.25, 0.5
# What no reader sees, beside the format characters of Unicode.
_IGNORABLE = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0"
#: Styled forms start here; the signs of Latin-1 below are ordinary typography.
_FROM = 0x100
_KEEP = set("…‥‑″‴‶‷⁗™℠№ŉ´¨˘˙˚˛˜˝΄΅·ʹ;")
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}\p{Cf}\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0]+")
_WORDS = r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+"
SHARDS = 64


def _ignorable(c: str) -> bool:
    return c in _IGNORABLE or "\ufe00" <= c <= "\ufe0f" or unicodedata.category(c) == "Cf"


def _odd_space(c: str) -> bool:
    return c not in " \t\n\r\v\f\x1c\x1d\x1e\x1f\x85\u2028\u2029" and (unicodedata.category(c) == "Zs" or c == "\u2800")


def _styled(c: str) -> str | None:
    """The ordinary characters that a wide, styled or joined form stands for."""
    if ord(c) < _FROM or c in _KEEP or "\u0600" <= c <= "\u0fff" or "\uac00" <= c <= "\ud7a3" or "\u3131" <= c <= "\u318e":
        return None
    plain = unicodedata.normalize("NFKC", c)
    if plain == c or unicodedata.normalize("NFC", c) == plain:
        return None
    return plain if all(unicodedata.category(x)[0] in "LNPSM" for x in plain) else None


@lru_cache(maxsize=1)
def candidate_pattern() -> str:
    """Java pattern of the characters that may be stand-ins, by rule; texts without one are in form already.

    The commonest other characters are ruled out first, since a class of many ranges is slow.
    """
    found = [x for x in range(0xA0, 0x1FC00) if not 0xD800 <= x < 0xE000 and (unicodedata.category(c := chr(x))[0] == "M" or c in LOOKALIKE or _odd_space(c) or _ignorable(c) or _styled(c) is not None)]
    ranges: list[list[int]] = []
    for x in found:
        if ranges and ranges[-1][1] == x - 1:
            ranges[-1][1] = x
        else:
            ranges.append([x, x])
    low = "".join(f"\\x{{{a:x}}}" for a, b in ranges if b <= 0xFF)
    high = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges if b > 0xFF)
    other = r"[\p{L}&&[^\p{IsLatin}]]"
    mixed = rf"{other}(?=\p{{IsLatin}})|(?<=\p{{IsLatin}}){other}"
    return rf"[{low}]|(?=[^\x00-\xff‘’“”–—…€])(?:[{high}\x{{e0000}}-\x{{e0fff}}]|{mixed})"


def _table(token: str) -> str:
    """A token with every stand-in replaced by what it looks like, composed."""
    out = "".join("" if _ignorable(c) else LOOKALIKE.get(c) or (_styled(c) or c) for c in token)
    return unicodedata.normalize("NFC", "".join(LOOKALIKE.get(c, c) for c in out))


def _script(c: str) -> str:
    """'latin', 'other' or '' for what isn't a letter."""
    if not c.isalpha():
        return ""
    base = (_styled(c) or c)[0]
    return "latin" if base.isascii() or "\u00c0" <= base <= "\u024f" or "\u1e00" <= base <= "\u1eff" else "other"


def _unlisted(token: str) -> dict[int, float]:
    """Places, in the token by table, of letters that stand for a Latin one only if the vocabulary tells so, and their cost.

    Empty unless all such letters may: one that resembles a Latin letter in a token of three letters,
    any other between two Latin letters, where the token has three of them.
    """
    plain = _table(token)
    scripts = [_script(c) for c in plain]
    latin = scripts.count("latin")
    places = {k: _NEAR if c in _RESEMBLES else _FAR for k, c in enumerate(plain) if scripts[k] == "other"}
    if not latin or len(plain) < 3 or len(places) > latin:
        return {}
    if any(cost == _FAR and (latin < 3 or [scripts[k - 1] if k else "", *scripts[k + 1 : k + 2]] != ["latin", "latin"]) for k, cost in places.items()):
        return {}
    return places


def _shard(token: str) -> str | None:
    """Length, place and letter of a sure Latin letter, where others are not sure; a word that the token may stand for has them too."""
    places = _unlisted(token)
    plain = _table(token)
    return next((f"{len(plain)} {k + 1} {c}" for k, c in enumerate(plain) if k not in places and _script(c) == "latin"), None) if places else None


def token_state(token: str) -> str:
    """'clean', 'odd' (holds a stand-in for sure), 'mixed' (may hold one, if the vocabulary has the word) or 'foreign' (look-alikes of another script throughout)."""
    if token.isascii():
        return "clean"
    scripts = Counter(map(_script, token))
    latin, other = scripts["latin"], scripts["other"]
    hit = False
    for k, c in enumerate(token):
        if c.isascii():
            continue
        category = unicodedata.category(c)
        if _ignorable(c):
            hit = hit or not (other and not latin and c in "\u200c\u200d")
        elif category[0] == "M":
            hit = hit or (k > 0 and (latin > 0 or unicodedata.normalize("NFC", token) != token))
        elif _styled(c) is not None:
            hit = True
        elif c in LOOKALIKE and latin:
            hit = True
    if hit:
        return "odd"
    if latin and other and _unlisted(token):
        return "mixed"
    return "foreign" if other and not latin and all(c in LOOKALIKE for c in token if c.isalpha()) else "clean"


class Trie:
    """Vocabulary words by their decomposed characters, with counts."""

    def __init__(self, words: dict[str, int]) -> None:
        self.root: dict = {}
        for word, n in words.items():
            node = self.root
            for c in unicodedata.normalize("NFD", word):
                node = node.setdefault(c, {})
            node[""] = (n, word)

    def spell(self, token: str, limit: float = 0.0) -> str | None:
        """The commonest word of least cost. A look-alike, styled form or ignorable is free; other edits cost 1.

        Letters of another script beside Latin ones cost less than an edit, beyond the limit; those that resemble the word's least.
        """
        unsure = _unlisted(token)
        limit += sum(unsure.values())
        chars: list[tuple[str, ...]] = []
        for c in token:
            if _ignorable(c):
                continue
            plain = _styled(c)
            for x in unicodedata.normalize("NFD", plain if plain is not None else c):
                chars.append((x, LOOKALIKE[x]) if x in LOOKALIKE else (x,))
        best: tuple[float, int, str] | None = None
        stack, seen = [(self.root, 0, 0.0)], set()
        while stack:
            node, at, cost = stack.pop()
            if cost > limit or (id(node), at, cost) in seen:
                continue
            seen.add((id(node), at, cost))
            if at == len(chars):
                if "" in node:
                    n, word = node[""]
                    best = min(best or (cost, -n, word), (cost, -n, word))
            else:
                for x in chars[at]:
                    if x in node:
                        stack.append((node[x], at + 1, cost))
                    elif unsure and _script(x) == "other" and x not in LOOKALIKE:
                        if x in _RESEMBLES:
                            if _RESEMBLES[x] in node:
                                stack.append((node[_RESEMBLES[x]], at + 1, cost + _NEAR))
                        else:
                            stack += [(child, at + 1, cost + _FAR) for y, child in node.items() if y and y.isalpha()]
                if cost < limit:
                    stack.append((node, at + 1, cost + 1))
            if cost < limit:
                for x, child in node.items():
                    if x:
                        stack.append((child, at, cost + 1))
                        if at < len(chars):
                            stack.append((child, at + 1, cost + 1))
        return best[2] if best else None


def _rewrite(text: str, spelled: dict[str, str]) -> str:
    """A text in one form, given the canonical spelling of its odd tokens; foreign ones that lack any stay."""

    def token(m: regex.Match) -> str:
        t = m.group()
        state = token_state(t)
        return t if state == "clean" else spelled.get(t, _table(t) if state == "odd" else t)

    out = _TOKEN.sub(token, text)
    return "".join(" " if _odd_space(c) else "" if _ignorable(c) else (_styled(c) or c) if not c.isalpha() else c for c in out)


def vocabulary(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(word, n): every word of Latin letters in all fields, counted."""
    words = F.explode(F.flatten(F.array(*[F.coalesce(F.regexp_extract_all(F.col(f), F.lit(_WORDS), F.lit(0)), F.array().cast("array<string>")) for f in fields])))
    return df.select(words.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _shortened(df: DataFrame, times: int) -> DataFrame:
    """Rows with every text that ``left`` gives when up to ``times`` letters are taken out."""
    for _ in range(times):
        less = F.transform(F.sequence(F.lit(1), F.length("left")), lambda k: F.concat(F.left("left", k - 1), F.substring("left", k + 1, F.length("left"))))
        df = df.withColumn("left", F.explode(F.array_distinct(F.concat(F.array("left"), F.when(F.col("left") != "", less).otherwise(F.array().cast("array<string>")))))).distinct()
    return df


def canonical_fields(df: DataFrame, id_cols: Sequence[str], text_col: str, words: DataFrame | None = None, limit: float = 0.0) -> DataFrame:
    """One row per field that holds a stand-in: the id columns and ``canonical``, the text in one form.

    words: (word, n) of the vocabulary, by default that of ``text_col``. limit: cost of true edits
    that a canonical spelling may have. Null, empty and clean fields give no row; repeated ids give
    a row each; an empty table gives none. Garbled spans come out restored but don't make a row by themselves.
    """
    words = vocabulary(df, [text_col]) if words is None else words
    ids = [f"_id{k}" for k in range(len(id_cols))]
    rows = df.select(*[F.col(c).alias(x) for c, x in zip(id_cols, ids, strict=True)], F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike(candidate_pattern()))
    id_fields = ", ".join(f"{x} {rows.schema[x].dataType.simpleString()}" for x in ids)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, texts, tokens = [], [], []
            for text in batch.column("text").to_pylist():
                text = repair(text)[0]
                odd = sorted({t for t in _TOKEN.findall(text) if token_state(t) != "clean"})
                keep.append(bool(odd) or any(_odd_space(c) or _ignorable(c) or _styled(c) is not None for c in text))
                texts.append(text)
                tokens.append(odd)
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in ids], pa.array(texts, pa.string()), pa.array(tokens, pa.list_(pa.string()))], [*ids, "text", "tokens"]).filter(pa.array(keep, pa.bool_()))

    # read by the tokens and by the rewriting: split once
    found = materialize(rows.mapInArrow(split, f"{id_fields}, text string, tokens array<string>"))
    plain, shard = F.pandas_udf(lambda s: s.map(_table), "string"), F.pandas_udf(lambda s: s.map(_shard), "string")
    odd = found.select(F.explode("tokens").alias("token")).distinct().withColumns({"plain": plain("token"), "key": shard("token")})
    # where every letter is sure, the table's answer is the only spelling at no cost
    sure, unsure = (odd.where("key is null"), odd.where("key is not null")) if limit == 0 else (odd, None)
    if limit == 0:
        known = sure.join(words.withColumnRenamed("word", "plain"), "plain")
    else:
        # spellings within so many edits share what is left when as many letters are taken out of each
        left, right = sure, words.withColumn("left", F.col("word"))
        left = _shortened(left.withColumnRenamed("plain", "left"), int(limit))
        right = _shortened(right, int(limit))
        known = left.join(right, "left").select("token", F.col("word").alias("plain"), "n").distinct()

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        trie = Trie(dict(zip(pdf["plain"], pdf["n"], strict=True)))
        tokens = sorted(set(pdf["token"]))
        return pd.DataFrame({"token": tokens, "spelled": [trie.spell(t, limit) for t in tokens]}).dropna()

    spelled = known.withColumn("shard", F.pmod(F.xxhash64("token"), F.lit(SHARDS))).groupBy("shard").applyInPandas(match, "token string, spelled string")
    if unsure is not None:
        place = F.explode(F.sequence(F.lit(1), F.length("word"))).alias("place")
        keyed = words.select("word", "n", place).select("word", "n", F.concat_ws(" ", F.length("word"), "place", F.substring("word", F.col("place"), F.lit(1))).alias("key"))
        keyed = keyed.join(unsure.select("key").distinct(), "key")

        def match_key(tokens: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
            trie = Trie(dict(zip(words["word"], words["n"], strict=True)))
            return pd.DataFrame({"token": tokens["token"], "spelled": [trie.spell(t) for t in tokens["token"]]}).dropna()

        spelled = spelled.unionByName(unsure.select("token", "key").groupBy("key").cogroup(keyed.groupBy("key")).applyInPandas(match_key, "token string, spelled string"))
    one = found.withColumn("_row", F.monotonically_increasing_id())
    per_row = one.select("_row", *ids, "text", F.explode_outer("tokens").alias("token")).join(spelled, "token", "left")
    gathered = per_row.groupBy("_row", *ids, "text").agg(F.collect_list(F.when(F.col("spelled").isNotNull(), F.struct("token", "spelled"))).alias("pairs"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            new = [_rewrite(t, {p["token"]: p["spelled"] for p in pairs}) for t, pairs in zip(texts, batch.column("pairs").to_pylist(), strict=True)]
            changed = pa.array([a != b for a, b in zip(texts, new, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in ids], pa.array(new, pa.string())], [*ids, "canonical"]).filter(changed)

    out = gathered.mapInArrow(rewrite, f"{id_fields}, canonical string")
    return out.select(*[F.col(x).alias(c) for x, c in zip(ids, id_cols, strict=True)], "canonical")
