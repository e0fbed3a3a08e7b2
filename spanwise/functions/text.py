"""Text functions as Column expressions that stay in the JVM; an Arrow UDF where Spark lacks the function."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

# Characters that the lexical form replaces, and by what.
LEXICAL_REPLACEMENTS = (
    ("‘", "'"),
    ("’", "'"),
    ("“", '"'),
    ("”", '"'),
    ("–", "-"),
    ("—", "-"),
    ("−", "-"),
    ("£", " GBP "),
    ("€", " EUR "),
    (" ", " "),
)
# Joined forms that decompose into several ASCII characters.
JOINED = ("ﬀ", "ﬁ", "ﬂ", "ﬃ", "ﬄ", "ﬆ", "…", "™", "½", "¼", "¾", "№")


def _folded(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if x.isascii())


#: Characters that decompose into one ASCII character and marks, by rule.
_SINGLE = [c for c in map(chr, [*range(0xA1, 0x3400), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)]) if len(_folded(c)) == 1]
_LONGER = [(a, b) for a, b in (*LEXICAL_REPLACEMENTS, *((x, _folded(x)) for x in JOINED)) if len(b) > 1]
_SHORTER = {a: b for a, b in LEXICAL_REPLACEMENTS if len(b) == 1}
ACCENTED = "".join([*_SHORTER, *(c for c in _SINGLE if c not in _SHORTER)])
PLAIN = "".join([*_SHORTER.values(), *(_folded(c) for c in _SINGLE if c not in _SHORTER)])
_SPACE = r"[\s\x1c-\x1f\u0085   -     　]+"


def collapse(c: Column) -> Column:
    """Runs of white space of any script as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def strip(c: Column) -> Column:
    """A text without white space of any script at its ends."""
    return F.regexp_replace(c, f"^{_SPACE}|{_SPACE}$", "")


def canonical(c: Column) -> Column:
    """The form for lexical comparison: marks and currencies spelt, accents and other non-ASCII dropped, lower case.

    Null becomes ''. Characters that fold into one ASCII character and the common joined forms are folded in
    the JVM; ``canonical_full`` decomposes the few others too, in a UDF.
    """
    out = F.coalesce(c, F.lit(""))
    spelt = F.reduce(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _LONGER]), out, lambda acc, p: F.replace(acc, p["a"], p["b"]))
    # one step a pair instead of a chain of calls, which would make a method too long to be compiled
    out = F.when(out.rlike("[" + "".join(a for a, _ in _LONGER) + "]"), spelt).otherwise(out)
    out = F.translate(out, ACCENTED, PLAIN)
    return collapse(F.lower(F.regexp_replace(out, r"[^\x00-\x7F]", "")))


@F.pandas_udf(StringType())
def _decomposed(s):
    return s.map(lambda x: "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch)), na_action="ignore")


def canonical_full(c: Column) -> Column:
    """``canonical`` with compatibility decomposition of every character, in Arrow batches where a text isn't plain."""
    out = F.coalesce(c, F.lit(""))
    for a, b in LEXICAL_REPLACEMENTS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return collapse(F.lower(F.regexp_replace(_decomposed(out), r"[^\x00-\x7F]", "")))


def tokens(canonical_text: Column) -> Column:
    """ASCII words of a text that is in canonical form."""
    return F.regexp_extract_all(canonical_text, F.lit("[a-z0-9]+"), F.lit(0))


def ngrams(words: Column, k: int, limit: int | None = None) -> Column:
    """Runs of k words joined by a space, the first ``limit`` of them; none where there are fewer words."""
    n = F.size(words) - (k - 1)
    if limit is not None:
        n = F.least(n, F.lit(limit))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.when(n >= 1, grams).otherwise(F.array().cast("array<string>"))


def normalize_line(c: Column) -> Column:
    """Lower case, runs outside printable ASCII as a space, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\x20-\x7E]+", " "), r"\s+", " "))


def normalize_for_dedupe(c: Column) -> Column:
    """Lower case and collapsed; null as ''."""
    return collapse(F.lower(F.coalesce(c, F.lit(""))))


@F.pandas_udf(StringType())
def nfkc(s):
    """Compatibility composition."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def normalize_text(c: Column) -> Column:
    """Compatibility composition, white space collapsed; null as ''. Texts of Latin-1 without signs skip the UDF."""
    plain = F.coalesce(c, F.lit(""))
    return collapse(F.when(plain.rlike(r"[^\x00-\x9f¡-§©«-®°±¶·»¿-ž‐-‖‘-‟€]"), nfkc(plain)).otherwise(plain))


def for_prompt(c: Column) -> Column:
    """As ``normalize_text``, with straight quotes and plain dashes."""
    return F.translate(normalize_text(c), "–—‘’“”", "--''\"\"")


def word_tokens(c: Column) -> Column:
    """Words of any script, and each mark by itself, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))


def looks_like_summary(line: Column, low: int = 12, high: int = 140, periods: int = 4) -> Column:
    """Whether a line has a summary's number of words and full stops, and half of its words are alphabetic."""
    words = F.regexp_extract_all(F.lower(line), F.lit("[a-z0-9]+"), F.lit(0))
    n = F.size(words)
    alphabetic = F.size(F.filter(words, lambda w: w.rlike("^[a-z]+$")))
    return n.between(low, high) & (F.regexp_count(line, F.lit(r"\.")) <= periods) & (alphabetic * 2 >= n)


def gold_suffix(reference: Column, prefix: Column) -> Column:
    """What follows the prefix in the reference; '' where it doesn't begin so."""
    return F.when(F.startswith(reference, prefix) & (prefix != ""), F.trim(F.substring(reference, F.length(prefix) + 1, F.length(reference)))).otherwise("")


def make_prefix(c: Column) -> Column:
    """The first 40 % of the words, at least 12 and never all."""
    words = F.split(c, " ")
    n = F.size(words)
    return F.array_join(F.slice(words, 1, F.least(F.greatest(F.lit(12), F.floor(n * 0.4).cast("int")), F.greatest(F.lit(1), n - 1))), " ")


def hash_order(items: Column, seed: Column) -> Column:
    """Items in the order of the hashes of seed and item: a shuffle that every engine repeats."""
    keyed = F.transform(items, lambda x: F.struct(F.sha2(F.concat(seed, F.lit("::"), x), 256).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def seed_of(c: Column) -> Column:
    """A 32-bit number from a text: the first eight hexadecimal digits of its SHA-256."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("bigint")


def parse_choice(c: Column) -> Column:
    """The letter A-E that an answer chooses, '' where it chooses none; the first rule that matches counts."""
    up = F.upper(collapse(F.coalesce(c, F.lit(""))))
    rules = [
        F.regexp_extract(up, r"^\s*([ABCDE])\b", 1),
        F.regexp_extract(up, r"\b(ANSWER|OPTION|CHOICE)\s*(?:IS\s*)?[:\-]?\s*([ABCDE])\b", 2),
        F.regexp_extract(up, r"\(\s*([ABCDE])\s*\)", 1),
        F.regexp_extract(F.right(up, F.lit(50)), r"\b([ABCDE])\b", 1),
    ]
    return F.coalesce(*[F.nullif(r, F.lit("")) for r in rules], F.lit(""))


def redact(c: Column) -> Column:
    """Secrets in messages replaced."""
    return F.regexp_replace(F.regexp_replace(c, r"Bearer\s+\S+", "Bearer [REDACTED]"), r"sk-[A-Za-z0-9._\-]+", "sk-[REDACTED]")


def file_split(name: Column) -> Column:
    """The split that a file's name tells."""
    base = F.lower(F.regexp_extract(name, r"([^/:]+)$", 1))
    return F.when(base.contains("test"), "test").when(base.contains("train"), "train").when(base.contains("val"), "validation")


def detected_split(c: Column) -> Column:
    """The split that a text names beside the word split."""
    low = F.lower(c)
    return F.when(low.contains("split"), F.when(low.contains("test"), "test").when(low.contains("train"), "train").when(low.contains("val"), "validation"))


def four_lines(c: Column) -> Column:
    """The first four lines of an answer that aren't blank, without bullets and numbers; null where there are fewer."""
    lines = F.transform(F.split(c, "\n"), strip)
    # Fixed value: what begins a listed line.
    bare = F.transform(F.filter(lines, lambda x: x != ""), lambda x: strip(F.regexp_replace(x, r"^(\d+[\).\s]+|[-•]\s+)", "")))
    kept = F.filter(bare, lambda x: x != "")
    return F.when(F.size(kept) >= 4, F.slice(kept, 1, 4))


def is_one_sentence(c: Column) -> Column:
    """At most two marks that end a sentence, as abbreviations have some."""
    return F.regexp_count(c, F.lit("[.!?]")) <= 2


@F.pandas_udf(IntegerType())
def changed_characters(s):
    """How many characters compatibility composition changes, each by itself."""
    return s.map(lambda x: sum(unicodedata.normalize("NFKC", c) != c for c in x), na_action="ignore")


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))
