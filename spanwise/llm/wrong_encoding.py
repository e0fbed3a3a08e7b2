"""Garbled text from wrong character encodings, found and restored (problem 6).

Every character of a repertoire is encoded as UTF-8 and decoded with each of the encodings that
are taken for it by mistake, once and twice over. The garbled sequences go into one multi-pattern
automaton; only matched spans are replaced, so correct text beside them stays as it is. Bytes of a
single-byte encoding read as UTF-8 leave U+FFFD, which shows the damage but can't be restored.

All other assigned characters are found by the structure of UTF-8: the image of a lead byte, then those of
as many continuation bytes as it asks for. Sequences that correct text may hold as well (a letter and
the quotes, dashes or letters after it) count only beside another span or inside a word. What is
restored is searched once more, so that text garbled by two different encodings comes back as well.

A pair of single-byte encodings (Windows-1252 read as Mac Roman, say) maps letters to letters one by
one and leaves no sequence to find; only its C1 control characters are evident, and are restored.

Plan: a regular expression on the first two characters of all patterns filters in the JVM; only
the few survivors go through Arrow batches to the automaton. No shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Encodings that UTF-8 bytes are mistaken for.
ENCODINGS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1254", "iso8859-15", "mac_roman", "cp437", "cp850")
# What is garbled, as ranges of code points.
REPERTOIRE = ((0xA0, 0x17F), (0x218, 0x21B), (0x2C6, 0x2DD), (0x386, 0x3CE), (0x400, 0x45F), (0x490, 0x491), (0x2010, 0x203A), (0x20AC, 0x20AC), (0x2116, 0x2122), (0xFB01, 0xFB02), (0xFEFF, 0xFEFF))
#: Originals that stand where the garbled sequence is that of several.
FIRST = "”’"
#: Quotes, dashes and the like, which may follow a genuine capital.
_TYPOGRAPHIC = "‘’“”‚„–—…•†‡™"
LOST = "�"
# What may follow a letter in correct text, beside other letters.
_FOLLOWS = frozenset("‘’“”…–—«»‹›™®©°²³¹·¡¿\xa0\xad")
# Lead bytes by the number of continuation bytes.
_LEADS = {1: range(0xC2, 0xE0), 2: range(0xE0, 0xF0), 3: range(0xF0, 0xF5)}


def _decode(data: bytes, encoding: str) -> str:
    """Byte by byte; a byte that the encoding lacks stays as the control character of its number."""
    out = []
    for b in data:
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@lru_cache(maxsize=1)
def patterns() -> dict[str, str]:
    """Garbled sequence -> original character. Where several originals fit, the earlier encoding and character stand."""
    found: dict[str, str] = {}
    originals = [*FIRST, *(chr(x) for a, b in REPERTOIRE for x in range(a, b + 1))]
    for encoding in ENCODINGS:
        once = {c: _decode(c.encode(), encoding) for c in originals}
        for c, g in once.items():
            found.setdefault(g, c)
            if encoding != "cp1251":
                found.setdefault(_decode(g.encode(), encoding), c)
            if encoding in ("cp1252", "cp1254", "cp1250") and any("\x80" <= x <= "\x9f" for x in g):
                found.setdefault("".join(LOST if "\x80" <= x <= "\x9f" else x for x in g), c)
    for b in range(0x80, 0xA0):
        found.setdefault(chr(b), _decode(bytes([b]), "cp1252"))
    return {g: c for g, c in found.items() if g != c and not g.isascii()}


@lru_cache(maxsize=1)
def _small() -> dict[str, str]:
    """Sequences that stand for a capital by the first encoding that has them, and for a small letter by a later one."""
    out: dict[str, str] = {}
    for encoding in ENCODINGS:
        for c in (chr(x) for a, b in REPERTOIRE for x in range(a, b + 1)):
            g = _decode(c.encode(), encoding)
            if c.islower() and patterns().get(g, "").isupper():
                out.setdefault(g, c)
    return out


@lru_cache(maxsize=1)
def _cyrillic() -> frozenset[str]:
    """Patterns that might be two letters of correct Cyrillic text: they count only side by side."""
    others = {_decode(chr(x).encode(), e) for e in ENCODINGS if e != "cp1251" for a, b in REPERTOIRE for x in range(a, b + 1)}
    return frozenset({_decode(chr(x).encode(), "cp1251") for a, b in REPERTOIRE for x in range(a, b + 1)} - others)


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for g, c in patterns().items():
        a.add_word(g, (g, c))
    a.add_word(LOST, (LOST, None))
    a.make_automaton()
    return a


@lru_cache(maxsize=1)
def _images() -> dict[str, tuple[dict[int, str], str]]:
    """For each encoding, the images of the lead bytes by their number of continuation bytes, and of those."""
    return {e: ({n: _decode(bytes(b), e) for n, b in _LEADS.items()}, _decode(bytes(range(0x80, 0xC0)), e)) for e in ENCODINGS}


@lru_cache(maxsize=1)
def _structures() -> list[tuple[str, re.Pattern[str], dict[str, int]]]:
    """(encoding, pattern of whole sequences, byte of each image)."""
    out = []
    for e, (leads, rest) in _images().items():
        sequences = "|".join(f"[{re.escape(leads[n])}][{re.escape(rest)}]{{{n}}}" for n in _LEADS)
        out.append((e, re.compile(f"(?=({sequences}))"), {_decode(bytes([b]), e): b for b in range(0x80, 0x100)}))
    return out


def _sure(g: str, original: str, encoding: str) -> bool:
    """Whether a sequence shows damage by itself, wherever it stands."""
    if original == LOST or original >= "\U0001f000" and len(g) == 4 and (encoding != "cp1251" or g[1] == "џ"):
        return True
    if encoding == "cp1251" or len(g) == 2:
        return False
    if "\u2000" <= original < "\u3000" or original >= "\uf000":
        return True  # no word ends in the image of these lead bytes
    # feminine and masculine ordinals are letters to Unicode
    return not all(x in _FOLLOWS or x.isalpha() and x not in "ªº" and encoding not in ("mac_roman", "cp437", "cp850") for x in g[1:])


def _in_latin(text: str, s: int, e: int) -> bool:
    """Whether a sequence of Windows-1251 stands where no Cyrillic word has it: beside a Latin letter, as a currency before a digit, or as a mark that no word holds."""
    g, before, after = text[s:e], text[s - 1 : s] if s else "", text[e : e + 1]
    if len(g) == 3:
        return g[0] == "в" and g[1] in "Ђ‚"  # a small letter, then a foreign capital or a low quote
    if len(g) != 2 or g[0] not in "ВГДЕ":
        return False
    if g[0] in "ВЕ" and g[1] in "іјѕІЈЅ":  # both may stand for Latin letters
        return g[1] == "Ј" and after.isdigit() and not before.isalpha()
    return any(x.isalpha() and x < "\u0250" for x in (before, after))


def _inside(text: str, s: int, e: int, encoding: str) -> bool:
    """Whether a doubtful sequence stands where correct text has no such letters and signs: inside a word."""
    before, after = text[s - 1 : s] if s else "", text[e : e + 1]
    if "\u2500" <= text[s] <= "\u259f":
        return before.islower() or after.islower()  # a box touches no letter
    if encoding == "cp1251":
        return _in_latin(text, s, e)
    if text[s + 1].isspace() or not text[s].isalpha():
        return False
    if e - s == 2:
        return text[s].isupper() and (before.islower() or after.islower() and not before.isalpha() and not text[s + 1].isalpha())
    return text[s + 1] == "»" and after.islower()


def _structural(text: str, known: list[tuple[int, int, str | None]]) -> list[tuple[int, int, str | None]]:
    """Known spans and those by structure, left to right; of two that overlap, the known one stands unless the other begins before it and is longer."""
    found: dict[int, tuple[int, str, str]] = {}
    for encoding, pattern, byte in _structures():
        for m in pattern.finditer(text):
            s, g = m.start(), m.group(1)
            try:
                original = bytes(byte[x] for x in g).decode()
            except UnicodeDecodeError:
                continue
            if unicodedata.category(original) == "Cn" or s in found and found[s][0] >= s + len(g):
                continue
            found[s] = (s + len(g), original, encoding)
    if not found:
        return known
    new: list[tuple[int, int, str, str]] = []
    k = 0
    for s, (e, original, encoding) in sorted(found.items()):
        if new and new[-1][1] > s:
            continue
        while k < len(known) and known[k][1] <= s:
            k += 1
        over = []
        for x in known[k:]:
            if x[0] >= e:
                break
            if not new or x[0] >= new[-1][1]:
                over.append(x)
        if all(s <= a and b - a < e - s and (b <= e or _sure(text[s:e], original, encoding)) for a, b, _ in over):
            new.append((s, e, original, encoding))
    own = [_sure(text[s:e], o, c) or _inside(text, s, e, c) for s, e, o, c in new]
    starts, ends = {a for a, _, _ in known}, {b for _, b, _ in known}
    out = []
    for j, (s, e, o, c) in enumerate(new):
        ok = own[j]
        if not ok:
            left = j > 0 and new[j - 1][1] == s and new[j - 1]
            right = j + 1 < len(new) and new[j + 1][0] == e and new[j + 1]
            beside = [x for x in (left, right) if x]
            ok = s in ends or e in starts or bool(beside)
            if ok and c == "cp1251":
                # letters throughout may be a word in capitals, or of Ukrainian
                ok = any(not x.isalpha() for a, b in [(s, e), *[(x[0], x[1]) for x in beside]] for x in text[a:b])
        if ok:
            out.append((s, e, None if o == LOST else o))
    kept = [x for x in known if not any(s < x[1] and x[0] < e for s, e, _ in out)] if out else known
    return sorted([*kept, *out])


@lru_cache(maxsize=1)
def candidate_regex() -> str:
    """Matches every text that holds a pattern, by the pairs of its first two characters' classes; few others."""
    esc = lambda chars: "".join(f"\\x{{{ord(c):x}}}" for c in sorted(chars))
    long = [g for g in patterns() if len(g) > 1]
    single = {g for g in patterns() if len(g) == 1} | {LOST}
    three = [g for g in long if len(g) > 2]
    two = [g for g in long if len(g) == 2]
    parts = [f"[{esc(single)}]"]
    for part in (two, three):
        by_second: dict[frozenset[str], set[str]] = {}
        firsts = {g[0] for g in part}
        for f in firsts:
            by_second.setdefault(frozenset(g[1] for g in part if g[0] == f), set()).add(f)
        parts += [f"[{esc(fs)}][{esc(ss)}]" for ss, fs in sorted(by_second.items(), key=lambda x: sorted(x[1]))]
    for leads, rest in _images().values():
        parts += [f"[{esc(leads[n])}]" + f"[{esc(rest)}]" * n for n in _LEADS]
    return rf"(?=[^\x00-\x7f])(?:{'|'.join(parts)})"


def spans(text: str) -> list[tuple[int, int, str | None]]:
    """(start, end, original) of each garbled span, left to right; None where the original is lost."""
    a = _automaton()
    raw = [(end - len(g) + 1, end + 1, c) for end, (g, c) in a.iter_long(text)]
    out = []
    for k, (s, e, c) in enumerate(raw):
        g = text[s:e]
        if len(g) == 2 and g[0].isupper() and g[1] in _TYPOGRAPHIC and s and text[s - 1].isupper() and not text[e : e + 1].islower():
            continue  # a word in capitals, then a quote or dash
        if g in _cyrillic() and not _in_latin(text, s, e) and not (k and raw[k - 1][1] == s and text[raw[k - 1][0] : s] in _cyrillic() or k + 1 < len(raw) and raw[k + 1][0] == e and text[e : raw[k + 1][1]] in _cyrillic()):
            continue
        if g in _small() and s and text[s - 1].islower():
            c = _small()[g]  # no capital follows a small letter
        out.append((s, e, c))
    return _structural(text, out)


def repair(text: str) -> tuple[str, int, int]:
    """(text with every restorable span restored, spans restored, characters lost)."""
    found = spans(text)
    if not found:
        return text, 0, 0
    parts, at, lost, first = [], 0, 0, 0
    whole: list[str] = []  # originals side by side
    for s, e, c in [*found, (len(text), len(text), None)]:
        if whole and (s > at or c is None):
            parts.append(_again(text[first:at], "".join(whole)))
            whole = []
        parts.append(text[at:s])
        if c is None:
            parts.append(text[s:e])
            lost += s < e
        else:
            first = first if whole else s
            whole.append(c)
        at = e
    return "".join(parts), len(found) - lost, lost


def _undone(text: str) -> Iterator[str]:
    """What the text was before each encoding that may have garbled the whole of it."""
    for _, _, byte in _structures():
        try:
            yield bytes(byte[x] if x in byte else ord(x) if x < "\x80" else 256 for x in text).decode()
        except ValueError:
            continue


def _again(garbled: str, restored: str) -> str:
    """Restored characters side by side, without what a first wrong encoding had made of them."""
    if len(restored) > 1:
        for once in _undone(garbled):
            for twice in _undone(once):
                if twice != once and all(unicodedata.category(x) not in ("Cn", "Cc") for x in twice):
                    return twice
    return repair(restored)[0] if len(restored) > 1 or "\x80" <= restored <= "\x9f" else restored


def repair_fields(df: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """One row per garbled field: (id, field_name, restored, n_restored, n_lost).

    ``restored`` is the whole field with matched spans replaced. Null, empty and correct fields give no row;
    repeated ids give a row each; texts of any length are scanned in one pass.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("text")) for f in fields]))
    rows = df.select(F.col(id_col).alias("id"), pairs.alias("p")).select("id", "p.field_name", "p.text").where(F.col("text").rlike(candidate_regex()))
    kind = df.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fixed = [repair(x) for x in batch.column("text").to_pylist()]
            keep = pa.array([n + lost > 0 for _, n, lost in fixed], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("field_name"), pa.array([x for x, _, _ in fixed], pa.string()), pa.array([n for _, n, _ in fixed], pa.int32()), pa.array([n for _, _, n in fixed], pa.int32())],
                ["id", "field_name", "restored", "n_restored", "n_lost"],
            ).filter(keep)

    return rows.mapInArrow(scan, f"id {kind}, field_name string, restored string, n_restored int, n_lost int")
