"""Keyword-stuffed and link-list pages, told apart from pages of sentences (problem 9).

Tokens become function-word groups (articles, prepositions, ... of English, French, German and
Spanish) and word classes (lower-case word, name, number, price, link, hashtag, compound, marks).
A class trigram model is trained on prose; a word of an open class costs, besides its class, what such words cost on
average in the prose. Pages are scored in windows of a line, a piece of a long line or a run of short lines.
A window is no prose when its perplexity is abnormally high (hardly any function words: word lists, links, tags), or when
its perplexity under the same model with a cache of the window's own words is abnormally low and most of them are repeats (the
same few keywords again and again). Names and numbers are context that the trigrams don't score, and names enter the cache only where
there are hardly any figures, so lists of results give no evidence. A page is flagged when more than half of its characters lie in windows that are no prose.

Model and bounds are fitted on all prose of a table given by the caller, in two passes: counts first, then the
fragments' order statistics, of which a task keeps those of the tail only. The bounds are functions of the number of tokens scored: the ``TAIL`` quantiles of all
fragments of so many tokens, so that a few words can't convict a page, without a cut-off by length. The prose is taken as
it is and in lower case without marks. Every page is scored whole, in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words of a window; lines of fewer than SHORT tokens are joined with their like.
WINDOW, SHORT = 40, 12
#: Tokens that the shorter context counts for in a longer one.
PRIOR = 20
#: Weight of the cache in the cost of a word.
CACHE = 0.1
#: Share of the prose's own fragments that lie beyond each bound.
TAIL = 1e-4
#: Numbers of tokens for which bounds are fitted; between them they are interpolated.
SIZES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)
_TOKEN = re.compile(r"<[^<>\n]{1,500}>|https?://[^\s)\"'<>]+|www\.[^\s)\"'<>]+|#\w+|[£€$]\s?\d[\d.,]*\w*|\w+(?:[-'’]\w+)*|\n|[.!?]+|[^\w\s]")
_PLAIN = re.compile(r"\w+")

# Words of the closed classes, in four languages.
GROUPS = {
    "article": "the a an le la les l un une des du der die das den dem ein eine einen einem einer el los las una unos unas al del",
    "of": "of de von d",
    "preposition": "in on at to by for from with about into over under near against between through during per nach im am zum zur mit bei auf aus vor für ohne à au aux dans sur pour par avec sans sous en entre malgré selon con por para sin sobre desde según hasta trotz",
    "and": "and or but yet nor et ou mais und oder aber y e o pero ni",
    "when": "as when while before after since because although though once if until whereas than where que quand pendant avant après parce lorsque als während bevor nachdem weil obwohl wenn cuando mientras antes después porque aunque tras",
    "be": "is are was were be been being am est sont était étaient fut ist sind war waren wurde wurden es son era eran fue fueron",
    "have": "has have had having ont avait avaient hat haben hatte hatten ha han había habían",
    "modal": "will would can could may might must shall should do does did not no wird würde kann nicht pas ne puede",
    "pronoun": "he she it they we you i his its her their our your him them us me this that these those which who whose what there here some any all both each il elle ils elles nous vous je son sa ses leur ce cette qui er sie wir ihr sein seine se su sus él ella ellos lo",
}
OPEN = ("lower", "compound", "price", "link", "tag")
CLASSES = (*GROUPS, *OPEN, "name", "number", "stop", "comma", "mark", "line")
_ID = {c: k for k, c in enumerate(CLASSES)}
_N = len(CLASSES)
_WORDS = {w: _ID[g] for g in reversed(GROUPS) for w in GROUPS[g].split()}
_SCORED = np.array([c not in ("name", "number", "line") for c in CLASSES])
_OPEN = np.array([c in OPEN for c in CLASSES])
_CACHED = np.array([c in ("lower", "compound", "name", "link", "tag") for c in CLASSES])


def word_class(token: str) -> int:
    """The class of one token."""
    low = token.lower()
    if low in _WORDS:
        return _WORDS[low]
    first = token[0]
    if first == "\n":
        return _ID["line"]
    if first == "<" and len(token) > 1:
        return _ID["link" if "href" in low or "://" in low else "mark"]
    if first == "#" and len(token) > 1:
        return _ID["tag"]
    if first in "£€$" and len(token) > 1:
        return _ID["price"]
    if low.startswith(("http://", "https://", "www.")):
        return _ID["link"]
    if first.isdigit():
        return _ID["number"]
    if first.isalpha():
        return _ID["name"] if first.isupper() and not (len(token) > 1 and token.isupper()) else _ID["compound"] if "-" in token else _ID["lower"]
    return _ID["stop"] if first in ".!?" else _ID["comma"] if first in ",;:" else _ID["mark"]


class _Memo(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[token] = k = word_class(token)
        return k


_CLASS = _Memo()


def windows(tokens: list[str], classes: np.ndarray) -> list[tuple[int, int]]:
    """[first, end) of each window: pieces of long lines, and runs of short ones."""
    cuts = [-1, *np.flatnonzero(classes == _ID["line"]).tolist(), len(tokens)]
    out: list[tuple[int, int]] = []
    run = -1
    for a, b in zip(cuts, cuts[1:], strict=False):
        first, n = a + 1, b - a - 1
        if n <= 0:
            continue
        if n < SHORT:
            if run < 0:
                run = first
            elif b - run > WINDOW:
                out.append((run, b))
                run = -1
            continue
        if run >= 0:
            out.append((run, first))
            run = -1
        pieces = max(1, round(n / WINDOW))
        edges = [first + n * k // pieces for k in range(pieces + 1)]
        out += list(zip(edges, edges[1:], strict=False))
    if run >= 0:
        out.append((run, len(tokens)))
    return out


def _classes(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(_CLASS.__getitem__, tokens), np.int64, len(tokens))


def _repeats(words: list[str]) -> np.ndarray:
    """Of each word, the share of the words before it that are the same."""
    seen: dict[str, int] = {}
    out = np.zeros(len(words))
    for k, w in enumerate(words):
        n = seen.get(w, 0)
        if n:
            out[k] = n / k
        seen[w] = n + 1
    return out


class ProseModel:
    """Interpolated class trigrams and a cache of words, with the bounds of what prose does."""

    def __init__(self, three: np.ndarray, words: dict[int, int]) -> None:
        """three: counts of class trigrams; words: how many lower-case words occur so many times. ``high`` and ``low`` are set by ``fit``."""
        three = three.reshape(_N, _N, _N)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 0.5) / (one.sum() + 0.5 * _N)
        # which closed classes are frequent is a matter of style, and one table's style isn't all prose
        p1[: len(GROUPS)] = p1[: len(GROUPS)].mean()
        p2 = (two + PRIOR * p1) / (two.sum(axis=1, keepdims=True) + PRIOR)
        p3 = (three + PRIOR * p2[None]) / (three.sum(axis=2, keepdims=True) + PRIOR)
        times, many = (np.array(x, np.float64) for x in zip(*sorted(words.items() or [(1, 1)]), strict=True))
        freq = times / (times * many).sum()
        #: mean cost of a word of an open class
        self.open = float(-(many * freq * np.log(freq)).sum())
        extra = np.where(_OPEN, self.open, 0)
        self.costs = [np.where(_SCORED, -np.log(p) + extra, 0).ravel() for p in (p1, p2, p3)]
        self.high, self.low = np.full(len(SIZES), np.inf), np.full(len(SIZES), -np.inf)

    def _token_costs(self, classes: np.ndarray) -> list[np.ndarray]:
        """Cost of each token as the first, the second and a later one of a window."""
        a, b, c = (np.concatenate([np.zeros(2, np.int64), classes])[k : k + len(classes)] for k in range(3))
        return [self.costs[0][c], self.costs[1][b * _N + c], self.costs[2][(a * _N + b) * _N + c]]

    def _cached_costs(self, words: list[str]) -> tuple[float, float]:
        """Mean cost of words under the cache of those before them, and the share of them that it has."""
        if not words:
            return self.open, 0.0
        r = _repeats(words)
        return float(-np.log(CACHE * r + (1 - CACHE) * np.exp(-self.open)).mean()), float((r > 0).mean())

    def fragments(self, tokens: list[str], classes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(side, place in SIZES, values) of all fragments: side 0 the mean costs of scored tokens, negated, and side 1 those of cached words."""
        first, second, later = self._token_costs(classes)
        total = np.concatenate([[0.0], np.cumsum(later)])
        at = np.flatnonzero(_SCORED[classes])
        edge = first - later
        edge[:-1] += (second - later)[1:]
        for k, n in enumerate(SIZES):
            if len(at) >= n:
                s, e = at[: len(at) - n + 1], at[n - 1 :] + 1
                yield 0, k, -(total[e] - total[s] + np.where(e - s > 1, edge[s], (first - later)[s])) / n
        own = [tokens[k].lower() for k in np.flatnonzero(_CACHED[classes]).tolist()]
        most, step = SIZES[-1], 4096
        word = np.unique(own, return_inverse=True)[1] if own else np.empty(0, np.int64)
        for a in range(0, len(own), step):
            ids = word[a : a + step + most]
            # of each word, how many of the d words before it are the same
            same = np.zeros((len(ids) + most, most), np.int64)
            for d in range(1, min(most, len(ids))):
                same[d : len(ids), d] = ids[d:] == ids[:-d]
            k = np.arange(most)
            starts = np.arange(min(step, len(ids)))
            again = same.cumsum(axis=1)[starts[:, None] + k, k] / np.maximum(k, 1)
            cost = -np.log(CACHE * again + (1 - CACHE) * np.exp(-self.open)).cumsum(axis=1)
            for j, n in enumerate(SIZES):
                whole = starts + a + n <= len(own)
                if whole.any():
                    yield 1, j, cost[whole, n - 1] / n

    def scores(self, tokens: list[str], classes: np.ndarray) -> list[tuple[int, int, float, float, float, int, int]]:
        """Per window: first, end, mean cost of its scored tokens, mean cost of its words under the cache, share of them that are repeats, and the number of each."""
        first, second, later = self._token_costs(classes)
        total = np.concatenate([[0.0], np.cumsum(later)])
        number = np.concatenate([[0], np.cumsum(_SCORED[classes])])
        cached, names = _CACHED[classes], classes == _ID["name"]
        figures = np.concatenate([[0], np.cumsum((classes == _ID["number"]) | (classes == _ID["price"]))])
        out = []
        for a, b in windows(tokens, classes):
            n = int(number[b] - number[a])
            cost = float(total[b] - total[a]) + float(first[a] - later[a]) + (float(second[a + 1] - later[a + 1]) if b - a > 1 else 0.0)
            own = cached[a:b]
            if 10 * int(figures[b] - figures[a]) >= int(own.sum()):
                own = own & ~names[a:b]
            words = [tokens[k].lower() for k in (np.flatnonzero(own) + a).tolist()]
            out.append((a, b, cost / n if n else 0.0, *self._cached_costs(words), n, len(words)))
        return out

    def share(self, text: str) -> tuple[float, float, float]:
        """(share of the characters in windows that are no prose, highest and lowest window score)."""
        tokens = _TOKEN.findall(text)
        classes = _classes(tokens)
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))])
        found = self.scores(tokens, classes)
        if not found:
            return 0.0, 0.0, self.open
        a, b, cost, own, again, n, m = (np.array(x) for x in zip(*found, strict=True))
        bad = (cost > np.interp(n, SIZES, self.high)) & (n > 0) | (own < np.interp(m, SIZES, self.low)) & (2 * again > 1)
        return float((ends[b] - ends[a])[bad].sum() / ends[-1]), float(cost.max()), float(own.min())


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Tokens and classes of each text, as it is and in lower case without marks."""
    for batch in batches:
        for t in batch.column("t").to_pylist():
            for x in (t, " ".join(_PLAIN.findall(t.lower()))):
                tokens = _TOKEN.findall(x)
                yield tokens, _classes(tokens)


def fit(prose: DataFrame, text_col: str, tail: float = TAIL) -> ProseModel:
    """A model of all prose in ``text_col``, counted where it lies. Null and empty texts are left out; a table without prose has no bounds."""
    rows = prose.select(F.col(text_col).cast("string").alias("t")).where(F.length("t") > 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        three, number, words = np.zeros(_N**3, np.int64), np.zeros(2 * len(SIZES), np.int64), {}

        def told() -> pa.RecordBatch:
            n = len(words)
            out = pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.array(np.zeros(n, np.int64)), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["kind", "at", "word", "n"])
            words.clear()
            return out

        for tokens, classes in _parsed(batches):
            np.add.at(three, (classes[:-2] * _N + classes[1:-1]) * _N + classes[2:], 1)
            for side, own in ((0, _SCORED), (1, _CACHED)):
                number[side * len(SIZES) : (side + 1) * len(SIZES)] += np.maximum(0, own[classes].sum() - np.array(SIZES) + 1)
            for k in np.flatnonzero(classes == _ID["lower"]).tolist():
                words[tokens[k]] = words.get(tokens[k], 0) + 1
            if len(words) > 500_000:
                yield told()
        yield told()
        for kind, x in ((0, three), (2, number)):
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.nulls(len(at), pa.string()), pa.array(x[at])], ["kind", "at", "word", "n"])

    counts = rows.mapInArrow(count, "kind int, at long, word string, n long").groupBy("kind", "at", "word").agg(F.sum("n").alias("n"))
    # of the words, only how many occur so many times reaches the driver
    word = F.col("kind") == 1
    counts = counts.select("kind", F.when(word, F.col("n")).otherwise(F.col("at")).alias("at"), F.when(word, F.lit(1)).otherwise(F.col("n")).alias("n")).groupBy("kind", "at").agg(F.sum("n").alias("n")).collect()
    three, number = np.zeros(_N**3), np.zeros(2 * len(SIZES), np.int64)
    for r in counts:
        if r["kind"] != 1:
            (three if r["kind"] == 0 else number)[r["at"]] = r["n"]
    model = ProseModel(three, {r["at"]: r["n"] for r in counts if r["kind"] == 1})
    place = np.maximum(number - 1, 0) * tail
    least = np.floor(place).astype(np.int64)

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = [[] for _ in number]

        def cut(k: int) -> np.ndarray:
            return np.sort(np.concatenate(kept[k]))[: least[k] + 2] if kept[k] else np.empty(0)

        for n, (tokens, classes) in enumerate(_parsed(batches)):
            for side, j, x in model.fragments(tokens, classes):
                kept[side * len(SIZES) + j].append(x)
            if n % 256 == 255:
                kept = [[cut(k)] for k in range(len(kept))]
        for k in range(len(kept)):
            x = cut(k)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k, np.int32)), pa.array(x, pa.float64())], ["k", "x"])

    ranked = rows.mapInArrow(tails, "k int, x double").withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("x")))
    wanted = F.element_at(F.array(*[F.lit(int(x)) for x in least]), F.col("k") + 1)
    found = {(r["k"], r["rank"] - 1): r["x"] for r in ranked.where((F.col("rank") - 1 == wanted) | (F.col("rank") - 2 == wanted)).collect()}
    bounds = np.full(len(number), -np.inf)
    for k, n in enumerate(number.tolist()):
        if n:
            low = found[k, int(least[k])]
            bounds[k] = low + (found.get((k, int(least[k]) + 1), low) - low) * (place[k] - least[k])
    model.high, model.low = np.minimum.accumulate(-bounds[: len(SIZES)]), bounds[len(SIZES) :]
    return model


def page_scores(pages: DataFrame, id_col: str, text_col: str, model: ProseModel) -> DataFrame:
    """(id, share, log_perplexity, own_perplexity) of every page; those that aren't prose have share > 0.5.

    Null, empty and blank texts score 0; ties at one half aren't flagged; repeated rows are scored
    each; an empty table gives no rows; long texts are scored whole.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            found = np.array([m.share(t) for t in batch.column("text").to_pylist()], np.float64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(found[:, k]) for k in range(3))], ["id", "share", "log_perplexity", "own_perplexity"])

    return rows.mapInArrow(scan, f"id {kind}, share double, log_perplexity double, own_perplexity double")
