"""Long exact spans shared between records (problem 1).

The paragraphs compared are all windows of ``length`` characters, and a window's MinHash is the
smallest hash among its runs of half that length. One band of one row is tuned for full recall:
equal windows always have the same minimum, so records that share a span always collide. Colliding
windows are then verified by a 128-bit hash of the whole window (edit distance 0, Jaccard similarity 1), and the windows found are merged into
spans. Banding of whole paragraphs couldn't give this: records that share 100 of 400 characters have a
Jaccard similarity far below what any number of bands finds for certain. ``shared_clusters`` groups the records by
the connected components of their shared windows, for removals that leave one of each.

Plan: pass 1 keeps the minima of each distinct text (about 2 for every half window); a partially
aggregated count of distinct texts a minimum drops those that occur in one text only. Pass 2 hashes
the remaining windows alone, and counts them in the same way. Copies of a whole text, told by their MD5, are never
compared with each other, and no two records are ever paired. Hot minima, windows and
texts are split off by their counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwise.llm._components import components
from spanwise.llm._windows import code_points, window_hashes, window_minima
from spanwise.runtime import hot_join, materialize

#: Characters that are hashed at a time.
CHUNK = 1 << 19
_NONE = np.uint64(2**64 - 1)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _minima(texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window that lies in one text: its minimum, its text and its place in it; and the code points."""
    half = length // 2
    codes, starts = code_points(texts)
    own = np.repeat(np.arange(len(texts)), np.diff(starts))
    grams = window_hashes(codes, half)
    at = np.arange(max(0, len(codes) - length + 1))
    inside = own[at] == own[at + length - 1]
    grams[own[: len(grams)] != own[half - 1 :]] = _NONE
    least = window_minima(grams, length - half + 1)
    at = at[inside]
    return least[inside], own[at], at - starts[own[at]], codes


def _lists(values: np.ndarray, owners: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of n lists whose owners are in order."""
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(owners, minlength=n), out=offsets[1:])
    return offsets, values


def _found(records: DataFrame, keys: tuple[str, ...], text_col: str, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records with ``tid``, the identity of their text; texts with their number of copies; windows found in more than one text, by text and place)."""
    ids = [f"_k{k}" for k in range(len(keys))]
    base = records.select(*[F.col(c).alias(x) for c, x in zip(keys, ids, strict=True)], F.col(text_col).cast("string").alias("text")).where(F.length("text") >= length)
    base = base.withColumn("tid", F.unhex(F.md5("text")))
    id_fields = ", ".join(f"{x} {base.schema[x].dataType.simpleString()}" for x in ids)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _chunks(texts):
                part = texts[a:b]
                least, own, _, _ = _minima(part, length)
                new = np.ones(len(least), bool)
                new[1:] = (least[1:] != least[:-1]) | (own[1:] != own[:-1])
                offsets, values = _lists(least[new].view(np.int64), own[new], len(part))
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(x) for x in ids], rows.column("tid"), pa.array([len(t) for t in part], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                    [*ids, "tid", "n_chars", "minima"],
                )

    seen = materialize(base.mapInArrow(first_pass, f"{id_fields}, tid binary, n_chars int, minima array<long>"))
    texts = seen.groupBy("tid").agg(F.count("*").alias("copies"), F.min(F.struct(*ids)).alias("rep"))
    minima = seen.select("tid", F.explode("minima").alias("m"))
    common = materialize(minima.groupBy("m").agg(F.min(F.xxhash64("tid")).alias("a"), F.max(F.xxhash64("tid")).alias("b"), F.count("*").alias("n")).where("a <> b").select("m", "n"))
    wanted = hot_join(minima, common, "m").groupBy("tid").agg(F.collect_set("m").alias("minima"))
    todo = wanted.join(texts, "tid").select("minima", "tid", *[F.col(f"rep.{x}").alias(x) for x in ids])
    located = base.join(todo.withColumnRenamed("tid", "_tid"), ids).where("tid = _tid").select("tid", "text", "minima")

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted_minima = batch.column("text").to_pylist(), batch.column("minima")
            for a, b in _chunks(texts):
                part = texts[a:b]
                least, own, at, codes = _minima(part, length)
                lists = wanted_minima.slice(a, b - a)
                marks = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                whose = np.repeat(np.arange(b - a), lists.value_lengths().to_numpy(zero_copy_only=False))
                where = np.flatnonzero(np.isin(least, marks))
                pairs = set(zip(whose.tolist(), marks.tolist(), strict=True))
                where = where[np.fromiter(((o, m) in pairs for o, m in zip(own[where].tolist(), least[where].tolist(), strict=True)), bool, len(where))]
                starts = np.concatenate([[0], np.cumsum([len(t) for t in part])])
                begin = starts[own[where]] + at[where]
                # two hashes of 64 bits, over differently coded symbols
                columns = [window_hashes(c, length)[begin].view(np.int64) for c in (codes, codes.astype(np.uint64) + np.uint64(1 << 40))] + [at[where].astype(np.int32)]
                offsets, _ = _lists(at, own[where], b - a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("tid").slice(a, b - a), *(pa.ListArray.from_arrays(pa.array(offsets), pa.array(c)) for c in columns)],
                    ["tid", "hashes", "checks", "places"],
                )

    windows = materialize(located.mapInArrow(second_pass, "tid binary, hashes array<long>, checks array<long>, places array<int>"))
    each = windows.select("tid", F.explode(F.arrays_zip("hashes", "checks", "places")).alias("w")).select("tid", F.col("w.hashes").alias("h"), F.col("w.checks").alias("g"), F.col("w.places").alias("at"))
    own = F.xxhash64("tid")
    common = materialize(each.groupBy("h", "g").agg(F.min(own).alias("a"), F.max(own).alias("b"), F.min_by("tid", own).alias("first"), F.count("*").alias("n")).where("a <> b").select("h", "g", "first", "n"))
    return seen.drop("minima"), texts, hot_join(each, common, ["h", "g"])


def shared_spans(records: DataFrame, keys: tuple[str, ...], text_col: str, length: int = 100) -> DataFrame:
    """Per record that shares a span: the key columns, ``n_chars`` and ``n_shared``, the characters inside shared spans.

    A span counts when it has at least ``length`` characters as stored and occurs in a record of another
    key. Null, empty and shorter texts give no row; repeated keys count as records of their own; an
    empty table gives no rows; texts of any length are taken whole, in chunks.
    """
    seen, texts, hits = _found(records, keys, text_col, length)
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("tid").orderBy("at"))
    covered = hits.select("tid", F.least(F.coalesce(gap, F.lit(length)), F.lit(length)).alias("new")).groupBy("tid").agg(F.sum("new").alias("covered"))
    state = materialize(texts.select("tid", F.col("copies").alias("n")).join(covered, "tid", "left").where("n > 1 or covered is not null"))
    out = hot_join(seen, state, "tid")
    shared = F.when(F.col("n") > 1, F.col("n_chars").cast("long")).otherwise(F.col("covered"))
    return out.select(*[F.col(f"_k{k}").alias(c) for k, c in enumerate(keys)], "n_chars", shared.cast("long").alias("n_shared"))


def shared_clusters(records: DataFrame, keys: tuple[str, ...], text_col: str, length: int = 100) -> DataFrame:
    """Per record that shares a span: the key columns, and those of the smallest record of its cluster as ``first_...``.

    A cluster is a component of records that share spans; removing all of its records but one leaves no shared span. Cases as in ``shared_spans``.
    """
    seen, texts, hits = _found(records, keys, text_col, length)
    ids = [f"_k{k}" for k in range(len(keys))]
    links = hits.select(F.col("tid").alias("a"), F.col("first").alias("b")).where("a <> b").distinct()
    linked = components(texts.select(F.col("tid").alias("v")), links).select(F.col("v").alias("tid"), "component")
    known = texts.join(linked, "tid")
    size = known.groupBy("component").agg(F.sum("copies").alias("size"), F.min("rep").alias("first")).where("size > 1")
    state = materialize(known.join(size, "component").select("tid", F.col("copies").alias("n"), "first"))
    out = hot_join(seen, state, "tid")
    return out.select(*[F.col(x).alias(c) for x, c in zip(ids, keys, strict=True)], *[F.col(f"first.{x}").alias(f"first_{c}") for x, c in zip(ids, keys, strict=True)])
