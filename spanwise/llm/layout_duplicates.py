"""Duplicates hidden by formatting differences, collapsed and counted (problem 4).

Two records are copies when their canonical keys agree: the letters and digits of a text in
their order, without case, or, for JSON lines, the same fields with values equal in that
sense. Texts without a letter or digit have no key and are left out.

Plan: one narrow pass makes (id, key). Each task counts its keys in a bounded table of counters that loses no key with a
share of its rows above ``1 / (2 * HOT_SHARE)``; the counts of all tasks together leave at most ``2 * HOT_SHARE`` candidates, which are
then counted exactly. Keys above a share of ``1 / HOT_SHARE`` of all rows are hot, at most ``HOT_SHARE`` of them. They are
aggregated in two levels, by key and salt and then by key, and broadcast to their rows, which never meet in one task; all other keys take one
shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.runtime import materialize

#: A key is hot with more than one such part of all rows. Tasks that share a hot key's first aggregation.
HOT_SHARE, SALTS = 4096, 16
_NOT_ALNUM = re.compile(r"[\W_]+")


def text_key(text: Column) -> Column:
    """128-bit key of the letters and digits of a text without case; null where there are none."""
    bare = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")
    return F.when(bare != "", F.md5(bare))


def _bare(value: object) -> str:
    """A JSON value as its letters and digits; containers field by field and item by item."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{v}" for k, v in sorted((str(k).lower(), _bare(v)) for k, v in value.items())) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_bare, value)) + "]"
    return _NOT_ALNUM.sub("", (value if isinstance(value, str) else json.dumps(value)).lower())


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _decoded(line: str | None) -> dict | None:
    """The object on a line of strictly valid JSON; null for anything else."""
    if line is None:
        return None
    try:
        value = json.loads(line, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def json_key(raw: Column) -> Column:
    """128-bit key of a JSON object: field names without case, values by letters and digits, any order."""

    @F.pandas_udf("string")
    def canonical(lines):
        return lines.map(lambda x: None if (d := _decoded(x)) is None else _bare(d), na_action=None)

    return F.md5(canonical(raw))


def keyed(df: DataFrame, id_col: str, key: Column) -> DataFrame:
    """(id, key) of the rows that have a key."""
    return df.select(F.col(id_col).cast("long").alias("id"), key.alias("key")).where("key is not null and id is not null")


def _partial_counts(rows: DataFrame, capacity: int) -> DataFrame:
    """(key, n) of each task: lower bounds of the counts of its commonest keys, each short by at most ``1 / capacity`` of the task's rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            for x in pc.value_counts(batch.column("key")).to_pylist():
                held[x["values"]] = held.get(x["values"], 0) + x["counts"]
            if len(held) > capacity:
                # every counter is lowered by the one that would be the first without a place
                least = sorted(held.values(), reverse=True)[capacity]
                held = {k: n - least for k, n in held.items() if n > least}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["key", "n"])

    return rows.select("key").mapInArrow(count, "key string, n long")


def hot_keys(rows: DataFrame, share: int = HOT_SHARE) -> DataFrame:
    """(key) of the keys with more than one ``share``-th of all rows, found exactly; at most ``share`` of them."""
    total = rows.count()
    candidates = _partial_counts(rows, 2 * share).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > F.lit(total / (2 * share)))
    counted = rows.join(F.broadcast(candidates.select("key")), "key").groupBy("key").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > F.lit(max(total / share, 1.0))).select("key")


def groups(rows: DataFrame, hot: DataFrame, salts: int = SALTS) -> DataFrame:
    """(key, n, first_id, hot): copies and smallest id per key. Hot keys in two levels over ``salts`` tasks, all others in one."""
    both = [F.count("*").alias("n"), F.min("id").alias("first_id")]
    salted = rows.join(F.broadcast(hot), "key").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts))).groupBy("key", "salt").agg(*both)
    top = salted.groupBy("key").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"))
    rest = rows.join(F.broadcast(hot), "key", "left_anti").groupBy("key").agg(*both)
    return top.withColumn("hot", F.lit(True)).unionByName(rest.withColumn("hot", F.lit(False)))


def collapse(df: DataFrame, id_col: str, key: Column, share: int = HOT_SHARE) -> DataFrame:
    """One row per distinct record: ``first_id`` (its smallest id) and ``copies``.

    Null, blank and unkeyed records are left out; an empty input gives no rows; repeated ids count each time.
    """
    rows = materialize(keyed(df, id_col, key))
    return groups(rows, materialize(hot_keys(rows, share))).select("first_id", F.col("n").alias("copies"))


def members(df: DataFrame, id_col: str, key: Column, share: int = HOT_SHARE) -> DataFrame:
    """(first_id, id) of every record whose group has two rows or more, the first one included."""
    rows = materialize(keyed(df, id_col, key))
    hot = materialize(hot_keys(rows, share))
    counts = groups(rows, hot).where("n > 1")
    top = rows.join(F.broadcast(counts.where("hot").select("key", "first_id")), "key")
    rest = rows.join(F.broadcast(hot), "key", "left_anti").join(counts.where("not hot").select("key", "first_id"), "key")
    return top.unionByName(rest).select("first_id", "id")


def copies(df: DataFrame, id_col: str, key: Column) -> DataFrame:
    """(first_id, copy_id): every later copy with the smallest id of its group."""
    return members(df, id_col, key).where("id <> first_id").select("first_id", F.col("id").alias("copy_id"))
