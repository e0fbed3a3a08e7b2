"""Best representative of each duplicate group, built from consistent bundles (problem 3).

A bundle is a set of fields that are taken together from one row (an id with the source that
vouches for it, a hash with its date). Each bundle has candidates per group, reduced on the map
side to one per distinct value: its rank and the row that supplies it. Branch and bound over whole bundles chooses among
them: in every group of several rows or, where functional dependencies are given, in the groups whose
root (each bundle's best candidate) violates one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.runtime import hot_join, materialize

#: Candidates of a group that one task searches; larger groups are solved by aggregation.
GROUP_CANDIDATES = 100_000


@dataclass(frozen=True)
class Bundle:
    """Fields chosen together. ``rank``: one ascending number or timestamp, null where a row doesn't qualify."""

    name: str
    rank: Column
    value: Column | None = None


def best_rows(rows: DataFrame, group: str, row_id: str, bundles: Sequence[Bundle]) -> DataFrame:
    """Per group and bundle the supplying row: the highest rank, the smaller row id on ties, 0 where none qualifies.

    ``n`` is the number of rows and ``first_id`` the smallest row id. One shuffle of partial aggregates, so a
    group of any size is reduced where its rows lie.
    """
    best = [
        F.max(F.when(b.rank.isNotNull(), F.struct(b.rank.alias("r"), (-F.col(row_id)).alias("i")))).alias(f"_{b.name}")
        for b in bundles
    ]
    agg = rows.groupBy(group).agg(F.count("*").alias("n"), F.min(row_id).alias("first_id"), *best)
    return agg.select(group, "n", "first_id", *[F.coalesce(-F.col(f"_{b.name}.i"), F.lit(0)).cast("long").alias(b.name) for b in bundles])


def looked_up(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Left join with a right side that has one row a key. Rows without a key stay where they are; keys with many rows are split off by their counts."""
    left = materialize(left)
    named = left.where(F.col(on).isNotNull())
    counts = materialize(named.groupBy(on).agg(F.count("*").alias("n")).join(right, on))
    found = hot_join(named, counts, on).drop("n")
    unknown = named.join(counts.select(on), on, "left_anti")
    return found.unionByName(left.where(F.col(on).isNull()).unionByName(unknown), allowMissingColumns=True)


def _search(candidates: list[list[tuple]], allowed: dict[tuple[int, int], dict]) -> list[tuple | None]:
    """Branch and bound over bundles: maximise the sum of scores of mutually consistent candidates.

    candidates: per bundle (score, row, value), best first. allowed: for a dependency (a, b) the
    values of b seen with a value of a; a value seen with none constrains nothing. A bundle may stay empty at score 0.
    """
    n = len(candidates)
    bound = [0.0] * (n + 1)
    for k in range(n - 1, -1, -1):
        bound[k] = bound[k + 1] + max([0.0, *(c[0] for c in candidates[k])])
    best: list = [-1.0, [None] * n]
    chosen: list[tuple | None] = [None] * n

    def fits(k: int, c: tuple) -> bool:
        for (a, b), seen in allowed.items():
            if k not in (a, b) or max(a, b) > k:
                continue
            x, y = (c if a == k else chosen[a]), (c if b == k else chosen[b])
            if x and y and x[2] in seen and y[2] not in seen[x[2]]:
                return False
        return True

    def step(k: int, score: float) -> None:
        if score + bound[k] <= best[0]:
            return
        if k == n:
            best[0], best[1] = score, list(chosen)
            return
        for c in candidates[k]:
            if fits(k, c):
                chosen[k] = c
                step(k + 1, score + c[0])
        chosen[k] = None
        step(k + 1, score)

    step(0, 0.0)
    return best[1]


def _clashing(valued: DataFrame, top: DataFrame, group: str, dependencies: Sequence[tuple[str, str]]) -> DataFrame:
    """Groups that clash: their best a stands beside some b, and never beside their best b."""
    one = lambda c: F.max(c.cast("int")) == 1
    held = valued.join(top.select(group, *[F.col(f"_{x}.v").alias(f"_v_{x}") for x in {y for d in dependencies for y in d}]), group)
    bad = F.lit(False)
    for a, b in dependencies:
        beside = F.col(f"{a}.v").eqNullSafe(F.col(f"_v_{a}")) & F.col(f"{a}.v").isNotNull() & F.col(f"{b}.v").isNotNull()
        bad = bad | (F.coalesce(one(beside), F.lit(False)) & F.max(F.col(f"_v_{b}")).isNotNull() & ~F.coalesce(one(beside & (F.col(f"{b}.v") == F.col(f"_v_{b}"))), F.lit(False)))
    return held.groupBy(group).agg(bad.alias("bad")).where("bad").select(group)


def best_bundles(rows: DataFrame, group: str, row_id: str, bundles: Sequence[Bundle], dependencies: Sequence[tuple[str, str]] = (), limit: int = GROUP_CANDIDATES) -> DataFrame:
    """(group, one row id per bundle): whole bundles of maximal total trust under functional dependencies.

    A dependency (a, b) says that a value of bundle a fixes that of b: the chosen b must be one that some row
    of the group holds beside the chosen a, if any does. Scores are each bundle's ranks scaled to (0, 1] within the
    group; ties go to the smaller row id. Groups whose independent best rows clash are searched, or without dependencies all of several rows, and
    they travel as distinct values, never as rows. A group with more than ``limit`` of these is solved by aggregation instead of a search. Null groups are left out; an empty input gives no rows.
    """
    rows = rows.where(F.col(group).isNotNull())
    names = [b.name for b in bundles]
    # one narrow pass: what each bundle of a row is worth
    valued = materialize(rows.select(group, row_id, *[F.struct(b.rank.cast("double").alias("r"), b.value.cast("string").alias("v")).alias(b.name) for b in bundles]))
    plain = [Bundle(b, F.col(f"{b}.r"), F.col(f"{b}.v")) for b in names]
    # the best rows with their values, in one aggregate
    top = valued.groupBy(group).agg(
        F.count("*").alias("n"), F.min(row_id).alias("first_id"),
        *[F.max(F.when(b.rank.isNotNull(), F.struct(b.rank.alias("r"), (-F.col(row_id)).alias("i"), b.value.alias("v")))).alias(f"_{b.name}") for b in plain],
    )
    top = materialize(top)
    if not dependencies:
        clash = top.where("n > 1").select(group)
    else:
        clash = materialize(_clashing(valued, top, group, dependencies))
    root = top.select(group, "n", "first_id", *[F.coalesce(-F.col(f"_{x}.i"), F.lit(0)).cast("long").alias(x) for x in names])
    inside = valued.join(clash, group)
    # candidates, one a distinct value, with their scores
    long = inside.select(group, F.explode(F.array(*[F.struct(F.lit(k).alias("a"), F.col(f"{x}.r").alias("r"), F.col(f"{x}.v").alias("x"), F.col(row_id).alias("i")) for k, x in enumerate(names)])).alias("c")).select(group, "c.*")
    best = long.where("r is not null").groupBy(group, "a", "x").agg(F.max(F.struct("r", (-F.col("i")).alias("i"))).alias("m")).select(group, "a", "x", F.col("m.r").alias("r"), (-F.col("m.i")).alias("i"))
    candidates = materialize(scored(best, group))
    facts = candidates.select(group, "a", F.lit(-1).alias("b"), "x", F.lit(None).cast("string").alias("y"), "score", "i")
    seen = None
    if dependencies:
        each = F.array(*[F.struct(F.lit(names.index(a)).alias("a"), F.lit(names.index(b)).alias("b"), F.col(f"{a}.v").alias("x"), F.col(f"{b}.v").alias("y")) for a, b in dependencies])
        seen = materialize(inside.select(group, F.explode(each).alias("s")).select(group, "s.*").where("x is not null and y is not null").distinct())
        facts = facts.unionByName(seen.select(group, "a", "b", "x", "y", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("i")))
    sizes = facts.groupBy(group).agg(F.count("*").alias("size"))
    small = sizes.where(F.col("size") <= limit).select(group)
    n, kind = len(bundles), rows.schema[group].dataType.simpleString()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        cand: list[list[tuple]] = [[] for _ in range(n)]
        allowed: dict[tuple[int, int], dict] = {}
        for f in pdf.itertuples(index=False):
            if f.b < 0:
                cand[f.a].append((f.score, int(f.i), f.x))
            else:
                allowed.setdefault((f.a, f.b), {}).setdefault(f.x, set()).add(f.y)
        for c in cand:
            c.sort(key=lambda x: (-x[0], x[1]))
        found = _search(cand, allowed)
        return pd.DataFrame([[pdf[group].iloc[0], *(x[1] if x else 0 for x in found)]], columns=[group, *names])

    searched = facts.join(small, group, "left_semi").groupBy(group).applyInPandas(solve, f"{group} {kind}, " + ", ".join(f"{x} long" for x in names))
    if sizes.where(F.col("size") > limit).limit(1).count():
        large = sizes.where(F.col("size") > limit).select(group)
        searched = searched.unionByName(_aggregated(candidates.join(large, group, "left_semi"), seen and seen.join(large, group, "left_semi"), large, group, names, dependencies))
    # a group without any candidate has nothing to search
    redone = root.select(group, "n", "first_id").join(clash, group).join(searched, group, "left").fillna(0, names)
    return root.join(clash, group, "left_anti").unionByName(redone)


def scored(candidates: DataFrame, group: str) -> DataFrame:
    """Candidates with their score: the share of a bundle's distinct ranks in the group that don't exceed theirs.

    Distinct ranks are numbered by a window over (group, bundle), which Spark sorts and streams without holding it.
    """
    ranks = candidates.select(group, "a", "r").distinct()
    place = F.row_number().over(Window.partitionBy(group, "a").orderBy("r"))
    many = ranks.groupBy(group, "a").agg(F.count("*").alias("of"))
    numbered = ranks.withColumn("place", place).join(many, [group, "a"]).select(group, "a", "r", (F.col("place") / F.col("of")).alias("score"))
    return candidates.join(numbered, [group, "a", "r"])


def _aggregated(candidates: DataFrame, seen: DataFrame | None, groups: DataFrame, group: str, names: Sequence[str], dependencies: Sequence[tuple[str, str]]) -> DataFrame:
    """The same optimum by joins and aggregates, for one dependency or none: of every value of a, the best b that it allows, and of these pairs the best.

    No group is held in a task. Several dependencies at once are an error.
    """
    if len(dependencies) > 1:
        raise ValueError("a group of so many candidates is solved for one dependency only")
    # a bundle may stay empty, at score 0, after all others
    empty = lambda k: groups.select(group, F.lit(k).alias("a"), F.lit(None).cast("string").alias("x"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("i"))
    of = lambda k: candidates.where(F.col("a") == k).select(group, "a", "x", "score", "i").unionByName(empty(k))
    order = F.struct("score", F.when(F.col("i") > 0, -F.col("i")).otherwise(F.lit(-(2**62))).alias("o"), "i")
    ka = kb = -1
    out = groups.select(group)
    if dependencies:
        ka, kb = (names.index(x) for x in dependencies[0])
        out = _tied(candidates, seen, group, names, ka, kb, of, order)
    for k, name in enumerate(names):
        if k not in (ka, kb):
            out = out.join(of(k).groupBy(group).agg(F.max(order).alias("_m")).select(group, F.col("_m.i").alias(name)), group)
    return out.select(group, *names)


def _tied(candidates: DataFrame, seen: DataFrame, group: str, names: Sequence[str], ka: int, kb: int, of: Callable[[int], DataFrame], order: Column) -> DataFrame:
    """The rows of two bundles, the first of which fixes the second."""
    best = of(kb).groupBy(group).agg(F.max(order).alias("free"))
    allowed = seen.join(candidates.where(F.col("a") == kb).select(group, F.col("x").alias("y"), "score", "i"), [group, "y"], "left").groupBy(group, "x").agg(F.max(F.when(F.col("i").isNotNull(), order)).alias("tied"))
    nothing = F.struct(F.lit(0.0).alias("score"), F.lit(-(2**62)).alias("o"), F.lit(0).cast("long").alias("i"))
    pairs = of(ka).join(allowed.withColumn("bound", F.lit(True)), [group, "x"], "left").join(best, group)
    pairs = pairs.withColumn("other", F.when(F.col("bound"), F.coalesce("tied", nothing)).otherwise(F.col("free")))
    own = F.struct("score", F.when(F.col("i") > 0, -F.col("i")).otherwise(F.lit(-(2**62))).alias("o"), "i")
    first, second = (own, F.col("other")) if ka < kb else (F.col("other"), own)
    top = pairs.select(group, F.struct((F.col("score") + F.col("other.score")).alias("t"), first.alias("p"), second.alias("q"), F.col("i").alias("ia"), F.col("other.i").alias("ib")).alias("m")).groupBy(group).agg(F.max("m").alias("m"))
    return top.select(group, F.col("m.ia").alias(names[ka]), F.col("m.ib").alias(names[kb]))


def built(rows: DataFrame, group: str, row_id: str, chosen: DataFrame, fields: dict[str, Sequence[str]]) -> DataFrame:
    """(group, n, first_id, fields): one record a group, each bundle's fields from the row chosen for it, null where none is.

    fields: bundle -> the columns that are taken together from its row.
    """
    wanted = chosen.select(F.explode(F.array(*[F.struct(F.col(group).alias("g"), F.lit(b).alias("b"), F.col(b).alias("i")) for b in fields])).alias("w")).select("w.*").where("i > 0")
    columns = sorted({c for f in fields.values() for c in f})
    found = rows.select(F.col(row_id).alias("i"), F.struct(*columns).alias("v")).join(wanted, "i")
    picked = [F.max(F.when(F.col("b") == b, F.struct(*[F.col(f"v.{c}").alias(c) for c in f]))).alias(f"_{b}") for b, f in fields.items()]
    taken = found.groupBy(F.col("g").alias(group)).agg(*picked)
    out = chosen.select(group, "n", "first_id").join(taken, group, "left")
    return out.select(group, "n", "first_id", *[F.col(f"_{b}.{c}").alias(c) for b, f in fields.items() for c in f])
