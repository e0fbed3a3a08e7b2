"""Scores of stored model answers: quiz choices, completions and repeated samples, in long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions import rubrics
from spanwise.functions.distance import char_distance, token_distance
from spanwise.functions.text import hash_order

LETTERS = ("A", "B", "C", "D", "E")
NONE_OPTION = "None of the provided options."


def bdq_options(items: DataFrame) -> DataFrame:
    """(item, slot, label, option): four paraphrases in hash order and the none-option. items: (item, p array of label and text)."""
    order = hash_order(F.transform("p", lambda x: x["label"]), F.concat(F.lit("BDQ::"), F.col("item")))
    rows = items.select("item", "p", F.posexplode(order).alias("k", "label"))
    text = F.element_at(F.filter("p", lambda x: x["label"] == F.col("label")), 1)["text"]
    opts = rows.select("item", F.element_at(F.array(*map(F.lit, LETTERS)), F.col("k") + 1).alias("slot"), "label", text.alias("option"))
    none = items.select("item", F.lit("E").alias("slot"), F.lit("NONE").alias("label"), F.lit(NONE_OPTION).alias("option"))
    return opts.unionByName(none)


def bcq_options(items: DataFrame, target: DataFrame) -> DataFrame:
    """(model_id, item, slot, label, option): the canonical text in the model's target slot and three of the paraphrases in the others. target: (model_id, slot)."""
    rows = items.join(target.select("model_id", F.col("slot").alias("target")))
    pick = F.slice(hash_order(F.transform("p", lambda x: x["label"]), F.concat(F.lit("BCQ_PICK::"), F.col("item"))), 1, 3)
    fill = hash_order(pick, F.concat(F.lit("BCQ_FILL::"), F.col("item"), F.lit("::"), F.col("target")))
    free = F.filter(F.array(*map(F.lit, LETTERS[:4])), lambda s: s != F.col("target"))
    slots = rows.select("model_id", "item", "p", F.explode(F.arrays_zip(free.alias("slot"), fill.alias("label"))).alias("z"))
    text = F.element_at(F.filter("p", lambda x: x["label"] == F.col("z.label")), 1)["text"]
    three = slots.select("model_id", "item", F.col("z.slot").alias("slot"), F.col("z.label").alias("label"), text.alias("option"))
    one = rows.select("model_id", "item", F.col("target").alias("slot"), F.lit("CANONICAL").alias("label"), F.col("canonical").alias("option"))
    none = rows.select("model_id", "item", F.lit("E").alias("slot"), F.lit("NONE").alias("label"), F.lit(NONE_OPTION).alias("option"))
    return three.unionByName(one).unionByName(none)


def position_bias(answers: DataFrame) -> DataFrame:
    """Per model: the histogram of A-E, the least chosen of A-D (the earlier on ties) and its share of all valid answers."""
    counts = [F.count_if(F.col("choice") == c).alias(f"n_{c.lower()}") for c in LETTERS]
    out = answers.where(F.col("choice").isin(*LETTERS)).groupBy("model_id").agg(F.count("*").alias("n_valid"), *counts)
    least = F.array_min(F.array(*[F.struct(F.col(f"n_{c.lower()}").alias("n"), F.lit(c).alias("slot")) for c in LETTERS[:4]]))
    return out.withColumn("least_slot", least["slot"]).withColumn("pe", F.try_divide(least["n"], F.col("n_valid")))


def quiz_scores(answers: DataFrame, bias: DataFrame, least_valid: int = 50) -> DataFrame:
    """Per model: share of canonical choices, of none-choices, kappa against the position's own share, and the level."""
    valid = answers.where(F.col("choice").isin(*LETTERS)).groupBy("model_id").agg(F.count("*").alias("n_bcq"), F.avg(F.when(F.col("choice") == F.col("target"), 1.0).otherwise(0.0)).alias("cps"), F.avg(F.when(F.col("choice") == "E", 1.0).otherwise(0.0)).alias("e_rate"))
    out = bias.select("model_id", "n_valid", "pe").join(valid, "model_id", "left")
    kappa = F.when((F.col("n_valid") >= least_valid) & (F.col("pe") < 1), (F.col("cps") - F.col("pe")) / (1 - F.col("pe")))
    out = out.withColumn("kappa", kappa)
    return out.withColumn("s", rubrics.ssem(F.col("cps"), F.col("kappa"), F.col("e_rate"))).select("*", F.col("s.level").alias("ssem"), F.col("s.reason").alias("ssem_reason")).drop("s")


def completion_scores(rows: DataFrame, near: float = 0.10) -> DataFrame:
    """Adds exact, distance, near and level to (suffix, completion), which are normalised; null without a suffix."""
    ok = (F.coalesce("suffix", F.lit("")) != "") & F.col("completion").isNotNull()
    d = F.when(ok, char_distance(F.col("completion"), F.col("suffix")))
    out = rows.withColumn("exact", F.when(ok, (F.col("completion") == F.col("suffix")).cast("int"))).withColumn("distance", d)
    return out.withColumn("near", (F.col("distance") <= near).cast("int")).withColumn("smem", rubrics.smem_item(F.col("exact"), F.col("distance")))


def completion_summary(scored: DataFrame) -> DataFrame:
    """Per model: counts, rates with their Wilson bounds, quantiles of the distance and the commonest level (the lower on ties)."""
    levels = [F.count_if(F.col("smem") == k).alias(f"n{k}") for k in range(4)]
    out = scored.where("exact is not null").groupBy("model_id").agg(
        F.count("*").alias("n"), F.sum("exact").alias("n_exact"), F.sum("near").alias("n_near"), *levels,
        F.avg("distance").alias("distance_mean"), F.percentile("distance", [0.1, 0.5, 0.9]).alias("q"),
    )
    low, high = rubrics.wilson(F.col("n_exact"), F.col("n"))
    top = F.array_min(F.array(*[F.struct((-F.col(f"n{k}")).alias("m"), F.lit(k).alias("k")) for k in range(4)]))
    return out.select(
        "model_id", "n", "n_exact", (F.col("n_near") - F.col("n_exact")).alias("n_near_only"), (F.col("n") - F.col("n_near")).alias("n_none"),
        F.round(F.col("n_exact") / F.col("n"), 6).alias("em_rate"), F.round(F.col("n_near") / F.col("n"), 6).alias("ne_rate"), low.alias("em_low"), high.alias("em_high"),
        F.round("distance_mean", 6).alias("distance_mean"), *[F.round(F.col("q")[k], 6).alias(f"distance_p{p}") for k, p in enumerate((10, 50, 90))], top["k"].cast("bigint").alias("dominant_level"),
    )


def sample_scores(samples: DataFrame, eps: float = 0.15, distance=token_distance) -> DataFrame:
    """Per (model_id, item): uar, mned, anchor_mned and peak_eps of its samples.

    samples: (model_id, item, idx, output, tokens, anchor, anchor_tokens), normalised in lower case. Pairs are
    those within one item, whose number of samples is a parameter of the run; each distinct pair of texts is compared once.
    """
    key = ["model_id", "item"]
    own = samples.groupBy(*key).agg(F.count("*").alias("n_samples"), F.count_distinct("output").alias("n_distinct"))
    texts = samples.groupBy(*key, "output").agg(F.count("*").alias("copies"), F.first("tokens").alias("tokens"))
    a, b = texts.select(*key, F.col("output").alias("x"), F.col("copies").alias("cx"), F.col("tokens").alias("tx")), texts.select(*key, F.col("output").alias("y"), F.col("copies").alias("cy"), F.col("tokens").alias("ty"))
    pairs = a.join(b, key).where("x < y").select(*key, (F.col("cx") * F.col("cy")).alias("w"), distance("tx", "ty").alias("d"))
    apart = pairs.groupBy(*key).agg(F.sum(F.col("w") * F.col("d")).alias("apart"))
    near = samples.where("anchor <> ''").select(*key, distance("tokens", "anchor_tokens").alias("d")).groupBy(*key).agg(F.avg("d").alias("anchor_mned"), F.avg((F.col("d") <= eps).cast("double")).alias("peak_eps"))
    n = F.col("n_samples")
    mned = F.when(n >= 2, F.coalesce("apart", F.lit(0.0)) / (n * (n - 1) / 2))
    return own.join(apart, key, "left").join(near, key, "left").select(*key, "n_samples", (F.col("n_distinct") / n).alias("uar"), mned.alias("mned"), "anchor_mned", "peak_eps")


def stability_summary(scored: DataFrame) -> DataFrame:
    """Per model: means, quantiles, counts and shares of levels, the commonest level and that of the whole set."""
    n = F.count("sprob")
    levels = [F.count_if(F.col("sprob") == k).alias(f"n{k}") for k in range(4)]
    out = scored.groupBy("model_id").agg(n.alias("n"), *levels, *[F.round(F.avg(c), 6).alias(f"{c}_mean") for c in ("uar", "mned")], *[F.percentile(c, [0.1, 0.5, 0.9]).alias(f"q_{c}") for c in ("uar", "mned")])
    top = F.array_min(F.array(*[F.struct((-F.col(f"n{k}")).alias("m"), F.lit(k).alias("k")) for k in range(4)]))
    share = [F.bround(F.try_divide(100.0 * F.col(f"n{k}"), F.col("n")), 2).alias(f"pct{k}") for k in range(4)]
    q = [F.round(F.col(f"q_{c}")[k], 6).alias(f"{c}_p{p}") for c in ("uar", "mned") for k, p in enumerate((10, 50, 90))]
    return out.select("model_id", "n", *[f"n{k}" for k in range(4)], *share, "uar_mean", "mned_mean", *q, top["k"].cast("bigint").alias("mode_level"), rubrics.sprob_aggregate(F.col("n"), F.col("n1"), F.col("n2"), F.col("n3")).cast("bigint").alias("sprob_aggregate"))


def length_baseline(control: DataFrame, buckets: int = 4) -> DataFrame:
    """(low, high, uar_median, mned_median) of buckets of equal frequency by length; equal edges are merged.

    The edges are a handful of quantiles in one row; rows find their bucket without a sort of all rows.
    """
    edges = control.agg(F.percentile("n_tokens", [k / buckets for k in range(1, buckets)]).alias("e"))
    which = F.size(F.array_distinct(F.filter("e", lambda x: x < F.col("n_tokens"))))
    placed = control.join(edges).withColumn("bucket", which)
    return placed.groupBy("bucket").agg(F.min("n_tokens").alias("low"), F.max("n_tokens").alias("high"), F.percentile("uar", 0.5).alias("uar_median"), F.percentile("mned", 0.5).alias("mned_median"))


def with_baseline(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """Rows with the medians of their length's bucket, the nearest one (the lower on ties) outside all."""
    every = baseline.agg(F.sort_array(F.collect_list(F.struct("low", "high", "uar_median", "mned_median"))).alias("b"))
    near = F.array_min(F.transform("b", lambda x: F.struct(F.greatest(x["low"] - F.col("n_tokens"), F.col("n_tokens") - x["high"], F.lit(0)).alias("d"), x.alias("x"))))
    return rows.join(every).withColumn("_n", near["x"]).withColumn("uar_control", F.col("_n.uar_median")).withColumn("mned_control", F.col("_n.mned_median")).drop("b", "_n")


def first_choice(raw: Column, retry: Column, parse) -> tuple[Column, Column]:
    """(choice, status): the parsed answer, else that of the one retry."""
    a, b = parse(raw), parse(retry)
    status = F.when(raw.isNull(), "api_error").when(a != "", "ok").when(b != "", "ok_after_retry").otherwise("parse_failed")
    return F.when(a != "", a).otherwise(b), status
