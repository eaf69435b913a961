"""Mixing sources to target shares of tokens (problem 9).

The slots of the mixture are points of a low-discrepancy sequence: slot k stands at the
fractional part of k times the golden ratio, and the cumulative target weights map the points to
sources, so that every stretch of the mixture is close to the targets. The documents of a source
are shuffled by a keyed hash and laid end to end; blocks of equal token length cut this line, and
the r-th slot of a source is joined with its r-th block. When a source is used up, its documents
follow once more in another order, up to ``max_repeats`` times.

Positions along a line are prefix sums in two steps: sums by hash bucket first, then inside each
bucket, so no task holds a whole source. The same holds for the ranks of slots within a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwire.llm.tokens import token_counts
from loomwire.scratch import materialize

#: Tokens of a slot, documents of a bucket on average, slots of a chunk.
BLOCK, BUCKET, CHUNK = 2048, 4096, 4096
GOLDEN = 0.6180339887498949


def _prefix(df: DataFrame, groups: list[str], order: str, value: str, out: str, n: int) -> DataFrame:
    """``out``: the sum of ``value`` over the rows of the same ``groups`` that come before in ``order``
    (hash values over the whole range of bigint), with ``n`` buckets of the order."""
    width = (2**64 - 1) // n + 1
    bucketed = df.withColumn("__b", F.floor(F.col(order) / F.lit(float(width))).cast("bigint"))
    sums = bucketed.groupBy(*groups, "__b").agg(F.sum(value).alias("__s"))
    before = Window.partitionBy(*groups).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    names = {g: f"__{i}" for i, g in enumerate(groups)}
    starts = sums.withColumn("__start", F.coalesce(F.sum("__s").over(before), F.lit(0))).drop("__s").withColumnsRenamed({**names, "__b": "__sb"})
    on = F.col("__b") == F.col("__sb")
    for g, name in names.items():
        on = on & (F.col(g) == F.col(name))
    inside = Window.partitionBy(*groups, "__b").orderBy(order, "__tie").rowsBetween(Window.unboundedPreceding, -1)
    return bucketed.join(starts, on).withColumn(out, F.col("__start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("__b", "__sb", "__start", *names.values())


def targets_of(counts: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """One row per target source: source, target_share, max_repeats, n_docs, own (its tokens) and quota.

    Without ``total`` the mixture is as long as it can be with every present source at its share:
    the least of own * max_repeats / share, with the shares of the present sources scaled to 1. With
    ``total`` a source that cannot fill its share gives what it has, repeated as often as allowed,
    and the others share the rest in proportion.
    """
    own = counts.groupBy(F.col("source").alias("os")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("own"))
    t = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    t = t.join(own, F.col("source") == F.col("os"), "left").select("source", "target_share", "max_repeats", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("own", F.lit(0)).alias("own"))
    cap = (F.col("own") * F.greatest(F.col("max_repeats"), F.lit(0))).cast("double")
    t = t.withColumn("cap", cap).withColumn("w", F.when((F.col("cap") > 0) & (F.col("target_share") > 0), F.col("target_share")).otherwise(0.0))
    rows = t.agg(F.collect_list(F.struct("w", "cap")).alias("all"))  # one entry per target, a dimension
    scale = F.aggregate("all", F.lit(0.0), lambda a, r: a + r["w"])
    if total is None:
        length = F.array_min(F.transform(F.filter("all", lambda r: r["w"] > 0), lambda r: r["cap"] / (r["w"] / scale)))
        level = rows.select((length / scale).alias("level"))
    else:
        # water-filling: raise the level until the quotas add up to the total; each step fixes the sources that are full
        def filled(level: Column) -> Column:
            return F.aggregate("all", F.lit(0.0), lambda a, r: a + F.least(r["cap"], r["w"] * level))

        def step(level: Column, _: Column) -> Column:
            open_w = F.aggregate("all", F.lit(0.0), lambda a, r: a + F.when(r["w"] * level < r["cap"], r["w"]).otherwise(0.0))
            return F.when(open_w > 0, level + (F.lit(float(total)) - filled(level)) / open_w).otherwise(level)

        level = rows.select(F.aggregate(F.sequence(F.lit(1), F.size("all") + 1), F.lit(float(total)) / scale, step).alias("level"))
    return t.crossJoin(F.broadcast(level)).select("source", "target_share", "max_repeats", "n_docs", "own", F.when(F.col("w") > 0, F.least("cap", F.col("w") * F.col("level"))).otherwise(0.0).alias("quota"))


def mix(
    df: DataFrame, targets: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source",
    total: int | None = None, seed: int = 0, block: int = BLOCK, tokenizer: str = "byte_bpe_50k", folder: str | None = None,
) -> DataFrame:
    """slot, part (the order within a slot), ``key``, ``source``, copy (from 1) and n_tokens of the
    documents of the mixture, and quota.

    ``targets`` has source, target_share and max_repeats. Documents of other sources, with a null
    source or key, and without tokens (null and empty texts) are not in the mixture; a source that is
    absent has no rows; a target listed twice counts once. ``key`` must be unique. A document
    belongs to the slot in which it begins; the one across the end of a source's quota is taken or left, whichever errs less
    (the first of a source is always taken). The same seed gives the same mixture.
    """
    wanted = targets.select(F.col("source").alias("ts")).distinct()
    docs = df.select(F.col(key).alias("doc"), F.col(source).alias("source"), F.col(text).alias("t")).where("doc is not null and source is not null")
    docs = docs.join(wanted, F.col("source") == F.col("ts"), "left_semi")
    counts = materialize(token_counts(docs, "t", ("doc", "source"), tokenizer, folder).where("n_tokens > 0"), "tokens")
    goal = materialize(targets_of(counts, targets, total), "goals")
    size = goal.agg(F.sum("n_docs").alias("n"), F.max("n_docs").alias("most"), F.sum("quota").alias("tokens")).first()  # three numbers
    if not size or not size["tokens"]:
        kinds = counts.select(F.lit(0).cast("bigint").alias("slot"), F.lit(0).alias("part"), F.col("doc").alias(key), F.col("source").alias(source), F.lit(0).alias("copy"), "n_tokens", F.lit(0.0).alias("quota"))
        return kinds.where("false")
    use = goal.where("quota > 0").select(F.col("source").alias("gs"), "own", "quota", F.ceil(F.col("quota") / F.col("own")).cast("int").alias("copies"))
    laid = counts.join(use, F.col("source") == F.col("gs")).drop("gs")
    laid = laid.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    laid = laid.withColumn("h", F.xxhash64(F.lit(seed), "copy", F.col("doc").cast("string"))).withColumn("__tie", F.col("doc"))
    laid = _prefix(laid, ["source", "copy"], "h", "n_tokens", "at", max(1, -(-int(size["most"]) // BUCKET)))
    # the document across the quota's end is taken if that misses the quota by less than leaving it does
    laid = laid.withColumn("at", F.col("at") + (F.col("copy") - 1) * F.col("own")).where((F.col("at") < F.col("quota")) & ((F.col("at") + F.col("n_tokens") - F.col("quota") <= F.col("quota") - F.col("at")) | (F.col("at") == 0)))
    laid = laid.withColumn("block", F.floor(F.col("at") / block).cast("bigint"))
    slots = source_slots(goal, int(size["tokens"] // block) + 1, block)
    on = (F.col("source") == F.col("ss")) & (F.col("block") == F.col("rank"))
    part = F.row_number().over(Window.partitionBy("slot").orderBy("at", "h")) - 1
    return laid.join(slots, on).select("slot", part.alias("part"), F.col("doc").alias(key), F.col("source").alias(source), "copy", "n_tokens", "quota")


def source_slots(goal: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """slot, ss (the source it is for) and rank (from 0, within the source). ``n`` slots follow the
    golden-ratio sequence; the few blocks by which rounding leaves a source short come after them."""
    spark = goal.sparkSession
    weights = goal.where("quota > 0").select("source", "quota", F.ceil(F.col("quota") / block).cast("bigint").alias("blocks"))
    edges = weights.agg(F.array_sort(F.collect_list(F.struct("source", "quota"))).alias("q"))  # one entry per target
    whole = F.aggregate("q", F.lit(0.0), lambda a, r: a + r["quota"])
    point = F.col("id") * F.lit(GOLDEN) - F.floor(F.col("id") * F.lit(GOLDEN))
    walk = F.aggregate(
        "q",
        F.struct(F.lit(0.0).alias("upto"), F.lit(None).cast("string").alias("source")),
        lambda a, r: F.struct((a["upto"] + r["quota"] / whole).alias("upto"), F.when(a["source"].isNull() & (F.col("u") < a["upto"] + r["quota"] / whole), r["source"]).otherwise(a["source"]).alias("source")),
    )
    last = F.element_at("q", -1)["source"]
    slots = spark.range(n).withColumn("u", point).crossJoin(F.broadcast(edges)).select("id", F.floor(F.col("id") / CHUNK).alias("c"), F.coalesce(walk["source"], last).alias("ss"))
    sums = slots.groupBy("ss", "c").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("ss").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("ss").alias("s2"), F.col("c").alias("c2"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("ss", "c").orderBy("id")) - 1
    ranked = slots.join(starts, (F.col("ss") == F.col("s2")) & (F.col("c") == F.col("c2"))).select(F.col("id").alias("slot"), "ss", (F.col("start") + inside).alias("rank"))
    given = sums.groupBy(F.col("ss").alias("gs")).agg(F.sum("n").alias("given"))
    short = weights.join(given, F.col("source") == F.col("gs"), "left").where(F.col("blocks") > F.coalesce("given", F.lit(0)))
    more = short.select("source", F.explode(F.sequence(F.coalesce("given", F.lit(0)), F.col("blocks") - 1)).alias("rank"))
    tail = more.select((F.lit(n) + F.xxhash64("source", "rank") % F.lit(1 << 20) + F.lit(1 << 20)).alias("slot"), F.col("source").alias("ss"), "rank")
    return ranked.unionByName(tail)


def shares(mixed: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """source, target_share, n_tokens, actual_share, n_docs (rows) and most_repeats of each target in
    the result of :func:`mix`; zeros for an absent source."""
    by_doc = mixed.groupBy(source, key).agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("c"))
    by = by_doc.groupBy(F.col(source).alias("ms")).agg(F.sum("n").alias("n_tokens"), F.sum("c").alias("n_docs"), F.max("c").alias("most_repeats"))
    t = targets.groupBy("source").agg(F.max("target_share").alias("target_share"))
    out = t.join(by, F.col("source") == F.col("ms"), "left").drop("ms").na.fill(0, ["n_tokens", "n_docs", "most_repeats"])
    whole = out.agg(F.sum("n_tokens").alias("whole"))  # one row
    return out.crossJoin(F.broadcast(whole)).select("source", "target_share", "n_tokens", F.when(F.col("whole") > 0, F.col("n_tokens") / F.col("whole")).otherwise(0.0).alias("actual_share"), "n_docs", "most_repeats")
