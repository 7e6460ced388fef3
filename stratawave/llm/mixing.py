"""Mix sources to target shares by hash thresholds, without sorting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratawave.llm.encode import count_tokens
from stratawave.session import cut

#: Bits of the hash that one histogram resolves, and how often its boundary bucket is refined.
BITS, ROUNDS = 12, 4


def level(spread: Column, k: int) -> Column:
    """The k-th group of BITS bits of a 63-bit hash, from the top."""
    return F.shiftrightunsigned(spread, 63 - BITS * (k + 1)).bitwiseAND((1 << BITS) - 1)


def mix_sources(sized: DataFrame, targets: DataFrame, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Choose copies of records so that each source has its share of ``total`` tokens.

    ``sized`` has doc_id, source and tokens and may hold other columns; ``targets`` has
    source, target_share and max_repeats and is a reference table of fixed size (a source
    listed twice counts once; a null share is 0, null repeats are 1). ``total`` is by
    default the tokens of all records whose source is listed.

    A source gets floor(budget / its tokens) whole passes, at most max_repeats, and one
    more copy of the records whose hash lies below a threshold. The threshold comes from
    a histogram of tokens by (source, hash bucket): the bucket in which the budget ends
    is resolved by a histogram of its own, ROUNDS times, so it is sharp to 2 ** -48 of a
    source. Records never exceed the budget; they fall short by less than the records of
    one finest bucket, unless the source cannot fill its budget. Thresholds are nested: a
    larger budget keeps what a smaller one chose.

    Result: the records with copies >= 1 (doc_id, source, tokens, copies), and a report
    (source, tokens, target_share, max_repeats, budget, mixed, share, share_of_total,
    reachable) with one row for each target. share is the reached share of all mixed
    tokens, share_of_total that of ``total``: where a source cannot reach its share, the
    others keep theirs of the total and so have a larger one of what is mixed. Records
    without source, or of a source that is not listed, are not mixed.
    """
    records, histogram, budgets = source_budgets(sized, targets, total)
    edges = budgets.select("source", "open", F.lit(0).cast("long").alias("threshold"))
    order = Window.partitionBy("source").orderBy("bucket")
    for k in range(ROUNDS):
        if k:
            prefix = F.shiftrightunsigned(F.col("spread"), 63 - BITS * k)
            histogram = (
                records.join(F.broadcast(edges.select("source", "threshold")), "source")
                .filter(prefix == F.shiftrightunsigned(F.col("threshold"), 63 - BITS * k))
                .groupBy("source", level(F.col("spread"), k).alias("bucket")).agg(F.sum("tokens").alias("tokens"))
            )
        upto = F.sum("tokens").over(order)
        fits = (
            histogram.join(F.broadcast(edges), "source")
            .withColumns({"upto": upto, "before": upto - F.col("tokens")})
            .filter(F.col("upto") > F.col("open"))  # buckets in which, or behind which, the budget ends
            .groupBy("source").agg(F.min(F.struct("bucket", "before")).alias("edge"))
        )
        step = 1 << (63 - BITS * (k + 1))
        edges = cut(
            edges.join(F.broadcast(fits), "source", "left")
            .select(
                "source",
                (F.col("open") - F.coalesce("edge.before", F.lit(0))).alias("open"),
                # a budget that no bucket ends takes the whole range left
                (F.col("threshold") + F.coalesce(F.col("edge.bucket"), F.lit((1 << BITS) - 1)) * F.lit(step)).alias("threshold"),
            )
        )
    limits = edges.select("source", "threshold").join(budgets, "source")
    chosen = (
        records.join(F.broadcast(limits.select("source", "threshold", "passes", "open")), "source")
        .withColumn("copies", F.col("passes") + F.when((F.col("open") > 0) & (F.col("spread") < F.col("threshold")), 1).otherwise(0))
        .filter("copies > 0")
        .select("doc_id", "source", "tokens", "copies")
    )
    mixed = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed"))
    report = budgets.join(mixed, "source", "left").fillna(0, ["mixed"])
    report = report.select(
        "source", "tokens", "target_share", "max_repeats", "budget", "mixed",
        (F.col("mixed") / F.nullif(F.sum("mixed").over(Window.partitionBy(F.lit(0))), F.lit(0).cast("long"))).alias("share"),
        (F.col("mixed") / F.nullif(F.col("everything"), F.lit(0).cast("long"))).alias("share_of_total"), "reachable",
    )
    return chosen, report


def source_budgets(sized: DataFrame, targets: DataFrame, total: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What thresholds are sought for: the records with their hash, the histogram of tokens by (source, hash bucket), and the budget of each target, with ``reachable``."""
    wanted = F.broadcast(
        targets.filter(F.col("source").isNotNull()).dropDuplicates(["source"])
        .select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    )
    spread = F.xxhash64("doc_id").bitwiseAND((1 << 63) - 1)
    records = cut(sized.join(wanted.select("source"), "source", "left_semi").select("doc_id", "source", "tokens", spread.alias("spread")))
    first = records.groupBy("source", level(F.col("spread"), 0).alias("bucket")).agg(F.sum("tokens").alias("tokens"))
    histogram = cut(first)  # at most 2 ** BITS rows for each target
    have = histogram.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    everything = F.lit(total) if total is not None else F.coalesce(F.sum("tokens").over(Window.partitionBy(F.lit(0))), F.lit(0))
    budgets = (
        wanted.join(have, "source", "left").fillna(0, ["tokens"])
        .withColumn("everything", everything.cast("long"))
        .withColumn("budget", F.col("target_share") * F.col("everything"))
        .withColumn("reachable", ~(F.col("tokens") * F.col("max_repeats") < F.col("budget")))
        .withColumn("passes", F.when(F.col("tokens") > 0, F.least(F.col("max_repeats").cast("long"), F.floor(F.col("budget") / F.col("tokens")))).otherwise(F.lit(0).cast("long")))
        .withColumn("open", F.when(F.col("passes") < F.col("max_repeats"), F.col("budget") - F.col("passes") * F.col("tokens")).otherwise(0.0))
    )
    budgets = cut(budgets)  # one row for each target
    return records, histogram, budgets


def unreachable(documents: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """Sources that cannot reach their share even with all their repeats, from the histograms alone."""
    return source_budgets(count_tokens(documents, path), targets)[2].filter("NOT reachable").select("source")


def mix_documents(documents: DataFrame, targets: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """:func:`mix_sources` over documents, sized in tokens of the tokenizer at ``path``."""
    return mix_sources(count_tokens(documents, path), targets)
