"""Mixing sources to target weights by weighted fair queueing.

Every use of a text gets a virtual finish time: the tokens its source has handed out up to and with it,
divided by the source's target weight. Sorted by finish time and cut at the total budget, every prefix
of the mix holds the target shares up to one text per source.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window, functions as F

from fotoloom.session import Scratch

#: Rows whose running total one task sums up; more rows make more buckets.
BUCKET_ROWS = 10_000


def bare_source(c: Column | str) -> Column:
    """Lower case, without outer blanks, with - as _."""
    return F.translate(F.regexp_replace(F.lower(c), r"^\s+|\s+$", ""), "-", "_")


def one_per_text(records: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, source, size) with each text once, in one of the named sources.

    ``records`` has id, source, size and the text's hashes h1 and h2. Copies of one text, in one source
    or in several, are one text: it goes to the source that may repeat most often (then by name) under
    its smallest id there. Null sources, unnamed sources and null, zero or negative sizes are left out.
    """
    named = targets.filter("max_repeats > 0").groupBy("source").agg(F.max("max_repeats").alias("max_repeats"))  # a row per named source
    kept = records.select("id", "source", "size", "h1", "h2").filter("id is not null and size > 0").join(named, "source")
    best = F.min_by(F.struct("id", "source", "size"), F.struct(-F.col("max_repeats"), "source", "id")).alias("r")
    return kept.groupBy("h1", "h2").agg(best).select("r.*")


def _running(rows: DataFrame) -> DataFrame:
    """The rows with ``upto``, their source's sum of sizes up to and with them in the order use, h, id.

    Sums per bucket, then offsets over the buckets (a row each), then inside a bucket: no task holds a source.
    """
    key = ["source", "use", "bucket"]
    before = Window.partitionBy("source").orderBy("use", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*key).agg(F.sum("size").alias("in_bucket"))
    offsets = offsets.select(*key, F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*key).orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("within", F.sum("size").over(inside)).join(offsets, key).withColumn("upto", F.col("offset") + F.col("within")).drop("offset", "within")


def mix_sources(texts: DataFrame, targets: DataFrame, seed: int = 17, slack: float = 0.001, rounds: int | None = 6) -> DataFrame:
    """(finish, id, source, use, size) in the order of the mix: the largest one that keeps all shares and caps.

    ``texts`` has one row per text (id, source, size), ``targets`` source, target_share and max_repeats.
    The budget is the least, over the sources that have any text, of their tokens times max_repeats over
    their share; sources without text are left out and the others' shares scaled up. A source hands out
    all its texts, shuffled, before it hands out any again, and stops at its share of the budget. A text
    that would pass it is passed over, and up to ``rounds`` times what is left open is filled with the
    texts after it that still fit, until each source is within ``slack`` of its share (None: until nothing
    more fits); ``mix_report`` shows what stays open. To stop each source at its share of the budget is to
    cut the sorted mix at the finish time that equals the budget. Rows of null, zero
    or negative share or cap are no targets; without texts the result is empty.
    """
    s = Scratch(texts.sparkSession)
    targets = targets.select("source", "target_share", "max_repeats").filter("source is not null and target_share > 0 and max_repeats > 0")
    texts = texts.select(F.col("id").cast("bigint").alias("id"), "source", F.col("size").cast("bigint").alias("size")).filter("id is not null and size > 0")
    supply = texts.groupBy("source").agg(F.sum("size").alias("tokens"), F.count("*").alias("n"))
    plan = targets.groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")).join(supply, "source")
    total = Window.partitionBy()  # over one row per named source
    plan = plan.withColumn("share", F.col("share") / F.sum("share").over(total))
    plan = plan.withColumn("budget", F.min(F.col("tokens") * F.col("cap") / F.col("share")).over(total))
    # one use more than the share needs on average, where the cap allows, to fill gaps from
    uses = F.least(F.col("cap"), F.ceil(F.col("budget") * F.col("share") / F.col("tokens") - 1e-9).cast("int") + 1)
    need = F.floor(F.col("budget") * F.col("share") + 1e-6).cast("bigint").alias("need")
    plan = s.cut(plan.select("source", "share", need, "n", uses.alias("uses")))
    used = texts.join(plan.drop("share", "need"), "source").withColumn("use", F.explode(F.sequence(F.lit(1), F.col("uses"))))
    used = used.withColumn("h", F.pmod(F.xxhash64("id", "use", F.lit(seed)), F.lit(1 << 52)))
    bucket = F.floor(F.col("h") * F.ceil(F.col("n") / BUCKET_ROWS) / float(1 << 52)).cast("bigint")
    used = used.withColumn("bucket", bucket).select("id", "source", "size", "use", "h", "bucket")
    order = F.struct("use", "h", "id")
    gap = plan.select("source", F.lit(0).cast("bigint").alias("done"), F.col("need").alias("open"), F.lit(None).cast("struct<use:int,h:bigint,id:bigint>").alias("last"))
    taken = None
    for _ in count() if rounds is None else range(1 + rounds):
        rest = used.join(gap, "source").filter((F.col("size") <= F.col("open")) & (F.col("last").isNull() | (order > F.col("last"))))
        new = s.cut(_running(rest.drop("last")).filter("upto <= open").select("id", "source", "use", "size", "h", (F.col("done") + F.col("upto")).alias("upto")))
        taken = new if taken is None else taken.unionByName(new)
        got = new.groupBy("source").agg(F.sum("size").alias("got"), F.max(order).alias("end"))
        gap = gap.join(got, "source", "left").withColumn("got", F.coalesce("got", F.lit(0)))
        gap = s.cut(gap.select("source", (F.col("done") + F.col("got")).alias("done"), (F.col("open") - F.col("got")).alias("open"), F.coalesce("end", "last").alias("last"), "got"))
        left = gap.join(plan.select("source", "need"), "source").filter((F.col("got") > 0) & (F.col("open") > slack * F.col("need")))
        if left.isEmpty():
            break
        gap = gap.drop("got")
    out = taken.join(plan.select("source", "share"), "source").withColumn("finish", F.col("upto") / F.col("share"))
    return out.select("finish", "id", "source", "use", "size").orderBy("finish", "source", "use", "id")


def mix_report(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, texts, most_uses) of every target; zeros for a source without text."""
    got = mix.groupBy("source").agg(F.sum("size").alias("tokens"), F.count_if(F.col("use") == 1).alias("texts"), F.max("use").alias("most_uses"))
    out = targets.select("source", "target_share").join(got, "source", "left").fillna(0, ["tokens", "texts", "most_uses"])
    share = F.coalesce(F.round(F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy())), 6), F.lit(0.0))
    return out.select("source", "target_share", share.alias("actual_share"), "tokens", "texts", F.col("most_uses").cast("int").alias("most_uses"))
