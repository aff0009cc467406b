"""Best representative of each duplicate group: unpivot to long rows, vote per value, pivot back.

``fuse`` builds one record field by field from weighted votes; ``best_record`` chooses one existing
record by criteria in order of importance. Both group by (group, field, value) or (group, record)
with partial aggregation, so a group that holds a third of all rows is combined before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Texts that tools write for "not known", fixed values.
FILLERS = [
    "", "-", "--", "---", "?", "??", "0000:00:00 00:00:00", "0000-00-00 00:00:00", "(null)", "[]", "{}", "n.a.", "n/a", "na",
    "nan", "nil", "none", "not available", "not known", "null", "undefined", "unknown", "unspecified",
]
#: Kinds of file format in the order of preference, fixed values.
FORMAT_KINDS = [("raw", ["nef", "cr2", "arw", "dng", "raf", "orf", "rw2"]), ("heic", ["heic", "heif"]), ("jpg", ["jpg", "jpeg"]), ("png", ["png"])]


def says_something(text: Column) -> Column:
    """The text is not null, blank (control characters count as blank) or a filler."""
    bare = F.lower(F.regexp_replace(text, r"^[\s\p{Cntrl}]+|[\s\p{Cntrl}]+$", ""))
    return text.isNotNull() & ~bare.isin(FILLERS)


def json_entries(text: Column | str) -> Column:
    """Top-level entries of a JSON object as a map to variants, read through one level of JSON string; else null."""
    v = F.try_parse_json(text)
    inner = F.try_parse_json(F.try_variant_get(v, "$", "string"))
    v = F.when(F.schema_of_variant(v) == "STRING", inner).otherwise(v)
    return F.try_variant_get(v, "$", "map<string,variant>")


def n_speaking_entries(text: Column | str) -> Column:
    values = F.map_values(json_entries(text))
    return F.coalesce(F.size(F.filter(values, lambda x: says_something(F.try_variant_get(x, "$", "string")))), F.lit(0)).cast("bigint")


def bare_format(c: Column | str) -> Column:
    """Lower case, without outer blanks and leading dot."""
    return F.regexp_replace(F.lower(c), r"^\s*\.?|\s+$", "")


def format_kind(c: Column | str) -> Column:
    f, out = bare_format(c), F.lit("other")
    for name, group in reversed(FORMAT_KINDS):
        out = F.when(f.isin(group), name).otherwise(out)
    return out


def format_rank(c: Column | str) -> Column:
    """4 for raw down to 0 for all else or unknown."""
    f, out = bare_format(c), F.lit(0)
    for i, (_, group) in enumerate(reversed(FORMAT_KINDS)):
        out = F.when(f.isin(group), i + 1).otherwise(out)
    return out.cast("bigint")


def in_range(c: Column | str, low: int, high: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.between(low, high), c.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def unpivot(records: DataFrame, keys: dict[str, Column], fields: dict[str, Column], value_type: str) -> DataFrame:
    """Long rows: the keys, field and value."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), c.cast(value_type).alias("value")) for k, c in fields.items()]))
    return records.select(*[c.alias(k) for k, c in keys.items()], rows.alias("r")).select(*keys, "r.field", "r.value")


def best_record(records: DataFrame, group: str, record: str, criteria: dict[str, Column]) -> DataFrame:
    """(group, record) of the record that is largest by the criteria compared in turn; ties: the smaller record.

    Criteria are numbers, a null counts below all others. Rows with a null group or record take no
    part; a repeated record counts once with its best values; an empty table gives an empty result.
    """
    records = records.filter(F.col(group).isNotNull() & F.col(record).isNotNull())
    long = unpivot(records, {"__g": F.col(group), "__r": F.col(record)}, criteria, "bigint")
    wide = long.groupBy("__g", "__r").agg(*[F.max(F.when(F.col("field") == k, F.col("value"))).alias(f"c{i}") for i, k in enumerate(criteria)])
    order = F.struct(*[F.col(f"c{i}") for i in range(len(criteria))], (-F.col("__r")).alias("tie"))
    return wide.groupBy("__g").agg(F.max_by("__r", order).alias(record)).select(F.col("__g").alias(group), record)


def fuse(records: DataFrame, group: str, fields: dict[str, Column], trust: Column, age_days: Column, half_life_days: float) -> DataFrame:
    """One built record per group: of each field the value with most votes, ties to the smaller value.

    A record votes for its normalised value (the given Column, as text) with trust * 2**(-age / half
    life), in millionths. Null values have no vote, a null trust or age counts as 0, a future date as
    age 0; a group none of whose records knows a field gets null there; null groups take no part.
    """
    age = F.greatest(F.lit(0.0), F.coalesce(age_days, F.lit(0.0)).cast("double"))
    vote = F.round(1e6 * F.coalesce(trust, F.lit(0.0)) * F.pow(F.lit(2.0), -age / half_life_days)).cast("bigint")
    records = records.filter(F.col(group).isNotNull())
    groups = {"__g": F.col(group), "__vote": vote}
    votes = unpivot(records, groups, fields, "string").groupBy("__g", "field", "value").agg(F.sum("__vote").alias("votes"))
    known = F.col("value").isNotNull()
    win = votes.groupBy("__g", "field").agg(F.min_by("value", F.when(known, F.struct(-F.col("votes"), F.col("value")))).alias("value"))
    return win.groupBy("__g").agg(*[F.max(F.when(F.col("field") == k, F.col("value"))).alias(k) for k in fields]).withColumnRenamed("__g", group)
