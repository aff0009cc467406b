"""Filling containers of fixed capacity by minimum bin slack.

Items are dealt at random to shares small enough for one task, so every share has the corpus's mix of
lengths and is packed on its own; what a share's last containers leave open is a few containers per
share of thousands. Per container the bitset of reachable fillings finds the fullest combination that
holds the longest item left, which is then removed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Items of a share.
SHARE_ROWS = 20_000


def fill_containers(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number (from 0) of each item; sizes are 1 to capacity.

    ``layers[i]`` holds, as bits, the fillings that the lengths tried before the i-th can reach; walking
    back through the layers tells how often each length is used.
    """
    by_size: dict[int, list[int]] = {}
    for i in np.argsort(sizes, kind="stable")[::-1].tolist():
        by_size.setdefault(int(sizes[i]), []).append(i)
    lengths = sorted(by_size, reverse=True)
    out = np.full(len(sizes), -1, np.int64)
    n, first = 0, 0
    while True:
        while first < len(lengths) and not by_size[lengths[first]]:
            first += 1
        if first == len(lengths):
            return out
        longest = lengths[first]
        room = capacity - longest
        out[by_size[longest].pop()] = n
        mask, reach, layers = (1 << (room + 1)) - 1, 1, []
        for length in lengths[first:]:
            have = len(by_size[length])
            if not have or length > room:
                continue
            before, times = reach, min(have, room // length)
            step = 1
            while times > 0:  # doubling: up to ``times`` copies by shifts of 1, 2, 4, ... and the rest
                take = min(step, times)
                reach |= (reach << (take * length)) & mask
                times -= take
                step *= 2
            if reach != before:
                layers.append((length, before))
                if reach >> room & 1:
                    break
        left = reach.bit_length() - 1
        for length, before in reversed(layers):
            while not before >> left & 1:  # the filling needs this length once more
                out[by_size[length].pop()] = n
                left -= length
        n += 1


def pack_items(items: DataFrame, id_col: str, size_col: str, capacity: int, share_rows: int = SHARE_ROWS) -> DataFrame:
    """(container, id, piece, start, size): every item whole in one container unless it exceeds the capacity.

    An item longer than the capacity is cut into pieces of the capacity and a last, shorter one, numbered
    from 0 with their start; the others are piece 0. Items of null id or of null, zero or negative size
    need no room and are left out; repeated rows are packed as often as they occur; an empty table gives
    an empty result. ``container`` is unique over all shares.
    """
    rows = items.select(F.col(id_col).cast("bigint").alias("id"), F.col(size_col).cast("bigint").alias("size")).filter("id is not null and size > 0")
    # repeated rows are counted before they are shuffled and then numbered, so that they spread over the shares
    rows = rows.groupBy("id", "size").count().withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"cast((size - 1) div {capacity} as int)"))))
    start = F.col("piece").cast("bigint") * capacity
    rows = rows.select("id", "copy", "piece", start.alias("start"), F.least(F.lit(capacity).cast("bigint"), F.col("size") - start).alias("size"))
    shares = max(1, -(-rows.count() // share_rows))
    rows = rows.withColumn("share", F.pmod(F.xxhash64("id", "copy", "piece"), F.lit(shares)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "copy", "piece"], kind="stable")
        pdf.insert(0, "container", fill_containers(pdf["size"].to_numpy(), capacity) * shares + key[0])
        return pdf.drop(columns=["share", "copy"])

    return rows.groupBy("share").applyInPandas(run, "container bigint, id bigint, piece int, start bigint, size bigint")


def fill_rates(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, items, tokens and the share of room used."""
    return packed.agg(
        F.countDistinct("container").alias("containers"), F.count("*").alias("pieces"), F.sum("size").alias("tokens")
    ).withColumn("filled", F.round(F.col("tokens") / F.nullif(F.col("containers") * capacity, F.lit(0)), 4))
