"""Links between hashes that differ in few bits, without hot keys.

Two hashes within ``most`` bits agree on at least one of most + 1 bands of bits (pigeonhole), so each band
is a bucket. The bits of a band are dealt in turn over the whole hash, so that short hashes filled with
zeros spread; buckets that are still large are divided by further bits, and at last block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fotoloom.functions.hashing import lanes
from fotoloom.session import Scratch, parallelism

BITS = 256
#: Rows of one bucket that a task compares; a larger bucket is divided by further bits, then in blocks.
BUCKET_ROWS = 2048
MAX_LEVEL = 3
_LANES = ["l0", "l1", "l2", "l3"]
_COLS = ["part", *_LANES]


def _bits(lane_rows: np.ndarray) -> np.ndarray:
    """(n, 4) int64 to (n, 256) of 0 and 1."""
    return np.unpackbits(np.ascontiguousarray(lane_rows, dtype=">i8").view(np.uint8).reshape(len(lane_rows), 32), axis=1)


def _band_bits(path: tuple[int, ...], n_bands: int) -> list[np.ndarray]:
    """Bit positions of each band within what the path of bands leaves, dealt in turn so that short hashes spread."""
    left = np.arange(BITS)
    for b in path:
        left = np.delete(left, np.arange(b, len(left), n_bands))
    return [left[b::n_bands] for b in range(n_bands)]


def _key(bits: np.ndarray, salt: np.ndarray) -> np.ndarray:
    packed = np.packbits(bits, axis=1)
    words = np.zeros((len(bits), -(-packed.shape[1] // 8) * 8), np.uint8)
    words[:, : packed.shape[1]] = packed
    h = salt.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for w in words.view(np.uint64).T:
        h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of lane rows; counted unsigned, as bitwise_count takes absolute values."""
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=1)


def _spanning(rows: np.ndarray, most: int) -> list[tuple[int, int]]:
    """A spanning forest of the rows that differ in at most ``most`` bits: never more links than rows."""
    left, out = np.arange(len(rows)), []
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            i = stack.pop()
            near = _near(rows[left], rows[i], most)
            hit, left = left[near], left[~near]
            out += [(i, j) for j in hit]
            stack += list(hit)
    return out


def _near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Rows (part, lanes) of one part that differ in at most ``most`` bits."""
    return (a[..., 0] == b[..., 0]) & (_differ(a[..., 1:], b[..., 1:]) <= most)


def _links(ids: np.ndarray, rows: np.ndarray, key: np.ndarray, most: int, forest: bool) -> pd.DataFrame:
    """Matches inside each run of equal keys: all, or a spanning forest of them where a run is long."""
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    size = np.diff(edge)
    a, b = [], []
    row_size = np.repeat(size, size)
    short = 8 if forest else BUCKET_ROWS
    for d in range(1, int(min(short, size.max(initial=1)))):
        i = np.flatnonzero((row_size[:-d] <= short) & (key[:-d] == key[d:]))
        ok = i[_near(rows[i], rows[i + d], most)] if len(i) else i
        a.append(ok), b.append(ok + d)
    for g in np.flatnonzero(size > short):
        at = np.arange(edge[g], edge[g + 1])
        if forest:
            pairs = np.array(_spanning(rows[at], most), dtype=np.int64).reshape(-1, 2)
            a.append(at[pairs[:, 0]]), b.append(at[pairs[:, 1]])
            continue
        for k in range(len(at) - 1):
            hit = at[k + 1 :][_near(rows[at[k + 1 :]], rows[at[k]], most)]
            a.append(np.full(len(hit), at[k])), b.append(hit)
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
    other = ids[a] != ids[b]  # two bands of one hash may meet by chance in a key
    a, b = a[other], b[other]
    x, y = ids[a], ids[b]
    return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "distance": _differ(rows[a, 1:], rows[b, 1:]).astype(np.int32)})


def near_hash_links(hashes: DataFrame, id_col: str, hash_col: str, most: int, part: Column | None = None, forest: bool = True) -> DataFrame:
    """(a, b, distance), a < b: ids whose 64-digit hashes differ in at most ``most`` bits, each once.

    ``hashes`` holds one id per distinct hash (and ``part``), as ``clean_hash`` writes it; only rows of
    one part meet. With ``forest`` a task returns a spanning forest of the matches of a large bucket, so
    the links connect exactly what the matches connect; else all matches come out. Buckets above
    BUCKET_ROWS are divided again by most + 1 bands of the bits left, and beyond MAX_LEVEL compared block
    against block. An empty table gives an empty result.
    """
    spark = hashes.sparkSession
    s, n_bands = Scratch(spark), most + 1
    v = lanes(hash_col)
    part = F.lit(0).cast("bigint") if part is None else F.xxhash64(part)
    rows = hashes.select(F.col(id_col).cast("bigint").alias("id"), part.alias("part"), *[v[i].alias(c) for i, c in enumerate(_LANES)])
    rows = rows.withColumn("path", F.array().cast("array<int>"))
    level_schema = "key bigint, id bigint, part bigint, l0 bigint, l1 bigint, l2 bigint, l3 bigint, path array<int>"
    found_schema = "a bigint, b bigint, distance int"

    def keyed(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if pdf.empty:
                continue
            bits = _bits(pdf[_LANES].to_numpy(np.int64))
            paths = [tuple(p) for p in pdf.path]
            for path in set(paths):
                at = np.fromiter((p == path for p in paths), bool, len(paths))
                chosen, own = pdf[at], bits[at]
                salt = chosen.part.to_numpy(np.int64).view(np.uint64)
                used: tuple[int, ...] = ()
                for b in path:  # rows of one parent bucket share its bits, rows of another must not meet them
                    salt = _key(own[:, _band_bits(used, n_bands)[b]], salt + np.uint64(b + 1)).view(np.uint64)
                    used += (b,)
                for b, cols in enumerate(_band_bits(path, n_bands)):
                    out = chosen[["id", *_COLS]].copy()
                    out.insert(0, "key", _key(own[:, cols], salt + np.uint64(b + 1)))
                    out["path"] = [[*path, b]] * len(out)
                    yield out

    def compare(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = None
        for pdf in it:  # sorted by key; a run may go on in the next batch
            if tail is not None:
                pdf = pd.concat([tail, pdf], ignore_index=True)
            key = pdf.key.to_numpy()
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            tail = pdf.iloc[last:]
            if last:
                yield _links(pdf.id.to_numpy()[:last], pdf[_COLS].to_numpy(np.int64)[:last], key[:last], most, forest)
        if tail is not None and len(tail):
            yield _links(tail.id.to_numpy(), tail[_COLS].to_numpy(np.int64), tail.key.to_numpy(), most, forest)

    def matches(buckets: DataFrame, tasks: int) -> DataFrame:
        return s.cut(buckets.repartition(tasks, "key").sortWithinPartitions("key").mapInPandas(compare, found_schema).distinct())

    n = parallelism(spark)
    found = []
    for level in range(1, MAX_LEVEL + 1):
        keys = rows.mapInPandas(keyed, level_schema)
        if level > 1:
            keys = s.cut(keys)
        count = s.cut(keys.groupBy("key").count().filter("count > 1"))
        shared = keys.join(count, "key")
        found.append(matches(shared.filter(F.col("count") <= BUCKET_ROWS).select("key", "id", *_COLS), n))
        if count.filter(F.col("count") > BUCKET_ROWS).isEmpty():
            break
        rows = shared.filter(F.col("count") > BUCKET_ROWS)
        if level < MAX_LEVEL:
            rows = s.cut(rows.select("id", *_COLS, "path"))
            continue
        parts = F.ceil(F.col("count") / BUCKET_ROWS).cast("int")
        own = F.pmod(F.xxhash64("id"), parts).cast("int")
        other = F.explode(F.sequence(F.lit(0), parts - 1)).alias("o")
        blocks = rows.select("key", "id", *_COLS, own.alias("s"), other).select(
            F.xxhash64("key", F.least("s", "o"), F.greatest("s", "o")).alias("key"), "id", *_COLS
        )
        found.append(matches(blocks, 8 * n))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()
