"""Near-duplicate pairs of vectors, all of them: cells around centres bring near vectors together, exact cosines decide.

Of two vectors in different cells, the distances to the wall between them add up to no more than their own
distance; so if a vector also goes to the cells whose wall is within half the reach, any two within the reach
meet. Centres come from a sample, in the number that copies few vectors and leaves the least to compare.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from fotoloom.functions.vectors import cosine_rows, dot_rows, vector_matrix
from fotoloom.session import Scratch

#: Rows of the sample for the centres, the most cells, and how often a vector may be sent on average where cells allow it.
SAMPLE_ROWS, MOST_CELLS, MOST_COPIES = 20_000, 1024, 1.5
#: Rows from which on a cell is compared block by block, and for which a cell is not divided.
BLOCK_ROWS, CELL_ROWS = 65_536, 2_048
#: Directions that are compared first, elements of a product, candidates checked at once, and ids sent to all tasks.
DIRECTIONS, PRODUCT, CHECKED, SENT_IDS = 32, 16_000_000, 200_000, 1_000_000
#: What single precision may be off in a distance and in a product.
SLACK, ROUNDING = 1e-3, 2e-5


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]).astype(np.float32)


def _usable(x: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", x, x)
    return (square > 0) & np.isfinite(square)


class Cells:
    """Cells around centres drawn from the unit vectors x, of which each stands for ``weight`` rows; ``blocks`` has the blocks of each."""

    def __init__(self, x: np.ndarray, weight: float, reach: float, seed: int = 13):
        self.margin = np.float32(reach / 2 + SLACK)
        rng, tried = np.random.default_rng(seed), []
        seeds, near = x[:1], (x @ x[0] if len(x) else x[:, 0])
        n = 1
        while n <= max(1, min(MOST_CELLS, int(len(x) * weight) // CELL_ROWS, len(x) // 16)):
            while len(seeds) < n:
                far = np.maximum(1 - near, 0).astype(np.float64)
                new = x[rng.choice(len(x), p=far / far.sum())] if far.sum() > 0 else x[rng.integers(len(x))]
                seeds, near = np.vstack([seeds, new]), np.maximum(near, x @ new)
            self.centres = self._settled(x, seeds)
            share = np.zeros(len(self.centres))
            for cell, rows in self.route(x):
                share[cell] = len(rows) * weight
            blocks = np.maximum(1, -(-share // BLOCK_ROWS)).astype(int)
            tried.append(((share * blocks).sum() / max(1.0, len(x) * weight), (share**2).sum(), n, self.centres, blocks.tolist()))
            n *= 2
        fit = [t for t in tried if t[0] <= MOST_COPIES]
        best = min(fit, key=lambda t: t[1:3]) if fit else min(tried, key=lambda t: t[:3])
        self.copies, self.centres, self.blocks = best[0], best[3], best[4]

    @staticmethod
    def _settled(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        for _ in range(6 if len(centres) > 1 else 0):
            own = (x @ centres.T).argmax(axis=1)
            order = np.argsort(own, kind="stable")
            cell, at = np.unique(own[order], return_index=True)
            total = np.add.reduceat(x[order], at, axis=0)
            length = np.sqrt((total * total).sum(axis=1))
            centres = centres.copy()
            centres[cell[length > 0]] = (total / np.where(length > 0, length, 1)[:, None])[length > 0]
        return centres

    def route(self, x: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(cell, rows of x) of each cell that a row lies in or within the margin of."""
        if len(self.centres) < 2:
            return [(0, np.arange(len(x)))] if len(x) else []
        apart = np.sqrt(np.maximum(0, 2 - 2 * self.centres @ self.centres.T)) + np.float32(SLACK)
        s = x @ self.centres.T
        row, cell = np.nonzero(s.max(axis=1, keepdims=True) - s <= self.margin * apart[s.argmax(axis=1)])
        order = np.argsort(cell, kind="stable")
        k, at = np.unique(cell[order], return_index=True)
        return list(zip(k.tolist(), np.split(row[order], at[1:])))


def near_rows(ids: np.ndarray, x: np.ndarray, least: float, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, other rows, cosines) of the k best others of each row of x from ``least`` on; ties go to the smaller id.

    In a few directions two near vectors are no further apart than in all, which leaves few pairs to be compared in full.
    """
    square, u = dot_rows(x, x), _unit(x)
    basis = np.linalg.qr(np.random.default_rng(13).normal(size=(x.shape[1], min(DIRECTIONS, x.shape[1]))))[0].astype(np.float32)
    p = u @ basis
    half = (p * p).sum(axis=1, keepdims=True) / 2
    one = np.ones_like(half)
    left, right = np.hstack([p, -half, one]), np.ascontiguousarray(np.hstack([p, one, -half]).T)
    floor = np.float32(least - 1 - ROUNDING)
    step = max(1, PRODUCT // max(1, len(x)))
    for at in range(0, len(x), step):
        near = left[at : at + step] @ right >= floor
        near[np.arange(len(near)), at + np.arange(len(near))] = False
        many = np.flatnonzero(near.sum(axis=1) > 64 + 8 * k)
        if len(many):  # so many that single precision chooses first
            s = u[at + many] @ u.T
            s[np.arange(len(many)), at + many] = -2
            enough = np.partition(s, -k, axis=1)[:, -k, None] if k < s.shape[1] else -2
            near[many] = s >= np.maximum(enough, np.float32(least)) - np.float32(ROUNDING)
        each = near.sum(axis=1)
        parts = np.flatnonzero(np.diff(np.cumsum(each) // CHECKED, prepend=0)) if each.sum() > CHECKED else []
        for a, b in zip([0, *parts], [*parts, len(near)]):
            i, j = np.nonzero(near[a:b])
            i += at + a
            if len(i):
                same = ids[i] == ids[j]
                s = cosine_rows(x[i], x[j], square[i], square[j])
                hit = np.flatnonzero((s >= least) & ~same)
                hit = hit[np.lexsort((ids[j[hit]], -s[hit], i[hit]))]
                first = np.r_[True, np.diff(i[hit]) > 0] if len(hit) else np.empty(0, bool)
                rank = np.arange(len(hit)) - np.flatnonzero(first)[np.cumsum(first) - 1]
                hit = hit[rank < k]
                yield i[hit], j[hit], s[hit]


def _best(edges: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc("s"), "p")
    return edges.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def nearest(rows: DataFrame, id_col: str, vector: str, least: float, k: int, dim: int) -> DataFrame:
    """(q, p, s): of each row its k most similar others from ``least`` on."""
    spark = rows.sparkSession
    cuts = Scratch(spark)
    v = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v")).filter((F.size("v") == dim) & F.col("id").isNotNull())
    kind = "<f8" if v.schema["v"].dataType.elementType.typeName() == "double" else "<f4"
    numbers = F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    keyed = cuts.cut(v.filter(numbers).select("id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")))
    hot = cuts.cut(keyed.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("id").alias("one")).filter(F.col("n") > k + 1).drop("n"))
    rest = None
    if not hot.isEmpty():
        members = keyed.join(hot, ["h1", "h2"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
        few = members
        for by in (["h1", "h2", "salt"], ["h1", "h2"]):
            few = few.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).filter(F.col("r") <= k + 1)
        rest = cuts.cut(members.join(few.select("id"), "id", "left_anti").select("id", "one"))
        gone = rest.select("id")
        v = v.join(F.broadcast(gone) if rest.count() <= SENT_IDS else gone, "id", "left_anti")

    def packed(it: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for pdf in it:
            x = vector_matrix(pdf.v, dim)
            ok = _usable(x)
            yield pdf.id.to_numpy()[ok], x[ok]

    def as_bytes(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, x in packed(it):
            yield pd.DataFrame({"v": [r.tobytes() for r in _unit(x)]})

    total = keyed.count()
    share = min(1.0, SAMPLE_ROWS / max(1, total))
    sample = b"".join(r.v for r in v.select("id", "v").sample(share, seed=5).mapInPandas(as_bytes, "v binary").limit(2 * SAMPLE_ROWS).collect())
    x = np.frombuffer(sample, np.float32).reshape(-1, dim)
    shared = spark.sparkContext.broadcast(Cells(x, total / max(1, len(x)), float(np.sqrt(max(0.0, 2 - 2 * least)))))

    def route(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = shared.value
        for ids, x in packed(it):
            raw = np.array([r.tobytes() for r in x.astype(kind)], dtype=object)
            for cell, rows in cells.route(_unit(x)):
                n = cells.blocks[cell]
                mine = (ids[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n
                for b in range(n):
                    at = rows[mine == b] if n > 1 else rows
                    for o in range(n):
                        yield pd.DataFrame({"cell": cell, "a": min(b, o), "b": max(b, o), "id": ids[at], "v": raw[at]})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x = pdf.id.to_numpy(), np.frombuffer(b"".join(pdf.v), kind).reshape(len(pdf), dim).astype(np.float64)
        out = [pd.DataFrame({"q": ids[i], "p": ids[j], "s": s}) for i, j, s in near_rows(ids, x, least, k)]
        return pd.concat([pd.DataFrame({"q": np.empty(0, np.int64), "p": np.empty(0, np.int64), "s": np.empty(0)}), *out])

    routed = v.mapInPandas(route, "cell int, a int, b int, id bigint, v binary")
    met = routed.groupBy("cell", "a", "b").applyInPandas(compare, "q bigint, p bigint, s double")
    best = _best(met.groupBy("q", "p").agg(F.max("s").alias("s")), k)  # two vectors may meet in several cells
    if rest is None:
        return best
    best = cuts.cut(best)
    copies = rest.select(F.col("id").alias("q"), F.col("one").alias("p"), F.lit(1.0).alias("s"))
    same = rest.join(best.withColumnRenamed("q", "one"), "one").select(F.col("id").alias("q"), "p", "s")
    return best.unionByName(_best(copies.unionByName(same), k))


def similar_pairs(rows: DataFrame, id_col: str, vector: str, least: float = 0.98, k: int = 10, dim: int = 128) -> DataFrame:
    """(id1, id2, similarity), id1 < id2: pairs from ``least`` on where either is among the other's k best.

    Of equal vectors only the k + 1 smallest ids are compared, as in a list of the k best no further one can
    stand; the others' best are the smallest one and its best. Ties go to the smaller id. Null, zero,
    non-number and wrongly sized vectors and null ids take no part.
    """
    best = nearest(rows, id_col, vector, least, k, dim)
    return best.select(F.least("q", "p").alias("id1"), F.greatest("q", "p").alias("id2"), F.col("s").alias("similarity")).distinct()


def duplicate_pairs(photos: DataFrame, vector: str, least: float = 0.98, k: int = 10, probe: str | None = None) -> DataFrame:
    """Pairs of photos of equal format (in lower case), compared after the k best are chosen; ``probe`` limits one side by path."""
    pairs = similar_pairs(photos, "image_id", vector, least, k)
    side = photos.select(F.col("image_id"), F.lower("file_format").alias("f"), (F.col("file_path").like(probe) if probe else F.lit(True)).alias("p"))
    for n in "12":
        pairs = pairs.join(side.select(F.col("image_id").alias("id" + n), F.col("f").alias("f" + n), F.col("p").alias("p" + n)), "id" + n)
    return pairs.filter("f1 = f2 and (p1 or p2)").select("id1", "id2", "similarity")
