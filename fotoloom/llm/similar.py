"""The most similar vectors of every vector: vantage-point trees per shard with relaxed pruning.

Shards are the cells around pivots drawn from a bounded sample. Of two vectors in different cells, the
distances to the wall between them sum up to no more than their own distance; so if each vector is also
sent to every cell whose wall is within half the reach, any two vectors within the reach meet in some
cell. Inside a cell all its rows are indexed under a vantage-point tree and all are queries. A subtree
is left out when |d(q, vantage) - radius| exceeds the query's current reach divided by ``relax``: by the
triangle inequality relax = 1 loses nothing, and since two close vectors differ little in their distance
to a third, or to a wall, larger factors lose few neighbours and prune far more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from fotoloom.session import Scratch

#: Rows of a cell for each row of the sample, and the most rows of the sample; every row is indexed.
ROWS_A_SAMPLE_ROW, SAMPLE_ROWS = 500, 200_000
#: Rows that belong to a shard about, the least number of shards, and the pivots of one node.
SHARD_ROWS = 16_384
MIN_SHARDS = 8
FANOUT = 4096
#: Rows from which on a shard that pivots do not part is searched block against block.
BLOCK_ROWS = 131_072
LEAF_ROWS = 128
_BATCH = 4096
#: What single precision may be off in a distance.
SLACK = np.float32(1e-3)
_QUERY_ROWS = 32_768


def unit_vector(c: Column | str, dim: int) -> Column:
    """The vector divided by its length, in double; null if null, of another length, with a null or non-number, or all zero."""
    c = F.col(c) if isinstance(c, str) else c
    v = F.transform(c, lambda x: x.cast("double"))
    sq = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    norm = F.sqrt(sq)
    ok = c.isNotNull() & (F.size(c) == dim) & (sq > 0) & (sq < float("inf"))
    return F.when(ok, F.transform(v, lambda x: x / norm))


def to_matrix(col: pd.Series, dim: int) -> np.ndarray:
    """Vectors as float32 rows of length 1; a row of zeros for what is no vector."""
    out, values = np.zeros((len(col), dim), np.float32), col.to_list()
    fit = np.fromiter((v is not None and len(v) == dim for v in values), bool, len(values))
    if fit.any():
        m = np.concatenate([v for v, f in zip(values, fit) if f]).astype(np.float32, copy=False).reshape(-1, dim)
        square = np.einsum("ij,ij->i", m, m, dtype=np.float64)
        ok = (square > 0) & np.isfinite(square)
        out[np.flatnonzero(fit)[ok]] = m[ok] / np.sqrt(square[ok])[:, None].astype(np.float32)
    return out


def pack(x: np.ndarray, exact: bool = False) -> list[bytes]:
    """A float32 scale and 12-bit integers: of unit vectors the cosine is off by about 1e-4 at most. ``exact``: float32 as it is."""
    if exact:
        return [r.tobytes() for r in x.astype("<f4")]
    scale = np.abs(x).max(axis=1).astype(np.float32)
    q = (np.rint(x / np.where(scale > 0, scale, 1)[:, None] * 2047) + 2048).astype(np.uint16)
    if q.shape[1] % 2:
        q = np.concatenate([q, np.full((len(q), 1), 2048, np.uint16)], axis=1)
    lo, hi = q[:, 0::2], q[:, 1::2]
    raw = np.empty((len(q), 4 + 3 * lo.shape[1]), np.uint8)
    raw[:, :4] = scale.astype("<f4")[:, None].view(np.uint8)
    raw[:, 4::3], raw[:, 5::3], raw[:, 6::3] = lo & 255, lo >> 8 | (hi & 15) << 4, hi >> 4
    return [r.tobytes() for r in raw]


def raw_rows(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint8).reshape(len(col), -1)


def unpack(raw: np.ndarray, dim: int) -> np.ndarray:
    if raw.shape[1] == 4 * dim:
        return np.ascontiguousarray(raw).view("<f4")
    scale = np.ascontiguousarray(raw[:, :4]).view("<f4")
    a, b, c = (raw[:, i::3].astype(np.int16) for i in (4, 5, 6))
    q = np.empty((len(raw), 2 * a.shape[1]), np.float32)
    q[:, 0::2], q[:, 1::2] = (a | (b & 15) << 8) - 2048, (b >> 4 | c << 4) - 2048
    return q[:, :dim] * (scale / np.float32(2047))


class Cells:
    """Cells around pivots drawn from the sample x, of which each row stands for ``weight`` rows.

    A cell that by the sample receives more than four times SHARD_ROWS is divided again around pivots of
    its own, unless that would only copy its rows; ``blocks`` says in how many blocks a leaf is searched.
    """

    def __init__(self, x: np.ndarray, weight: float, margin: float, seed: int = 3):
        self.margin, self.blocks = margin, []
        self.rng = np.random.default_rng(seed)
        self.root = self._node(x, np.arange(len(x)), weight, MIN_SHARDS)

    def _node(self, x: np.ndarray, here: np.ndarray, weight: float, least: int):
        rows = len(here) * weight
        n = min(FANOUT, max(least, -int(-rows // SHARD_ROWS)), len(here) // 4)
        if n >= 2 and (rows > 4 * SHARD_ROWS or least > 1):
            pivots = x[self.rng.choice(here, n, replace=False)]
            kids = [np.empty(0, np.int64)] * n
            for k, idx in self._reached(pivots, x[here]):
                kids[k] = here[idx]
            if max(map(len, kids)) <= 0.7 * len(here) and sum(map(len, kids)) <= 8 * len(here):
                return pivots, [self._node(x, k, weight, 1) for k in kids]
        self.blocks.append(max(1, -int(-rows // BLOCK_ROWS)))
        return len(self.blocks) - 1

    def _reached(self, pivots: np.ndarray, q: np.ndarray) -> list[tuple[int, np.ndarray]]:
        apart = _distance(pivots @ pivots.T) + SLACK
        cell, row = [], []
        for at in range(0, len(q), step := max(64, 4_000_000 // len(pivots))):
            s = q[at : at + step] @ pivots.T
            own = s.argmax(axis=1)
            i, k = np.nonzero(s.max(axis=1, keepdims=True) - s <= self.margin * apart[own])
            row.append(at + i), cell.append(k)
        row, cell = np.concatenate([*row, np.empty(0, np.int64)]), np.concatenate([*cell, np.empty(0, np.int64)])
        order = np.argsort(cell, kind="stable")
        k, at = np.unique(cell[order], return_index=True)
        return list(zip(k.tolist(), np.split(row[order], at[1:])))

    def route(self, q: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(leaf, rows of q) of each leaf that a row lies in or within the margin of."""
        out, todo = [], [(self.root, np.arange(len(q)))]
        while todo:
            node, idx = todo.pop()
            if isinstance(node, int):
                out.append((node, idx))
            elif len(idx):
                todo += [(node[1][k], idx[rows]) for k, rows in self._reached(node[0], q[idx])]
        return out


class VPTree:
    """Vantage points and median radii over the rows of x, down to leaves of at most ``leaf`` rows or to ``depth``."""

    def __init__(self, x: np.ndarray, leaf: int, depth: int = 60, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.vantage, self.radius, self.kids, self.leaves = [], [], [], []
        slots, todo = [], [(np.arange(len(x)), 0, -1, 0)]
        while todo:
            idx, level, up, side = todo.pop()
            d = None
            if len(idx) > leaf and level < depth:
                tries = x[rng.choice(idx, min(8, len(idx)), replace=False)]
                probe = x[rng.choice(idx, min(256, len(idx)), replace=False)]
                v = tries[np.argmax(np.std(_distance(probe @ tries.T), axis=0))]
                d = _distance(x[idx] @ v)
                r = np.float32(np.median(d))
                near = d < r
                if not near.any() or near.all():  # ties, such as copies: no ball parts them
                    d = None
            if d is None:
                me = -1 - len(self.leaves)
                self.leaves.append(idx)
            else:
                me = len(self.vantage)
                self.vantage.append(v), self.radius.append(r), slots.append([0, 0])
                todo += [(idx[near], level + 1, me, 0), (idx[~near], level + 1, me, 1)]
            if up >= 0:
                slots[up][side] = me
            else:
                self.root = me
        self.kids = slots

    def own_leaves(self, q: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(leaf, rows of q) of the leaf each row of q lies in."""
        out, todo = [], [(self.root, np.arange(len(q)))]
        while todo:
            node, idx = todo.pop()
            if node < 0:
                out.append((-1 - node, idx))
                continue
            near = _distance(q[idx] @ self.vantage[node]) < self.radius[node]
            todo += [(kid, idx[go]) for kid, go in zip(self.kids[node], (near, ~near)) if go.any()]
        return out


def _distance(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cos))


class Shard:
    """Rows x with their ids under a vantage-point tree; ``search`` answers many queries at once."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.tree = VPTree(x, LEAF_ROWS)
        self.ids = [np.sort(ids[leaf]) for leaf in self.tree.leaves]
        self.blocks = [np.ascontiguousarray(x[leaf[np.argsort(ids[leaf])]].T) for leaf in self.tree.leaves]

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int, min_cos: float, relax: float) -> tuple[np.ndarray, np.ndarray]:
        """Of each query row the ids (-1: none) and cosines of its k best, itself left out; ties to the smaller id."""
        tree = self.tree
        best = np.full((len(q), k), -2, np.float32)
        who = np.full((len(q), k), -1, np.int64)
        own = np.full(len(q), -1, np.int64)
        for leaf, idx in tree.own_leaves(q):  # first the own leaf, so that full lists shorten the reach
            self._visit(leaf, idx, q_ids, q, best, who, min_cos)
            own[idx] = leaf
        todo = [(tree.root, np.arange(len(q)))]
        while todo:
            node, idx = todo.pop()
            if node < 0:
                self._visit(-1 - node, idx[own[idx] != -1 - node], q_ids, q, best, who, min_cos)
                continue
            reach = _distance(np.maximum(best[idx, -1], np.float32(min_cos))) / np.float32(relax) + SLACK
            d = _distance(q[idx] @ tree.vantage[node]) - tree.radius[node]
            near, far = tree.kids[node]
            for kid, go in ((near, d <= reach), (far, d >= -reach)):
                if go.any():
                    todo.append((kid, idx[go]))
        return who, best

    def _visit(self, leaf: int, idx: np.ndarray, q_ids: np.ndarray, q: np.ndarray, best: np.ndarray, who: np.ndarray, min_cos: float) -> None:
        k, name = best.shape[1], self.ids[leaf]
        for at in range(0, len(idx), _BATCH):
            i = idx[at : at + _BATCH]
            cos = q[i] @ self.blocks[leaf]
            floor = np.maximum(best[i, -1] - np.float32(2e-6), np.float32(min_cos))
            hit = np.flatnonzero(cos.max(axis=1) >= floor)
            if not len(hit):
                continue
            i, cos = i[hit], np.round(cos[hit], 6)
            cos[(cos < min_cos) | (name[None, :] == q_ids[i][:, None])] = -2
            if cos.shape[1] > k:  # names are sorted within a leaf, so a stable sort leaves ties to the smaller
                top = np.argsort(-cos, axis=1, kind="stable")[:, :k]
                cos, new = np.take_along_axis(cos, top, 1), name[top]
            else:
                new = np.broadcast_to(name, cos.shape)
            cos, new = np.concatenate([best[i], cos], 1), np.concatenate([who[i], np.where(cos > -2, new, -1)], 1)
            order = np.lexsort((new, -cos), axis=1)[:, :k]
            best[i], who[i] = np.take_along_axis(cos, order, 1), np.take_along_axis(new, order, 1)


def _spread_keys(spark, n: int) -> list[int]:
    """n keys that hash partitioning over n partitions sends to n different ones."""
    at = spark.range(40 * n).select("id", F.pmod(F.hash(F.col("id")), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
    at = {r.p: r.id for r in at}
    return [at.get(i, 40 * n + i) for i in range(n)]


def _thin_copies(rows: DataFrame, s: Scratch, k: int) -> tuple[DataFrame, DataFrame | None]:
    """Of each set of more than k + 1 equal vectors only the k + 1 smallest ids need a search.

    The others' best are the k smallest ids of their set, at cosine 1, and they are among nobody else's
    best. Returns the rows to search and the (q, p, cos) of the others.
    """
    keyed = rows.select("id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    hot = s.cut(keyed.groupBy("h1", "h2").count().filter(F.col("count") > k + 1).drop("count"))
    if hot.isEmpty():
        return rows, None
    members = keyed.join(hot, ["h1", "h2"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(256)))
    few = members
    for by in (["h1", "h2", "salt"], ["h1", "h2"]):
        few = few.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).filter(F.col("r") <= k + 1)
    few = s.cut(few.select("id", "h1", "h2", "r"))
    rest = s.cut(members.select("id", "h1", "h2").join(few.select("id"), "id", "left_anti"))
    links = rest.join(few.filter(F.col("r") <= k).withColumnRenamed("id", "p"), ["h1", "h2"])
    return rows.join(rest.select("id"), "id", "left_anti"), links.select(F.col("id").alias("q"), "p", F.lit(1.0).cast("float").alias("cos"))


def usable(vector: str, dim: int) -> Column:
    """The vector has ``dim`` entries, all finite numbers in single precision and not all zero."""
    return (F.size(vector) == dim) & F.exists(vector, lambda x: x != 0) & F.coalesce(F.forall(vector, lambda x: F.abs(x) < 3.4e38), F.lit(False))


def most_similar(vectors: DataFrame, id_col: str, vector_col: str, k: int, min_cos: float, dim: int = 128, relax: float = 6.0) -> DataFrame:
    """(q, p, cos): for every vector q its up to k most similar others p with a cosine of at least min_cos.

    Rows whose vector is null, all zero, not ``dim`` long or not all finite numbers, or whose id is null,
    take no part; ties go to the smaller id; of rows with the same id and vector one is searched; an empty
    table gives an empty result. relax = 1 is exact (vectors then travel in full single precision); larger
    factors may lose neighbours (see the README for the measured recall).
    """
    spark = vectors.sparkSession
    s = Scratch(spark)
    exact = relax <= 1
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & usable("v", dim))
    rows, copies = _thin_copies(rows, s, k)
    total = rows.count()
    wanted = min(SAMPLE_ROWS, max(20_000, total // ROWS_A_SAMPLE_ROW))
    share = min(1.0, wanted / max(1, total))
    x = to_matrix(rows.select("v").sample(share, seed=5).limit(2 * SAMPLE_ROWS).toPandas().v, dim)
    x = x[x.any(axis=1)]
    cells = Cells(x, 1 / share, float(np.sqrt(2 - 2 * min_cos)) / (2 * relax) + float(SLACK) * exact)
    pairs = [(leaf, a, b) for leaf, n in enumerate(cells.blocks) for a in range(n) for b in range(a, n)]
    keys = dict(zip(pairs, _spread_keys(spark, len(pairs))))
    shared = spark.sparkContext.broadcast((cells, keys))

    def route(it):
        tree, names = shared.value
        for pdf in it:
            m = to_matrix(pdf.v, dim)
            ok = m.any(axis=1)
            m, ids = m[ok], pdf.id.to_numpy()[ok]
            if not len(m):
                continue
            raw = np.array(pack(m, exact), dtype=object)
            for leaf, idx in tree.route(m):
                n = tree.blocks[leaf]
                mine = (ids[idx].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n
                for b in range(n):
                    at = idx[mine == b] if n > 1 else idx
                    for o in range(n):
                        yield pd.DataFrame({"shard": names[leaf, min(b, o), max(b, o)], "id": ids[at], "v": raw[at]})

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf.id.duplicated().any():
            pdf = pdf.drop_duplicates(["id", "v"])
        raw, ids = raw_rows(pdf.v), pdf.id.to_numpy()
        out = [pd.DataFrame({"q": np.empty(0, np.int64), "p": np.empty(0, np.int64), "cos": np.empty(0, np.float32)})]
        x = unpack(raw, dim)
        index = Shard(ids, x)
        for at in range(0, len(ids), _QUERY_ROWS):
            part = ids[at : at + _QUERY_ROWS]
            who, cos = index.search(part, x[at : at + _QUERY_ROWS], k, min_cos, relax)
            r, c = np.nonzero(who >= 0)
            out.append(pd.DataFrame({"q": part[r], "p": who[r, c], "cos": cos[r, c]}))
        return pd.concat(out)

    routed = rows.mapInPandas(route, "shard bigint, id bigint, v binary")
    found = routed.repartition(len(keys), "shard").groupBy("shard").applyInPandas(shard, "q bigint, p bigint, cos float")
    best = Window.partitionBy("q").orderBy(F.desc("cos"), "p")
    found = found.groupBy("q", "p").agg(F.max("cos").alias("cos"))  # two vectors may meet in several shards
    found = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).drop("r")
    return found if copies is None else found.unionByName(copies)


def similar_pairs(vectors: DataFrame, id_col: str, vector_col: str, k: int, min_cos: float, dim: int = 128, relax: float = 6.0) -> DataFrame:
    """(id_lo, id_hi) where either is among the other's k most similar; each pair once."""
    found = most_similar(vectors, id_col, vector_col, k, min_cos, dim, relax)
    return found.select(F.least("q", "p").alias("id_lo"), F.greatest("q", "p").alias("id_hi")).distinct()
