"""Similarity clusters of vectors: k-means with parallel oversampled seeding.

1. Centres of some tables of cells are seeded over all rows: each round draws, with chances in proportion to the
   distance from the centres so far, a bounded number of rows at once; the drawn ones are weighted by the rows
   nearest to them and reduced to the centres of each table.
2. Clusters so large that a bounded sample shows them are refined over all rows and taken out.
3. Every other row lies in one cell of each table, where k-means, seeded by rounds of oversampling among the rows
   no centre covers yet, finds candidates, weighted by their rows; candidates near each other are merged.
4. Every candidate is held against the rows of the cells of each table that it lies in or not far behind the wall
   of, and the rows around it settle the members: mean and members are found again in turn until they agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fotoloom.llm.similar import pack, raw_rows, to_matrix, unpack
from fotoloom.session import Scratch, parallelism

#: Bounded sample that shows large clusters; all rows are clustered.
SAMPLE_ROWS = 40_000
#: Rows of the sample from which on a cluster counts as large.
LARGE = 12
#: Tables of cells, rows that a cell holds about, the most cells of a table, and rows from which on a cell is sliced.
TABLES, CELL_ROWS, CELLS, SLICE_ROWS = 3, 4_096, 2_048, 65_536
#: Tables in whose cells candidates are sought.
SEED_TABLES = 3
#: Rounds of seeding the cells; each draws twice as many rows as a table has cells, and no more than DRAWN.
ROUNDS, DRAWN = 4, 1_024
#: A candidate visits the cells whose wall towards its own lies at most at this cosine from it, the farther the fewer
#: rows it stands for. A member has the cosine a to it and is a * candidate + sqrt(1 - a * a) * a rest that is as good
#: as random, so few lie far behind a wall, and what one table misses another finds: see the README for the measured
#: recall.
WALLS = ((6, 0.12), (1 << 62, 0.1))
SEEDS_A_ROUND = 1024
#: Rows this much less similar than ``apart`` are still looked at around a centroid; then a set whose mean has
#: at least the cosine SETTLED to the centroid is seen whole.
AROUND = 0.25
SETTLED = 0.8


def hashed_features(items: Column, weights: Column, dim: int) -> Column:
    """Weighted features as a vector of ``dim`` numbers: each item adds its weight, signed by one bit of its hash, at the place the hash gives.

    Items and weights are arrays of one length; null items and weights add nothing; null for a null array.
    An embedding is already such a vector, its entries being the features, and is used as it is. Items are
    hashed in the JVM and added up over Arrow batches.
    """

    @F.pandas_udf("array<double>")
    def add(hashes: pd.Series, weights: pd.Series) -> pd.Series:
        out = np.zeros((len(hashes), dim))
        given = [i for i, (h, w) in enumerate(zip(hashes, weights)) if h is not None and w is not None]
        if given:
            size = [min(len(hashes.iloc[i]), len(weights.iloc[i])) for i in given]
            h = np.concatenate([np.asarray(hashes.iloc[i][:n], np.int64) for i, n in zip(given, size)])
            w = np.concatenate([np.asarray(weights.iloc[i][:n], np.float64) for i, n in zip(given, size)])
            row = np.repeat(given, size)
            ok = ~np.isnan(w)
            h, w, row = h[ok].view(np.uint64), w[ok], row[ok]
            sign = 1.0 - 2.0 * (h >> np.uint64(63)).astype(np.float64)
            np.add.at(out, (row, (h % np.uint64(dim)).astype(np.int64)), w * sign)
        return pd.Series([v if h is not None and w is not None else None for v, h, w in zip(out, hashes, weights)])

    hashes = F.transform(items, lambda x: F.xxhash64(x))
    bare = F.transform(F.arrays_zip(items.alias("i"), weights.cast("array<double>").alias("w")), lambda p: F.when(p["i"].isNotNull(), F.coalesce(p["w"], F.lit(float("nan")))).otherwise(float("nan")))
    return add(hashes, F.when(items.isNotNull() & weights.isNotNull(), bare))


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(n > 0, n, 1)).astype(np.float32)


def _blocks(rows: int, columns: int) -> Iterator[slice]:
    """Slices of rows whose products with so many columns stay small."""
    step = max(64, 4_000_000 // max(1, columns))
    return (slice(at, at + step) for at in range(0, rows if columns else 0, step))


def _best(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and cosine of each row's nearest centre."""
    who, cos = np.zeros(len(x), np.int64), np.full(len(x), -2, np.float32)
    for b in _blocks(len(x), len(c)):
        s = x[b] @ c.T
        who[b] = s.argmax(axis=1)
        cos[b] = s[np.arange(len(s)), who[b]]
    return who, cos


def _means(x: np.ndarray, who: np.ndarray, n: int) -> np.ndarray:
    order = np.argsort(who, kind="stable")
    out = np.zeros((n, x.shape[1]), np.float32)
    k, at = np.unique(who[order], return_index=True)
    if len(k):
        out[k] = np.add.reduceat(x[order], at, axis=0)
    return out


def kmeans(x: np.ndarray, tight: float, least: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of the clusters of at least ``least`` rows, and each row's cluster or -1.

    Two members with a cosine of ``tight`` to their mean have about tight squared to each other, so a
    seed covers rows from a little below that on. Each round draws SEEDS_A_ROUND of the rows not
    covered, keeps those not covered by each other, and covers with them; Lloyd steps follow.
    """
    cover, floor = np.float32(0.9 * tight * tight), np.float32(tight - 0.1)
    rng = np.random.default_rng(seed)
    free, found = rng.permutation(len(x)), []
    while len(free):
        drawn, rest = free[:SEEDS_A_ROUND], free[SEEDS_A_ROUND:]
        s = x[drawn] @ x[drawn].T >= cover
        kept = s.sum(axis=1) == 1
        for i in np.flatnonzero(~kept):
            kept[i] = not (s[i] & kept).any()
        c, pool = x[drawn[kept]], np.concatenate([rest, drawn[~kept]])
        who, cos = _best(x[pool], c)
        hit = np.flatnonzero(cos >= cover)
        near, who, low = x[pool[hit]], who[hit], cover
        own = np.bincount(who, minlength=len(c))
        c = _unit(_means(near, who, len(c)) + c)[own >= 1] if len(hit) else c[:0]
        taken = np.zeros(len(pool), bool)
        if len(c):
            for _ in range(2):  # a seed between two clusters covers rows of both: only what its mean then covers is taken
                who, cos = _best(near, c)
                ok = cos >= floor
                size = np.bincount(who[ok], minlength=len(c))
                c = _unit(_means(near[ok], who[ok], len(c)))[size >= 1]
                if not len(c):
                    break
            found.append(c)
            taken[hit] = _best(near, c)[1] >= floor
        taken[len(rest) :] |= rng.random(len(pool) - len(rest)) < 0.5  # each round uses up its seeds
        free = pool[~taken]
    c = np.concatenate(found) if found else x[:0]
    for _ in range(2):
        who, cos = _best(x, c)
        who = np.where(cos >= floor, who, -1)
        size = np.bincount(who[who >= 0], minlength=len(c))
        c = _unit(_means(x[who >= 0], who[who >= 0], len(c)))[size >= least] if len(c) else c
    who, cos = _best(x, c)
    return c, np.where(cos >= floor, who, -1)


def outweighed(c: np.ndarray, n: np.ndarray, names: np.ndarray, least_cos: float) -> np.ndarray:
    """Which centroids have one of more rows (of ties the smaller name) near them."""
    order = np.lexsort((names, -n))
    x = np.ascontiguousarray(c[order])
    out = np.zeros(len(c), bool)
    for b in _blocks(len(x), len(x)):
        s = x[b] @ x[: b.stop].T >= least_cos
        out[order[b]] = (s & (np.arange(s.shape[1])[None, :] < (b.start + np.arange(len(s)))[:, None])).any(axis=1)
    return out


def _name(raw: np.ndarray) -> int:
    """A number that stands for some bytes or a set of ids."""
    return int.from_bytes(hashlib.blake2b(raw.tobytes(), digest_size=8).digest(), "little", signed=True)


def merged(c: np.ndarray, n: np.ndarray, names: np.ndarray, least_cos: float) -> tuple[np.ndarray, np.ndarray]:
    """Means and rows of the centres that none of more rows is near, each with the lesser ones nearest to it."""
    lesser = outweighed(c, n, names, least_cos)
    head = c[~lesser]
    who, cos = _best(c, head)
    near = cos >= least_cos
    mean = _unit(_means(c[near] * n[near, None].astype(np.float32), who[near], len(head)))
    return mean, np.bincount(who[near], weights=n[near], minlength=len(head)).astype(np.int64)


def code(x: np.ndarray) -> list[bytes]:
    """The direction in 4-bit integers: of vectors of 128 entries the cosine is off by about 0.01; enough to seed by and to look around."""
    most = np.abs(x).max(axis=1, keepdims=True)
    q = (np.rint(x / np.where(most > 0, most, 1) * 7) + 8).astype(np.uint8)
    if q.shape[1] % 2:
        q = np.concatenate([q, np.full((len(q), 1), 8, np.uint8)], axis=1)
    return [r.tobytes() for r in q[:, 0::2] | q[:, 1::2] << 4]


def decode(raw: np.ndarray, dim: int) -> np.ndarray:
    """The unit vectors of ``code``."""
    q = np.empty((len(raw), 2 * raw.shape[1]), np.float32)
    q[:, 0::2], q[:, 1::2] = raw & 15, raw >> 4
    return _unit(q[:, :dim] - 8)


class Cells:
    """Tables of cells around centres. A cell of more than SLICE_ROWS rows by the weights is cut into slices by id."""

    def __init__(self, drawn: np.ndarray, weight: np.ndarray, n: int):
        self.centres, self.slices, self.first, self.walls, at = [], [], [], WALLS, 0
        drawn, weight = drawn[weight > 0], weight[weight > 0].astype(np.float64)
        for t in range(TABLES):
            rng = np.random.default_rng(10 + t)
            k = min(n, len(drawn))
            c = drawn[rng.choice(len(drawn), k, replace=False, p=weight / weight.sum())] if k else np.zeros((1, drawn.shape[1]), np.float32)
            for _ in range(3):
                who = _best(drawn, c)[0]
                mean = _means(drawn * weight[:, None].astype(np.float32), who, len(c))
                c = np.where(np.linalg.norm(mean, axis=1, keepdims=True) > 0, _unit(mean), c)
            held = np.bincount(_best(drawn, c)[0], weights=weight, minlength=len(c))
            slices = np.maximum(1, np.ceil(held / SLICE_ROWS)).astype(np.int64)
            self.centres.append(c), self.slices.append(slices), self.first.append(at + np.cumsum(slices) - slices)
            at += int(slices.sum())
        self.count = at
        self.apart = [np.sqrt(np.maximum(2 - 2 * (c @ c.T), 1e-6)) for c in self.centres]

    def own(self, x: np.ndarray, ids: np.ndarray, tables: int) -> Iterator[np.ndarray]:
        """Per table each row's slice of its nearest cell."""
        salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
        for c, slices, first in list(zip(self.centres, self.slices, self.first))[:tables]:
            cell = _best(x, c)[0]
            yield first[cell] + salt % slices[cell]

    def visited(self, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, slice) of all slices of the cells whose wall is as near to the row, which stands for n rows, as WALLS says, in every table."""
        wall = np.array([w for _, w in self.walls], np.float32)[np.searchsorted([m for m, _ in self.walls], n, side="right")]
        row, to = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for c, slices, first, apart in zip(self.centres, self.slices, self.first, self.apart):
            for b in _blocks(len(x), len(c)):
                s = x[b] @ c.T
                i, k = np.nonzero(s.max(axis=1, keepdims=True) - s <= wall[b, None] * apart[s.argmax(axis=1)])
                many = slices[k]
                i, k = np.repeat(i, many), np.repeat(k, many)
                row.append(b.start + i), to.append(first[k] + np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many))
        return np.concatenate(row), np.concatenate(to)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for the three nearest cells of the first table."""
        to = np.argsort(-(x @ self.centres[0].T), axis=1)[:, :3]
        return np.repeat(np.arange(len(x)), to.shape[1]), to.ravel()


def sound_sets(x: np.ndarray, tight: float, apart: float, least: int, start: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """All sound clusters found among the rows around a centroid: from it, then from the densest rows in none yet.

    A set whose mean has moved far from the centroid may have rows that are not here, and is left out.
    """
    centre = start
    out: list[tuple[np.ndarray, np.ndarray]] = []
    left, rng = np.ones(len(x), bool), np.random.default_rng(4)
    while True:
        got = settle(x, tight, apart, least, start)
        if got is not None and not any((got[0] == o[0]).all() for o in out):
            if _unit(x[got[0]].sum(axis=0)[None, :])[0] @ centre >= SETTLED:
                out.append(got)
        if got is not None:
            left &= ~got[0]
        if left.sum() < least:
            return out
        tried = rng.choice(np.flatnonzero(left), min(64, int(left.sum())), replace=False)
        at = np.flatnonzero(left)
        near = x[tried] @ x[at].T >= tight * tight
        dense = near.sum(axis=1)
        start = _unit(x[at[near[dense.argmax()]]].sum(axis=0)[None, :])[0]
        left[tried[dense < least]] = False  # too few rows around them to be the middle of a cluster
        left[tried[dense.argmax()]] = False


_SUMS = "c bigint, n bigint, s binary"


def _sums(x: np.ndarray, who: np.ndarray, n: np.ndarray, sums: np.ndarray) -> None:
    """Add rows to the number and sum of their clusters' rows."""
    np.add.at(n, who, 1)
    np.add.at(sums, who, x)


def _add_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.frombuffer(b"".join(pdf.s), np.float64).reshape(len(pdf), -1).sum(axis=0)
    return pd.DataFrame({"c": pdf.c[:1], "n": [pdf.n.sum()], "s": [total.tobytes()]})


def settle(x: np.ndarray, tight: float, apart: float, least: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Members (mask) and cosines of a sound cluster among the rows x around the centroid ``start``; None if none.

    The floor rises from apart to tight while mean and members are found again in turn; if rows between
    the two remain, they are tried as members too.
    """
    for floors in ((apart - 0.05, apart, tight), (apart - 0.05, apart)):
        mean, old = start, None
        for floor in [*floors, *[floors[-1]] * 20]:
            cos = x @ mean
            member = cos >= floor
            if member.sum() < least:
                break
            if old is not None and floor == floors[-1] and (member == old).all():
                if cos[member].min() >= tight and not (cos[~member] >= apart).any():
                    return member, cos
                break
            old = member
            mean = x[member].astype(np.float64).sum(axis=0)
            mean = (mean / np.linalg.norm(mean)).astype(np.float32)
    return None


def seeded(packed: DataFrame, dim: int, n: int, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Rows drawn as seeds, about 2 * ROUNDS times n, and how many rows each is nearest to.

    Each round is one pass over all rows. A row's chance is in proportion to its distance from the seeds
    so far: of the keys log(u) / distance the largest win, so a task sends only its own largest ones.
    """
    spark = packed.sparkSession
    seeds, draw = np.zeros((0, dim), np.float32), min(2 * n, DRAWN)
    for r in range(ROUNDS):
        told = spark.sparkContext.broadcast(seeds)

        def keyed(it: Iterator[pd.DataFrame], told=told, r=r) -> Iterator[pd.DataFrame]:
            best = pd.DataFrame({"key": np.empty(0), "id": np.empty(0, np.int64), "v": []})
            for pdf in it:
                ids = pdf.id.to_numpy()
                u = (_hashed(ids, seed + r) + 0.5) / float(1 << 52)
                far = 1 - _best(unpack(raw_rows(pdf.v), dim), told.value)[1] if len(told.value) and len(pdf) else np.ones(len(pdf))
                pdf = pdf.assign(key=np.log(u) / np.maximum(far, 1e-6))[["key", "id", "v"]]
                best = pd.concat([best, pdf]).nlargest(draw, "key")
            yield best

        got = packed.mapInPandas(keyed, "key double, id bigint, v binary").orderBy(F.desc("key"), "id").limit(draw).select("v").toPandas()
        if len(got):
            seeds = np.concatenate([seeds, unpack(raw_rows(got.v), dim)])
    told = spark.sparkContext.broadcast(seeds)

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(len(told.value), np.int64)
        for pdf in it:
            if len(pdf):
                n += np.bincount(_best(unpack(raw_rows(pdf.v), dim), told.value)[0], minlength=len(n))
        yield pd.DataFrame({"c": np.arange(len(n)), "n": n})

    weight = np.zeros(len(seeds), np.int64)
    if len(seeds):
        got = packed.select("v").mapInPandas(count, "c bigint, n bigint").groupBy("c").agg(F.sum("n").alias("n")).toPandas()
        weight[got.c] = got.n
    return seeds, weight


def _hashed(ids: np.ndarray, salt: int) -> np.ndarray:
    """52 bits of each id."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64) + np.uint64(salt * 0x2545F4914F6CDD1D & (1 << 64) - 1)
        for _ in range(2):
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(12)).astype(np.float64)


def similarity_clusters(
    vectors: DataFrame, id_col: str, vector_col: str, tight: float = 0.75, apart: float = 0.70, least: int = 5, dim: int = 128
) -> DataFrame:
    """(cluster_id, id, cos) of the members of all clusters of at least ``least`` rows.

    A cluster is a set whose members each have a cosine of at least ``tight`` to the mean of the members
    while no other row reaches ``apart``; cluster_id is its smallest id. Candidates that turn out not to
    be such sets are left out, as are rows in no cluster. Rows whose vector is null, all zero, not
    ``dim`` long or not all numbers, or whose id is null, take no part; equal vectors are so many
    members; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    s = Scratch(spark)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & (F.size("v") == dim))

    def packing(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            x = to_matrix(pdf.v, dim)
            ok = x.any(axis=1)
            yield pd.DataFrame({"id": pdf.id.to_numpy()[ok], "v": pack(x[ok])})

    packed = s.cut(rows.mapInPandas(packing, "id bigint, v binary"))
    total = packed.count()
    vectors_of = lambda pdf: unpack(raw_rows(pdf.v), dim) if len(pdf) else np.zeros((0, dim), np.float32)

    # 1. large clusters
    sample = vectors_of(packed.select("v").sample(min(1.0, SAMPLE_ROWS / max(1, total)), seed=9).limit(2 * SAMPLE_ROWS).toPandas())
    large, who = kmeans(sample, tight, LARGE)
    told = spark.sparkContext.broadcast(large)

    def large_sums(it: Iterator[pd.DataFrame], told=told) -> Iterator[pd.DataFrame]:
        n, sums = np.zeros(len(told.value), np.int64), np.zeros((len(told.value), dim))
        for pdf in it:
            x = vectors_of(pdf)
            who, cos = _best(x, told.value)
            hit = cos >= apart
            _sums(x[hit], who[hit], n, sums)
        got = np.flatnonzero(n)
        yield pd.DataFrame({"c": got, "n": n[got], "s": [r.tobytes() for r in sums[got]]})

    if len(large):  # the sample's means are near those of all rows, so one step over all rows is enough
        got = packed.select("v").mapInPandas(large_sums, _SUMS).groupBy("c").applyInPandas(_add_sums, _SUMS).toPandas()
        large = _unit(np.frombuffer(b"".join(got.s), np.float64).reshape(len(got), dim)) if len(got) else large[:0]
    told = spark.sparkContext.broadcast(large)

    def count_large(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = told.value
        ok, bad, twice = (np.zeros(len(c), np.int64) for _ in range(3))
        for pdf in it:
            x = vectors_of(pdf)
            for b in _blocks(len(x), len(c)):
                cos = x[b] @ c.T
                member = cos >= tight
                ok += member.sum(axis=0)
                bad += ((cos >= apart) & ~member).sum(axis=0)
                twice += member[member.sum(axis=1) > 1].sum(axis=0)
        yield pd.DataFrame({"c": np.arange(len(c)), "n": ok, "bad": bad + twice})

    if len(large):
        got = packed.select("v").mapInPandas(count_large, "c bigint, n bigint, bad bigint").groupBy("c").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).toPandas()
        large = large[np.sort(got.c[(got.n >= least) & (got.bad == 0)])]
    told_large = spark.sparkContext.broadcast(large)

    def place(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Members of large clusters with their cluster, all other rows with their vector."""
        for pdf in it:
            x = vectors_of(pdf)
            who, cos = _best(x, told_large.value)
            hit = cos >= tight
            yield pd.DataFrame({"c": who[hit], "id": pdf.id[hit], "cos": cos[hit], "v": None})
            yield pd.DataFrame({"c": None, "id": pdf.id[~hit], "cos": None, "v": pdf.v[~hit]}).astype({"c": "Int64", "cos": "Float32"})

    everywhere = packed
    if len(large):
        everywhere = s.cut(packed.mapInPandas(place, "c bigint, id bigint, cos float, v binary"))
        s.free(packed)
    rest = everywhere.filter("v is not null").select("id", "v")

    # 2. cells of all other rows
    n = min(CELLS, max(8, -(-(rest.count() if len(large) else total) // CELL_ROWS)))
    told = spark.sparkContext.broadcast(Cells(*seeded(rest, dim, n), n))

    def in_cells(tables: int):
        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                x, ids = vectors_of(pdf), pdf.id.to_numpy()
                raw = code(x) if len(x) else []
                for to in told.value.own(x, ids, tables):
                    yield pd.DataFrame({"cell": to, "id": ids, "v": raw})

        return rest.mapInPandas(run, "cell int, id bigint, v binary")

    # 3. k-means inside cells
    centre = "c bigint, n bigint, v binary"
    none_c = pd.DataFrame({"c": np.empty(0, np.int64), "n": np.empty(0, np.int64), "v": []})

    def named(x: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        """Centres with a name each, the same wherever one is found."""
        v = pack(x) if len(x) else []
        return pd.DataFrame({"c": np.array([_name(np.frombuffer(r, np.uint8)) for r in v], np.int64), "n": n, "v": v}).drop_duplicates("c")

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = raw_rows(pdf.v)
        raw = raw[np.lexsort(raw[:, :8].T)]  # the same whatever the order of arrival
        c, who = kmeans(decode(raw, dim), tight, 2)
        return named(c, np.bincount(who[who >= 0], minlength=len(c))) if len(c) else none_c

    def near(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                x = vectors_of(pdf)
                i, cell = told.value.nearest(x)
                yield pdf.assign(v=code(x)).iloc[i].assign(cell=cell)

    def merging(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """The means that lie in this cell: those that lie in another come out there."""
        raw, n = raw_rows(pdf.v), pdf.n.to_numpy()
        order = np.lexsort([*raw[:, :8].T, n])  # the same whatever the order of arrival
        x, n = merged(decode(raw[order], dim), n[order], np.arange(len(n)), tight)
        here = _best(x, told.value.centres[0])[0] == key[0]
        return named(x[here], n[here]) if here.any() else none_c

    def lighter(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c": pdf.c[outweighed(decode(raw_rows(pdf.v), dim), pdf.n.to_numpy(), pdf.c.to_numpy(), tight)]})

    placed = "c bigint, n bigint, v binary, cell int"
    candidates = s.cut(in_cells(SEED_TABLES).select("cell", "v").groupBy("cell").applyInPandas(inside, centre).filter("n > 0"))
    # rows of one cluster lie in several cells: the candidates found there are merged, wherever three of their cells meet
    means = s.cut(candidates.drop("c").mapInPandas(near, "n bigint, v binary, cell int").groupBy("cell").applyInPandas(merging, centre))
    lesser = means.mapInPandas(near, placed).groupBy("cell").applyInPandas(lighter, "c bigint").distinct()
    centres = s.cut(means.join(lesser, "c", "left_anti"))

    # 4. candidates against the rows of the cells near them
    around = apart - AROUND

    def visiting(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                x = vectors_of(pdf)
                i, cell = told.value.visited(x, pdf.n.to_numpy())
                yield pdf.assign(v=code(x)).iloc[i].assign(cell=cell)[["cell", "c", "v"]]

    def gather(r: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"c": np.empty(0, np.int64), "id": np.empty(0, np.int64)})]
        if len(r) and len(c):
            x, m = decode(raw_rows(r.v), dim), decode(raw_rows(c.v), dim)
            for b in _blocks(len(x), len(m)):
                i, j = np.nonzero(x[b] @ m.T >= around)
                out.append(pd.DataFrame({"c": c.c.to_numpy()[j], "id": r.id.to_numpy()[b.start + i]}))
        return pd.concat(out)

    def settled(ids: np.ndarray, x: np.ndarray, start: np.ndarray) -> list[tuple]:
        """A row per sound set: its name, size, mean cosine, and members with their cosines."""
        out = []
        for member, cos in sound_sets(x, tight, apart, least, start) if len(x) >= least else []:
            own, cos = ids[member], np.round(cos[member], 4)  # ids are sorted
            out.append((_name(own), len(own), round(float(cos.mean()), 6), own, cos))
        return out

    def runs(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf.c.to_numpy()
        cut = np.flatnonzero(np.r_[True, c[1:] != c[:-1], True])
        x, centre, ids = vectors_of(pdf), pdf.id.isna().to_numpy(), pdf.id.fillna(-1).to_numpy().astype(np.int64)
        out = []
        for a, b in zip(cut[:-1], cut[1:]):
            mine = a + np.flatnonzero(~centre[a:b])
            mine = mine[np.argsort(ids[mine])]
            out += settled(ids[mine], x[mine], x[a + np.argmax(centre[a:b])])
        return pd.DataFrame(out, columns=["name", "size", "close", "ids", "cos"])

    def members(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = None
        for pdf in it:  # sorted by candidate; the last one's rows may go on in the next batch
            pdf = pdf if tail is None else pd.concat([tail, pdf], ignore_index=True)
            last = int(np.searchsorted(pdf.c.to_numpy(), pdf.c.iloc[-1])) if len(pdf) else 0
            tail = pdf.iloc[last:]
            if last:
                yield runs(pdf.iloc[:last])
        if tail is not None and len(tail):
            yield runs(tail)

    visits = centres.mapInPandas(visiting, "cell int, c bigint, v binary").groupBy("cell")
    hits = in_cells(TABLES).groupBy("cell").cogroup(visits).applyInPandas(gather, "c bigint, id bigint")
    # a row may meet a candidate in every table; a candidate with fewer rows around it than a cluster has is none
    hits = hits.groupBy("c").agg(F.collect_set("id").alias("ids")).filter(F.size("ids") >= least).select("c", F.explode("ids").alias("id"))
    near_rows = hits.join(rest, "id").select("c", "id", "v").unionByName(centres.select("c", F.lit(None).cast("bigint").alias("id"), "v"))
    near_rows = near_rows.repartition(2 * parallelism(spark), "c").sortWithinPartitions("c")
    # a cluster that no sample showed has few rows: a task may hold the rows around its centroid
    sets = near_rows.mapInPandas(members, "name bigint, size bigint, close double, ids array<bigint>, cos array<float>")
    sets = s.cut(sets.dropDuplicates(["name"]))
    # several centroids may lead to one set or to sets that overlap: of these the largest, then the closest, stays, whole
    rank = F.struct("size", "close", (-F.col("name")).alias("m"))
    claims = sets.select(F.explode("ids").alias("id"), rank.alias("rank")).groupBy("id").agg(F.max("rank").alias("most"), F.min("rank").alias("least"), F.collect_set("rank").alias("all"))
    loses = claims.filter("most <> least").select(F.explode(F.filter("all", lambda r: r != F.col("most"))).alias("r")).select((-F.col("r.m")).alias("name")).distinct()
    small = sets.join(loses, "name", "left_anti").select(F.array_min("ids").alias("cluster_id"), F.explode(F.arrays_zip("ids", "cos")).alias("x"))
    small = small.select("cluster_id", F.col("x.ids").alias("id"), F.col("x.cos").alias("cos"))
    if not len(large):
        return small
    big = everywhere.filter("c is not null").select("c", "id", "cos")
    big = big.join(big.groupBy("c").agg(F.min("id").alias("cluster_id")), "c").select("cluster_id", "id", "cos")
    return small.unionByName(big)


def cluster_profiles(members: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster_id, size, typical_ids, mean_cos): the ids nearest the centroid first, ties to the smaller id."""
    best = lambda: F.struct((-F.col("cos")).alias("far"), F.col("id").alias("id"))
    near = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    from pyspark.sql import Window

    for by in (["cluster_id", "salt"], ["cluster_id"]):
        near = near.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("cos"), "id"))).filter(F.col("r") <= typical)
    top = near.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(best())), lambda x: x["id"]).alias("typical_ids"))
    size = members.groupBy("cluster_id").agg(F.count("*").alias("size"), F.round(F.avg("cos"), 3).alias("mean_cos"))
    return size.join(top, "cluster_id")
