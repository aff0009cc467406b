"""Photo searches: filters, pages, vector top-k, rank fusion and lookups that keep an order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window, functions as F

from fotoloom.functions import media, predicates as pr
from fotoloom.functions.vectors import MODEL_LEAST, cosine_rows, cosine_to, dot_rows, normalized_similarity
from fotoloom.session import Scratch, parallelism

#: Queries of a task, rows read at once, elements of a product, and candidates checked at once.
QUERY_ROWS, SLICE_ROWS, PRODUCT, CHECKED = 8_192, 4_096, 8_400_000, 20_000
#: What a product in single precision may be off.
ROUNDING = 2e-5
#: Columns of a search result.
RESULT = ["image_id", "file_path", "file_name", "file_format", "width", "height", "file_size", "photo_date"]


@dataclass
class Spec:
    """What a search asks for; unset parts restrict nothing. ``viewer_is_admin`` with ``include_hidden`` shows hidden photos."""

    date_from: str | None = None
    date_to: str | None = None
    formats: Sequence[str] = ()
    box: tuple[float, float, float, float] | None = None
    persons: Sequence[int] = ()
    person_mode: str = "or"
    tags: Sequence[int] = ()
    exclude_tags: Sequence[int] = ()
    include_hidden: bool = False
    viewer_is_admin: bool = False
    sort: str = "date-desc"
    top_k: int = 100
    offset: int = 0
    extra: Sequence[Column] = field(default_factory=tuple)


def restrict(photos: DataFrame, spec: Spec, faces: DataFrame | None = None, photo_tag: DataFrame | None = None, tag: DataFrame | None = None) -> DataFrame:
    """The photos that meet the spec: scalar filters first, so that they reach the scan, then semi and anti joins."""
    out = photos.filter(pr.in_dates("photo_date", spec.date_from, spec.date_to) & pr.in_formats("file_format", spec.formats))
    if spec.box:
        out = out.filter(pr.in_box(*spec.box))
    for c in spec.extra:
        out = out.filter(c)
    if spec.persons:
        out = (pr.having_all if spec.person_mode == "and" else pr.having_any)(out, faces, "person_id", spec.persons)
    if spec.tags:
        out = pr.having_all(out, photo_tag, "tag_id", spec.tags)
    if spec.exclude_tags:
        out = pr.having_none(out, photo_tag, "tag_id", spec.exclude_tags)
    if tag is not None and not (spec.include_hidden and spec.viewer_is_admin):
        out = pr.visible(out, photo_tag, tag)
    return out


def ordering(sort: str) -> list[Column]:
    modes = {
        "date-asc": [F.asc_nulls_last("photo_date"), F.asc("image_id")],
        "id-asc": [F.asc("image_id")],
        "id-desc": [F.desc("image_id")],
    }
    return modes.get(sort, [F.desc_nulls_last("photo_date"), F.desc("image_id")])


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit) if offset else df.orderBy(*order).limit(limit)


def with_tags(photos: DataFrame, photo_tag: DataFrame, tag: DataFrame) -> DataFrame:
    """A column ``tags`` of the photo's tags by id; empty without any. Repeated links count once."""
    linked = photo_tag.select("image_id", "tag_id").distinct().join(tag.select("tag_id", "name", "is_system", "color"), "tag_id")
    lists = linked.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("tag_id", "name", "is_system", "color"))).alias("tags"))
    empty = F.array().cast("array<struct<tag_id:int,name:string,is_system:boolean,color:string>>")
    return photos.join(lists, "image_id", "left").withColumn("tags", F.coalesce("tags", empty))


def filter_search(photos: DataFrame, spec: Spec, faces: DataFrame, photo_tag: DataFrame, tag: DataFrame) -> DataFrame:
    """One page of the photos that meet the spec, with rotation and tags; tags are looked up for the page alone."""
    wide = restrict(photos.select(*RESULT, "exif_data", "latitude", "longitude"), spec, faces, photo_tag, tag)
    got = page(wide, ordering(spec.sort), spec.top_k, spec.offset)
    got = got.select(*RESULT, media.rotation(F.col("exif_data")).alias("rotation"))
    on_page = photo_tag.join(got.select("image_id"), "image_id", "left_semi")
    return with_tags(got, on_page, tag)


def top_k(df: DataFrame, id_col: str, vector: str, query: Sequence[float], k: int, threshold: float = -1.0) -> DataFrame:
    """(id, similarity) of the k rows most similar to a vector; ties to the smaller id; unusable vectors take no part."""
    found = df.select(id_col, cosine_to(vector, query).alias("similarity")).filter(F.col("similarity") >= threshold)
    return found.orderBy(F.desc("similarity"), F.asc(id_col)).limit(k)


def similar_to(df: DataFrame, id_col: str, vector: str, this: int, k: int, threshold: float = 0.01, drop_self: str = "before") -> DataFrame:
    """(id, similarity to four decimals) of the rows most similar to a stored one.

    drop_self before: the row itself never counts; after: the k best are taken first, so at most k - 1 remain.
    A row that is not there, or has no vector, gives an empty result. The reference is one row by key.
    """
    ref = df.filter((F.col(id_col) == this) & F.col(vector).isNotNull()).select(vector).first()
    rows = df.select(id_col, vector) if drop_self == "after" else df.select(id_col, vector).filter(F.col(id_col) != this)
    similarity = F.lit(None).cast("double") if ref is None else cosine_to(vector, list(ref[0]))
    found = rows.select(id_col, similarity.alias("similarity"))
    found = found.filter(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), F.asc(id_col)).limit(k)
    return found.filter(F.col(id_col) != this).withColumn("similarity", F.round("similarity", 4))


class Best:
    """The k best rows of each query so far, by cosine and then by the smaller id; rows come slice by slice.

    A product in single precision finds the rows that may come in, their cosines in double decide.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, threshold: float):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.k, self.threshold = ids[order], x[order], k, threshold
        self.square = dot_rows(self.x, self.x)
        self.unit = (self.x / np.sqrt(self.square)[:, None]).astype(np.float32)
        self.s, self.who = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        self.floor = np.full(len(ids), threshold - ROUNDING, np.float32)
        self.step = max(1, PRODUCT // max(1, len(ids)))

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        square = dot_rows(x, x)
        ok = (square > 0) & np.isfinite(square)
        ids, x, square = ids[ok], x[ok], square[ok]
        unit = (x / np.sqrt(square)[:, None]).astype(np.float32)
        for at in range(0, len(ids), self.step):
            part = slice(at, at + self.step)
            self._slice(ids[part], x[part], square[part], unit[part])

    def _slice(self, ids: np.ndarray, x: np.ndarray, square: np.ndarray, unit: np.ndarray) -> None:
        s = self.unit @ unit.T
        left, right = (np.searchsorted(self.ids, ids, side) for side in ("left", "right"))
        for j in np.flatnonzero(right > left):
            s[left[j] : right[j], j] = -2
        hit = np.flatnonzero(s.max(axis=1) >= self.floor)
        s = s[hit]
        near = s >= self.floor[hit, None]
        each = np.count_nonzero(near, axis=1)
        many = np.flatnonzero(each > 4 * self.k + 64)
        if len(many):
            enough = np.partition(s[many], -self.k, axis=1)[:, -self.k, None] - np.float32(ROUNDING)
            near[many] &= s[many] >= enough
            each[many] = np.count_nonzero(near[many], axis=1)
        parts = np.flatnonzero(np.diff(np.cumsum(each) // CHECKED, prepend=0))
        for a, b in zip([0, *parts], [*parts, len(hit)]):
            i, j = np.divmod(np.flatnonzero(near[a:b]), len(ids))
            if len(i):
                i = hit[a + i]
                self._merge(i, cosine_rows(self.x[i], x[j], self.square[i], square[j]), ids[j])

    def _merge(self, i: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
        own = np.unique(i)
        old, place = np.nonzero(self.s[own] > -np.inf)
        i, s, ids = np.concatenate([i, own[old]]), np.concatenate([s, self.s[own[old], place]]), np.concatenate([ids, self.who[own[old], place]])
        order = np.lexsort((ids, -s, i))
        order = order[s[order] >= self.threshold]
        i, s, ids = i[order], s[order], ids[order]
        first = np.searchsorted(i, i)
        rank = np.arange(len(i)) - first
        i, s, ids, rank = (v[rank < self.k] for v in (i, s, ids, rank))
        self.s[i, rank], self.who[i, rank] = s, ids
        last = self.s[own, -1]
        self.floor[own] = np.where(last > -np.inf, last, self.threshold) - ROUNDING

    def result(self) -> pd.DataFrame:
        i, place = np.nonzero(self.s > -np.inf)
        return pd.DataFrame({"query_id": self.ids[i], "id": self.who[i, place], "similarity": self.s[i, place]})


def _parquet_files(path: str) -> tuple[fs.FileSystem, list[str]]:
    system, root = fs.FileSystem.from_uri(path)
    return system, sorted(f.path for f in system.get_file_info(fs.FileSelector(root)) if f.base_name.endswith(".parquet") and f.base_name[0] not in "._")


def _vectors(system: fs.FileSystem, path: str, dim: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors in double) of a file of id and v, in batches."""
    with system.open_input_file(path) as f:
        for batch in pq.ParquetFile(f).iter_batches(rows, use_threads=False):
            yield batch.column("id").to_numpy(), batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def similar_to_each(df: DataFrame, id_col: str, vector: str, queries: DataFrame, k: int, threshold: float = 0.01, dim: int = 128) -> DataFrame:
    """(query_id, id, similarity) of the k rows most similar to each of a stated set of rows, themselves left out; ties to the smaller id.

    ``queries`` has the same two columns. Rows and queries are written once to the shared folder; a task reads a
    block of queries and then the rows, of which it holds a slice at a time and keeps the k best of each query, so no
    row is shuffled. With few blocks the rows of a block are shared out among several tasks. Vectors that are null,
    zero, not ``dim`` long or not all numbers, and null ids, take no part; empty inputs give an empty result.
    """
    spark, cuts = df.sparkSession, Scratch(df.sparkSession)
    fit = lambda d: d.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v")).filter(F.col("id").isNotNull() & (F.size("v") == dim))
    total = fit(queries).count()
    blocks = max(1, -(-total // QUERY_ROWS))
    asked, rows = (cuts.path(cuts.cut(d)) for d in (fit(queries).repartition(blocks), fit(df)))
    shares = -(-parallelism(spark) // blocks)

    def best(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for task in (n for pdf in it for n in pdf["id"]):
            system, files = _parquet_files(asked)
            for path in files[task % blocks : task % blocks + 1]:
                ids, x = (np.concatenate(v) for v in zip((np.empty(0, np.int64), np.empty((0, dim))), *_vectors(system, path, dim, SLICE_ROWS)))
                square = np.einsum("ij,ij->i", x, x)
                ok = (square > 0) & np.isfinite(square)
                found = Best(ids[ok], x[ok], k, threshold)
                for part in _parquet_files(rows)[1][task // blocks :: shares] if ok.any() else []:
                    for i, v in _vectors(system, part, dim, SLICE_ROWS):
                        found.add(i, v)
                yield found.result()

    found = spark.range(0, blocks * shares, 1, blocks * shares).mapInPandas(best, "query_id bigint, id bigint, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def fuse_ranks(
    scored: DataFrame, id_col: str = "image_id", top: int = 500, threshold: float = 0.01, relative_cutoff: float = 0.65,
    rrf_cutoff: float = 0.35, cap: int | None = 300, k: int = 60, within_candidates: bool = False,
) -> DataFrame:
    """Reciprocal rank fusion of (model, id, similarity): id, rrf, votes, best (normalised similarity), rank.

    Per model the ``top`` best from ``threshold`` on, then those above the model's least similarity and
    ``relative_cutoff`` (0.80 within candidates) of its best; then all from ``rrf_cutoff`` (0.65 within
    candidates) of the best score on, at most ``cap`` (all within candidates). Ties go to the smaller id.
    """
    w = Window.partitionBy("model").orderBy(F.desc("similarity"), F.asc(id_col))
    best = scored.filter(F.col("similarity") >= threshold).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top)
    least = F.lit(0.10)
    for m, low in MODEL_LEAST.items():
        least = F.when(F.col("model") == m, low).otherwise(least)
    best = best.filter(F.col("similarity") >= least)
    cut = F.lit(0.80 if within_candidates else relative_cutoff)
    model = Window.partitionBy("model")  # at most ``top`` rows a model
    best = best.withColumn("top", F.max("similarity").over(model)).filter(F.col("similarity") >= F.col("top") * cut)
    best = best.withColumn("r", F.row_number().over(w))
    scaled = normalized_similarity(F.col("similarity"), F.col("model"))
    fused = best.groupBy(id_col).agg(F.sum(1.0 / (k + F.col("r"))).alias("rrf"), F.count("*").alias("votes"), F.max(scaled).alias("best"))
    share = 0.65 if within_candidates else rrf_cutoff
    fused = fused.withColumn("top", F.max("rrf").over(Window.partitionBy()))  # at most ``top`` rows a model
    fused = fused.filter(F.col("rrf") >= share * F.col("top")).drop("top")
    fused = fused.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rrf"), F.asc(id_col))))
    return fused if cap is None or within_candidates else fused.filter(F.col("rank") <= cap)


def adaptive_cut(scored: DataFrame, share: float = 0.55, least: float = 0.0) -> DataFrame:
    """The rows of one model's (id, similarity) from ``least`` and ``share`` of the best on."""
    best = scored.agg(F.max("similarity").alias("top"))
    return scored.filter(F.col("similarity") >= least).crossJoin(F.broadcast(best)).filter(F.col("similarity") >= share * F.col("top")).drop("top")


def in_rank_order(photos: DataFrame, ranked: DataFrame, id_col: str = "image_id") -> DataFrame:
    """Photos of a ranked list (id, rank), in its order, with the similarity its rank stands for."""
    total = ranked.agg(F.count("*").alias("total"))
    shown = F.when(F.col("total") <= 1, 1.0).otherwise(1.0 - (F.col("rank") - 1) / (2.0 * F.col("total")))
    return photos.join(ranked.select(id_col, "rank"), id_col).crossJoin(F.broadcast(total)).withColumn("similarity", F.round(shown, 4)).drop("total").orderBy("rank", id_col)


def search_in_box(photos: DataFrame, vector: str, query: Sequence[float], spec: Spec, faces: DataFrame, photo_tag: DataFrame, tag: DataFrame, threshold: float) -> DataFrame:
    """The ``spec.top_k`` photos of a map's box most similar to a vector, without hidden ones unless an admin asks."""
    here = restrict(photos.select("image_id", vector, "file_format", "photo_date", "latitude", "longitude"), spec, faces, photo_tag, tag)
    return top_k(here, "image_id", vector, query, spec.top_k, threshold)
