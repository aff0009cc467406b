"""Text cut off by field limits or broken transfers.

Per source, the histograms of lengths in characters and in bytes show limits as spikes; values at a spike
length without terminal punctuation are cut. Cuts that leave no spike (broken transfers, blanks trimmed
after a cut, words a feed adds after it) show in how a text ends: counts over the whole corpus tell
whether its last words ever end a sentence or line, and whether its last word is but the beginning of one.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from fotoloom.session import Scratch

_ENDS = ".!?…\n)]\"»”"
_SOFT = _ENDS + ",;:–—-"
#: What may close a finished text: terminal punctuation or a closing mark, signs such as emoji after it.
_TERMINAL = regex.compile(r"[.!?…)\]\"»”’*]\W*$|[\p{So}\p{Sk}]\s*$|[:;]-?[)(D]$|<3$")
#: A character or entity of which only the beginning is there.
_BROKEN = regex.compile(r"(�|(^|\s)&[A-Za-z#0-9]{0,8})$")
_TAIL = r"(?s)(\s*(\n--\n[^\n]*|\[[^\[\]\n]{1,40}\])\s*)$"
_ELLIPSIS = r"(?s)(\s*(?:\[(?:\.\.\.|…)\]|\.\.\.|…)\s*)$"
_BLANKS = " \t\n\x0b\f\r"
#: Characters from the end in which a feed's final block is looked for, and in which a text's last words mostly lie.
BLOCK_CHARS, END_CHARS = 400, 256
#: Final blocks up to which they are sent to every task; more are joined.
MOST_MARKS = 50_000
#: Bits of the filter of words asked for: so many a key, at most 2 ** MOST_BITS in all (beyond, more pass and the join decides).
BITS_A_KEY, MOST_BITS = 16, 29
#: Characters that are tokenised, and counts that are held, at once.
_CHARS, _COUNTS = 500_000, 1_000_000
#: A final block counts as the feed's own when so many of the feed's texts, and so large a share, end in it.
TAIL_TEXTS, TAIL_SHARE = 3, 0.005
#: A length is a spike when so many texts have it and so many times the mean of the lengths around it.
SPIKE_TEXTS, SPIKE_RATIO, SPIKE_AROUND = 8, 6.0, 12
#: Times that words must occur elsewhere to be judged by, and the share of ends from which on they may end a text.
SEEN, END_SHARE = 8, 0.03


_SPACE, _LETTER, _DIGIT, _SINGLE = range(4)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _kind(c: str) -> int:
    cat = unicodedata.category(c)
    if cat[0] in "LM":
        return _LETTER
    if cat == "Nd":
        return _DIGIT
    return _SPACE if c != "\n" and (cat[0] == "Z" or c in "\t\x0b\f\r\x85") else _SINGLE


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind, lower case and whether upper case, of the characters below 65,536."""
    every = [chr(i) for i in range(1 << 16)]
    low = [x if len(x := c.lower()) == 1 else c for c in every]
    return (
        np.fromiter(map(_kind, every), np.uint8, 1 << 16), np.fromiter(map(ord, low), np.uint32, 1 << 16), np.fromiter((c.isupper() for c in every), bool, 1 << 16),
    )


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def _key(salt: int, *parts: np.ndarray) -> np.ndarray:
    h = np.uint64(salt * 0x2545F4914F6CDD1D & (1 << 64) - 1)
    for p in parts:
        h = _mix(p + h * np.uint64(_BASE))
    return h


class _Tokens:
    """The tokens of some texts: runs of letters, runs of digits, line ends and other signs; each text begins with a line end.

    ``low`` and ``shape`` stand for a token in lower case and as it is written, where a run of digits
    stands for its length and, in ``shape``, all capitalised words are one. ``number`` counts a text's
    tokens from 0, its line end; ``last`` marks its last one.
    """

    def __init__(self, texts: list[str]):
        cp = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "replace"), np.uint32)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        kinds, lows, uppers = _tables()
        far = cp > 0xFFFF
        small = np.where(far, 0, cp)
        kind, self.low_cp, upper = kinds[small], lows[small], uppers[small]
        if far.any():
            for c in np.unique(cp[far]):
                at = cp == c
                kind[at], self.low_cp[at] = _kind(chr(c)), ord(chr(c).lower())
        other = np.r_[True, kind[1:] != kind[:-1], True]
        solid, single = kind != _SPACE, kind == _SINGLE
        self.start = np.flatnonzero(solid & (single | other[:-1]))
        self.end = np.flatnonzero(solid & (single | other[1:])) + 1
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(len(cp), _BASE, np.uint64))
            self.back = np.cumprod(np.full(len(cp) + 1, _INVERSE, np.uint64))
            self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum((c.astype(np.uint64) + np.uint64(1)) * power)]) for c in (self.low_cp, cp)]
            self.kind, first = kind[self.start], cp[self.start]
            low, shape = (self._hash(s, self.start, self.end) for s in self.sums)
            run = _key(91, (self.end - self.start).astype(np.uint64))
            digit, capital = self.kind == _DIGIT, (self.kind == _LETTER) & upper[self.start]
            self.low = np.where(digit, run, low)
            self.shape = np.where(digit, run, np.where(capital, np.uint64(7), shape))
        ends, soft = (np.isin(first, np.frombuffer(x.encode("utf-32-le"), np.uint32)) for x in (_ENDS, _SOFT))
        self.ends, self.soft = np.r_[ends[1:], True], np.r_[soft[1:], True]  # of the token after this one
        begin = np.searchsorted(self.start, np.concatenate([[0], np.cumsum(size + 1)]))  # each text's line end, and the one after all
        self.begin = begin[:-1]
        self.number = np.arange(len(self.start)) - np.repeat(begin, np.diff(np.r_[begin, len(self.start)]))
        self.last = np.zeros(len(self.start), bool)
        self.last[begin[1:] - 1] = True

    def _hash(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((sums[end] - sums[start]) * self.back[start])

    def contexts(self, j: np.ndarray) -> list[np.ndarray]:
        """The keys of the contexts that end at tokens j (no line ends of texts), the most telling first."""
        two = np.where(self.number[j] > 1, j - 2, j - 1)
        a, b, c = self.low[two], self.low[j - 1], self.low[j]
        x, y, z = self.shape[two], self.shape[j - 1], self.shape[j]
        return [_key(1, a, b, c), _key(2, b, c), _key(3, x, y, z), _key(4, y, z), _key(5, c)]

    def words(self, j: np.ndarray) -> np.ndarray:
        return _key(6, self.low[j])

    def beginnings(self, j: np.ndarray) -> Iterator[np.ndarray]:
        """Keys of the proper beginnings of words j, by length."""
        start, size = self.start[j], self.end[j] - self.start[j]
        for q in range(1, int(size.max(initial=1))):
            start, size = start[size > q], size[size > q]
            yield _key(7, self._hash(self.sums[0], start, start + q))

    def as_beginnings(self, j: np.ndarray) -> np.ndarray:
        return _key(7, self.low[j])


def _portions(texts: list[str]) -> Iterator[list[str]]:
    part, chars = [], 0
    for t in texts:
        part.append(t)
        chars += len(t)
        if chars >= _CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


class _Asked:
    """The keys somebody asks for, as a bitmap: all of them pass, and few others."""

    def __init__(self, bits: int, chunks: dict[int, bytes]):
        self.bits, self.map = bits, np.zeros(max(1, (1 << bits) >> 3), np.uint8)
        for k, b in chunks.items():
            self.map[k << _CHUNK - 3 : (k + 1) << _CHUNK - 3] = np.frombuffer(b, np.uint8)

    def place(self, key: np.ndarray) -> np.ndarray:
        return key >> np.uint64(64 - self.bits)

    def passes(self, key: np.ndarray) -> np.ndarray:
        at = self.place(key)
        return (self.map[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


_CHUNK = 16


def _asked_filter(asked: DataFrame) -> _Asked:
    """The bitmap of the column ``key``: made in the tasks by chunks of bits, of which there are at most 2 ** (MOST_BITS - _CHUNK)."""
    n = asked.agg(F.approx_count_distinct("key")).first()[0]
    bits = min(MOST_BITS, max(_CHUNK, int(np.ceil(np.log2(max(1, n) * BITS_A_KEY)))))
    place = F.shiftrightunsigned("key", 64 - bits)
    at = asked.select(place.alias("at")).distinct().select((F.col("at") / (1 << _CHUNK)).cast("int").alias("chunk"), (F.col("at") % (1 << _CHUNK)).cast("int").alias("at"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        b = np.zeros(1 << _CHUNK, np.uint8)
        b[pdf["at"].to_numpy()] = 1
        return pd.DataFrame({"chunk": pdf.chunk[:1], "b": [np.packbits(b, bitorder="little").tobytes()]})

    got = at.groupBy("chunk").applyInPandas(fill, "chunk int, b binary").collect()
    return _Asked(bits, {r.chunk: bytes(r.b) for r in got})


class _Counts:
    """Counts of keys: how often they occur, end and softly end."""

    def __init__(self):
        self.parts, self.rows = [], 0

    def add(self, key: np.ndarray, ends: np.ndarray | None = None, soft: np.ndarray | None = None) -> None:
        if len(key):
            none = np.zeros(len(key), np.int64)
            self.parts.append((key, none + 1, none if ends is None else ends.astype(np.int64), none if soft is None else soft.astype(np.int64)))
            self.rows += len(key)

    def shrink(self) -> None:
        if self.parts:
            key, n, e, s = (np.concatenate(x) for x in zip(*self.parts))
            order = np.argsort(key)
            key = key[order]
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            self.parts = [(key[at], *(np.add.reduceat(x[order], at) for x in (n, e, s)))]
            self.rows = len(at)

    def flush(self) -> Iterator[pd.DataFrame]:
        self.shrink()
        for key, n, e, s in self.parts:
            yield pd.DataFrame({"key": key.view(np.int64), "n": n, "e": e, "s": s})
        self.parts, self.rows = [], 0


def _count(it: Iterator[pd.DataFrame], asked: _Asked) -> Iterator[pd.DataFrame]:
    """Partial counts of the keys asked for: of contexts how often they occur, end and softly end; of words and word beginnings how often inside a text."""
    c = _Counts()
    for pdf in it:
        for texts in _portions(pdf.core.to_list()):
            with np.errstate(over="ignore"):
                t = _Tokens(texts)
                j = np.flatnonzero(t.number > 0)
                j = j[:-1] if len(j) and j[-1] == len(t.start) - 1 else j  # not the line end after all
                for key in t.contexts(j):
                    ok = asked.passes(key)
                    c.add(key[ok], t.ends[j[ok]], t.soft[j[ok]])
                w = j[(t.kind[j] == _LETTER) & ~t.last[j]]
                for key in (t.words(w), *t.beginnings(w)):
                    c.add(key[asked.passes(key)])
            if c.rows > _COUNTS:
                c.shrink()
                if c.rows > _COUNTS // 2:
                    yield from c.flush()
    yield from c.flush()


def _ending(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How each text ends: closed, broken, or the contexts to look up."""
    for pdf in it:
        tails, closed, broken = [], [], []
        for core in pdf.core:
            t = core[-END_CHARS:]
            if len(t) < len(core) and len(regex.findall(r"\w\s", t)) < 4:  # few or endless words
                t = core
            tails.append(t)
            broken.append(bool(_BROKEN.search(t)))
            closed.append(not broken[-1] and bool(_TERMINAL.search(t)))
        with np.errstate(over="ignore"):
            t = _Tokens(tails)
            end = np.r_[t.begin[1:], len(t.start) - 1] - 1
            n = t.number[end]
            ask = (n > 0) & ~np.array(closed, bool) & ~np.array(broken, bool)
            j = end[ask]
            keys = np.stack([*t.contexts(j), t.words(j), t.as_beginnings(j)], axis=1).view(np.int64) if len(j) else np.empty((0, 7), np.int64)
        letters, rows = (t.kind[j] == _LETTER).tolist(), iter(keys)
        found = [[]] * len(pdf)
        for i, letter in zip(np.flatnonzero(ask).tolist(), letters):
            found[i] = next(rows)[: 7 if letter else 5]
        yield pd.DataFrame({"h1": pdf.h1, "h2": pdf.h2, "closed": closed, "broken": broken, "tokens": n.astype(np.int32), "keys": found})


def _block(core: Column, group: int) -> Column:
    """A group of _TAIL at the end of the text; the pattern runs only where the end can match it."""
    end = F.right(core, F.lit(BLOCK_CHARS))
    return F.when(core.endswith("]") | end.contains("\n--\n"), F.regexp_extract(end, _TAIL, group)).otherwise("")


def _without(core: Column, end: Column) -> Column:
    return F.when(end == "", core).otherwise(F.rtrim(F.substring(core, F.lit(1), F.char_length(core) - F.char_length(end)), F.lit(_BLANKS)))


def strip_feed_marks(docs: DataFrame, source: str, text: str) -> DataFrame:
    """The rows with ``core``: the text without outer blanks, its feed's final block and marks of omission.

    A final block is a signature after a line of two dashes, or words in square brackets, that ends at
    least TAIL_TEXTS texts and TAIL_SHARE of the texts of some source (digits may differ). Blocks of more
    than BLOCK_CHARS characters are the author's.
    """
    mark = lambda c: F.when((b := _block(c, 2)) == "", b).otherwise(F.regexp_replace(F.trim(b), r"\d+", "9"))
    docs = docs.withColumn("core", F.rtrim(F.col(text), F.lit(_BLANKS))).withColumn("mark", mark(F.col("core")))
    marks = docs.groupBy(source, "mark").agg(F.count("*").alias("n"))
    size = marks.groupBy(source).agg(F.sum("n").alias("of")).withColumnRenamed(source, "src")
    own = marks.filter("mark <> ''").join(size, F.col(source).eqNullSafe(F.col("src"))).filter((F.col("n") >= TAIL_TEXTS) & (F.col("n") >= TAIL_SHARE * F.col("of")))
    own = Scratch(docs.sparkSession).cut(own.select("mark").distinct().withColumn("own", F.lit(True)))
    few = own.count() <= MOST_MARKS
    for _ in range(2):  # a feed's block may follow another's
        if few:
            docs = docs.join(F.broadcast(own), "mark", "left")
        else:  # texts without a mark are dealt over all tasks
            docs = docs.withColumn("salt", F.when(F.col("mark") == "", F.pmod(F.xxhash64("core"), F.lit(1 << 20))).otherwise(-1))
            docs = docs.join(own.withColumn("salt", F.lit(-1).cast("bigint")), ["mark", "salt"], "left").drop("salt")
        docs = docs.withColumn("core", F.when(F.col("own"), _without(F.col("core"), _block(F.col("core"), 1))).otherwise(F.col("core"))).drop("own", "mark")
        docs = docs.withColumn("mark", mark(F.col("core")))
    core = F.col("core")
    dots = F.when(core.endswith("...") | core.endswith("…") | core.endswith("]"), F.regexp_extract(F.right(core, F.lit(BLOCK_CHARS)), _ELLIPSIS, 1)).otherwise("")
    return docs.drop("mark").withColumn("core", F.btrim(_without(core, dots), F.lit(_BLANKS)))


def length_spikes(rows: DataFrame) -> DataFrame:
    """(source, unit, len, texts) of each source's lengths at which texts without an end pile up.

    ``rows`` has source, h1 and ``lens``, a map from unit (characters or bytes, of the text or its core)
    to length, of the texts that do not close. Copies of a text count once per source. Where several units spike, the one with the
    largest spike is the source's.
    """
    hist = rows.select("source", "h1", F.explode("lens").alias("unit", "len"))
    hist = hist.groupBy("source", "unit", "len", "h1").count().groupBy("source", "unit", "len").agg(F.count("*").alias("texts"))
    w = Window.partitionBy("source", "unit").orderBy("len").rangeBetween(-SPIKE_AROUND, SPIKE_AROUND)  # a row per length
    around = (F.sum("texts").over(w) - F.col("texts")) / (2.0 * SPIKE_AROUND)
    spikes = hist.withColumn("around", around).filter((F.col("texts") >= SPIKE_TEXTS) & (F.col("texts") >= SPIKE_RATIO * (F.col("around") + 0.5)))
    best = spikes.groupBy("source").agg(F.max_by("unit", F.struct("texts", "unit")).alias("best"))
    best = best.withColumnRenamed("source", "src")
    return spikes.join(best, F.col("source").eqNullSafe(F.col("src")) & (F.col("unit") == F.col("best"))).select("source", "unit", "len", "texts")


def _lengths() -> dict[str, Column]:
    return {
        "text chars": F.char_length("text"), "text bytes": F.octet_length("text"),
        "core chars": F.char_length("core"), "core bytes": F.octet_length("core"),
    }


def truncated(docs: DataFrame, id_col: str, source: Column, text: str) -> DataFrame:
    """(id, source, cut) of every row with a text; cut is 'limit' at a spike length, 'ending' by its end, or null.

    Null texts and texts of blanks are left out; a null source is a source of its own. A text that closes
    with terminal punctuation, a bracket or an emoji is not cut, whatever its length. What was counted of
    a text itself does not speak for it, and copies are counted once.
    """
    s = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), source.alias("source"), F.col(text).alias("text"))
    rows = strip_feed_marks(rows.filter("text is not null"), "source", "text").filter("core <> ''")
    rows = rows.withColumns({"h1": F.xxhash64("core"), "h2": F.xxhash64(F.lit(1), "core")})
    lens = F.create_map(*[x for k, v in _lengths().items() for x in (F.lit(k), v.cast("int"))])
    texts = s.cut(rows.groupBy("h1", "h2").agg(F.first("core").alias("core")))
    rows = s.cut(rows.select("id", "source", "h1", "h2", lens.alias("lens")))

    # ends
    ending = s.cut(texts.mapInPandas(_ending, "h1 bigint, h2 bigint, closed boolean, broken boolean, tokens int, keys array<bigint>"))
    asked = ending.select("h1", "h2", F.posexplode("keys").alias("rank", "key"))
    told = docs.sparkSession.sparkContext.broadcast(_asked_filter(asked))
    counts = texts.select("core").mapInPandas(lambda it: _count(it, told.value), "key bigint, n bigint, e bigint, s bigint")
    counts = counts.groupBy("key").agg(*[F.sum(c).alias(c) for c in "nes"])
    known = asked.join(counts, "key")
    at = lambda i: F.max(F.when(F.col("rank") == i, F.struct("n", "e", "s"))).alias(f"k{i}")
    seen = known.groupBy("h1", "h2").agg(*[at(i) for i in range(7)])
    verdict = ending.join(seen, ["h1", "h2"], "left")
    inside, begun = F.coalesce("k5.n", F.lit(0)), F.coalesce("k6.n", F.lit(0))
    stump = (F.size("keys") == 7) & (begun >= 5) & (inside <= F.greatest(F.lit(1), begun / 2000))
    share = F.lit(None).cast("double")
    for i in reversed(range(5)):
        share = F.when(F.col(f"k{i}.n") - 1 >= SEEN, (F.col(f"k{i}.e") - 1) / (F.col(f"k{i}.n") - 1)).otherwise(share)
    # a line of one or two words, such as a caption, is whole where it mostly stands before a comma or an end
    short = (F.col("tokens") <= 2) & (F.col("k0.n") > 1) & ((F.col("k0.s") - 1) >= 0.5 * (F.col("k0.n") - 1))
    open_end = F.col("broken") | (~F.col("closed") & ~F.coalesce(short, F.lit(False)) & (stump | F.coalesce(share < END_SHARE, F.lit(False))))
    verdict = verdict.select("h1", "h2", "closed", open_end.alias("open_end"))

    # limits
    spikes = length_spikes(rows.join(verdict.filter("not closed").select("h1", "h2"), ["h1", "h2"], "left_semi"))
    units = F.explode("lens").alias("unit", "len")
    at_limit = rows.select("id", "source", units).join(spikes.withColumnRenamed("source", "src"), ["unit", "len"]).filter(F.col("source").eqNullSafe(F.col("src")))
    at_limit = at_limit.select("id").distinct().withColumn("at_limit", F.lit(True))
    out = rows.select("id", "source", "h1", "h2").join(verdict, ["h1", "h2"]).join(at_limit, "id", "left")
    cut = F.when(F.col("at_limit") & ~F.col("closed"), "limit").when(F.col("open_end"), "ending")
    return out.select("id", "source", cut.alias("cut"))


def truncation_rates(found: DataFrame) -> DataFrame:
    """(source, texts, truncated, rate) per source, of the rows of ``truncated``."""
    out = found.groupBy("source").agg(F.count("*").alias("texts"), F.count("cut").alias("truncated"))
    return out.withColumn("rate", F.round(F.col("truncated") / F.col("texts"), 4))
