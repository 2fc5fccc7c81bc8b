"""Vector code compression: product codes whose nearest codebook entries are found by annular norm pruning.

A vector's components become whole numbers, its parts are coded by the entry of the part's codebook that is nearest. An
entry at distance d from x has a norm within d of x's. So entries are sorted by norm, and evaluated outward from x's own;
a binary search finds the interval of norms that the best distance so far allows, which shrinks as that falls; only
entries in the annulus, borders included, are evaluated, exactly. Ties go to the entry of lower index, which may lie on
the border: that is why the interval is inclusive.

All arithmetic is in whole numbers: 64 bits where the values allow it, Python's own beyond. Norms are rounded down to
whole numbers, and the interval is wider by one on both sides for that.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm import common

#: Parts of a vector, entries of a codebook, rounds of learning, and what components are multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components up to this size, in parts of up to WIDE of them, are reckoned in 64 bits.
NARROW, WIDE = 1 << 22, 1 << 8
#: Entries on each side that are evaluated before the annulus is searched for again, and rows that are coded at a time.
STEP, ROWS = 6, 1 << 14
#: Sums travel in digits of so many bits, so that no sum over tasks goes beyond 64 bits.
BITS = 30


def whole(vectors: list[list[float]], scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of each component, exactly, for scale a power of two; int64, or Python's whole numbers where one is large."""
    v = np.array(vectors, np.float64)
    if not v.size or np.abs(v).max() * scale < NARROW:
        return np.floor(v * scale).astype(np.int64)
    out = np.empty(v.shape, object)
    out[...] = [[math.floor(x * scale) if abs(x) < 1 << 60 else int(x) * scale for x in row] for row in v.tolist()]
    return out


_isqrt = np.frompyfunc(math.isqrt, 1, 1)


def _root(squares: np.ndarray) -> np.ndarray:
    """Square roots, rounded down; those of numbers below 2^53 are told apart from whole ones by doubles."""
    if squares.dtype == object:
        return _isqrt(squares)
    root = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    root -= root * root > squares
    return root + ((root + 1) * (root + 1) <= squares)


class Codebook:
    """A part's entries, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        norms = _root((entries * entries).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.sorted = norms[self.order], entries[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Per row of x the index of its nearest entry (of equally near ones the lowest), the squared distance, and how many pairs were evaluated in all."""
        n, k = len(self.entries), len(x)
        if x.dtype != self.entries.dtype:
            x, book = x.astype(object), Codebook(self.entries.astype(object))
            return book.nearest(x)
        keys, pairs = np.empty(k, x.dtype), 0
        for start in range(0, k, ROWS):
            keys[start : start + ROWS], some = self._walk(x[start : start + ROWS])
            pairs += some
        return (keys % n).astype(np.int64), keys // n, pairs

    def _walk(self, x: np.ndarray) -> tuple[np.ndarray, int]:
        """Per row squared distance * entries + index of its nearest entry: outward from the row's own norm, STEP entries a side at a time, within the annulus that the best distance so far allows."""
        n, k = len(self.sorted), len(x)
        norms, rows, pairs = _root((x * x).sum(axis=1)), np.arange(k), 0
        begin = np.searchsorted(self.norms, norms)
        end, low, high = begin.copy(), np.zeros(k, np.int64), np.full(k, n)
        keys = ((x - self.sorted[np.minimum(begin, n - 1)]) ** 2).sum(axis=1) * n + self.order[np.minimum(begin, n - 1)]
        while len(rows):
            to = np.maximum(np.minimum(low[rows], begin[rows]), begin[rows] - STEP), np.minimum(np.maximum(high[rows], end[rows]), end[rows] + STEP)
            for a, b in ((to[0], begin[rows]), (end[rows], to[1])):
                some = np.flatnonzero(b > a)
                if len(some):
                    count = b[some] - a[some]
                    first = np.cumsum(count) - count
                    row, entry = np.repeat(rows[some], count), np.arange(count.sum()) - np.repeat(first - a[some], count)
                    key = ((x[row] - self.sorted[entry]) ** 2).sum(axis=1) * n + self.order[entry]
                    keys[rows[some]] = np.minimum(keys[rows[some]], np.minimum.reduceat(key, first))
                    pairs += len(row)
            begin[rows], end[rows] = to
            reach = _root(keys[rows] // n) + 1
            low[rows], high[rows] = np.searchsorted(self.norms, norms[rows] - reach, "left"), np.searchsorted(self.norms, norms[rows] + reach, "right")
            rows = rows[(low[rows] < begin[rows]) | (high[rows] > end[rows])]
        return keys, pairs


def _usable(column: str) -> Column:
    return F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _cut(x: np.ndarray, parts: int) -> np.ndarray:
    """Rows as (part, row, component), with zeros at the end where the size isn't a multiple of the parts."""
    n, size = x.shape
    wide = -(-size // parts)
    if wide * parts != size:
        x = np.concatenate([x, np.zeros((n, wide * parts - size), x.dtype)], axis=1)
    return x.reshape(n, parts, wide).transpose(1, 0, 2)


def _narrow(x: np.ndarray) -> np.ndarray:
    """int64 where 64 bits hold every distance with an index, else Python's whole numbers."""
    small = x.shape[-1] <= WIDE and (not x.size or max(abs(int(x.max())), abs(int(x.min()))) <= NARROW)
    return x.astype(np.int64 if small else object)


def _sums(books: list[Codebook], parts: int, scale: int):
    """For mapInArrow: per part, entry and component (-1: the number of parts) the sum over the task's rows, in digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = [len(books), len(books[0].entries), books[0].entries.shape[1] + 1]
        totals = np.zeros(shape, object)
        for batch in batches:
            if not batch.num_rows:
                continue
            for p, x in enumerate(_cut(whole(batch.column("v").to_pylist(), scale), parts)):
                x = _narrow(x)
                at, _, _ = books[p].nearest(x)
                order = np.argsort(at, kind="stable")
                used, begin = np.unique(at[order], return_index=True)
                totals[p, used, :-1] += np.add.reduceat(x[order], begin, axis=0).astype(object)
                totals[p, used, -1] += np.diff([*begin, len(at)]).astype(object)
        rows = []
        for (p, e, c), v in np.ndenumerate(totals):
            sign, v, digit = (1, v, 0) if v >= 0 else (-1, -v, 0)
            while v:
                rows.append((p, e, c if c < shape[2] - 1 else -1, digit, sign * (v & (1 << BITS) - 1)))
                v, digit = v >> BITS, digit + 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["part", "entry", "c", "digit", "v"])

    return run


def learn(vectors: DataFrame, first: np.ndarray, parts: int = PARTS, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """Codebooks by part, begun with the rows of first. Each round is one pass; the driver gets the sums of each entry's components, as many as the codebooks have, whatever the rows are."""
    books = [_narrow(x) for x in _cut(first, parts)]
    for _ in range(rounds):
        sums = vectors.mapInArrow(_sums([Codebook(x) for x in books], parts, scale), "part bigint, entry bigint, c bigint, digit bigint, v bigint")
        total: dict[tuple[int, int, int], int] = {}
        for x in sums.groupBy("part", "entry", "c", "digit").agg(F.sum("v").alias("v")).collect():
            key = (x["part"], x["entry"], x["c"])
            total[key] = total.get(key, 0) + (x["v"] << BITS * x["digit"])
        for p, book in enumerate(books):
            book = book.astype(object)
            for e in range(len(book)):
                n = total.get((p, e, -1))
                if n:
                    book[e] = [total.get((p, e, c), 0) // n for c in range(book.shape[1])]
            books[p] = _narrow(book)
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components as decimal numbers, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for book in books for v in book.ravel()).encode()).hexdigest()


def encode(df: DataFrame, vector: str = "embedding", id_: str = "vec_id", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """id, label, code (two hexadecimal digits a part), error, label_error, codebooks_sha256, pairs of each vector that can be coded.

    Vectors that are null or empty or hold null or non-finite components are left out, as are those whose size isn't that
    of the first one. First are those of smallest id, null last, of equal ids by components; a repeated row counts as
    often as it stands there. Where there are fewer rows than entries, codebooks are as small. Sizes that aren't a
    multiple of the parts are filled up with zeros. error is the squared distance, null beyond 64 bits; label_error sums
    it over equal labels, nulls being equal (null where the sum is beyond 64 bits or all of it is). pairs is how many
    pairs of a part and an entry were evaluated for the row, on average over its batch. Other columns are ignored; an
    empty table gives no rows.
    """
    kept = df.where(_usable(vector)).select(F.col(id_).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    size = len(first[0]["v"]) if first else 0
    first = [x["v"] for x in first]
    kept = kept.where(F.size("v") == size)
    if any(len(x) != size for x in first):
        first = [x["v"] for x in kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    schema = kept.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0.0).alias("pairs")).schema
    books = learn(kept.select("v"), whole(first, scale), parts, rounds, scale) if first else []
    last = [Codebook(x) for x in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, error, pairs = np.empty((batch.num_rows, parts), np.int64), np.zeros(batch.num_rows, object), 0
            for p, x in enumerate(_cut(whole(batch.column("v").to_pylist(), scale), parts)):
                codes[:, p], d, n = last[p].nearest(_narrow(x))
                error, pairs = error + d.astype(object), pairs + n
            digits = [f"{x:02x}" for x in range(entries)]
            told = [x if x < 1 << 63 else None for x in error]
            texts = ["".join(digits[x] for x in row) for row in codes.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(texts), pa.array(told, pa.int64()), pa.array([pairs / batch.num_rows] * batch.num_rows)], ["id", "label", "code", "error", "pairs"])

    coded = common.kept(kept, run, schema).withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    labels = common.kept(coded.groupBy("key").agg(F.expr("try_sum(error)").alias("label_error"), F.count("*").alias("n")))
    total = labels.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = common.join_spread(coded, labels, ["key"], "n", total, ["id", "code"])
    return out.select(F.col("id").alias(id_), F.col("label").alias(label), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"), "pairs")
