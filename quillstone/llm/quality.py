"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

The cosine features approximate a Gaussian kernel over standardised statistics. The ridge fit needs only sums of
products of features, which each partition adds up for itself and the aggregation adds over partitions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstone.llm import common

#: Labelled rows to learn from (those of smallest hash), cosine features, ridge penalty per row, kernel width, bins of the calibration, seed.
SAMPLE, FEATURES, RIDGE, WIDTH, BINS, SEED = 65_536, 160, 1e-4, 1.5, 2000, 7

_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_SPACE, _STOP = b" \t\n\r\x0b\x0c", b".,;:?"
_MARK = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _STOP)
STATISTICS = ("log_bytes", "log_words", "word_length", "long_words", "upper", "digits", "stops", "marks", "top_mark", "distinct_words", "top_word", "repeats", "log_lines", "line_words", "distinct_lines", "repeated_line_bytes", "word_ends", "distinct_quads")


def statistics(text: str | None) -> list[float]:
    """Statistics of one text, all finite; a null or empty one has zeros."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [float(np.log1p(size)), *[0.0] * (len(STATISTICS) - 1)]
    solid = len(raw.translate(None, _SPACE))
    share = lambda chars: (size - len(raw.translate(None, chars))) / solid
    marks = raw.translate(None, bytes(set(range(256)) - set(_MARK)))
    counts = Counter(words)
    lines = raw.split(b"\n")
    seen = Counter(lines)
    again = sum((k - 1) * len(x) for x, k in seen.items() if k > 1)
    quads = len(set(zip(words, words[1:], words[2:], words[3:], strict=False))) / (n - 3) if n > 3 else 1.0
    return [
        float(np.log1p(size)), float(np.log1p(n)), solid / n, sum(len(x) > 12 for x in counts) / len(counts),
        share(_UPPER), share(_DIGIT), share(_STOP), len(marks) / solid, max(Counter(marks).values(), default=0) / solid,
        len(counts) / n, max(counts.values()) / n, sum(map(eq, words, words[1:])) / n,
        float(np.log1p(len(lines))), float(np.log1p(n / len(lines))), len(seen) / len(lines), again / size,
        sum(x[-1] in _MARK for x in counts) / len(counts), quads,
    ]


def _floats(batch: pa.RecordBatch, column: str, n: int) -> np.ndarray:
    return np.asarray(batch.column(column).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, n)


def isotonic(total: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The non-decreasing rates closest to ones / total, by pooling adjacent violators; empty bins take no part (NaN)."""
    pools: list[list[float]] = []
    for i in np.flatnonzero(total):
        pools.append([ones[i], total[i], [i]])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            o, t, k = pools.pop()
            pools[-1] = [pools[-1][0] + o, pools[-1][1] + t, pools[-1][2] + k]
    rate = np.full(len(total), np.nan)
    for o, t, k in pools:
        rate[k] = o / t
    return rate


class Model:
    """Standardisation, cosine features, ridge weights and the calibration curve."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(size=(len(mean), FEATURES)) / (WIDTH * np.sqrt(len(mean)))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta = np.zeros(FEATURES + 1)
        self.at, self.rate = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.rate), 0, 1)


def train(df: DataFrame, labels: DataFrame, label: str = "quality", train_where: str = "true", sample: int = SAMPLE) -> Model:
    """Learn from the texts of at most about `sample` labelled rows that train_where (over doc_id) admits.

    Of these, those whose crc32 of the id gives 4 modulo 5 calibrate, the others fit the ridge. Rows without label
    are left out; several labels of a document are averaged. Without labelled rows every score is one half.
    """
    own = labels.where(train_where).where(f"doc_id is not null and {label} is not null").groupBy("doc_id").agg(F.avg(label).alias("y"))
    n = own.count()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    if n > sample:
        own = own.where(part < int(sample / n * (1 << 30)))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 4
    known = df.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("text", "y", held.alias("held"))
    k = len(STATISTICS)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.give_back()
        for batch in batches:
            rows = [statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("y"), batch.column("held")], names=["x", "y", "held"])

    # one Python step, not one before another: in a stage of two each task takes two workers, which stay and all come to hold what later tasks load
    known = common.kept(known, measure, StructType.fromDDL("x array<double>, y double, held boolean"))
    sums = known.agg(F.count("*").alias("n"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(k)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(k)]).first()
    if not sums["n"]:
        return Model(np.zeros(k), np.ones(k))
    model = Model(np.array([sums[f"m{i}"] for i in range(k)]), np.maximum([sums[f"s{i}"] for i in range(k)], 1e-6))
    size = FEATURES + 1
    upper = np.triu_indices(size)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, moment, rows = np.zeros((size, size)), np.zeros(size), 0
        for batch in batches:
            z = model.features(_floats(batch, "x", k))
            gram += z.T @ z
            moment += z.T @ np.asarray(batch.column("y"), float)
            rows += len(z)
        if rows:
            yield pa.RecordBatch.from_pydict({"v": pa.array([np.concatenate([gram[upper], moment, [rows]])], pa.list_(pa.float64()))})

    fitted = known.where("not held").select("x", "y").coalesce(64).mapInArrow(products, "v array<double>")
    added = fitted.select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    if added:
        v = np.array([x["v"] for x in sorted(added, key=lambda x: x["i"])])
        gram = np.zeros((size, size))
        gram[upper] = v[: len(upper[0])]
        gram += np.triu(gram, 1).T
        penalty = RIDGE * v[-1] * np.append(np.ones(FEATURES), 0)
        model.beta = np.linalg.lstsq(gram + np.diag(penalty), v[len(upper[0]) : -1], rcond=None)[0]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k_ = np.clip(((model.raw(_floats(batch, "x", k)) + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(k_), batch.column("y")], names=["bin", "y"])

    bins = known.where("held").select("x", "y").mapInArrow(binned, "bin bigint, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect()
    total, ones = np.zeros(BINS), np.zeros(BINS)
    for x in bins:
        total[x["bin"]], ones[x["bin"]] = x["n"], x["s"]
    rate = isotonic(total, ones)
    if (seen := np.flatnonzero(total)).size:
        centre = (np.arange(BINS) + 0.5) / BINS * 2 - 0.5
        # one knot for each level, at the mean of its rows, so that scores between levels still rise
        levels, of = np.unique(rate[seen], return_inverse=True)
        model.at = np.array([np.average(centre[seen[of == i]], weights=total[seen[of == i]]) for i in range(len(levels))])
        model.rate = levels
    return model


def scores(df: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """All columns of df, and score (0 to 1: how likely label 1 is) and predicted (1 from threshold on).

    Null and empty texts have statistics of zero and a score as any other. Null and repeated doc_ids and repeated
    rows are kept. An empty table gives no rows. Only the text enters the score; columns named score or predicted
    are replaced.
    """
    df = df.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.give_back()
        for batch in batches:
            if batch.num_rows:
                s = model.score(np.array([statistics(t) for t in batch.column(text).to_pylist()]))
                new = [pa.array(s), pa.array((s >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "score", "predicted"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return df.mapInArrow(run, ", ".join([*fields, "score double, predicted int"]))
