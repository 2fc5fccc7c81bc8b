"""Toxic passages as maximal scoring segments of token log-odds, with extreme-value calibration.

Log-odds of words and of word beginnings, with a Dirichlet prior in proportion to the whole sample, come from
labelled documents. In every text, all maximal segments of positive score are found in one linear scan. How far a
segment stands out is measured against the extreme-value law that segments of clean text follow. The law takes words
to be independent; so it, and a document's score, rest on segments for which each further time that a text has a word
its log-odds count half as much as the time before. The law and the curve from evidence to probability are fitted on
labelled documents that the log-odds have not seen.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstone.llm import common

#: Labelled rows to learn from (those of smallest hash), weight of the Dirichlet prior in tokens and its least share for any unit, least z-score of a unit, what a token without evidence costs.
SAMPLE, PRIOR, FLOOR, LEAST_Z, DRIFT = 65_536, 500.0, 0.5, 3.0, 2.0
#: Lengths of word beginnings that count as units beside whole words (fixed values), and words that a worker remembers.
BEGINNINGS, REMEMBERED = (4, 5, 6), 500_000
#: Documents in one partition of the result, on average (it has no more partitions than the written table is read in).
PARTITION_ROWS = 1 << 16
_STRIP = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def units(token: bytes) -> list[bytes]:
    """The word without marks around it, and its beginnings (in whole characters), each marked by its length."""
    word = token.strip(_STRIP)
    if not word:
        return []
    chars = word.decode("utf-8", "surrogatepass")
    return [word, *(b" %d %s" % (n, chars[:n].encode("utf-8", "surrogatepass")) for n in BEGINNINGS if len(chars) > n)]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, after the last, score) by the linear-time scan of Ruzzo and Tompa.

    Only tokens of positive score start a step; the others enter through running sums. Each segment found so far
    points to the last one before it that starts from a lower sum, so that a search follows pointers instead of
    looking at all segments, and every pointer is followed once.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)]).tolist()
    first: list[int] = []
    after: list[int] = []
    low: list[float] = []  # sums before a segment and after it
    high: list[float] = []
    lower: list[int] = []  # pointers; -1 for none
    for i in np.flatnonzero(scores > 0).tolist():
        a, under, over, j = i, total[i], total[i + 1], len(first) - 1
        while True:
            while j >= 0 and low[j] >= under:
                j = lower[j]
            if j < 0 or high[j] >= over:
                break
            a, under, up = first[j], low[j], lower[j]
            del first[j:], after[j:], low[j:], high[j:], lower[j:]
            j = up
        first.append(a)
        after.append(i + 1)
        low.append(under)
        high.append(over)
        lower.append(j)
    return [(a, b, y - x) for a, b, x, y in zip(first, after, low, high, strict=True)]


class Lexicon(dict):
    """Token -> score: the log-odds of its unit of strongest evidence less the drift."""

    def __init__(self, odds: dict[bytes, float]):
        self.odds = odds

    def __missing__(self, token: bytes) -> float:
        s = max((self.odds[u] for u in units(token) if u in self.odds), default=0.0) - DRIFT
        if len(self) < REMEMBERED and len(token) < 64:
            self[token] = s
        return s

    def __reduce__(self):
        return Lexicon, (self.odds,)


def learn(df: DataFrame, known: DataFrame) -> dict[bytes, float]:
    """Units whose log-odds speak for toxic documents: {unit: log-odds}."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter(), Counter()]

        def rows() -> pa.RecordBatch:
            names = list(counts[0].keys() | counts[1].keys())
            return pa.RecordBatch.from_pydict({"unit": pa.array(names, pa.binary()), "clean": pa.array([counts[0][x] for x in names], pa.int64()), "toxic": pa.array([counts[1][x] for x in names], pa.int64())})

        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                own: Counter = Counter()
                for token, k in Counter(tokens(text)).items():
                    for u in units(token):
                        own[u] += k
                counts[y >= 0.5].update(own)
                if len(counts[0]) + len(counts[1]) > 400_000:
                    yield rows()
                    counts = [Counter(), Counter()]
        yield rows()

    c = df.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "y").mapInArrow(run, "unit binary, clean bigint, toxic bigint")
    c = common.kept(c.groupBy("unit").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")))
    sums = c.agg(F.sum("c").alias("c"), F.sum("t").alias("t")).first()
    clean, toxic = float(sums["c"] or 0), float(sums["t"] or 0)
    if not clean or not toxic:
        return {}
    prior = F.lit(FLOOR) + F.lit(PRIOR / (clean + toxic)) * (F.col("c") + F.col("t"))
    odds = lambda k, n: F.log((F.col(k) + F.col("p")) / (F.lit(n + PRIOR) - F.col(k) - F.col("p")))
    c = c.where("t > 1").withColumn("p", prior).withColumn("odds", odds("t", toxic) - odds("c", clean))
    c = c.withColumn("z", F.col("odds") / F.sqrt(1 / (F.col("t") + F.col("p")) + 1 / (F.col("c") + F.col("p"))))
    # the units that are kept are a few: each needs evidence, of which the bounded sample has only so much
    rows = c.where((F.col("odds") > DRIFT) & (F.col("z") >= LEAST_Z)).select("unit", "odds").collect()
    return {bytes(x["unit"]): float(x["odds"]) for x in rows}


def halved(t: list[bytes], s: np.ndarray) -> np.ndarray:
    """The scores with the log-odds of a word's further occurrences in the text halved each time."""
    s = s.copy()
    seen: Counter = Counter()
    for i in np.flatnonzero(s > 0).tolist():
        word = t[i].strip(_STRIP)
        if k := seen[word]:
            s[i] = (s[i] + DRIFT) * 0.5**k - DRIFT
        seen[word] += 1
    return s


def find(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, n_tokens, and of all maximal segments their first tokens, the tokens after their last, and scores; fresh: scores of the segments with repeats halved. All written, as by common.cut()."""
    schema = StructType([df.schema["doc_id"], *StructType.fromDDL("n_tokens bigint, first array<int>, after array<int>, points array<double>, fresh array<double>")])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = lexicon.__getitem__
        for batch in batches:
            sizes, found, fresh = [], [], []
            for text in batch.column("text").to_pylist():
                t = tokens(text)
                sizes.append(len(t))
                s = np.fromiter(map(score, t), float, len(t))
                some = len(t) and s.max() > 0
                found.append(segments(s) if some else [])
                fresh.append([p for *_, p in segments(halved(t, s))] if some else [])
            columns = [pa.array([[x[i] for x in f] for f in found], pa.list_(kind)) for i, kind in enumerate((pa.int32(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *columns, pa.array(fresh, pa.list_(pa.float64()))], names=names)

    return common.kept(df.select("doc_id", "text"), run, schema)


def decay(scores: Counter) -> float:
    """The positive root of E[exp(lambda * score)] = 1 over token scores of clean text; 1 if there is none."""
    x, w = np.array(list(scores), float), np.array(list(scores.values()), float)
    if not len(x) or x.max() <= 0:
        return 1.0
    f = lambda k: float(np.average(np.exp(np.minimum(k * x, 700)), weights=w)) - 1
    if float(np.average(x, weights=w)) >= 0:
        return 1e-3
    low, high = 0.0, 1.0
    while f(high) < 0 and high < 50:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if f(mid) > 0 else (mid, high)
    return max((low + high) / 2, 1e-3)


class Calibration:
    """Gumbel law of a clean text's segments, and the logistic curve from evidence to probability.

    A segment of score s in n tokens is expected rate * n * exp(-shape * s) times in clean text; its evidence is
    minus the logarithm of that where it is below one. A document's evidence is the sum over significant segments.
    """

    def __init__(self, shape: float = 1.0, rate: float = 1.0, a: float = 0.0, b: float = 0.0):
        self.shape, self.rate, self.a, self.b = shape, rate, a, b

    def each(self, n: int, points: list[float]) -> list[float]:
        base = math.log(max(self.rate * n, 1e-12))
        return [max(0.0, self.shape * s - base) for s in points]

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * np.log1p(evidence) + self.b, -40, 40)))


def fit_law(seen: Counter, size: int) -> Calibration:
    """The law from how many segments of each score clean text of so many tokens has.

    Log-odds alone make the decay 1 at least where words are independent and labels right. The highest segments that
    pull it below that are of other text (one of them can flatten the whole law), and are left out.
    """

    def root() -> float:
        return decay(Counter({-DRIFT: max(size - sum(seen.values()), 1)}) + seen)

    seen = Counter(seen)
    while (shape := root()) < 1 and seen:
        del seen[max(seen)]
    shape = min(shape, 2.0)
    # rate: from how many segments clean text has of each score, by the mean of exp(shape * s), which the law makes constant
    rate = sum(n * math.exp(min(shape * s, 50)) for s, n in seen.items()) / len(seen) / max(size, 1) if seen else 0.0
    return Calibration(shape, max(rate, 1.0 / max(size, 1)))


def calibrate(found: DataFrame, known: DataFrame) -> Calibration:
    """Fit the law to clean documents of the calibration fold and the curve to all of it; both need only small histograms."""
    sample = common.kept(found.join(F.broadcast(known), "doc_id").select("n_tokens", "fresh", "y"))
    total = sample.agg(F.sum("n_tokens")).first()[0]
    if not total:
        return Calibration()
    clean = sample.where("y < 0.5")
    size = clean.agg(F.sum("n_tokens")).first()[0] or 0
    seen = Counter({round(float(x["s"]), 1): x["n"] for x in clean.select(F.explode("fresh").alias("p")).groupBy(F.round("p", 1).alias("s")).agg(F.count("*").alias("n")).collect()})
    law = fit_law(seen, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = [sum(law.each(n, p or [])) for n, p in zip(batch.column("n_tokens").to_pylist(), batch.column("fresh").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(np.round(np.log1p(e), 2), 20)), batch.column("y")], names=["e", "y"])

    rows = sample.mapInArrow(run, "e double, y double").groupBy("e").agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect()
    e, n, s = (np.array([x[k] for x in rows], float) for k in ("e", "n", "s"))
    a, b, last = 0.0, math.log((s.sum() + 1) / (n.sum() - s.sum() + 1)), math.inf
    step = np.zeros(2)
    for _ in range(200):  # Newton's method with a slight penalty; a step that makes the fit worse is halved
        u = np.clip(a * e + b, -40, 40)
        loss = float((n * np.logaddexp(0, u) - s * u).sum()) + 0.005 * (a * a + b * b)
        if loss > last + 1e-9:
            step /= 2
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-9:
                break
            continue
        last, p = loss, 1 / (1 + np.exp(-u))
        g = np.array([((s - n * p) * e).sum() - 0.01 * a, (s - n * p).sum() - 0.01 * b])
        w = n * p * (1 - p)
        h = np.array([[(w * e * e).sum() + 0.01, (w * e).sum()], [(w * e).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    law.a, law.b = max(float(a), 1e-6), float(b)
    return law


def scores(df: DataFrame, labels: DataFrame, label: str = "toxic", train_where: str = "true", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_tokens, score (0 to 1), predicted (1 from threshold on), passages (first token, token after the last, points, evidence).

    Passages are whole, each with its evidence taken alone; the score counts a word's repeats less.
    Learns from at most about `sample` labelled rows that train_where (over doc_id) admits; several labels of a
    document are averaged. Of these, those whose crc32 of the id gives 4 modulo 5 calibrate, the others make the
    lexicon; where either part lacks one of the labels, all of them serve both. Null and empty texts have no tokens and no passages. Null and repeated doc_ids and
    repeated rows are kept; an empty table gives no rows; without labels every score is one half. df's other
    columns play no part.
    """
    own = labels.where(train_where).where(f"doc_id is not null and {label} is not null").groupBy("doc_id").agg(F.avg(label).alias("y"))
    n = own.count()
    if n > sample:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    known = common.kept(own.withColumn("held", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 4))
    toxic = F.col("y") >= 0.5
    kinds = known.select("held", toxic.alias("toxic")).distinct().count()
    fold = (lambda held: known.where(F.col("held") == held).drop("held")) if kinds == 4 else (lambda _: known.drop("held"))
    lexicon = Lexicon(learn(df, fold(False)))
    found = find(df, lexicon)
    found = found.coalesce(max(1, -(-found.count() // PARTITION_ROWS)))
    law = calibrate(found, fold(True))
    passage = pa.struct([("first", pa.int32()), ("after", pa.int32()), ("points", pa.float64()), ("evidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, shown = [], []
            for m, first, after, points, fresh in zip(*(batch.column(c).to_pylist() for c in ("n_tokens", "first", "after", "points", "fresh")), strict=True):
                each = law.each(m, points)
                total.append(sum(law.each(m, fresh)))
                shown.append([{"first": a, "after": b, "points": p, "evidence": v} for a, b, p, v in zip(first, after, points, each, strict=True) if v > 0])
            s = law.score(np.array(total))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32)), pa.array(shown, pa.list_(passage))], names=["doc_id", "n_tokens", "score", "predicted", "passages"])

    return found.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, score double, predicted int, passages array<struct<first:int,after:int,points:double,evidence:double>>")
