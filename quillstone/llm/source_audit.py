"""Source divergence audit: how far the term frequencies of a language's sources lie apart, and which terms tell a source.

Counts by language, source and term are summed in the tasks, then by one shuffle on language and term. What is left are
dense matrices: a tile holds the counts of two blocks of sources over a block of terms, as a numpy int64 matrix source by
term, and all its pairs are reckoned by broadcasting, a few columns at a time. Tiles give partial pair matrices, which are
summed, and for each source the best terms of the block, which are merged into the best of all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401, pa.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm import common

#: Documents of its language that a term must be in, what shares are in units of, and the terms listed for a source.
LEAST_DOCS, UNIT, TOP = 10, 1_000_000_000, 10
#: Terms and sources of a block, on average; pairs of sources times terms that are reckoned at a time.
TERMS, SOURCES, CELLS = 4096, 256, 1 << 20
#: Bytes of a text that are split at a time, and entries that a task's counters hold before they are passed on.
PART, ENTRIES = 1 << 20, 600_000
#: Languages up to so many are broadcast (a row of numbers each).
LANGS = 100_000

_letter = [x if 0x61 <= x <= 0x7A or x >= 0x80 else x + 32 if 0x41 <= x <= 0x5A else 0x20 for x in range(256)]
#: Bytes of a term as they are or lower-cased, others as spaces; in UTF-8 this needs no look at whole characters.
FOLD = bytes(_letter)


def terms(raw: bytes) -> Iterator[list[bytes]]:
    """Lists of a text's terms, a part of the text at a time."""
    if len(raw) <= PART:
        yield raw.translate(FOLD).split()
        return
    open_: list[bytes] = []  # parts since the last space
    for i in range(0, len(raw), PART):
        part = raw[i : i + PART].translate(FOLD)
        at = part.rfind(b" ") + 1
        if at:
            yield b"".join([*open_, part[:at]]).split()
            open_ = []
        open_.append(part[at:])
    yield b"".join(open_).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs over the task's rows; the same key may come again."""
    groups: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            keys = list(n)
            for i in range(0, len(keys), 50_000):
                some = keys[i : i + 50_000]
                head = [pa.array([x], pa.binary()).take(pa.array(np.zeros(len(some), np.int32))) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*head, pa.array(some, pa.binary()), pa.array([n[x] for x in some], pa.int64()), pa.array([docs[x] for x in some], pa.int64())], ["lang", "source", "term", "n", "docs"])
        groups.clear()

    for batch in batches:
        for lang, source, raw in zip(*(batch.column(x).to_pylist() for x in ("lang", "source", "raw")), strict=True):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(n), None
            for words in terms(raw):
                n.update(words)
                seen = set(words) if seen is None else seen | set(words) if len(words) > len(seen) else seen.union(words)
            docs.update(seen or ())
            held += len(n) - before
            if held >= ENTRIES:
                yield from flush()
                held = 0
    yield from flush()


def counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term (binary), n, total, first: counts of the terms that are in enough documents of their language; first marks one row of each (lang, term).

    Grouped by (lang, term) from the start, so sums by source and by language take one exchange; rows of a key are one for
    each task and source at most, as tasks have summed theirs.
    """
    raw = docs.select(*(F.coalesce(F.col(x).cast("string"), F.lit("")).cast("binary").alias(y) for x, y in (("lang", "lang"), ("source", "source"), ("text", "raw"))))
    each = raw.mapInArrow(_count, "lang binary, source binary, term binary, n bigint, docs bigint").repartition("lang", "term")
    by_source = each.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    there = by_source.withColumns({"total": F.sum("n").over(w), "all_docs": F.sum("docs").over(w), "least": F.min("source").over(w)})
    return there.where(F.col("all_docs") >= least_docs).select("lang", "source", "term", "n", "total", (F.col("least") == F.col("source")).alias("first"))


def shares(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (n + 2) / whole) by long division in base 1000, in 64 bits for wholes up to 9e15."""
    rest, out = n + 2, np.zeros_like(n + whole)
    for _ in range(3):
        rest = rest * 1000
        digit = rest // whole
        rest, out = rest - digit * whole, out * 1000 + digit
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


_TILE = "lang binary, source binary, part string, item binary, value bigint"


def _tile(top: int):
    """For applyInArrow: the pairs' partial sums and, where a block meets itself, its sources' best terms."""

    def run(table: pa.Table) -> pa.Table:
        heads = table.filter(pa.compute.is_null(table["term"]))
        names = heads["source"].to_pylist()
        lang, one, other = (heads[x][0].as_py() for x in ("lang", "one", "other"))
        whole, block = heads["whole"].to_numpy(), heads["block"].to_numpy()
        columns, lang_whole = heads["columns"][0].as_py(), heads["lang_whole"][0].as_py()
        cells = table.filter(pa.compute.is_valid(table["term"]))
        words = sorted(set(cells["term"].to_pylist()))
        at, row = {x: i for i, x in enumerate(words)}, {x: i for i, x in enumerate(names)}
        n = np.zeros((len(names), len(words) + 1), np.int64)  # the last column stands for all terms that none of these sources has
        r, c = np.array([row[x] for x in cells["source"].to_pylist()], int), np.array([at[x] for x in cells["term"].to_pylist()], int)
        n[r, c] = cells["n"].to_numpy()
        p = shares(n, whole[:, None])
        a, b = np.flatnonzero(block == one), np.flatnonzero(block == other)
        sums = apart(p[a, None, -1], p[None, b, -1]) * (columns - len(words))
        step = max(1, CELLS // max(1, len(a) * len(b)))
        for k in range(0, len(words), step):
            sums += apart(p[a, None, k : min(k + step, len(words))], p[None, b, k : min(k + step, len(words))]).sum(axis=2)
        out = []
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                if x != y:
                    out.append((names[x], "pair", names[y], int(sums[i, j])))
                    if one != other:
                        out.append((names[y], "pair", names[x], int(sums[i, j])))
        if one == other and words:
            total = np.zeros(len(words), np.int64)
            total[c] = cells["total"].to_numpy()
            q = shares(total, np.int64(lang_whole))
            for x in a:
                more = np.flatnonzero((n[x, :-1] > 0) & (p[x, :-1] > q))
                f = apart(p[x, more], q[more])
                best = np.argsort(-f, kind="stable")[:top]  # words are sorted, so equal values stay in their order
                out += [(names[x], "term", words[more[k]], int(f[k])) for k in best]
        source, part, item, value = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table([pa.array([lang] * len(out), pa.binary()), pa.array(source, pa.binary()), pa.array(part, pa.string()), pa.array(item, pa.binary()), pa.array(value, pa.int64())], ["lang", "source", "part", "item", "value"])

    return run


def tiles(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Partial pair sums and each block's best terms, one row a tile and pair or term: lang, source, part, item, value; written."""
    kept = common.kept(counts(docs, least_docs))
    groups = docs.select(*(F.coalesce(F.col(x).cast("string"), F.lit("")).cast("binary").alias(x) for x in ("lang", "source"))).distinct()
    size = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = common.kept(groups.join(size, ["lang", "source"], "left").withColumn("size", F.coalesce("size", F.lit(0).cast("bigint"))))
    v = kept.where("first").groupBy("lang").agg(F.count("*").alias("v"))
    langs = groups.groupBy("lang").agg(F.sum("size").alias("lang_size"), F.count("*").alias("s")).join(v, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0).cast("bigint")))
    blocks = {"term_blocks": F.greatest(F.ceil(F.col("v") / TERMS), F.lit(1)).cast("bigint"), "source_blocks": F.ceil(F.col("s") / SOURCES).cast("bigint"), "lang_whole": F.col("lang_size") + 2 * F.col("v")}
    langs = common.kept(langs.withColumns(blocks).drop("lang_size", "s"))
    if langs.count() <= LANGS:
        langs = F.broadcast(langs)

    def paired(df: DataFrame) -> DataFrame:
        """Each row once for every tile that its source's block takes part in."""
        df = df.withColumn("block", F.pmod(F.xxhash64("source"), F.col("source_blocks"))).withColumn("met", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("source_blocks") - 1)))
        return df.withColumns({"one": F.least("block", "met"), "other": F.greatest("block", "met")})

    where = F.pmod(F.xxhash64("term"), F.col("term_blocks")).alias("term_block")
    columns = kept.where("first").join(langs.select("lang", "term_blocks"), "lang").groupBy("lang", where).agg(F.count("*").alias("columns"))
    heads = groups.join(langs, "lang").withColumn("term_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("term_blocks") - 1))).join(columns, ["lang", "term_block"], "left")
    heads = paired(heads).select("lang", "term_block", "one", "other", "block", "source", F.greatest(F.col("size") + 2 * F.col("v"), F.lit(1)).alias("whole"), F.greatest("lang_whole", F.lit(1)).alias("lang_whole"), F.coalesce("columns", F.lit(0)).alias("columns"), F.lit(None).cast("binary").alias("term"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("total"))
    none = [F.lit(0).cast("bigint").alias(x) for x in ("whole", "lang_whole", "columns")]
    cells = paired(kept.join(langs, "lang").withColumn("term_block", where)).select("lang", "term_block", "one", "other", "block", "source", *none, "term", "n", "total")
    return common.kept(heads.unionByName(cells).groupBy("lang", "term_block", "one", "other").applyInArrow(_tile(top), _TILE))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language its distance to every other one, and the terms it has more of than the language.

    Null text, lang and source count as empty. A term is a run of letters A-Z (lower-cased), a-z and characters beyond
    ASCII; a language keeps those that at least `least_docs` of its rows have, however often they repeat. With count n of
    a source (or of the language), N the sum of n over the V kept terms, a term's share is p = 1 + floor(1e9 * (n + 2) /
    (N + 2 V)), and two shares are f = floor((p - q)^2 / (p + q)) apart, in whole numbers throughout, for N + 2 V up to
    9e15. Part `pair`: item is another source and value the sum of f over all kept terms, 0 without any; every pair is
    given, ranked from the farthest. Part `term`: item is a term with n > 0 and p > q, q the language's, value f, ranks
    up to `top`. Equal values rank by item as UTF-8. A language of one source has no pair; an empty table gives no rows.
    Other columns are ignored; repeated rows count each.
    """
    found = tiles(docs, least_docs, top)
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    w = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    best = found.where("part = 'term'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    ranked = pairs.withColumn("rank", F.row_number().over(w)).unionByName(best)
    return ranked.select(*(F.col(x).cast("string").alias(x) for x in ("lang", "source")), "part", F.col("item").cast("string").alias("item"), "value", "rank")
