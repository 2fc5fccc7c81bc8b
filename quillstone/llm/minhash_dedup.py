"""MinHash near-dedup: banded candidates, odd sketches to judge them, links confirmed on full shingle sets.

An odd sketch is a bitmap in which each MinHash sample of a document flips one bit. The XOR of two sketches has a
bit set for samples in which the documents differ, so its population count estimates high similarities precisely
in a few bytes; a candidate pair is looked at in full only if that estimate leaves a link possible. For two short sets,
the same bitmap over all shingles gives a bound instead: its XOR has at most as many bits as the sets have differences,
so that no linked pair is lost there.

Documents with one and the same shingle set form a class with one representative. In each band's bucket, members
are compared with a few centres first; only members whose components still differ after that are compared with each
other. A large group of near copies thus costs a few comparisons per member, not all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm import common

#: Bands and rows of each: a pair at similarity 0.8 shares no band with probability 5e-8. Bits of the odd sketch. Seed.
BANDS, ROWS, BITS, SEED = 32, 4, 512, 11
SAMPLES = BANDS * ROWS
#: A pair is dropped unseen only where its estimate is this far below the threshold: at similarity 0.8 some 2e-8 of the pairs.
MARGIN = 0.25
#: Bits of the parity bitmap of a whole set, kept for sets up to SHORT shingles. It rules pairs out without any error.
PARITY, SHORT = 2048, 3000
#: Centres of each bucket, how many of all its centres a member is compared with first; members of a tile of a bucket; members that meet a centre in one group; rows of one number each whose broadcast is always small; bytes of other rows that are broadcast.
CENTRES, FIRST, MEMBERS, GROUP, SMALL, LIGHT = 3, 4, 512, 64, 200_000, 32_000_000

_rng = np.random.default_rng(SEED)
_A = (_rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_B = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)[:, None]
_M1, _M2, _M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; with fewer words the whole sequence is one; no words, none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(len(h) - k + 1, 1)
    out = np.full(n, len(h) if len(h) < k else k, np.uint64)
    for i in range(min(k, len(h))):
        out = _mix(out * _M3 + h[i : i + n])
    return np.unique(out)


def samples(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over the set."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(least, (_A * x[i : i + 4096] + _B).min(axis=1), out=least)
    return least


_LANE = np.arange(SAMPLES, dtype=np.uint64)


def signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and the odd sketch's 64-bit words."""
    own = _mix(samples(hashes).astype(np.uint64) + (_LANE + np.uint64(1)) * _M3)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        keys = _mix(keys * _M3 + own[i::ROWS])
    bits = np.bincount((own % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return keys.view(np.int64), np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def parity(hashes: np.ndarray) -> np.ndarray | None:
    """The parity bitmap of a whole set as 64-bit words; none for long sets, which would fill it."""
    if not 0 < len(hashes) <= SHORT:
        return None
    bits = np.bincount((_mix(hashes) % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def set_key(hashes: np.ndarray) -> bytes | None:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def signatures(df: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, key (of the whole set), bands, sketch, parity."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.give_back()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                s = shingles(text, k)
                rows.append((doc, len(s), set_key(s), *(signature(s) if len(s) else (None, None)), parity(s)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, key binary, bands array<bigint>, sketch array<bigint>, parity array<bigint>")


def confirm(pairs: DataFrame, docs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes whose full sets reach the similarity. Each b's set meets its partners' one by one, in groups of bounded size."""
    dealt = pairs.groupBy("b").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / GROUP).cast("int")).drop("n")
    dealt = dealt.select(common.apart("b").alias("b"), "salts")
    member = pairs.join(dealt, "b").select(F.col("a").alias("node"), F.struct(F.col("b").alias("centre"), F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role")).alias("to"))
    centre = dealt.select(F.col("b").alias("node"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "b").select("node", F.struct(F.col("b").alias("centre"), "salt", F.lit(0).alias("role")).alias("to"))
    sent = member.unionByName(centre)
    # where a node goes, in lists of bounded length
    lists = sent.groupBy("node").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("lists")).select(common.apart("node").alias("node"), "lists")
    tasks = sent.join(lists, "node").groupBy("node", F.pmod(F.xxhash64("to"), F.col("lists")).alias("list")).agg(F.collect_list("to").alias("to"))
    tasks = common.cut(tasks.join(reps.select("node", "doc_id", "key"), "node").drop("list"))
    held = tasks.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("to")), F.lit(0)).alias("places")).first()
    if held["rows"] * 128 + held["places"] * 48 <= LIGHT:
        tasks = F.broadcast(tasks)
    schema = pa.schema([("centre", pa.int64()), ("salt", pa.int32()), ("role", pa.int32()), ("member", pa.int64()), ("hashes", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size, last = [], 0, (None, None, b"")
            for node, text, key, to in zip(*(batch.column(c).to_pylist() for c in ("node", "text", "key", "to")), strict=True):
                if last[:2] != (node, text):
                    s = shingles(text, k)
                    last = node, text, s.tobytes() if set_key(s) == key else None  # none: another row of this doc_id
                raw = last[2]
                for x in to if raw is not None else ():
                    rows.append((x["centre"], x["salt"], x["role"], node, raw))
                    size += len(raw)
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    sent = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(tasks, "doc_id").mapInArrow(send, "centre bigint, salt int, role int, member bigint, hashes binary")
    met = sent.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "role", "member")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for c, salt, role, m, raw in zip(*(batch.column(x) for x in schema.names), strict=True):
                c, m, s = c.as_py(), m.as_py(), np.frombuffer(raw.as_buffer(), np.uint64)
                if role.as_py() == 0:
                    at, own = (c, salt.as_py()), s.copy()
                elif at == (c, salt.as_py()):
                    low, high = sorted((len(own), len(s)))
                    if 100 * low >= percent * high:
                        both = len(own) + len(s) - len(np.union1d(own, s))
                        if 100 * both >= percent * (len(own) + len(s) - both):
                            found.append((m, c))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return met.mapInArrow(meet, "a bigint, b bigint")


def _ones(a: str, b: str, bits: int) -> Column:
    """Bits in which two bitmaps differ."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(bits // 64)), F.lit(0))


def _possible(percent: int) -> Column:
    """Whether the sketches of two documents (sa, pa, na and sb, pb, nb) leave a link possible: surely, where both sets are short, else by the estimate."""
    most = 2 * SAMPLES * (1 - (percent / 100 - MARGIN))  # flipped bits in expectation at the margin
    likely = _ones("sa", "sb", BITS) <= BITS / 2 * (1 - np.exp(-2 * most / BITS))
    # 100 * shared >= percent * all means at most this many differences
    fits = _ones("pa", "pb", PARITY) * F.lit(100 + percent) <= (F.col("na") + F.col("nb")) * F.lit(100 - percent)
    return F.coalesce(fits, likely)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def links(docs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between nodes, one for each representative, that connect every pair of similar ones, directly or through others."""
    every = reps.select(F.explode("bands").alias("bucket"), "node")
    sizes = every.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select(common.apart("bucket").alias("bucket"), "n")
    shared = common.cut(every.join(sizes, "bucket"))
    # who shares its buckets with most others is closest to the middle of its group, and links with most of it
    degree = shared.groupBy("node").agg(F.sum("n").alias("degree")).select(common.apart("node").alias("node"), "degree")
    known = common.cut(shared.join(degree, "node"))
    middle = F.struct("degree", "node")
    order = lambda i: F.xxhash64(F.lit(i), "node")
    centres = known.groupBy("bucket").agg(F.max(middle).alias("m"), *(F.min_by(middle, order(i)).alias(f"c{i}") for i in range(CENTRES - 1)))
    centres = centres.select(common.apart("bucket").alias("bucket"), F.array_distinct(F.array("m", *(f"c{i}" for i in range(CENTRES - 1)))).alias("centres"))
    buckets = common.cut(known.join(centres, "bucket").select("bucket", "n", "node", "centres"))
    one = lambda c: reps.select(F.col("node").alias(c), F.col("sketch").alias(f"s{c}"), F.col("parity").alias(f"p{c}"), F.col("n_shingles").alias(f"n{c}"))
    # of all centres of its buckets, a member meets the few in the middle, so these are mostly the same for a whole group
    pairs = buckets.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_set("centres"))).alias("c"))
    others = F.filter("c", lambda x: x["node"] != F.col("node"))
    pairs = _ordered(pairs.select(F.col("node").alias("a"), F.explode(F.slice(F.sort_array(others, asc=False), 1, FIRST)).alias("x")).select("a", F.col("x.node").alias("b")))
    first = common.cut(pairs.join(one("a"), "a").join(one("b"), "b").where(_possible(percent)).select("a", "b"))
    found = common.cut(confirm(first, docs, reps, k, percent))
    # what is left: members of one bucket whose components differ, in tiles of the bucket
    part = common.components(found).withColumnRenamed("node", "member")
    state = buckets.join(part, buckets["node"] == part["member"], "left").select("bucket", "n", "node", F.coalesce("component", "node").alias("component"))
    mixed = state.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select(common.apart("bucket").alias("bucket"))
    state = common.cut(state.join(mixed, "bucket").join(reps.select("node", "sketch", "bands", "parity", "n_shingles"), "node").withColumn("salts", F.ceil(F.col("n") / MEMBERS).cast("int")))
    left = state.select("bucket", F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt"), F.col("node").alias("a"), F.col("component").alias("ca"), F.col("sketch").alias("sa"), F.col("bands").alias("ba"), F.col("parity").alias("pa"), F.col("n_shingles").alias("na"))
    right = state.select("bucket", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("node").alias("b"), F.col("component").alias("cb"), F.col("sketch").alias("sb"), F.col("bands").alias("bb"), F.col("parity").alias("pb"), F.col("n_shingles").alias("nb"))
    # a pair counts in the first bucket that its members share
    here = F.element_at(F.filter(F.zip_with("ba", "bb", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull()), 1) == F.col("bucket")
    rest = left.join(right, ["bucket", "salt"]).where((F.col("a") > F.col("b")) & (F.col("ca") != F.col("cb")) & _possible(percent) & here).select("a", "b")
    rest = common.cut(rest.join(first, ["a", "b"], "left_anti"))
    return found if rest.isEmpty() else found.unionByName(confirm(rest, docs, reps, k, percent))


def dedup(df: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row per row of df.

    Documents are linked if 100 * intersection >= percent * union of their sets of k-word shingles (fewer words:
    the whole sequence is the one shingle). component_id is the smallest doc_id reachable by links, and a document
    is kept if it is its own. Null and empty texts have no shingles and link with nothing; neither do rows of null
    doc_id, which get a null component_id and aren't kept. Rows of one doc_id share its component. An empty table
    gives no rows. Columns other than doc_id and text play no part.
    """
    sigs = common.cut(signatures(df, k))
    linked = sigs.where("key is not null and doc_id is not null")
    classes = common.cut(linked.groupBy("key").agg(F.min("doc_id").alias("rep")))
    reps = linked.join(classes, (linked["key"] == classes["key"]) & (linked["doc_id"] == classes["rep"]), "left_semi").dropDuplicates(["doc_id", "key"])
    # a doc_id of several texts may represent several classes, so representatives have numbers of their own
    reps = common.cut(reps.select(F.monotonically_increasing_id().alias("node"), "doc_id", "n_shingles", "key", "bands", "sketch", "parity"))
    same = linked.join(classes, "key").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    name = lambda c: reps.select(F.col("node").alias(c), F.col("doc_id").alias(f"{c}_id"))
    found = links(df, reps, k, percent).join(name("a"), "a").join(name("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    edges = found.unionByName(same)
    part = common.components(edges)
    out = sigs.join(part, sigs["doc_id"] == part["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
