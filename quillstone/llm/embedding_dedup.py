"""Embedding near-dedup by a subspace pigeonhole join.

Two unit vectors of cosine c lie at squared distance 2 - 2c. A fixed rotation spreads that over all coordinates; these
are split into blocks, and of a pair within the whole budget at least one block lies within its proportional share. So
each block is range-joined by itself: vectors go to cells of a grid over the block's first coordinates (more of them for
larger labels, so that cells stay small), those near a border are guests of the neighbours that come before their own,
and within a cell, pairs whose block distance is in budget are candidates, verified exactly. The union over blocks is
complete, and a pair counts in the first block that admits it, so it counts once.

Equal vectors of one label form a class with one representative. Cells of more than a tile (groups of nearly equal
vectors) are cut into tiles of bounded size; each pair of tiles is a task of its own and returns sums of links and a
spanning forest of them, never the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import common

#: Blocks, width of a cell in block distances, rows of a tile, seed of the rotation, and the slack that rounding needs.
BLOCKS, STRIP, TILE, SEED, SLACK = 8, 3.0, 2000, 3, 1e-9
#: Coordinates that a grid has at most, and how many times fewer vectors each makes of a cell, by which their number is chosen.
GRID, FEWER = 4, 2.4


def rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def _blocks(size: int) -> list[slice]:
    at = np.linspace(0, size, min(BLOCKS, size) + 1).astype(int)
    return [slice(a, b) for a, b in zip(at, at[1:], strict=False)]


def _budget(size: int, cosine: float) -> list[float]:
    """Each block's share of the squared distance, in proportion to its coordinates."""
    return [(2 - 2 * cosine) * (b.stop - b.start) / size + SLACK for b in _blocks(size)]


def _unit(raw: list[bytes], size: int) -> np.ndarray:
    """Unit vectors of the bytes, which are single or double precision."""
    v = np.stack([np.frombuffer(x, np.float32 if len(x) == 4 * size else np.float64).astype(np.float64) for x in raw])
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares of tiny or huge numbers stay in range
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def classes(df: DataFrame) -> DataFrame:
    """vec_id, label, and of vectors that can link their bytes (in single precision where that holds them) and key; equal vectors share a key."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("raw", pa.binary()), ("key", pa.binary()), ("size", pa.int32())])

    def one(label: str | None, v: list[float | None] | None) -> tuple[bytes | None, bytes | None, int | None]:
        if label is None or not v or any(x is None for x in v):
            return None, None, None
        a = np.array(v, np.float64) + 0.0  # one zero
        if not np.isfinite(a).all() or not a.any():
            return None, None, None
        raw = a.tobytes()
        with np.errstate(over="ignore"):
            short = a.astype(np.float32)
        return short.tobytes() if (short == a).all() else raw, hashlib.blake2b(raw + label.encode(), digest_size=16).digest(), len(a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_pylist()
            rows = [one(k, v) for k, v in zip(labels, batch.column("embedding").to_pylist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(labels, pa.string()), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types[2:], strict=True))], schema=schema)

    return df.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding").mapInArrow(run, "vec_id bigint, label string, raw binary, key binary, size int")


def _before(coordinates: int) -> list[np.ndarray]:
    """Steps to the neighbours of a cell that come before it: the first coordinate that differs is smaller."""
    steps = [np.array(x) for x in product((-1, 0, 1), repeat=coordinates)]
    return [x for x in steps if x.any() and x[np.flatnonzero(x)[0]] < 0]


def cells(reps: DataFrame, cosine: float) -> DataFrame:
    """A row for each block of each representative: its cell, and again as a guest of each earlier neighbour cell whose border is near.

    Of a pair within the block's reach, the one in the later cell is a guest of the other's, so they meet once.
    """
    schema = pa.schema([("label", pa.string()), ("size", pa.int32()), ("block", pa.int32()), ("cell", pa.binary()), ("guest", pa.bool_()), ("vec_id", pa.int64()), ("copies", pa.int64()), ("raw", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.to_pandas()
            for (size, grid), rows in t.groupby(["size", "grid"]):
                y, share = _unit(list(rows["raw"]), int(size)) @ rotation(int(size)), _budget(int(size), cosine)
                for b, (cols, budget) in enumerate(zip(_blocks(int(size)), share, strict=True)):
                    reach, used = np.sqrt(budget), y[:, cols][:, : int(grid)]
                    width = STRIP * reach
                    cell = np.floor(used / width).astype("<i4")
                    over = used - cell * width
                    low, high = over <= reach * (1 + SLACK), width - over <= reach * (1 + SLACK)
                    parts = [(False, np.arange(len(rows)), cell)]
                    for step in _before(used.shape[1]):
                        near = np.flatnonzero((low | (step >= 0)).all(axis=1) & (high | (step <= 0)).all(axis=1))
                        parts.append((True, near, cell[near] + step.astype("<i4")))
                    for guest, which, at in parts:
                        some = rows.iloc[which]
                        placed = some[["label", "size", "vec_id", "copies", "raw"]].assign(block=b, cell=[x.tobytes() for x in at], guest=guest)
                        yield pa.RecordBatch.from_pandas(placed[schema.names], schema=schema, preserve_index=False)

    return reps.mapInArrow(run, "label string, size int, block int, cell binary, guest boolean, vec_id bigint, copies bigint, raw binary")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Which of the links form a spanning forest."""
    up = list(range(n))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    kept = []
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        i, j = top(i), top(j)
        if i != j:
            up[i] = j
            kept.append(k)
    return kept


def compare(t: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links within one pair of tiles: (1, vec_id, links counted with copies) and (0, vec_id, vec_id) of a spanning forest."""
    block, size, same = int(t["block"].iloc[0]), int(t["size"].iloc[0]), bool((t["i"] == t["j"]).all())
    cols, share, turn = _blocks(size), _budget(size, cosine), rotation(size)
    left = t[t["side"] == 0]
    right = left if same and not (t["side"] == 1).any() else t[t["side"] == 1]
    if not len(left) or not len(right):
        return pd.DataFrame({"kind": [], "a": [], "b": []})
    u, v = _unit(list(left["raw"]), size), _unit(list(right["raw"]), size)
    yu, yv = u @ turn, v @ turn
    cu, cv = yu[:, cols[block]], yv[:, cols[block]]
    limit = share[block] + 1e-6
    nu, nv = (cu * cu).sum(axis=1), (cv * cv).sum(axis=1)
    idu, idv = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
    copies_u, copies_v = left["copies"].to_numpy(), right["copies"].to_numpy()
    count_u, count_v, ends = np.zeros(len(u), np.int64), np.zeros(len(v), np.int64), []
    for at in range(0, len(u), 256):
        near = nu[at : at + 256, None] + nv[None, :] - 2 * (cu[at : at + 256] @ cv.T) <= limit
        if right is left:
            near &= np.arange(len(v))[None, :] > np.arange(at, min(at + 256, len(u)))[:, None]
        i, j = np.nonzero(near)
        i += at
        for k in range(0, len(i), 100_000):  # verified in pieces, so that a dense cell needs no more memory
            p, q = i[k : k + 100_000], j[k : k + 100_000]
            linked = np.einsum("ij,ij->i", u[p], v[q]) >= cosine
            p, q = p[linked], q[linked]
            first = np.ones(len(p), bool)
            for b in range(block):  # an earlier block that admits the pair has counted it
                d = yu[p][:, cols[b]] - yv[q][:, cols[b]]
                first &= (d * d).sum(axis=1) > share[b]
            d = yu[p][:, cols[block]] - yv[q][:, cols[block]]
            first &= (d * d).sum(axis=1) <= share[block]
            p, q = p[first], q[first]
            np.add.at(count_u, p, copies_v[q])
            np.add.at(count_v, q, copies_u[p])
            if len(p):
                ids, flat = np.unique(np.concatenate([idu[p], idv[q]]), return_inverse=True)
                kept = _forest(len(ids), flat[: len(p)], flat[len(p) :])
                ends.append(np.stack([idu[p[kept]], idv[q[kept]]]))
    has_u, has_v = np.flatnonzero(count_u), np.flatnonzero(count_v)
    pairs = np.concatenate(ends, axis=1) if ends else np.empty((2, 0), np.int64)
    a = np.concatenate([idu[has_u], idv[has_v], pairs[0]])
    b = np.concatenate([count_u[has_u], count_v[has_v], pairs[1]])
    return pd.DataFrame({"kind": np.repeat([1, 0], [len(has_u) + len(has_v), pairs.shape[1]]), "a": a, "b": b})


def dedup(df: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row per row of df.

    Rows of equal, non-null label link where the cosine of their vectors, in double precision, reaches the
    threshold. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
    neither do vectors of different lengths. n_links counts the other rows linked directly, copies included;
    component_id is the smallest vec_id reachable. Rows of one vec_id count as rows, but share a component. Rows
    of null vec_id link with nothing. An empty table gives no rows; other columns play no part.
    """
    spark = df.sparkSession
    rows = common.cut(classes(df))
    own = rows.where("key is not null and vec_id is not null")
    groups = common.cut(own.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    reps = own.join(groups, (own["key"] == groups["key"]) & (own["vec_id"] == groups["rep"])).select("vec_id", "label", "size", "raw", "copies", own["key"].alias("key")).dropDuplicates(["key"])
    # representatives are numbered by class: one vec_id may stand for several
    reps = common.cut(reps.withColumn("node", F.monotonically_increasing_id()))
    groups = common.cut(reps.groupBy("label", "size").agg(F.count("*").alias("n")))
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    grid = F.least(F.greatest(F.ceil(F.log(F.col("n") / TILE) / np.log(FEWER)), F.lit(1)), F.lit(GRID)).cast("int").alias("grid")
    sized = common.join_spread(reps, groups, ["label", "size"], "n", total, ["node"])
    placed = common.cut(cells(sized.select(F.col("node").alias("vec_id"), "label", "size", "raw", "copies", grid), cosine))
    place = ["label", "size", "block", "cell"]
    dealt = placed.groupBy(*place).agg(F.ceil(F.count_if(~F.col("guest")) / TILE).cast("int").alias("homes"), F.ceil(F.count_if(F.col("guest")) / TILE).cast("int").alias("guests"), F.count("*").alias("n")).where("homes > 0")
    dealt = common.cut(dealt)
    tiled = common.join_spread(placed, dealt, place, "n", placed.count(), ["vec_id"])
    tile = lambda n: F.pmod(F.xxhash64("vec_id"), F.greatest(F.col(n), F.lit(1))).cast("int")
    home = tiled.where("not guest").withColumn("t", tile("homes"))
    # tile pairs: of homes with themselves (i = j), with later homes (i < j), and with guests (numbered after the homes)
    as_left = home.withColumn("j", F.explode(F.sequence("t", F.col("homes") + F.col("guests") - 1))).withColumn("i", F.col("t")).withColumn("side", F.lit(0))
    as_right = home.where("t > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("t") - 1))).withColumn("j", F.col("t")).withColumn("side", F.lit(1))
    visit = tiled.where("guest").withColumn("j", F.col("homes") + tile("guests")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("homes") - 1))).withColumn("side", F.lit(1))
    columns = [*place, "i", "j", "side", "vec_id", "copies", "raw"]
    units = as_left.select(columns).unionByName(as_right.select(columns)).unionByName(visit.select(columns))
    found = common.cut(units.groupBy(*place, "i", "j").applyInPandas(lambda t: compare(t, cosine), "kind int, a bigint, b bigint"))
    counts = found.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n"))
    linked = common.cut(reps.select("node", "key", "vec_id", "copies").join(counts, F.col("node") == F.col("a"), "left").select("node", "key", "vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    ends = found.where("kind = 0").select("a", "b")
    name = lambda c, to: linked.select(F.col("node").alias(c), F.col("vec_id").alias(to))
    edges = ends.join(name("a", "x"), "a").join(name("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = own.select("vec_id", "key").join(linked.select("key", F.col("vec_id").alias("rep")), "key").where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    part = common.cut(common.components(edges.unionByName(same)))
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(linked.select("key", "n_links"), "key", "left")
    out = out.join(part, out["vec_id"] == part["node"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
