"""Best-fit packing by a configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits in one sequence; the program asks for the fewest that cover every
length's count. Multiplicative weights solve it approximately: a knapsack dynamic program prices all configurations near
the best at once, they are used together, and the lengths that they cover become cheaper. What they have used is then
polished: the program over those configurations is solved by pivots from a greedy cover on, and the same knapsack prices
what is still missing at the basis's duals. (Weights alone end about one per cent above the bound, or cover some lengths
not at all, the README has the figures; polished, the result is within a hundredth of one per cent.) The fractional
solution, a whole cover, is rounded, and so again for what remains; what rounding leaves goes best-fit, longest first. Only the histogram (one count per length)
and the number of pieces in each input partition reach the driver, and what goes back is a table whose size doesn't depend on the documents: where the pieces of a length go,
by their rank in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm import common
from quillstone.llm.tokens import encoder

#: Pivots after which the program stops short of its optimum (what it has is a whole cover all the same), the share (or half a sequence) above the bound at which it ends, columns taken of one pricing, pivots between fresh inverses, and how often the remainder is solved again.
PIVOTS, GAP, COLUMNS, FRESH, ROUNDS = 4000, 1e-4, 32, 1000, 4
#: Phases of the weights, how much a phase lowers the price of what it covers most, how near to the best a configuration must come to be used, and histograms of fewer lengths than which are left to pivots alone.
PHASES, RATE, NEAR, FEW = 30, 0.01, 0.004, 8


def _knapsack(values: np.ndarray, lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to the given one, the value of the best configuration and the length it takes there (-1: none, go one down)."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    order = np.argsort(lengths)
    sizes, worth = lengths[order], values[order]
    fits = np.searchsorted(sizes, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            gain = best[c - sizes[:k]] + worth[:k]
            j = int(gain.argmax())
            if gain[j] > best[c]:
                best[c], took[c] = gain[j], order[j]
    return best, took


def _trace(took: np.ndarray, lengths: np.ndarray, c: int) -> np.ndarray:
    """Copies of each length in the best configuration of room c."""
    copies = np.zeros(len(lengths), np.int64)
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            copies[took[c]] += 1
            c -= lengths[took[c]]
    return copies


def price(values: np.ndarray, lengths: np.ndarray, room: int) -> np.ndarray:
    """The most valuable configuration (copies of each length) that fits: an unbounded knapsack by dynamic programming."""
    return _trace(_knapsack(values, lengths, room)[1], lengths, room)


def _first_cover(lengths: np.ndarray, counts: np.ndarray, room: int) -> np.ndarray:
    """One configuration a length, as columns of a triangular matrix: longest first, each is used until one of its lengths is used up."""
    left, alive, columns = counts.astype(float), [int(i) for i in np.argsort(lengths)], []
    while alive:
        copies, gap = np.zeros(len(lengths), np.int64), room
        for i in reversed(alive):
            copies[i], gap = gap // lengths[i], gap % lengths[i]
        has = np.flatnonzero(copies)
        out = has[(left[has] / copies[has]).argmin()]
        left = np.maximum(left - left[out] / copies[out] * copies, 0.0)
        alive.remove(int(out))
        columns.append(copies)
    return np.array(columns).T


def _swap(inverse: np.ndarray, move: np.ndarray, out: int) -> np.ndarray:
    """Change the inverse as its basis takes a column, which is `move` in terms of the basis, for column `out`; returns the new row."""
    row = inverse[out] / move[out]
    rest = move.copy()
    rest[out] = 0.0
    at, along = np.flatnonzero(np.abs(rest) > 1e-13), np.flatnonzero(np.abs(row) > 1e-13)
    inverse[np.ix_(at, along)] -= rest[at, None] * row[along]
    inverse[out] = row
    return row


def _inverse(basis: np.ndarray) -> np.ndarray | None:
    """The inverse of a matrix with few entries a column, column by column from the identity's on; none if it is singular.

    It stays sparse for long, and no library routine of several threads is called, which may wait forever in a
    process that has forked.
    """
    inverse, column_of, free = np.eye(len(basis)), np.full(len(basis), -1), np.ones(len(basis), bool)
    for k in np.argsort((basis != 0).sum(axis=0), kind="stable"):
        has = np.flatnonzero(basis[:, k])
        move = (inverse[:, has] * basis[has, k]).sum(axis=1)
        out = int(np.where(free, np.abs(move), -1.0).argmax())
        if abs(move[out]) < 1e-9:
            return None
        _swap(inverse, move, out)
        column_of[out], free[out] = k, False
    return inverse[np.argsort(column_of)]


def weighted(lengths: np.ndarray, counts: np.ndarray, room: int, phases: int = PHASES) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Multiplicative weights: the configurations that the phases used, how often in all (in units of a phase), and the best lower bound that the prices gave.

    Prices begin as the lengths' shares of the room. In a phase every length's best configuration that comes near the
    best of all is used, each as often as its scarcest length allows, all scaled so that what is covered most is covered
    once; then each price falls by how far its length was covered.
    """
    demand, prices, bound = counts.astype(float), lengths / room, float(lengths @ counts) / room
    kinds: dict[bytes, list] = {}
    for _ in range(phases):
        best, took = _knapsack(prices, lengths, room)
        bound = max(bound, float(prices @ demand) / best[room])
        worth, covered, seen = prices + best[room - lengths], np.zeros(len(lengths)), set()
        for i in np.flatnonzero(worth >= (1 - NEAR) * best[room]):
            copies = _trace(took, lengths, room - lengths[i])
            copies[i] += 1
            has = np.flatnonzero(copies)
            kind = np.stack([has, copies[has]]).astype(np.int32)  # small, as there are some ten thousand
            if (key := kind.tobytes()) in seen:
                continue
            seen.add(key)
            use = float((demand[has] / copies[has]).min())
            covered[has] += use * copies[has] / demand[has]
            kinds.setdefault(key, [kind, 0.0])[1] += use
        prices = prices / best[room] * np.exp(-RATE * covered / covered.max())
    return [x[0] for x in kinds.values()], np.array([x[1] for x in kinds.values()]), bound


def solve(lengths: np.ndarray, counts: np.ndarray, room: int, pivots: int = PIVOTS) -> tuple[list[np.ndarray], np.ndarray, float]:
    """A fractional solution of the configuration program that covers every count exactly: configurations, how often each is used, and a lower bound on any packing.

    Multiplicative weights give the first configurations, over which the program is solved; then columns are generated:
    the knapsack prices configurations at the duals of the basis, and the dual value over the best price is the bound.
    The solution has at most one configuration for each length.
    """
    basis, demand = _first_cover(lengths, counts, room), counts.astype(float)
    inverse = _inverse(basis)
    x, duals = np.maximum((inverse * demand).sum(axis=1), 0.0), inverse.sum(axis=0)
    sound = (basis.copy(), x.copy())
    off = lambda columns, times: bool(np.abs((columns * times).sum(axis=1) - demand).max() > 1e-6 * demand.max())
    bound, done, stale, before = float(lengths @ demand) / room, 0, 0, -1

    def enter(has: np.ndarray, copies: np.ndarray) -> bool:
        """Take a configuration into the basis if that gains."""
        nonlocal x, duals, done, stale
        gain = float(duals[has] @ copies) - 1
        if gain <= 1e-9:
            return False
        move = (inverse[:, has] * copies).sum(axis=1)
        can = np.flatnonzero(move > 1e-7)
        if not len(can):
            return False
        ratio = x[can] / move[can]
        can = can[ratio <= ratio.min() + 1e-9]
        out = can[move[can].argmax()]  # of equal ones the largest pivot, which keeps the basis far from singular
        step = x[out] / move[out]
        x = np.maximum(x - step * move, 0.0)
        x[out] = step
        duals = duals - gain * _swap(inverse, move, out)
        basis[:, out] = 0
        basis[has, out] = copies
        done, stale = done + 1, stale + 1
        return True

    def refresh() -> bool:
        """A fresh inverse; False where the basis has become singular."""
        nonlocal inverse, x, duals, sound, stale
        fresh, stale = _inverse(basis), 0
        if fresh is None:
            return False
        inverse = fresh
        x, duals = np.maximum((inverse * demand).sum(axis=1), 0.0), inverse.sum(axis=0)
        sound = sound if off(basis, x) or x.sum() > sound[1].sum() else (basis.copy(), x.copy())
        return True

    regular, near = True, lambda: x.sum() <= max(bound * (1 + GAP), bound + 0.5)
    if len(lengths) >= FEW:
        kinds, _, least = weighted(lengths, counts, room)
        bound = max(bound, least)
        flat, starts = np.concatenate(kinds, axis=1), np.cumsum([0, *(k.shape[1] for k in kinds[:-1])])
        while regular and done < pivots and not near():
            gains = np.add.reduceat(duals[flat[0]] * flat[1], starts)
            if not sum(enter(*kinds[i]) for i in np.argsort(-gains, kind="stable")[:COLUMNS]):
                break
            regular = stale < FRESH or refresh()
    while regular and done < pivots and not near():
        best, took = _knapsack(duals, lengths, room)
        bound = max(bound, float(duals @ demand) / max(best[room], 1.0))
        if best[room] <= 1 + 1e-9 or done == before:
            break
        before = done
        worth = duals + best[room - lengths]  # of the best configuration with this length in it
        for i in [-1, *np.argsort(-worth, kind="stable")[:COLUMNS]]:
            copies = _trace(took, lengths, room if i < 0 else room - lengths[i])
            if i >= 0:
                copies[i] += 1
            has = np.flatnonzero(copies)
            enter(has, copies[has])
        regular = stale < FRESH or refresh()
    if off(basis, x):  # rounding errors have grown
        basis, x = sound
    return list(basis.T), x, bound


def programmed(histogram: dict[int, int], room: int) -> tuple[list[tuple[dict[int, int], int]], dict[int, int], float]:
    """What the program places, what its rounding leaves, and the lower bound on the sequences of any packing.

    Each configuration is used as often as the fraction rounded down says; then those of the largest rests once more,
    where enough pieces are left. What remains is solved again.
    """
    left = {k: v for k, v in histogram.items() if v}
    out: list[tuple[dict[int, int], int]] = []
    if full := left.pop(room, 0):
        out.append(({room: 1}, full))
    bound = 0.0
    for turn in range(ROUNDS):
        if not left:
            break
        lengths, counts = np.array(sorted(left)), np.array([left[k] for k in sorted(left)])
        kinds, used, least = solve(lengths, counts, room)
        bound = bound if turn else least
        whole = np.floor(used + 1e-6)
        todo = [(k, int(whole[k])) for k in np.argsort(-used, kind="stable")] + [(k, 1) for k in np.argsort(whole - used, kind="stable") if used[k] - whole[k] > 1e-6]
        for k, most in todo:
            has = kinds[k] > 0
            if times := min(most, int((counts[has] // kinds[k][has]).min())):
                counts = counts - times * kinds[k]
                out.append(({int(n): int(c) for n, c in zip(lengths[has], kinds[k][has], strict=True)}, times))
        left = {int(k): int(v) for k, v in zip(lengths, counts, strict=True) if v}
    return out, left, full + bound


def plan(histogram: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Configurations {length: copies} and how many sequences are packed so; every piece has its place, no sequence is over-full."""
    out, left, _ = programmed(histogram, room)
    return out + best_fit(left, room)


def best_fit(left: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first: each piece goes to the fullest sequence that has room. Sequences packed alike are grouped, so the work follows the number of lengths, not of pieces."""
    free: dict[int, dict[tuple[tuple[int, int], ...], int]] = {}
    for n in sorted(left, reverse=True):
        count = left[n]
        while count:
            gap = next((g for g in range(n, room) if free.get(g)), room)
            if gap == room:
                kind, times = (), -(-count // (room // n))
                free.setdefault(room, {})[kind] = times
            kind = next(iter(free[gap]))
            times = free[gap].pop(kind)
            each = min(gap // n, max(1, count // times))
            use = min(times, count // each)
            if times > use and (gap < room):
                free[gap][kind] = times - use
            merged = tuple(sorted({**dict(kind), n: dict(kind).get(n, 0) + each}.items()))
            at = free.setdefault(gap - n * each, {})
            at[merged] = at.get(merged, 0) + use
            count -= use * each
    return [(dict(kind), times) for kinds in free.values() for kind, times in kinds.items() if kind and times]


def places(plan: list[tuple[dict[int, int], int]], room: int) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, copies, offset), sorted by rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    seen: dict[int, int] = {}
    first = 0
    for kind, times in plan:
        at = 0
        for n in sorted(kind, reverse=True):
            rows.setdefault(n, []).append((seen.get(n, 0), first, kind[n], at))
            seen[n] = seen.get(n, 0) + kind[n] * times
            at += n * kind[n]
        if at > room:
            raise ValueError(f"{kind} is longer than {room}")
        first += times
    return {n: np.array(x, np.int64) for n, x in rows.items()}


PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("rank", pa.int64())])
PLACED = pa.schema([*list(PIECE)[:5], pa.field("sequence_id", pa.int64()), pa.field("offset", pa.int64())])
#: Pieces in one batch of a file (a batch ends with the 500 documents that reach them), and in one partition of the result, on average.
BATCH_PIECES, PARTITION_PIECES = 8192, 1 << 16
#: The end of a stream of Arrow's format, and the bits of a rank beside a length.
_ENDS, _RANK = b"\xff\xff\xff\xff\0\0\0\0", 40


def write_pieces(df: DataFrame, folder: str, tokenizer: str, end_id: int, room: int) -> dict[int, int]:
    """Cut every document and write, for each input partition that has any, its pieces and how many it has of each length; pieces by partition.

    A piece's rank numbers those of its length in its partition. Python writes the files: for each file that Spark
    writes to a local file system without native code, the JVM starts processes (chmod), each of which counts as large as the JVM
    until it runs its program.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.give_back(tokenizer=False)
        task, own, seen = TaskContext.get(), encoder(tokenizer), [0] * (room + 1)

        def chunks() -> Iterator[bytes]:
            rows: list[tuple] = []
            message = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), PIECE.types, strict=True)], schema=PIECE).serialize().to_pybytes()
            yield PIECE.serialize().to_pybytes()
            for batch in batches:
                for i in range(0, batch.num_rows, 500):
                    some = batch.slice(i, 500)
                    for doc, ids in zip(some.column("doc_id").to_pylist(), own.encode(some.column("text").to_pylist()), strict=True):
                        ids += end
                        n = len(ids) // 4
                        cuts = [0, *range(n % room or room, n + 1, room)]
                        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                            rows.append((doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), seen[b - a]))
                            seen[b - a] += 1
                    if len(rows) >= BATCH_PIECES:
                        yield message()
                        rows = []
            if rows:
                yield message()
            yield _ENDS

        part, attempt = task.partitionId(), str(task.taskAttemptId())
        common.write_file(folder, f"part-{part:05d}.pieces", chunks(), attempt)
        common.write_file(folder, f"part-{part:05d}.counts", iter([np.array(seen, "<i8").tobytes()]), attempt)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "n": pa.array([sum(seen)], pa.int64())})

    written = df.select("doc_id", "text").mapInArrow(run, "part bigint, n bigint").where("n > 0")
    return dict(written.collect())


def counted(spark: SparkSession, folder: str, pieces: dict[int, int]) -> DataFrame:
    """How many pieces of each length each partition has, from the files: part, length, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column("id").to_pylist():
                if part in pieces:
                    n = np.frombuffer(common.read_file(folder, f"part-{part:05d}.counts"), "<i8")
                    has = np.flatnonzero(n)
                    yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(has), part)), "length": pa.array(has), "n": pa.array(n[has])})

    return spark.range(0, max(pieces, default=-1) + 1, 1, max(1, min(len(pieces), spark.sparkContext.defaultParallelism))).mapInArrow(run, "part bigint, length bigint, n bigint")


def pack(df: DataFrame, tokenizer: str, end_id: int = 2, room: int = 1024) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document longer than room is cut into pieces of room tokens, of which the first may be shorter; others are
    one piece. A null text is empty (only the end id). Null and repeated doc_ids and repeated rows are kept, each
    packed for itself. An empty table gives no rows. Other columns are ignored. The result's partitions follow the
    number of pieces, not the partitions of the input.
    """
    spark = df.sparkSession
    folder = common.new_folder(spark, "pieces")
    pieces = write_pieces(df, folder, tokenizer, end_id, room)
    counts = counted(spark, folder, pieces)
    histogram = dict(counts.groupBy("length").agg(F.sum("n").alias("n")).collect())
    table = places(plan(histogram, room), room)
    rows = np.concatenate([np.empty((0, 4), np.int64), *(table[n] for n in sorted(table))])
    key = np.repeat(np.array(sorted(table), np.int64), [len(table[n]) for n in sorted(table)]) << _RANK | rows[:, 0]
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = counts.select("part", F.struct("length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first in zip(batch.column("part").to_pylist(), batch.column("based"), strict=True):
                length, n = (first.values.field(k).to_numpy() for k in (0, 1))
                base = np.zeros(room + 1, np.int64)
                base[length] = n
                with common.open_stream(folder, f"part-{part:05d}.pieces") as f:
                    for some in pa.ipc.open_stream(f):
                        length = some.column("length").to_numpy()
                        rank = base[length] + some.column("rank").to_numpy()
                        row = rows[np.searchsorted(key, (length << _RANK) + rank, side="right") - 1]
                        k, j = np.divmod(rank - row[:, 0], row[:, 2])
                        yield pa.RecordBatch.from_arrays([*some.columns[:5], pa.array(row[:, 1] + k), pa.array(row[:, 3] + j * length)], schema=PLACED)

    dealt = based.groupBy("part").agg(F.collect_list("x").alias("based")).repartition(max(1, -(-sum(pieces.values()) // PARTITION_PIECES)))
    return dealt.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
