"""LM scoring: a gated recurrent network over word classes, with a class-factored output softmax.

log P(text) = sum over tokens of log P(class | what came before) + log P(word | class). The network reads classes and
predicts the next one; within a class the softmax over words has their log counts as its only logits, so that it needs
counts of all words but no table of them in the network. Frequent words are classes of their own; the others share
classes by their last letters and the mark after them. Each class has one place for words never seen in training.

Counts cover all training documents. Words are split, counted and looked up by Arrow's kernels; one pass writes each
document's class ids (a byte a token), from which the network learns and scores. The network learns by truncated backpropagation through time: a warm start on
whole texts of a bounded sample on the driver, then one pass over all training documents, in which every partition
trains on its own documents from the same start, and the results are averaged by tokens (so the parameters depend on
how the table is partitioned). Scoring carries the state through each whole document. Words beyond the bounded table
of frequent ones get their counts by a join.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import common

#: Words that tasks know by heart (the most frequent), classes (256 at most, for ids are bytes), those of a single word, units of the network, tokens in a training window and its lanes, seed.
TABLE, CLASSES, SINGLES, UNITS, STEPS, LANES, SEED = 1 << 18, 128, 64, 16, 16, 256, 5
#: Documents of the warm start and characters of them in all (whole texts only); passes over them. Rates of the warm start and of the pass over all documents.
WARM, WARM_CHARS, WARM_PASSES, WARM_RATE, RATE = 512, 4_000_000, 4, 0.01, 0.004
#: Tokens that a task scores at a time (more only where one document alone has more), and lanes in which their documents lie.
CHUNK, ROWS = 1_500_000, 384
#: Rows of class probabilities that are computed at a time. Bytes of words that a task counts at a time.
BLOCK, COUNTED = 1024, 64 << 20
END, LONGEST, _MARKS = b" ", 32, b".,!?;:|"


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased (A-Z) runs of everything but ASCII white space, of all texts in a row, and how many each has; a null text has none."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat, cuts = split.flatten(), split.offsets.to_numpy()
    some = np.concatenate([[0], np.cumsum(pc.binary_length(flat).to_numpy() > 0)])  # white space at either end leaves empty words
    if some[-1] < len(flat):
        flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
    return flat.cast(pa.large_binary() if pa.types.is_large_string(flat.type) else pa.binary()).cast(pa.binary()), np.diff(some[cuts - cuts[0]])


def key(word: bytes) -> bytes:
    """The word itself, or for long ones a digest that no word can equal (words have no spaces)."""
    return word if len(word) <= LONGEST else b" " + hashlib.sha256(word).digest()


def keys(found: pa.Array) -> pa.Array:
    """The key of each word."""
    long = pc.greater(pc.binary_length(found), LONGEST)
    return pc.replace_with_mask(found, long, pa.array(map(key, found.filter(long).to_pylist()), pa.binary())) if pc.any(long).as_py() else found


def ending(word: bytes) -> bytes:
    """The kind of mark after the word, and its last two bytes before it."""
    core = word.rstrip(_MARKS)
    mark = word[len(core) : len(core) + 1]
    return (b"0" if not mark else b"1" if mark == b"." else b"2" if mark == b"," else b"3") + core[-2:]


class Classes(dict):
    """Word key -> class. 0 is the end; then come single words, endings, and one class for each kind of mark."""

    def __init__(self, singles: list[bytes], endings: list[bytes]):
        super().__init__({END: 0, **{w: i + 1 for i, w in enumerate(singles)}})
        self.singles, self.endings = singles, endings
        first = 1 + len(singles)
        self.by = {e: first + i for i, e in enumerate(endings)}
        self.other = first + len(endings)
        self.size = self.other + 4

    def __missing__(self, word: bytes) -> int:
        e = ending(word)
        c = self.by.get(e)
        return self.other + e[0] - 48 if c is None else c

    def __reduce__(self):
        return Classes, (self.singles, self.endings)


class Scratch:
    """Arrays that are used again and again, for making large ones anew costs more than what is computed in them."""

    def __init__(self):
        self.flat: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        n = int(np.prod(shape))
        if name not in self.flat or self.flat[name].size < n:
            self.flat[name] = np.empty(n, np.float32)
        return self.flat[name][:n].reshape(shape)


class Network:
    """A gated recurrent unit over one-hot classes with a softmax output, all in single precision."""

    NAMES = ("e", "u", "v", "o", "b")

    def __init__(self, classes: int, units: int, start: np.ndarray | None = None):
        rng = np.random.default_rng(SEED)
        shapes = {"e": (classes, 3 * units), "u": (units, 2 * units), "v": (units, units), "o": (units, classes), "b": (classes,)}
        self.shapes, self.units, self.classes = shapes, units, classes
        draw = lambda s: rng.normal(0, 0.3 / np.sqrt(s[0] if len(s) > 1 and s[0] == units else 1), s)
        self.p = {k: draw(s).astype(np.float32) for k, s in shapes.items()}
        self.p["b"] = np.zeros(classes, np.float32) if start is None else start.astype(np.float32)
        self.scratch = Scratch()

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.NAMES])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for k in self.NAMES:
            n = int(np.prod(self.shapes[k]))
            self.p[k] = flat[at : at + n].reshape(self.shapes[k]).astype(np.float32)
            at += n
        return self

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
        """The parameters of a step, each gate's apart (those of both gates negated, for their sigmoid), and whether logits may need clipping."""
        n, p = self.units, self.p
        e = np.ascontiguousarray(p["e"].reshape(self.classes, 3, n).transpose(1, 0, 2))
        np.negative(e[:2], out=e[:2])
        u = -p["u"].reshape(n, 2, n).transpose(1, 0, 2)
        return e, np.ascontiguousarray(u), p["v"], bool(np.abs(p["o"]).sum(axis=0).max() + np.abs(p["b"]).max() > 40)  # states lie within -1 and 1

    def step(self, h: np.ndarray, x: np.ndarray, parts: tuple | None = None) -> tuple[np.ndarray, ...]:
        """Next state, and what backpropagation needs of this step: the two gates, what the second one scales, the candidate."""
        e, u, v, _ = parts or self.parts()
        own = e.take(x, axis=1)
        gates = np.matmul(h, u)
        gates += own[:2]
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        w = h @ v
        c = gates[1] * w
        c += own[2]
        np.tanh(c, out=c)
        new = h - c
        new *= gates[0]
        new += c
        return new, gates[0], gates[1], w, c

    def surprise(self, h: np.ndarray, parts: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Unnormalised probabilities of all classes (until the next call) and their sums; logits are kept within what single precision holds."""
        y = np.matmul(h, self.p["o"], out=self.scratch("y", len(h), self.classes)) if h.dtype == np.float32 else h @ self.p["o"]
        y += self.p["b"]
        if (parts or self.parts())[3]:
            np.clip(y, -40, 40, out=y)
        p = np.exp(y, out=y)
        return p, p @ np.ones(p.shape[1], p.dtype)


class Trainer:
    """Truncated backpropagation through time over parallel lanes of tokens, with Adam."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.n = net, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.s = {k: np.zeros_like(v) for k, v in net.p.items()}

    def run(self, tokens: np.ndarray, lanes: int = LANES) -> None:
        """One pass over class ids of whole documents, one after the other; each starts anew after an end."""
        lanes = max(1, min(lanes, len(tokens) // STEPS))
        size = len(tokens) // lanes
        x = np.concatenate([[0], tokens[:-1]])[: lanes * size].reshape(lanes, size).T
        y = tokens[: lanes * size].reshape(lanes, size).T
        h = np.zeros((lanes, self.net.units), np.float32)
        for i in range(0, size, STEPS):
            h = self.window(h, x[i : i + STEPS], y[i : i + STEPS])
        if (rest := tokens[lanes * size :]).size:  # what the lanes leave over, fewer tokens than lanes
            self.window(np.zeros((1, self.net.units), np.float32), np.concatenate([[0], rest[:-1]])[:, None], rest[:, None])

    def window(self, h: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        net, p = self.net, self.net.p
        n, t, lanes, size = net.units, len(x), len(h), y.size
        goes_on = (x != 0).astype(np.float32)[:, :, None]  # after an end, a new document
        room, parts = net.scratch, net.parts()
        before, states, z, r, w, c, back = (room(k, t, lanes, n) for k in ("before", "states", "z", "r", "w", "c", "back"))
        for i in range(t):
            np.multiply(h, goes_on[i], out=before[i])
            states[i], z[i], r[i], w[i], c[i] = net.step(before[i], x[i], parts)
            h = states[i]
        flat_h, flat_back, flat_y = states.reshape(size, n), back.reshape(size, n), y.ravel()
        grad = {k: np.zeros_like(p[k]) for k in ("e", "u", "o", "b")}
        out_t = p["o"].T.copy()
        for i in range(0, size, BLOCK):  # so many rows of probabilities at a time stay in the processor's cache
            rows, goal = flat_h[i : i + BLOCK], flat_y[i : i + BLOCK]
            prob, total = net.surprise(rows, parts)
            prob[np.arange(len(rows)), goal] -= total
            weight = 1 / (total * size)
            grad["o"] += (rows * weight[:, None]).T @ prob
            grad["b"] += weight @ prob
            np.multiply(prob @ out_t, weight[:, None], out=flat_back[i : i + BLOCK])
        # how the gates and the candidate answer to what goes into them, for all steps at once
        to_z, to_r, to_c = (room(k, t, lanes, n) for k in ("to_z", "to_r", "to_c"))
        np.multiply(np.subtract(before, c, out=to_z), 1 - z, out=to_z)
        np.multiply(w, np.subtract(1, r, out=to_r), out=to_r)
        np.subtract(1, np.multiply(c, c, out=to_c), out=to_c)
        (uz, ur), vt = (np.ascontiguousarray(m) for m in p["u"].reshape(n, 2, n).transpose(1, 2, 0)), p["v"].T.copy()
        dz, dr, dc, dw = (room(k, t, lanes, n) for k in ("dz", "dr", "dc", "dw"))
        d = np.zeros((lanes, n), np.float32)
        for i in range(t - 1, -1, -1):
            d += back[i]
            straight = d * z[i]  # what goes straight to the state before
            np.multiply(d - straight, to_c[i], out=dc[i])
            np.multiply(straight, to_z[i], out=dz[i])
            np.multiply(dc[i], r[i], out=dw[i])
            np.multiply(dw[i], to_r[i], out=dr[i])
            straight += dz[i] @ uz
            straight += dr[i] @ ur
            straight += dw[i] @ vt
            straight *= goes_on[i]
            d = straight
        flat_before = before.reshape(size, n).T
        grad["v"] = flat_before @ dw.reshape(size, n)
        flat_x = x.ravel()
        order = np.argsort(flat_x.astype(np.int16), kind="stable")
        cuts = np.flatnonzero(np.diff(flat_x[order], prepend=-1))
        seen, sorted_d = flat_x[order][cuts], room("sorted", size, n)
        for k, m in enumerate((dz, dr, dc)):
            flat = m.reshape(size, n)
            if k < 2:
                grad["u"][:, k * n : (k + 1) * n] = flat_before @ flat
            grad["e"][seen, k * n : (k + 1) * n] = np.add.reduceat(np.take(flat, order, axis=0, out=sorted_d, mode="clip"), cuts, axis=0)
        self.n += 1
        rate = self.rate / np.sqrt(1 + self.n / 200) * np.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n)
        for k, g in grad.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.s[k] += 0.001 * (g * g - self.s[k])
            p[k] -= (rate * self.m[k] / (np.sqrt(self.s[k]) + 1e-8)).astype(np.float32)
        return h.copy()  # not a view of what the next window overwrites


def score_documents(net: Network, docs: list[np.ndarray]) -> np.ndarray:
    """Natural-log likelihood of each document's class ids, state carried from its first token to its last.

    Whole documents lie one after the other in lanes of about equal length; finished lanes drop out. Memory follows
    the tokens, however unequal the documents are.
    """
    lanes: list[list[int]] = [[] for _ in range(min(ROWS, len(docs)))]
    heap = [(0, i) for i in range(len(lanes))]
    for k in sorted(range(len(docs)), key=lambda k: -len(docs[k])):
        n, i = heapq.heappop(heap)
        lanes[i].append(k)
        heapq.heappush(heap, (n + len(docs[k]), i))
    lanes.sort(key=lambda ks: -sum(len(docs[k]) for k in ks))
    sizes = np.array([sum(len(docs[k]) for k in ks) for ks in lanes])
    starts = np.cumsum(sizes) - sizes
    order = [k for ks in lanes for k in ks]
    y = np.concatenate([docs[k] for k in order])
    x = np.concatenate([[0], y[:-1]])  # what comes before a document is an end, also where lanes meet
    out = np.empty(len(y), np.float32)
    h = np.zeros((len(lanes), net.units), np.float32)
    room, parts = net.scratch("states", STEPS, len(lanes), net.units).ravel(), net.parts()
    for i in range(0, int(sizes[0]), STEPS):
        live = int(np.searchsorted(-sizes, -i, side="left"))  # lanes longer than i
        steps = np.arange(i, min(i + STEPS, int(sizes[0])))[:, None]
        real = steps < sizes[:live]
        at = np.where(real, starts[:live] + steps, 0)
        before, h = x[at], h[:live]
        states = room[: at.size * net.units].reshape(*at.shape, net.units)
        for row, state in zip(before, states, strict=True):
            state[:] = h = net.step(h * (row != 0)[:, None], row, parts)[0]
        flat, goal = states.reshape(at.size, net.units), y[at].ravel()
        got = np.empty(at.size, np.float32)
        for j in range(0, at.size, BLOCK):
            prob, total = net.surprise(flat[j : j + BLOCK], parts)
            got[j : j + BLOCK] = prob[np.arange(len(total)), goal[j : j + BLOCK]] / total
        out[at[real]] = np.log(got).reshape(at.shape)[real]
    result = np.empty(len(docs))
    ends = np.cumsum([len(docs[k]) for k in order])
    result[order] = np.add.reduceat(out.astype(np.float64), np.concatenate([[0], ends[:-1]]))
    return result


def count_words(docs: DataFrame) -> DataFrame:
    """word (key) and its count over all documents, the end among them; each task adds up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: list[pa.Array]) -> pa.RecordBatch:
            counts = pa.chunked_array(held, pa.binary()).value_counts()
            return pa.RecordBatch.from_arrays([keys(counts.field("values")), counts.field("counts")], names=["word", "n"])

        held, size, docs_ = [], 0, 0
        for batch in batches:
            docs_ += batch.num_rows
            held.append(words(batch.column("text"))[0])
            size += held[-1].nbytes
            if size > COUNTED:
                yield rows(held)
                held, size = [], 0
        if held:
            yield rows(held)
        if docs_:
            yield pa.RecordBatch.from_pydict({"word": pa.array([END], pa.binary()), "n": pa.array([docs_], pa.int64())})

    return docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def least_count(counts: DataFrame, words_: int) -> int:
    """The smallest count that at most words_ words reach; from a histogram with a few hundred bins."""
    bins = counts.groupBy(F.floor(F.log2("n") * 8).alias("bin")).agg(F.count("*").alias("n"), F.min("n").alias("least")).orderBy(F.desc("bin")).collect()
    least, total = 1 << 62, 0
    for x in bins:
        total += x["n"]
        if total > words_:
            break
        least = x["least"]
    return least


def score(df: DataFrame, train: str = "true") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: one row per row of df.

    train is a condition over doc_id; documents for which it isn't false are learnt from (so are null ids).
    base_score is that of add-one unigram counts. A null or empty text has the end as its only token. Repeated
    doc_ids and rows are scored each for itself. An empty table gives no rows; where nothing is learnt from, all
    words are unknown. Columns other than doc_id and text play no part.
    """
    spark = df.sparkSession
    docs = df.select("doc_id", "text")
    learnt = docs.where(F.coalesce(F.expr(train), F.lit(True)))
    counts = common.cut(count_words(learnt))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = least_count(counts, TABLE)
    # the end is in the table whatever its count, for no join looks it up
    table = {bytes(x["word"]): x["n"] for x in counts.where((F.col("n") >= least) | (F.col("word") == F.lit(END))).collect()}

    ranked = sorted((w for w in table if w != END), key=lambda w: (-table[w], w))
    singles = ranked[:SINGLES]
    mass: Counter = Counter()
    for w in ranked[SINGLES:]:
        mass[ending(w)] += table[w]
    ends = [e for e, _ in sorted(mass.items(), key=lambda x: (-x[1], x[0]))[: CLASSES - SINGLES - 5]]
    classes = Classes(singles, ends)

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([classes[w] for w in batch.column("word").to_pylist()], pa.int32()), batch.column("n")], names=["class", "n"])

    tokens_in, words_in = np.zeros(classes.size), np.zeros(classes.size)
    for x in counts.mapInArrow(classed, "class int, n bigint").groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tokens_in[x["class"]], words_in[x["class"]] = x["n"], x["v"]
    single = np.arange(classes.size) <= len(singles)
    room = np.where(single, np.maximum(tokens_in + 1, 1), tokens_in + words_in + 1)  # a single word's class holds it for certain
    start = np.log((tokens_in + 0.5) / (tokens_in.sum() + 0.5 * classes.size))

    known = _Known(pa.array(list(table), pa.binary()), classes, np.log10(np.array(list(table.values()), float) + 1))
    net = Network(classes.size, UNITS, start)
    if drawn := common.drawn(learnt, "doc_id", "text", WARM, WARM_CHARS):
        warm, trainer = known.read(pa.array([x["text"] for x in drawn], pa.string()))[0].astype(np.int64), Trainer(net, WARM_RATE)
        for _ in range(WARM_PASSES):
            trainer.run(warm, 64)
    shared = spark.sparkContext.broadcast((known, classes.size, net.flat(), np.log10(room)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = shared.value[0], TaskContext.get().partitionId() << 40
        for batch in batches:
            seq, sizes, points, rare, n_rare = own.read(batch.column("text"))
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            n_known = sizes - n_rare - (0 if own.end >= 0 else 1)
            ids = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(seq)])
            rares = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_rare)]), pa.int32()), rare)
            columns = [pa.array(row + np.arange(len(sizes))), batch.column("doc_id"), batch.column("learnt"), pa.array(sizes), pa.array(n_known), pa.array(points), ids, rares]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "learnt", "n_tokens", "n_known", "points", "ids", "rare"])
            row += len(sizes)

    flagged = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(F.expr(train), F.lit(True)).alias("learnt"))
    encoded = common.cut(flagged.mapInArrow(read, "row bigint, doc_id bigint, learnt boolean, n_tokens bigint, n_known bigint, points double, ids binary, rare array<binary>"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, size, flat, _ = shared.value
        trainer = Trainer(Network(size, UNITS).load(flat.copy()), RATE)
        done, held, waiting = 0, [], 0
        for batch in batches:
            for ids in batch.column("ids"):
                held.append(np.frombuffer(ids.as_buffer(), np.uint8).astype(np.int64))
                waiting += len(held[-1])
                if waiting > 1_000_000:
                    trainer.run(np.concatenate(held))
                    done, held, waiting = done + waiting, [], 0
        if waiting:
            trainer.run(np.concatenate(held))
            done += waiting
        if done:  # weighted by tokens, whose number comes last
            v = np.append(trainer.net.flat().astype(float), 1.0) * done
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()]), "v": pa.array([v], pa.list_(pa.float64()))})

    summed = common.add_arrays(encoded.where("learnt").select("ids").mapInArrow(learn, "part bigint, v array<double>"), "v", "part")
    flat = net.flat() if summed is None else (summed[:-1] / summed[-1]).astype(np.float32)
    final = spark.sparkContext.broadcast(flat)
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("points", pa.float64()), ("model", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, size, _, rooms = shared.value
        trained = Network(size, UNITS).load(final.value)
        held, seqs, waiting = [], [], 0

        def flush() -> pa.RecordBatch:
            model = score_documents(trained, seqs) / np.log(10) - [rooms[s].sum() for s in seqs]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*held, strict=True), model], schema.types, strict=True)], schema=schema)

        for batch in batches:
            for *row, ids in zip(*(batch.column(x).to_pylist() for x in schema.names[:-1]), batch.column("ids"), strict=True):
                seq = np.frombuffer(ids.as_buffer(), np.uint8).astype(np.int64)
                if held and waiting + len(seq) > CHUNK:
                    yield flush()
                    held.clear()
                    seqs.clear()
                    waiting = 0
                held.append(row)
                seqs.append(seq)
                waiting += len(seq)
        if held:
            yield flush()

    scored = encoded.drop("learnt", "rare").mapInArrow(run, "row bigint, doc_id bigint, n_tokens bigint, n_known bigint, points double, model double")
    rare = encoded.select("row", F.explode("rare").alias("word")).join(counts.where(F.col("n") < least), "word")
    rare = rare.groupBy("row").agg(F.count("*").alias("k"), F.sum(F.log10(F.col("n") + 1)).alias("p"))
    out = scored.join(rare, "row", "left").na.fill({"k": 0, "p": 0.0})
    points = F.col("points") + F.col("p")
    return out.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.col("k")).alias("n_known"), F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (points - F.col("n_tokens") * F.lit(float(np.log10(int(total) + distinct + 1)))).alias("base_score"), (points + F.col("model")).alias("score"),
    )


class _Known:
    """The words that tasks know by heart, with their classes and points; others have their classes by their endings."""

    def __init__(self, heard: pa.Array, classes: Classes, points: np.ndarray):
        self.heard, self.classes = heard, classes
        listed = heard.to_pylist()
        self.end = listed.index(END) if END in listed else -1
        # the last place stands for words beyond the table
        self.class_of, self.points = np.array([*(classes[w] for w in listed), 0], np.uint8), np.append(points, 0.0)

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Class ids of all texts in a row, each with its end; tokens of each text, and points of those known by heart; the others of all texts in a row, and how many each has."""
        found, n = words(texts)
        found, sizes = keys(found), n + 1
        ends = np.cumsum(sizes) - 1
        at = np.full(int(sizes.sum()), self.end)
        word = np.ones(len(at), bool)
        word[ends] = False
        at[word] = places = pc.index_in(found, value_set=self.heard).fill_null(-1).to_numpy()
        seq, beyond = self.class_of[at], np.flatnonzero(places < 0)
        rare = found.take(pa.array(beyond))
        seq[np.flatnonzero(word)[beyond]] = [self.classes[w] for w in rare.to_pylist()]
        seq[ends] = 0
        points = np.add.reduceat(self.points[at], ends - n) if len(n) else np.zeros(0)
        return seq, sizes, points, rare, np.bincount(np.searchsorted(np.cumsum(n), beyond, side="right"), minlength=len(n))
