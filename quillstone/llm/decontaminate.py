"""Benchmark decontamination with a generalised suffix automaton of the benchmark's normalised words.

Every document's words run through the automaton once; at each word it knows the longest stretch ending there that
some item contains. A stretch of a window's length, or a short item as a whole, marks its words as hit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import common

#: Upper-case ASCII letters become lower case; other ASCII that is no letter or digit becomes a space.
_NORMAL = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower())
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Words of benchmark items in one automaton; a larger benchmark is taken in several, one after the other.
BLOCK_WORDS = 2_000_000


def words(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and everything beyond ASCII; a null text has none."""
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split() if text else []


class Automaton:
    """All stretches of words that occur in some item, as a deterministic automaton with suffix links."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.size = [-1], [0]
        owners: list[set[int]] = [set()]
        whole: dict[int, list[tuple[int, int]]] = {}
        for item, text in items:
            last = 0
            for w in text:
                last = self._extend(last, w, owners)
                owners[last].add(item)
            if 0 < len(text) < window:
                whole.setdefault(last, []).append((len(text), item))
        order = sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True)
        for v in order:  # what contains a stretch contains its ends; only ends of a window's length matter
            if self.size[self.link[v]] >= window:
                owners[self.link[v]] |= owners[v]
        #: For each state, the least match that means a hit; the state of its last window's stretch; short items that end here.
        self.least, self.state, self.short = [window] * len(self.size), [0] * len(self.size), [()] * len(self.size)
        for v in reversed(order):
            up = self.link[v]
            self.state[v] = self.state[up] if self.size[up] >= window else v
            self.short[v] = tuple(whole.get(v, ())) + self.short[up]
            self.least[v] = min([window, *(n for n, _ in self.short[v])])
        self.owners = [frozenset(x) if self.size[v] >= window and self.size[self.link[v]] < window else frozenset() for v, x in enumerate(owners)]

    def _extend(self, last: int, w: bytes, owners: list[set[int]]) -> int:
        nxt, link, size = self.next, self.link, self.size

        def clone(p: int, q: int) -> int:
            c = len(size)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            size.append(size[p] + 1)
            owners.append(set())
            link[q] = c
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = c
                p = link[p]
            return c

        if (q := nxt[last].get(w)) is not None:
            return q if size[q] == size[last] + 1 else clone(last, q)
        new = len(size)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        owners.append(set())
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if size[q] == size[p] + 1 else clone(p, q)
        return new

    def scan(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans (first word, after the last) that are hit, merged and in order, and the items with windows there."""
        nxt, link, size, least, window = self.next, self.link, self.size, self.least, self.window
        root = nxt[0]
        state = length = 0
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for i, w in enumerate(text):
            if w not in root:
                state = length = 0
                continue
            while (to := nxt[state].get(w)) is None:
                state = link[state]
                length = size[state]
            state = to
            length += 1
            if length >= least[state]:
                if length >= window:
                    items |= self.owners[self.state[state]]
                    spans.append((i + 1 - length, i + 1))
                for n, item in self.short[state]:
                    if n <= length:
                        items.add(item)
                        spans.append((i + 1 - n, i + 1))
        if not spans:
            return spans, items
        spans.sort()
        merged = [spans[0]]
        for a, b in spans[1:]:
            if a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, items


def blocks(benchmark: DataFrame, block_words: int) -> list[DataFrame]:
    """item_id and text of the items with a text, in parts of bounded size."""
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    n = max(1, -(-total // (4 * block_words)))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items for k in range(n)]


def automaton(items: DataFrame, window: int) -> Automaton:
    return Automaton([(i, words(t)) for i, t in sorted(items.collect())], window)


def _join(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what lies between them."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw)]
    parts, last = [], 0
    for a, b in spans:
        parts.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*parts, raw[last:]]).decode("utf-8", "surrogatepass")


def decontaminate(df: DataFrame, benchmark: DataFrame, window: int = 10, coverage: float = 0.5, block_words: int = BLOCK_WORDS, texts: bool = True) -> DataFrame:
    """All columns of df, and of each document n_words, n_hit, n_items, items_sha256, contaminated, cleaned.

    cleaned is the text without its hit spans, and null (the document goes) if more than `coverage` of its words
    are hit. A word is hit if it lies in an occurrence of `window` consecutive words of an item, or of all words of
    an item that has fewer. A null or empty text has no words and stays as it is. Repeated rows and ties are
    treated each for itself; an empty table or benchmark gives no rows or no hits. df needs the column text only;
    its columns of the names above are replaced. Without `texts`, text and cleaned are left out.

    A benchmark beyond block_words is taken in several passes over the texts, one automaton at a time on the driver
    and in the tasks; each pass adds the spans and items that it finds to the rows.
    """
    spark = df.sparkSession
    own = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", *(["cleaned"] if texts else [])]
    df = df.drop(*own, "cleaned")
    fields = [(f"`{f.name}`", f.dataType.simpleString()) for f in df.schema.fields]
    parts = blocks(benchmark, block_words)
    span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def passed(rows: DataFrame, items: DataFrame) -> DataFrame:
        """The rows with what an automaton finds added to the columns _spans and _items."""
        built = spark.sparkContext.broadcast(automaton(items, window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common.give_back()
            for batch in batches:
                found = [built.value.scan(words(x)) for x in batch.column("text").to_pylist()]
                before = zip(batch.column("_spans").to_pylist(), batch.column("_items").to_pylist(), strict=True) if "_spans" in batch.schema.names else [([], [])] * len(found)
                both = [([*a, *({"a": i, "b": j} for i, j in x)], [*b, *map(str, sorted(y))]) for (a, b), (x, y) in zip(before, found, strict=True)]
                kept = [k for k in batch.schema.names if k not in ("_spans", "_items")]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array([x for x, _ in both], span), pa.array([x for _, x in both], pa.list_(pa.string()))], names=[*kept, "_spans", "_items"])

        out = common.cut(rows.mapInArrow(run, ", ".join([*(f"{k} {t}" for k, t in fields), "_spans array<struct<a:bigint,b:bigint>>, _items array<string>"])))
        built.destroy()
        return out

    rows = df
    for items in parts[:-1]:
        rows = passed(rows, items)
    last = spark.sparkContext.broadcast(automaton(parts[-1], window))
    added = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("cleaned", pa.string())])

    def one(text: str | None, spans: list[dict], items: list[str]) -> tuple:
        w = words(text)
        found, more = last.value.scan(w)
        hits = _join([*((x["a"], x["b"]) for x in spans), *found])
        named, hit = sorted({*items, *map(str, more)}), sum(b - a for a, b in hits)
        digest = hashlib.sha256(",".join(named).encode()).hexdigest()
        return len(w), hit, len(named), digest, hit > 0, *([text if not hit else remove(text, hits) if hit <= coverage * len(w) else None] if texts else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                read = batch.column("text").to_pylist()
                before = [batch.column(k).to_pylist() if k in batch.schema.names else [[]] * len(read) for k in ("_spans", "_items")]
                new = zip(*(one(*x) for x in zip(read, *before, strict=True)), strict=True)
                kept = [k for k in batch.schema.names if k not in ("_spans", "_items") and (texts or k != "text")]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *(pa.array(x, t) for x, t in zip(new, added.types, strict=False))], names=[*kept, *own])

    new = dict(zip(added.names, ("bigint", "bigint", "bigint", "string", "boolean", "string"), strict=True))
    return rows.mapInArrow(run, ", ".join([*(f"{k} {t}" for k, t in fields if texts or k != "`text`"), *(f"{k} {new[k]}" for k in own)]))
