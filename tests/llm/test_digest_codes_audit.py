import hashlib
import math
import random

import numpy as np
import pytest

from quillstone.llm import common, digest_index, source_audit, vector_codes


def squeezed(text):
    return hashlib.sha256("".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r").encode()).hexdigest()


def deduped(rows):
    """By id and text: the documents' group and who stays, by plain search."""
    groups = {}
    for i, t in rows:
        groups.setdefault(squeezed(t), []).append((-len(t or ""), i is None, i or 0, i))
    return sorted(((i, min(g)[3], len(g), min(g)[3] == i, squeezed(t)) for i, t in rows for g in [groups[squeezed(t)]]), key=repr)


def told(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_digests_of_odd_and_no_rows(spark, odd, empty):
    index = digest_index.DigestIndex(spark, common.new_folder(spark, "index"), buckets=4)
    assert index.add(empty).count() == 0 and index.table().count() == 0
    frame = odd.withColumnsRenamed({"source": "digest", "score": "keep_id"})  # names that the operator uses
    assert told(index.add(frame)) == deduped([(r.doc_id, r.text) for r in odd.collect()])


def test_the_longest_then_the_smallest_stays(spark):
    rows = [(3, "a b"), (1, "ab"), (2, "a\tb"), (9, "a b"), (5, " ab"), (6, "é e"), (4, "ée"), (8, "x" * 100_000)] + [(100 + i, "same text") for i in range(300)]
    index = digest_index.DigestIndex(spark, common.new_folder(spark, "index"))
    got = told(index.add(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert got == deduped(rows) and (1, 2, 4, False, squeezed("ab")) in got


def test_the_index_lasts_and_what_it_has_isnt_added_again(spark):
    folder = common.new_folder(spark, "index")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    first = digest_index.DigestIndex(spark, folder, buckets=3)
    first.add(frame([(10, "one"), (11, "two"), (12, "o ne")]))
    spark.sql(f"DROP TABLE {first.name}")  # as in another session; the files stay
    again = digest_index.DigestIndex(spark, folder, buckets=99)
    assert again.buckets == 3 and sorted(again.table().select("keep_id").collect()) == [(11,), (12,)]
    new = {r.doc_id: (r.keep_id, r.kept, r.group_size, r.known) for r in again.add(frame([(1, "o n e"), (2, "three"), (3, "t w o"), (4, "three ")])).collect()}
    assert new == {1: (12, False, 1, True), 2: (4, False, 2, False), 3: (11, False, 1, True), 4: (4, True, 2, False)}
    retried = {r.doc_id: (r.keep_id, r.kept) for r in again.add(frame([(2, "three"), (4, "three ")])).collect()}
    assert retried == {2: (4, False), 4: (4, True)} and again.table().count() == 3


def test_the_index_is_joined_where_it_lies(spark):
    index = digest_index.DigestIndex(spark, common.new_folder(spark, "index"), buckets=5)
    index.add(spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id bigint, text string"))
    found = spark.table(index.name).select("digest").withColumn("keep_id", common.F.lit(1))
    plan = index.fresh(found)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and plan.count("Exchange hashpartitioning") <= 1
    files = {f.rsplit("_", 1)[1][:5] for f in spark.table(index.name).inputFiles()}
    assert files == {f"{i:05d}" for i in range(5)}  # one file a bucket


def coded(vectors, entries=64, rounds=2, parts=16):
    """Plain search: (codes, errors, codebooks) of lists of numbers, in order."""
    whole = [[math.floor(x * 256) if abs(x) < 1e300 else int(x) * 256 for x in v] for v in vectors]
    wide = -(-len(whole[0]) // parts)
    cut = [[(v + [0] * (parts * wide - len(v)))[p * wide : (p + 1) * wide] for p in range(parts)] for v in whole]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    near = lambda: [[min((sum((a - b) ** 2 for a, b in zip(v[p], c, strict=True)), e) for e, c in enumerate(books[p])) for p in range(parts)] for v in cut]
    for _ in range(rounds):
        at = near()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p] for v, a in zip(cut, at, strict=True) if a[p][1] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at = near()
    return ["".join(f"{e:02x}" for _, e in a) for a in at], [sum(d for d, _ in a) for a in at], hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


@pytest.mark.parametrize(("size", "scale", "n"), [(64, 0.3, 150), (48, 2.0, 40), (20, 0.01, 90), (32, 1e9, 70), (16, 1e305, 20)])
def test_codes_equal_plain_search(spark, size, scale, n):
    rng = np.random.default_rng(size)
    vectors = (rng.normal(size=(n, size)) * scale).tolist()
    vectors[7] = vectors[3]  # ties
    vectors[5] = [0.0] * size
    codes, errors, sha = coded(vectors)
    rows = [(i, v, i % 3 if i % 4 else None, "x") for i, v in enumerate(vectors)]
    random.Random(1).shuffle(rows)
    got = vector_codes.encode(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, code string").repartition(3)).collect()
    limit = lambda x: x if x < 1 << 63 else None
    assert {r.vec_id: (r.code, r.error, r.codebooks_sha256) for r in got} == {i: (c, limit(e), sha) for i, (c, e) in enumerate(zip(codes, errors, strict=True))}
    if scale < 1e9:
        by = {}
        for i, e in enumerate(errors):
            by[i % 3 if i % 4 else None] = by.get(i % 3 if i % 4 else None, 0) + e
        assert all(r.label_error == by[r.label] for r in got)


def test_codes_of_odd_rows(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    assert vector_codes.encode(spark.createDataFrame([], schema)).count() == 0
    bad = [(0, None, 1), (1, [float("nan")] * 16, 1), (2, [1.0] * 15 + [None], 1), (3, [float("inf")] * 16, 1), (4, [], 1)]
    assert vector_codes.encode(spark.createDataFrame(bad, schema)).count() == 0
    good = [(7, [1.0] * 16, None), (None, [0.5] * 16, None), (7, [1.0] * 16, None), (9, [1.0] * 17, 2)]
    got = {(r.vec_id, r.code, r.error, r.label_error) for r in vector_codes.encode(spark.createDataFrame(bad + good, schema)).collect()}
    assert got == {(7, "00" * 16, 0, 0), (None, "02" * 16, 0, 0)}


def test_only_the_annulus_is_evaluated():
    rng = np.random.default_rng(0)
    entries, x = rng.integers(-200, 200, size=(64, 4)), rng.integers(-200, 200, size=(3000, 4))
    at, d, pairs = vector_codes.Codebook(entries).nearest(x)
    far = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (at == far.argmin(axis=1)).all() and (d == far.min(axis=1)).all() and pairs < 0.8 * x.shape[0] * 64
    on_the_border = vector_codes.Codebook(np.array([[5, 0], [-3, 0], [3, 0]]))
    assert [a.tolist() for a in on_the_border.nearest(np.array([[0, 0], [1, 0], [4, 0]]))[:2]] == [[1, 2, 0], [9, 4, 1]]


def audited(rows, least=10, top=10):
    """Plain sums over all kept terms: sorted rows of the audit."""
    tokens = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c if "a" <= c <= "z" or c >= "\x80" else " " for c in t or "").split(" ")
    docs = [(g or "", s or "", [w for w in tokens(t) if w]) for t, g, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen, n = {}, {}
        for _, s, words in mine:
            n.setdefault(s, {})
            for w in set(words):
                seen[w] = seen.get(w, 0) + 1
            for w in words:
                n[s][w] = n[s].get(w, 0) + 1
        kept = [w for w in seen if seen[w] >= least]

        def share(count):
            whole = sum(count.get(w, 0) for w in kept) + 2 * len(kept)
            return {w: 1 + 10**9 * (count.get(w, 0) + 2) // whole for w in kept}

        p, q = {s: share(n[s]) for s in n}, share({w: sum(n[s].get(w, 0) for s in n) for w in kept})
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in n:
            pairs = sorted((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in n if o != s)
            best = sorted((-f(p[s][w], q[w]), w.encode(), w) for w in kept if n[s].get(w, 0) and p[s][w] > q[w])[:top]
            out += [(lang, s, part, x, -v, k + 1) for part, l in (("pair", pairs), ("term", best)) for k, (v, _, x) in enumerate(l)]
    return sorted(out)


def _rows(seed):
    r = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["é", "Été", "日本", "UPPER", "upper"]
    rows = [(" ".join(r.choices(words, k=r.randint(0, 60))) + r.choice(["", ".", " 12x3 "]), r.choice(["en", "en", "fr", None]), f"s{int(r.random() ** 2 * 9)}") for _ in range(300)]
    return rows + [(None, "en", None), ("", "de", "x"), ("alone", "de", "y"), (None, None, None), ("wa9wa" * 3, "en", "s1"), ("wa9wa" * 3, "en", "s1"), ("same", "it", "only")] + [("hot words here", "en", "s0")] * 150


@pytest.mark.parametrize(("terms", "sources", "cells", "part", "entries"), [(4096, 256, 1 << 20, 1 << 20, 600_000), (7, 2, 5, 4, 50), (3, 3, 1, 1, 1)])
def test_audit_equals_plain_sums(spark, monkeypatch, terms, sources, cells, part, entries):
    """Blocks, steps and parts of any size give the same."""
    for name, value in (("TERMS", terms), ("SOURCES", sources), ("CELLS", cells), ("PART", part), ("ENTRIES", entries)):
        monkeypatch.setattr(source_audit, name, value)
    rows = _rows(3)
    frame = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS term", "2 AS value")
    got = source_audit.audit(frame.repartition(4))
    assert sorted(tuple(r) for r in got.collect()) == audited(rows)


def test_audit_of_no_rows_and_long_division(spark):
    assert source_audit.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
    n, whole = np.array([0, 7, 10**12, 9 * 10**15 - 4]), 9 * 10**15
    assert source_audit.shares(n, np.int64(whole)).tolist() == [1 + 10**9 * (int(x) + 2) // whole for x in n]
    long = b"Ab1" * 10 + "é".encode() * 5
    assert [w for words in source_audit.terms(long) for w in words] == [b"ab"] * 10 + ["é".encode() * 5]
