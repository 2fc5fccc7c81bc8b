import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillstone.llm import common, packing, token_output, tokens
from quillstone.llm.tokens import Encoder


def test_encoder_equals_the_library(tokenizer):
    e, plain = Encoder(tokenizer), Tokenizer.from_file(tokenizer)
    random.seed(4)
    parts = [" ", "  ", "\n", "\t", "a", "b'", "'s", "é", "1", "_", "-", "　", " ", "​", ".", "\r", "日", "<|endoftext|>", "\x85", "\x1c"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 12))) for _ in range(3000)] + ["word " * 500, "x" * 5000, ""]
    assert all(np.frombuffer(x, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids for t, x in zip(texts, e.encode(texts), strict=True))


def test_round_trip_and_short_document_access(spark, odd, tokenizer):
    folder = common.new_folder(spark, "t")
    shards = token_output.write(odd, folder, tokenizer, end_id=0, shards=3)
    got = token_output.read(spark, folder, shards).orderBy("start").collect()
    plain = Tokenizer.from_file(tokenizer)
    want = sorted(((r.doc_id, [*plain.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in got] == [d for d, _ in want]
    start = 0
    texts = {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert r.start == start and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(r.ids)
        texts.setdefault(r.doc_id, []).append(ids.tolist())
        start += len(ids)
    assert all(ids in texts[d] for d, ids in want)
    first = shards.where("n_docs > 0").orderBy("shard").first()
    assert token_output.fetch(folder, first["shard"], 0).tolist() == np.frombuffer(got[0].ids, "<u4").tolist()


def test_documents_without_text_fill_shards_too_and_are_found_by_search(spark, monkeypatch, tokenizer):
    monkeypatch.setattr(token_output, "SHARD_DOCS", 500)
    monkeypatch.setattr(token_output, "SOME", 7)
    folder = common.new_folder(spark, "t")
    rows = [(None, "null id"), (-5, "below 0"), *((3 * i, None if i % 3 else "") for i in range(2000)), (12, "twice"), (7000, "a word " * 3000)]
    shards = token_output.write(spark.createDataFrame(rows, "doc_id bigint, text string"), folder, tokenizer, end_id=0)
    sizes = [r.n_docs for r in shards.collect()]
    assert len(sizes) == 5 and sum(sizes) == len(rows) and max(sizes) < 1000
    got = token_output.read(spark, folder, shards).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(r[0] for r in rows if r[0] is not None)
    at = {(k, r.doc_id): r for k in range(5) for r in token_output.read(spark, folder, shards.where(f"shard = {k}")).collect()}
    for (k, doc), r in list(at.items())[::97] + [((k, d), r) for (k, d), r in at.items() if d in (None, -5, 7000)]:
        assert token_output.find(folder, k, doc).tolist() == np.frombuffer(r.ids, "<u4").tolist()
    with pytest.raises(KeyError):
        token_output.find(folder, 0, 1)


def test_a_shard_of_another_dictionary_is_refused(spark, odd, tokenizer):
    folder = common.new_folder(spark, "t")
    shards = token_output.write(odd, folder, tokenizer, shards=1)
    common.write_file(folder, "dictionary.zdict", iter([b"other"]), "x")
    with pytest.raises(Exception, match="dictionary"):
        token_output.read(spark, folder, shards).collect()


def test_token_output_of_nothing(spark, empty, tokenizer):
    folder = common.new_folder(spark, "t")
    assert token_output.read(spark, folder, token_output.write(empty, folder, tokenizer, shards=2)).count() == 0


def _valid(plan, histogram, room):
    used = {}
    for kind, times in plan:
        assert times > 0 and sum(n * c for n, c in kind.items()) <= room
        for n, c in kind.items():
            used[n] = used.get(n, 0) + c * times
    return used == {k: v for k, v in histogram.items() if v}


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_piece_and_are_no_worse_than_best_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 129, 3000), rng.integers(40, 100, 2000), np.minimum(128, rng.lognormal(3, 1, 500).astype(int) + 1), np.array([128, 70, 58, 1])][seed]
    h = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
    p = packing.plan(dict(h), 128)
    assert _valid(p, h, 128) and _valid(packing.best_fit(dict(h), 128), h, 128)
    assert sum(t for _, t in p) <= 1.005 * sum(t for _, t in packing.best_fit(dict(h), 128)) + 1


def test_pricing_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths, values = rng.choice(np.arange(2, 12), 4, replace=False), rng.random(4)
        got = packing.price(values, lengths, 20)
        best = max(sum(v * c for v, c in zip(values, cs, strict=True)) for cs in np.ndindex(11, 11, 11, 11) if sum(n * c for n, c in zip(lengths, cs, strict=True)) <= 20)
        assert (got * lengths).sum() <= 20 and abs((got * values).sum() - best) < 1e-9


def test_packed_pieces_fill_sequences_without_gaps(spark, odd, tokenizer):
    plain = Tokenizer.from_file(tokenizer)
    got = packing.pack(odd, tokenizer, end_id=2, room=64).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    ids = [*plain.encode(next(r.text for r in odd.collect() if r.doc_id == 4), add_special_tokens=False).ids, 2]
    pieces = sorted((r for r in got if r.doc_id == 4), key=lambda r: r.piece)
    assert [p.length for p in pieces[1:]] == [64] * (len(pieces) - 1) and sum(p.length for p in pieces) == len(ids)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    assert sum(r.doc_id == 5 for r in got) == 2 and sum(r.doc_id is None for r in got) == 2


def test_small_partitions_cost_packing_no_files_of_spark_each(spark, tokenizer):
    # each such file makes an executor's JVM start processes, which count as large as itself until they run their program
    made = len(common._made)
    rows = [(i % 50, None if i % 9 == 0 else "word " * (i * 7 % 300)) for i in range(120)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(60), tokenizer, end_id=2, room=64)
    assert got.rdd.getNumPartitions() == 1
    pieces = got.collect()
    folders = [Path(x.removeprefix("file://")) for x in common._made[made:]]
    assert not [f for x in folders for f in x.rglob("*.parquet")]
    one = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), tokenizer, end_id=2, room=64).collect()
    assert sorted(x[:5] for x in pieces) == sorted(x[:5] for x in one)
    by = {}
    for x in pieces:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert len(by) == len({x.sequence_id for x in one})
    for places in by.values():
        ends = np.cumsum([n for _, n in sorted(places)]).tolist()
        assert [at for at, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 64


def test_packing_of_nothing(spark, empty, tokenizer):
    assert packing.pack(empty, tokenizer).count() == 0


def test_words_that_come_once_dont_take_the_places_of_those_that_come_again(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED_WORDS", 100)
    e = Encoder(tokenizer)
    letters = [chr(97 + i) + chr(97 + j) + chr(97 + k) for i in range(26) for j in range(26) for k in range(26)]
    e.encode(["x " + " ".join(letters[:2000])])
    for _ in range(9):
        e.encode(["x zebra apple, zebra apple, zebra"])
    assert {"zebra", "apple,"} <= e.words.keys() and len(e.words) <= 100


def test_words_in_parts_equal_the_library(tokenizer):
    e, plain = Encoder(tokenizer), Tokenizer.from_file(tokenizer)
    random.seed(8)
    parts = ["that", "É", "ǅ", "9", "'s", "'", "\n", "\n\n", "\x1c", "\x85", " ", "　", ".", "$$", "…", "́", "Ⅷ", "_"]
    texts = ["a " + "".join(random.choices(parts, k=random.randint(1, 6))) + random.choice([" b", "", " ", "\n"]) for _ in range(5000)]
    for grouped in (False, True):  # anew, then partly remembered
        assert all(np.frombuffer(x, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids for t, x in zip(texts, e.encode(texts, grouped), strict=True))


def test_each_distinct_word_is_looked_up_once(tokenizer, monkeypatch):
    e, plain, asked = Encoder(tokenizer), Tokenizer.from_file(tokenizer), []
    monkeypatch.setattr(tokens._Words, "__missing__", lambda self, word, f=tokens._Words.__missing__: asked.append(word) or f(self, word))
    e.words.places = 0  # nothing is remembered
    texts = ["some words here", None, "", "here", " words some some", "words here " * 3 + "é"] * 3
    assert all(np.frombuffer(x, "<u4").tolist() == (plain.encode(t, add_special_tokens=False).ids if t else []) for t, x in zip(texts, e.encode(texts, grouped=True), strict=True))
    assert asked.count("words") == 1
    monkeypatch.setattr(tokens, "TOGETHER", 20)
    assert e.encode(texts, grouped=True) == Encoder(tokenizer).encode(texts)
