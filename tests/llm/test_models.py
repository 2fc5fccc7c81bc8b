import math
import random
import re
import time
import tracemalloc
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.llm import common, lm_scoring, quality, queries, toxicity


def corpus(n, seed=0):
    random.seed(seed)
    a, b = [f"the{i}" for i in range(40)], [f"der{i}" for i in range(40)]
    return [(d, " ".join(random.choices(a if d % 2 else b, k=random.randint(0, 60))) + ("." if d % 3 else "")) for d in range(n)]


def test_base_scores_equal_brute_force_and_the_model_learns(spark):
    docs = corpus(300)
    got = {r.doc_id: r for r in lm_scoring.score(spark.createDataFrame(docs, "doc_id bigint, text string"), "crc32(cast(doc_id AS string)) % 7 <> 2").collect()}
    counts = Counter()
    for d, t in docs:
        if crc32(str(d).encode()) % 7 != 2:
            counts.update(t.lower().split())
            counts["\n"] += 1
    total, distinct = sum(counts.values()), len(counts)
    model = base = 0.0
    for d, t in docs:
        tokens = [*t.lower().split(), "\n"]
        want = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens)
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), total) and abs(r.base_score - want) < 1e-6
        if crc32(str(d).encode()) % 7 == 2:
            model, base = model + r.score, base + want
    assert model > base


def test_rare_words_get_their_counts_by_the_join(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(80), "doc_id bigint, text string")
    whole = {r.doc_id: r for r in lm_scoring.score(docs).collect()}
    monkeypatch.setattr(lm_scoring, "TABLE", 5)
    few = {r.doc_id: r for r in lm_scoring.score(docs).collect()}
    assert all(few[d].n_known == r.n_known and abs(few[d].base_score - r.base_score) < 1e-9 for d, r in whole.items())


def test_the_end_is_known_however_rare_it_is(spark, monkeypatch):
    docs = [(0, "a b c " * 50), (1, "a b c d e f " * 40)]
    monkeypatch.setattr(lm_scoring, "TABLE", 2)
    counts = Counter(w for _, t in docs for w in [*t.split(), "\n"])
    total, distinct = sum(counts.values()), len(counts)
    for r in lm_scoring.score(spark.createDataFrame(docs, "doc_id bigint, text string")).collect():
        tokens = [*docs[r.doc_id][1].split(), "\n"]
        assert r.n_known == r.n_tokens == len(tokens)
        assert abs(r.base_score - sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens)) < 1e-6


def test_scoring_memory_follows_the_tokens_not_the_longest_document():
    net, rng = lm_scoring.Network(6, 4), np.random.default_rng(0)
    docs = [np.append(rng.integers(1, 6, n), 0) for n in (60_000, *[3] * 400)]
    tracemalloc.start()
    got = lm_scoring.score_documents(net, docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000
    assert abs(got[1] - lm_scoring.score_documents(net, docs[1:2])[0]) < 1e-4


def test_class_probabilities_add_up_to_one_and_gradients_are_right():
    net = lm_scoring.Network(6, 4)
    docs = [np.array([1, 2, 3, 0]), np.array([0]), np.array([5, 5, 0])]
    whole = lm_scoring.score_documents(net, docs)
    for k, d in enumerate(docs):
        h, total, x = np.zeros((1, 4), np.float32), 0.0, 0
        for t in d:
            h = net.step(h if x else h * 0, np.array([x]))[0]
            p, s = net.surprise(h)
            assert abs(float((p / s[:, None]).sum()) - 1) < 1e-5
            total += math.log(float(p[0, t] / s[0]))
            x = t
        assert abs(total - whole[k]) < 1e-4
    x, y = np.array([[0, 2], [1, 3], [2, 0]]), np.array([[1, 3], [2, 0], [3, 4]])
    loss = lambda: -sum(math.log(p[k, t] / s[k]) for (p, s), t_ in zip(_run(net, x), y, strict=True) for k, t in enumerate(t_)) / y.size
    before = {k: v.copy() for k, v in net.p.items()}
    trainer = lm_scoring.Trainer(net, 1.0)
    trainer.window(np.zeros((2, 4), np.float32), x, y)
    grads = {k: 10 * m for k, m in trainer.m.items()}
    net.p.update({k: v.astype(np.float64) for k, v in before.items()})
    for k, v in net.p.items():
        at = np.unravel_index(np.abs(grads[k]).argmax(), v.shape)
        keep = v[at]
        v[at] = keep + 1e-4
        high = loss()
        v[at] = keep - 1e-4
        low = loss()
        v[at] = keep
        assert abs((high - low) / 2e-4 - grads[k][at]) < 1e-3 * max(1, abs(grads[k][at]))


def _run(net, x):
    h = np.zeros((x.shape[1], 4))
    for row in x:
        h = net.step(h * (row != 0)[:, None], row)[0]
        yield net.surprise(h)


def test_lm_edges(spark, odd):
    got = lm_scoring.score(odd).collect()
    assert len(got) == odd.count() and all(math.isfinite(r.score) for r in got)
    assert [r.n_tokens for r in got if r.doc_id == 1] == [1]
    assert lm_scoring.score(odd.limit(0)).count() == 0
    nothing = lm_scoring.score(odd, "false").collect()
    assert sum(r.n_known for r in nothing if r.doc_id is not None) == 0  # null ids are learnt from


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(0)
    total = rng.integers(0, 5, 30).astype(float)
    ones = np.minimum(total, rng.integers(0, 5, 30))
    rate = quality.isotonic(total, ones)
    known = rate[total > 0]
    assert (np.diff(known) >= -1e-12).all()
    y, w = ones[total > 0] / total[total > 0], total[total > 0]
    want = [max(min(np.average(y[a : b + 1], weights=w[a : b + 1]) for b in range(i, len(y))) for a in range(i + 1)) for i in range(len(y))]
    assert np.allclose(known, want)


def test_segments_equal_the_definition():
    rng = np.random.default_rng(1)

    def ruzzo_tompa(s, a, b):
        """Recursive definition: the best segment (longest of equals by extension), then both sides of it."""
        best = max(((sum(s[i:j]), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0), key=lambda x: (round(x[0], 9), x[1] - x[2]))
        if best[0] <= 0:
            return []
        return ruzzo_tompa(s, a, best[1]) + [(best[1], best[2])] + ruzzo_tompa(s, best[2], b)

    for _ in range(200):
        s = rng.normal(size=int(rng.integers(1, 14)))
        got = toxicity.segments(s)
        assert [(a, b) for a, b, _ in got] == ruzzo_tompa(s.tolist(), 0, len(s))
        assert all(abs(p - s[a:b].sum()) < 1e-9 for a, b, p in got)


def test_the_scan_is_linear():
    took = []
    for n in (20_000, 160_000):
        s = np.tile([1.0, -2.0], n // 2)
        begin = time.process_time()
        assert len(toxicity.segments(s)) == n // 2
        assert len(toxicity.segments(-s[::-1])) == 1
        took.append(time.process_time() - begin)
    assert took[1] < 40 * max(took[0], 0.02)


def _labelled(n):
    random.seed(6)
    rows, labels = [], []
    for d in range(n):
        words = random.choices([f"word{i}" for i in range(200)], k=random.randint(5, 80))
        toxic, junk = d % 5 == 0, d % 7 == 0
        if toxic:
            words[random.randrange(len(words))] = random.choice(["scumbag", "moronic", "idiotic"])
        if junk:
            words = [w.upper() + "!!" for w in words]
        rows.append((d, " ".join(words)))
        labels.append((d, int(not junk), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = _labelled(1200)
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    q = quality.scores(docs, quality.train(docs, labels, "quality", queries.TRAIN)).join(labels, "doc_id").where(held)
    t = toxicity.scores(docs, labels, "toxic", queries.TRAIN).join(labels, "doc_id").where(held)
    assert q.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.97
    assert t.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double"))).first()[0] > 0.97


def test_quality_equals_brute_force(labelled):
    """The same scores from all rows at once: standardise, cosine features, ridge by least squares, isotonic rates of bins."""
    docs, labels = labelled
    y = {r.doc_id: r.quality for r in labels.collect()}
    fold = lambda d: crc32(str(d).encode()) % 5
    texts = {r.doc_id: r.text for r in docs.collect()}
    x = {d: np.array(quality.statistics(t)) for d, t in texts.items()}
    known = sorted(d for d in y if fold(d) != 0)
    rows = np.array([x[d] for d in known])
    mean, scale = rows.mean(axis=0), np.maximum(rows.std(axis=0), 1e-6)
    rng, n = np.random.default_rng(quality.SEED), quality.FEATURES
    w = rng.normal(size=(rows.shape[1], n)) / (quality.WIDTH * np.sqrt(rows.shape[1]))
    phase = rng.uniform(0, 2 * np.pi, n)
    z = lambda ds: np.column_stack([np.sqrt(2 / n) * np.cos(np.clip((np.array([x[d] for d in ds]) - mean) / scale, -6, 6) @ w + phase), np.ones(len(ds))])
    fit, check = [d for d in known if fold(d) != 4], [d for d in known if fold(d) == 4]
    penalty = np.sqrt(quality.RIDGE * len(fit)) * np.eye(n + 1)[:n]
    beta = np.linalg.lstsq(np.vstack([z(fit), penalty]), np.append([y[d] for d in fit], np.zeros(n)), rcond=None)[0]
    bins = np.clip(((z(check) @ beta + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    total, ones = np.bincount(bins, minlength=quality.BINS).astype(float), np.bincount(bins, weights=[y[d] for d in check], minlength=quality.BINS)
    rate = quality.isotonic(total, ones)
    seen = total > 0
    centre = (np.arange(quality.BINS) + 0.5) / quality.BINS * 2 - 0.5
    levels = np.unique(rate[seen])
    at = [np.average(centre[seen][rate[seen] == v], weights=total[seen][rate[seen] == v]) for v in levels]
    every = sorted(texts)
    want = np.interp(z(every) @ beta, at, levels)
    got = {r.doc_id: r.score for r in quality.scores(docs, quality.train(docs, labels, "quality", queries.TRAIN)).collect()}
    assert np.allclose([got[d] for d in every], want, atol=1e-6)


def test_toxicity_equals_brute_force(labelled):
    """Lexicon, segments, law and curve from all rows at once."""
    docs, labels = labelled
    y = {r.doc_id: r.toxic for r in labels.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    fold = lambda d: crc32(str(d).encode()) % 5
    counts = [Counter(), Counter()]
    for d, t in texts.items():
        if fold(d) not in (0, 4):
            counts[y[d]].update(u for w in toxicity.tokens(t) for u in toxicity.units(w))
    clean, toxic = (sum(c.values()) for c in counts)
    odds = {}
    for u, t in counts[1].items():
        c = counts[0][u]
        p = toxicity.FLOOR + toxicity.PRIOR / (clean + toxic) * (c + t)
        o = math.log((t + p) / (toxic + toxicity.PRIOR - t - p)) - math.log((c + p) / (clean + toxicity.PRIOR - c - p))
        if t > 1 and o > toxicity.DRIFT and o / math.sqrt(1 / (t + p) + 1 / (c + p)) >= toxicity.LEAST_Z:
            odds[u] = o
    score = lambda w: max((odds[u] for u in toxicity.units(w) if u in odds), default=0.0) - toxicity.DRIFT
    found = {d: (len(toxicity.tokens(t)), [p for *_, p in toxicity.segments(np.array([score(w) for w in toxicity.tokens(t)] or [0.0]))]) for d, t in texts.items()}
    calm = [found[d] for d in texts if fold(d) == 4 and not y[d]]
    size = sum(n for n, _ in calm)
    seen = Counter(round(p, 1) for _, ps in calm for p in ps)
    shape = min(toxicity.decay(Counter({-toxicity.DRIFT: max(size - sum(seen.values()), 1)}) + seen), 2.0)
    rate = max(sum(k * math.exp(min(shape * s, 50)) for s, k in seen.items()) / max(len(seen), 1) / size, 1 / size)
    law = toxicity.Calibration(shape, rate)
    evidence = {d: math.log1p(sum(law.each(n, ps))) for d, (n, ps) in found.items()}
    e, label = (np.array(v) for v in zip(*[(min(round(evidence[d], 2), 20), y[d]) for d in texts if fold(d) == 4], strict=True))
    loss = lambda a, b: float(np.logaddexp(0, a * e + b).sum() - label @ (a * e + b)) + 0.005 * (a * a + b * b)
    got = {r.doc_id: r.score for r in toxicity.scores(docs, labels, "toxic", queries.TRAIN).collect()}
    ids = [d for d in texts if 1e-6 < got[d] < 1 - 1e-6]
    logit = np.array([math.log(got[d] / (1 - got[d])) for d in ids])
    a, b = np.polyfit([evidence[d] for d in ids], logit, 1)  # the curve that was fitted, read off the scores
    assert np.allclose(logit, [a * evidence[d] + b for d in ids], atol=1e-6)
    assert all(loss(a, b) <= loss(a + da, b + db) + 1e-9 for da in (-1e-3, 0, 1e-3) for db in (-1e-3, 0, 1e-3))


def test_one_clean_text_that_repeats_a_word_does_not_flatten_the_law(spark):
    """Long toxic texts, whose passages stand out against chance only under the law of the other clean texts, are still caught."""
    random.seed(9)
    fold = lambda d: crc32(str(d).encode()) % 5
    rows, labels, some = [], [], 0
    for d in range(500):
        words = random.choices([f"word{i}" for i in range(200)], k=random.choice([100, 1500]))
        if toxic := d % 5 == 0:
            for k in range(0, len(words), 50):
                words[k] = random.choice(["scumbag", "moronic", "idiotic"])
            if some < 12 and fold(d) not in (0, 4):  # a word that a few toxic texts of the lexicon's part have by chance
                words[-1] = "harmless"
                some += 1
        rows.append((d, " ".join(words)))
        labels.append((d, int(toxic)))
    odd = [d for d, y in labels if fold(d) == 4 and not y][0]
    rows[odd] = (odd, " ".join(["harmless"] * 400))
    got = {r.doc_id: r.predicted for r in toxicity.scores(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"), "toxic", queries.TRAIN).collect()}
    assert some == 12 and got == dict(labels)


def test_segments_of_other_text_are_left_out_of_the_law():
    seen = Counter({0.2: 300, 0.9: 120, 1.9: 30, 3.1: 4})
    law, with_one = toxicity.fit_law(seen, 2_000_000), toxicity.fit_law(seen + Counter({56.3: 1}), 2_000_000)
    assert (with_one.shape, with_one.rate) == (law.shape, law.rate) and law.shape > 1
    assert toxicity.fit_law(Counter({40.0: 3}), 100).shape == 1 == toxicity.fit_law(Counter(), 0).shape


def test_further_occurrences_of_a_word_count_less():
    t = [b"idiot", b"so", b"idiot!", b"fool", b"(idiot)"]
    got = toxicity.halved(t, np.array([4.0, -2.0, 4.0, 1.0, 4.0])) + toxicity.DRIFT
    assert got.tolist() == [6.0, 0.0, 3.0, 3.0, 1.5]


def test_passages_hold_every_repeat_of_a_word(spark, labelled):
    docs, labels = labelled
    words = [f"word{i % 200}" for i in range(400)]
    words[::50] = ["idiotic"] * 8
    every = docs.unionByName(spark.createDataFrame([(9999, " ".join(words))], docs.schema))
    row = toxicity.scores(every, labels).where("doc_id = 9999").first()
    inside = {i for p in row.passages for i in range(p["first"], p["after"])}
    assert row.predicted == 1 and set(range(0, 400, 50)) <= inside


def test_passages_are_where_the_words_are(labelled):
    docs, labels = labelled
    for r in toxicity.scores(docs, labels).where("predicted = 1").join(docs, "doc_id").limit(20).collect():
        words = r.text.lower().split()
        assert any(x in " ".join(w for p in r.passages for w in words[p["first"] : p["after"]]) for x in ("scumbag", "moronic", "idiotic"))


def test_classifier_edges(spark, odd, labelled):
    docs, labels = labelled
    model = quality.train(docs, labels)
    got = quality.scores(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.scores(odd.limit(0), model).count() == 0
    none = labels.limit(0)
    assert {r.score for r in quality.scores(odd, quality.train(odd, none)).collect()} == {0.5}
    strange = spark.createDataFrame([(0, 1, None), (0, 0, 1), (None, 1, 1), (5, None, 0), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert quality.scores(odd, quality.train(odd, strange)).count() == odd.count()
    tox = toxicity.scores(odd, strange).collect()
    assert len(tox) == odd.count() and all(0 <= r.score <= 1 for r in tox)
    assert toxicity.scores(odd.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.scores(odd, none).collect()} == {0.5}


def test_words_and_classes_equal_a_plain_reading():
    texts = ["  The\x0bthe THE.\t", None, "", " \n", "É É\x1cx\x85y\xa0z\x00 ß", "w" * 40 + " a " + "w" * 33, "unseen, unseen.", "a"]
    pattern = re.compile(rb"[^\x20\x09-\x0D]+")
    lists = [pattern.findall((t or "").encode().lower()) for t in texts]
    for array in (pa.array(texts), pa.array([*texts, *texts]).slice(len(texts)), pa.array(texts, pa.large_string())):
        found, n = lm_scoring.words(array)
        assert found.to_pylist() == [w for ws in lists for w in ws] and n.tolist() == [len(ws) for ws in lists]
    classes = lm_scoring.Classes([b"the", b"a"], [b"2en", b"0ww"])
    heard = {b"the": 2.0, b"a": 1.5, lm_scoring.key(b"w" * 40): 1.0, lm_scoring.END: 0.5}
    for end in (True, False):
        table = {w: x for w, x in heard.items() if end or w != lm_scoring.END}
        known = lm_scoring._Known(pa.array(list(table), pa.binary()), classes, np.array(list(table.values())))
        seq, sizes, points, rare, n_rare = known.read(pa.array(texts))
        by_key = [[lm_scoring.key(w) for w in ws] for ws in lists]
        assert seq.tolist() == [c for ws in by_key for c in [*(classes[w] for w in ws), 0]] and sizes.tolist() == [len(ws) + 1 for ws in by_key]
        assert np.allclose(points, [sum(table.get(w, 0) for w in [*ws, lm_scoring.END]) for ws in by_key])
        assert rare.to_pylist() == [w for ws in by_key for w in ws if w not in table] and n_rare.tolist() == [sum(w not in table for w in ws) for ws in by_key]


def test_words_are_looked_up_once_for_learning_and_scoring(spark, monkeypatch):
    written, cut = [], common.cut
    monkeypatch.setattr(common, "cut", lambda df: written.append(cut(df)) or written[-1])
    docs = spark.createDataFrame(corpus(40), "doc_id bigint, text string")
    lm_scoring.score(docs, "doc_id > 3").collect()
    ids = {r.doc_id: r for df in written if "ids" in df.columns for r in df.collect()}
    assert len(ids) == 40 and all(len(r.ids) == r.n_tokens and r.ids[-1] == 0 and r.learnt == (r.doc_id > 3) for r in ids.values())
