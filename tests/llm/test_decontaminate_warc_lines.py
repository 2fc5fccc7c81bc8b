import hashlib
import random

from quillstone.llm import common, decontaminate, line_dedup, warc


def brute(text, items, window):
    w = decontaminate.words(text)
    hit, found = set(), set()
    for k, t in items:
        t = decontaminate.words(t)
        grams = {tuple(t[i : i + window]) for i in range(len(t) - window + 1)} if len(t) >= window else {tuple(t)} if t else set()
        for g in grams:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found.add(k)
    return len(w), len(hit), found


def test_automaton_equals_brute_force():
    random.seed(1)
    for _ in range(300):
        word = lambda: random.choice("abc")
        items = [(k, " ".join(word() for _ in range(random.randint(0, 9)))) for k in range(4)]
        text = " ".join(word() for _ in range(random.randint(0, 30)))
        a = decontaminate.Automaton([(k, decontaminate.words(t)) for k, t in items], 4)
        spans, found = a.scan(decontaminate.words(text))
        n, hit, want = brute(text, items, 4)
        assert (sum(e - b for b, e in spans), found) == (hit, want)


def test_decontamination_cuts_spans_and_drops_mostly_hit_documents(spark, odd):
    item = "Alpha beta, gamma delta epsilon zeta eta theta iota KAPPA lambda"
    docs = spark.createDataFrame([(1, f"Before it all. {item.lower()}! And then some more words to follow it here, now and then."), (2, item), (3, "clean"), (4, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (None, "x y"), (9, "...")], "item_id bigint, text string")
    for block in (2_000_000, 2):  # in one automaton or several
        got = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench, block_words=block).collect()}
        assert got[1].n_hit == 11 and got[1].n_items == 1 and got[1].cleaned.startswith("Before it all. !") and "gamma" not in got[1].cleaned
        assert got[2].cleaned is None and got[3].cleaned == "clean" and not got[3].contaminated
        assert got[4].n_words == 0 and got[4].cleaned is None and got[4].items_sha256 == hashlib.sha256(b"").hexdigest()
    clash = odd.withColumnRenamed("score", "n_hit")
    assert decontaminate.decontaminate(clash, bench).count() == clash.count()
    assert decontaminate.decontaminate(odd.limit(0), bench.limit(0)).count() == 0


def test_warc_round_trip_with_revisits(spark):
    big, other = "é" * 600, "z" * 1200
    rows = [(1, "http://a/é", big), (5, "http://b", big), (3, None, big), (2, "u", other), (4, "u", None), (6, "u", "small"), (7, "u", "small"), (None, "n", big), (8, "u", ""), (5, "http://b", big)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, size int")
    folder = common.new_folder(spark, "w")
    files = warc.write(pages.repartition(3), folder)
    got = warc.read(spark, folder, files).collect()
    assert len(got) == len(rows)
    kinds = sorted((r.page_id if r.page_id is not None else -1, r.record_type, r.refers_to) for r in got)
    assert kinds == [(-1, "revisit", 5), (1, "revisit", 5), (2, "response", None), (3, "revisit", 5), (4, "response", None), (5, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (8, "response", None)]
    assert all(r.payload_bytes == 1200 and r.payload_digest == hashlib.sha1(big.encode()).hexdigest() for r in got if r.record_type == "revisit")
    assert {bytes(r.payload) for r in got if r.page_id in (6, 7)} == {b"small"}
    assert warc.read(spark, folder, warc.write(pages.limit(0), common.new_folder(spark, "w"))).count() == 0


def test_a_payload_on_half_the_pages_is_split(spark):
    hot = "h" * 3000
    pages = spark.createDataFrame([(i, f"u{i}", hot if i % 2 else f"{i} " * 300) for i in range(4000)], "page_id bigint, url string, html string").repartition(4)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(old, ("-1", "16", "false"), strict=True):
            spark.conf.set(k, v)
        folder = common.new_folder(spark, "w")
        files = warc.write(pages, folder)
        sizes = [r.n_records for r in files.collect()]
        assert len(sizes) == 16 and sum(sizes) == 4000 and max(sizes) < 2 * 250
        got = {r.page_id: r for r in warc.read(spark, folder, files).drop("payload").collect()}
        assert all(got[i].refers_to == 3999 for i in range(1, 3998, 2)) and got[3999].record_type == "response" and len(got) == 4000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_archives_end_with_the_record_that_reaches_their_bytes(spark):
    pages = spark.createDataFrame([(i, None, "p" * 2000 + str(i)) for i in range(50)], "page_id bigint, url string, html string").coalesce(1)
    folder = common.new_folder(spark, "w")
    files = warc.write(pages, folder, archive_bytes=10_000)
    assert sum(r.n_records for r in files.collect()) == 50 and max(r.n_records for r in files.collect()) <= 5
    assert sorted(r.page_id for r in warc.read(spark, folder, files).collect()) == list(range(50))


def test_line_dedup_equals_brute_force_and_keeps_first_places(spark, odd):
    random.seed(2)
    lines = [f"this is a line that some sites share, number {i}" for i in range(12)] + ["short", ""]
    around = ["", " ", "\t", "\r", " \x0b\x0c"]
    rows = [(d, "\n".join(random.choice(around) + x + random.choice(around) for x in random.choices(lines, k=random.randint(1, 6))), f"s{random.randint(0, 7)}" if d % 9 else None) for d in range(120)]
    spread, first = {}, {}
    for d, t, s in rows:
        for i, x in enumerate(t.split("\n")):
            if len(x.strip()) >= 20:
                spread.setdefault(x.strip(), set()).add(s)
                first.setdefault(x.strip(), (d, i))
    bad = {x for x, s in spread.items() if len(s - {None}) >= 5}
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if x.strip() not in bad or first[x.strip()] == (d, i)) for d, t, _ in rows}
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), sites=5).collect()
    assert {r.doc_id: r.cleaned for r in got} == want
    assert line_dedup.dedup(odd).count() == odd.count()
    same = {(r.doc_id, r.n_removed) for r in line_dedup.dedup(odd).collect() if r.text and r.text.startswith("The quick")}
    assert same == {(None, 0), (0, 1), (5, 1)}  # null ids come first
    assert line_dedup.dedup(odd.limit(0)).count() == 0
