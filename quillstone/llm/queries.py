"""The queries of this subpackage: (spark, folder of tables) -> DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import common, decontaminate, digest_index, embedding_dedup, line_dedup, lm_scoring, minhash_dedup, packing, quality, source_audit, token_output, toxicity, vector_codes, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score(table(spark, sf_dir, "documents"), "crc32(cast(doc_id AS string)) % 7 <> 2")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_folder(spark, "token-ids")
    shards = token_output.write(table(spark, sf_dir, "documents"), folder, tokenizer(), end_id=0)
    return token_output.read(spark, folder, shards).drop("ids")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), texts=False)


#: Four folds of five may be learnt from; the fifth is held out.
TRAIN = "crc32(cast(doc_id AS string)) % 5 <> 0"


def held_out(df: DataFrame) -> DataFrame:
    """A row without doc_id isn't held out."""
    return df.withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False)))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, x) for x in ("documents", "labels"))
    model = quality.train(docs, labels, "quality", TRAIN)
    return held_out(quality.scores(docs.select("doc_id", "text"), model, threshold=0.3)).select("doc_id", "held_out", "score", "predicted")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer(), end_id=2, room=1024)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.dedup(table(spark, sf_dir, "documents"), k=4, percent=80)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_folder(spark, "warc")
    files = warc.write(table(spark, sf_dir, "pages"), folder, least=1000)
    return warc.read(spark, folder, files).drop("payload")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, x) for x in ("documents", "labels"))
    return held_out(toxicity.scores(docs, labels, "toxic", TRAIN, threshold=0.5)).select("doc_id", "held_out", "score", "predicted")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.dedup(docs).select("doc_id", "n_lines", "n_removed", F.md5(F.encode("cleaned", "UTF-8")).alias("cleaned_md5"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = digest_index.DigestIndex(spark, common.new_folder(spark, "digest-index"))
    return index.add(table(spark, sf_dir, "documents")).drop("known")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_lm_scoring, op2_token_output, op3_decontamination, op4_quality, op5_embedding_dedup, op6_best_fit_packing, op7_minhash_dedup, op8_warc, op9_toxicity, op10_line_dedup,
    op11_exact_dedup, op12_vector_codes, op13_source_divergence,
)}

def _codes_sql(rounds: int = 2) -> str:
    """Product codes by plain search: each round's assignment and codebook is a table of its own."""
    near = """d{k} AS MATERIALIZED (SELECT vec_id, p, arg_min(e, {{'d': d, 'e': e}}) AS e, min(d) AS d FROM (
            SELECT vec_id, part.p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM part JOIN c{k} USING (p)) GROUP BY vec_id, p)"""
    mean = """c{n} AS MATERIALIZED (
            SELECT p, e, coalesce(m, c) AS c FROM c{k} LEFT JOIN (
                SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM (
                    SELECT p, e, i, sum(x[i]) AS s, count(*) AS n FROM part JOIN d{k} USING (vec_id, p), range(1, 5) AS r(i) GROUP BY p, e, i) GROUP BY p, e) USING (p, e))"""
    steps = [near.format(k=0)]
    for k in range(rounds):
        steps += [mean.format(k=k, n=k + 1), near.format(k=k + 1)]
    return f"""
        WITH v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        part AS MATERIALIZED (SELECT vec_id, p, x[4 * p + 1:4 * p + 4] AS x FROM v, range(16) AS r(p)),
        c0 AS MATERIALIZED (SELECT p, e, x AS c FROM part JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v ORDER BY vec_id LIMIT 64) USING (vec_id)),
        {", ".join(steps)},
        code AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM d{rounds} GROUP BY vec_id),
        book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM code JOIN v USING (vec_id), book"""


#: DuckDB SQL for the queries' rows.
ORACLES: dict[str, str] = {
    "op3_decontamination": r"""
        WITH item AS (
            SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
            WHERE item_id IS NOT NULL AND text IS NOT NULL),
        win AS (
            SELECT DISTINCT item_id, w[i:i + least(10, len(w)) - 1] AS g
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
        doc AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        sizes AS (SELECT DISTINCT len(g) AS n FROM win),
        place AS (
            SELECT doc_id, i, n, w[i:i + n - 1] AS g
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n)),
        hit AS (SELECT doc_id, i, n, item_id FROM place JOIN win USING (g)),
        span AS (SELECT DISTINCT doc_id, i, n FROM hit),
        hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM span) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
            sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op5_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
        reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
        part AS (SELECT a, min(b) AS least FROM reach GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
        SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id <= coalesce(least, vec_id) AS kept
        FROM embeddings LEFT JOIN part ON vec_id = part.a LEFT JOIN n ON vec_id = n.a""",
    "op7_minhash_dedup": r"""
        WITH RECURSIVE doc AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        place AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]) END) AS g FROM doc),
        shingle AS (SELECT DISTINCT doc_id, md5(array_to_string(g, ' ')) AS g FROM place),
        size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
        both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingle AS a JOIN shingle AS b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        link AS (SELECT a, b FROM both_ JOIN size AS x ON x.doc_id = a JOIN size AS y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
        reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
        part AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, doc_id <= coalesce(least, doc_id) AS kept
        FROM documents LEFT JOIN size USING (doc_id) LEFT JOIN part ON doc_id = part.a""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS size FROM pages),
        q AS (SELECT *, sha1(html) AS digest FROM p),
        r AS (SELECT digest, max(page_id) AS last FROM q WHERE size >= 1000 GROUP BY digest HAVING count(*) > 1)
        SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
            CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
        FROM q LEFT JOIN r USING (digest)""",
    "op10_line_dedup": """
        WITH line AS (
            SELECT doc_id, source, i, string_split(text, chr(10))[i] AS raw
            FROM (SELECT doc_id, source, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
        long AS (SELECT doc_id, source, i, trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS l FROM line WHERE length(trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) >= 20),
        spread AS (SELECT l, min({'d': doc_id, 'i': i}) AS first FROM long GROUP BY l HAVING count(DISTINCT source) >= 3),
        gone AS (SELECT doc_id, i FROM long JOIN spread USING (l) WHERE {'d': doc_id, 'i': i} <> first),
        kept AS (
            SELECT doc_id, count(*) AS n_lines, count(gone.i) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY line.i) FILTER (WHERE gone.i IS NULL), '') AS cleaned
            FROM line LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, md5(cleaned) AS cleaned_md5
        FROM documents LEFT JOIN kept USING (doc_id)""",
    "op11_exact_dedup": r"""
        WITH t AS (SELECT doc_id, coalesce(length(text), 0) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
        g AS (SELECT h, arg_min(doc_id, {'n': -n, 'd': doc_id}) AS keep_id, count(*) AS group_size FROM t GROUP BY h)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM t JOIN g USING (h)""",
    "op12_vector_codes": _codes_sql(),
    "op13_source_divergence": r"""
        WITH doc AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
        term AS (
            SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM doc),
        lt AS MATERIALIZED (SELECT lang, t, count(*) AS n FROM term GROUP BY lang, t HAVING count(DISTINCT r) >= 10),
        gt AS (SELECT lang, source, t, count(*) AS n FROM term GROUP BY lang, source, t),
        g AS (SELECT DISTINCT lang, source FROM doc),
        l AS (SELECT lang, sum(n)::HUGEINT + 2 * count(*) AS w FROM lt GROUP BY lang),
        cell AS (SELECT g.lang, g.source, lt.t, coalesce(gt.n, 0) AS n, 1 + 1000000000::HUGEINT * (lt.n + 2) // l.w AS q FROM g JOIN lt USING (lang) JOIN l USING (lang) LEFT JOIN gt USING (lang, source, t)),
        p AS MATERIALIZED (SELECT *, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER w + 2 * count(*) OVER w) AS p FROM cell WINDOW w AS (PARTITION BY lang, source)),
        f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS f FROM p AS a JOIN p AS b USING (lang, t) WHERE a.source <> b.source GROUP BY a.lang, a.source, b.source),
        pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
        own AS (SELECT lang, source, 'term' AS part, t AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM own))
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10""",
}
