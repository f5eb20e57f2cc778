"""The queries of this subpackage, each with production parameters over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.ball_tree import top_inner_products
from sedimenta.llm.byte_bpe import bpe_round_trip
from sedimenta.llm.collocations import collocations
from sedimenta.llm.decontaminate import contaminated
from sedimenta.llm.html_text import render_pages
from sedimenta.llm.importance import importance_sample
from sedimenta.llm.jaccard_join import jaccard_classes
from sedimenta.llm.language_id import fit_languages, held_out, identify_languages
from sedimenta.llm.near_dedup import near_duplicates
from sedimenta.llm.repeated_bytes import remove_repeats
from sedimenta.sources.scratch import Scratch
from sedimenta.llm.shuffle_shards import shuffle_shards, write_shards
from sedimenta.llm.surrogates import replace_entities
from sedimenta.llm.warc_index import merge_runs, positions, sorted_runs, write_archives

#: The key of the surrogates; a deployment passes its own.
SURROGATE_KEY = "sedimenta"
VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(spark.read.parquet(f"{sf_dir}/documents.parquet"), SURROGATE_KEY)


def op2_superminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "kept")


def op3_html_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_seed_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_hash")


def op5_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    shuffled = write_shards(shuffle_shards(spark.read.parquet(f"{sf_dir}/documents.parquet")), Scratch(spark, "shards").path("written"))
    text = F.coalesce("record.text", F.lit(""))
    return shuffled.select(
        F.col("record.doc_id").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), "shard", "slot", "grown_shard",
    )


def op6_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = F.col("held_out")
    model = fit_languages(docs.where(~held_out(F.col("doc_id"))))
    found = identify_languages(docs, model)
    return found.withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", out, "lang_pred", "score", "accepted")


def op7_deep_shallow_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op8_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_inner_products(rows.where("vec_id % 50 = 0"), rows)


def op9_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch.path("archives"))
    runs = scratch.keep(sorted_runs(spark, scratch.path("archives")), "runs")
    index = scratch.keep(merge_runs(runs), "index")
    return positions(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "position")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance_sample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii_surrogates, op2_superminhash_dedup, op3_html_rendering, op4_seed_alignment, op5_external_shuffle, op6_centroid_language, op7_deep_shallow_repeats, op8_ball_tree_topk, op9_warc_index_merge, op10_byte_bpe, op11_importance_resampling, op12_collocations, op13_jaccard_join)
}

SQL: dict[str, str] = {
    "op2_superminhash_dedup": r"""
        WITH RECURSIVE toks AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM toks WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
            FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (
            SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
        edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach(node, least) AS (
            SELECT doc_id, doc_id FROM documents
            UNION SELECT e.b, r.least FROM reach r JOIN edges e ON e.a = r.node WHERE r.least < e.b),
        found AS (SELECT node, min(least) AS component_id FROM reach GROUP BY node)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM documents d LEFT JOIN sizes USING (doc_id) JOIN found ON node = d.doc_id""",
    "op8_ball_tree_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op9_warc_index_merge": """
        WITH u AS (
            SELECT *, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\\.', '') AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query FROM pages),
        p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d, strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id % 1000000000), '%Y%m%d%H%M%S') AS captured_at,
                   array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE path WHEN '' THEN '/' ELSE lower(path) END || CASE query WHEN '' THEN '' ELSE '?' || lower(array_to_string(list_sort(string_split(query, '&')), '&')) END AS url_key
            FROM u),
        f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
        SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
               CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to, url_key, captured_at, row_number() OVER (ORDER BY url_key, captured_at, page_id) - 1 AS position
        FROM p LEFT JOIN f ON f.d = p.d AND n >= 100""",
    "op11_importance_resampling": r"""
        WITH RECURSIVE steps(b, k, c) AS (
            SELECT b, 0, b FROM (SELECT unnest(range(256)) AS b)
            UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
        crc AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
        texts AS (SELECT true AS own, doc_id AS id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark),
        w AS (SELECT own, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
        f AS (
            SELECT own, id, unnest(w) AS f FROM w
            UNION ALL SELECT own, id, w[i] || ' ' || w[i + 1] FROM (SELECT own, id, w, unnest(range(1, len(w))) AS i FROM w)),
        d AS (SELECT DISTINCT f, hex(encode(f)) AS h FROM f),
        z AS (
            SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)),
                lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
            FROM d, crc),
        n AS (SELECT own, count(*)::DOUBLE AS n FROM f GROUP BY own),
        c AS (SELECT bucket, count(*) FILTER (own)::DOUBLE AS s, count(*) FILTER (NOT own)::DOUBLE AS t FROM f JOIN z USING (f) GROUP BY bucket),
        g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT coalesce(sum(n), 0) FROM n WHERE own) + 10000) / ((s + 1) * ((SELECT coalesce(sum(n), 0) FROM n WHERE NOT own) + 10000)))) AS gain FROM c),
        x AS (SELECT id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM f JOIN z USING (f) JOIN g USING (bucket) WHERE own GROUP BY id),
        e AS (
            SELECT id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS able,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM w LEFT JOIN x USING (id) WHERE own),
        r AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY able) AS n FROM e)
        SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= n * 25 // 100 THEN place END AS rank FROM r""",
    "op12_collocations": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
        w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
        g AS (SELECT lang, k, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 5) r(k))),
        f AS (SELECT lang, k, g, array_to_string(g, ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT * FROM f WHERE k > 1 AND f >= 30),
        cut AS (SELECT lang, phrase, f AS a, j, array_to_string(g[:j], ' ') AS x, array_to_string(g[j + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
        s AS (
            SELECT cut.lang, cut.phrase, a, l.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (l.f + r.f))::BIGINT AS score
            FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = x JOIN f r ON r.lang = cut.lang AND r.phrase = y
            QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY score, j) = 1),
        inner_runs AS (SELECT lang, f, array_to_string(g[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, g, f, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 4) r(m) WHERE m < k)),
        covered AS (SELECT lang, phrase, max(f) AS f FROM inner_runs GROUP BY ALL),
        kept AS (SELECT s.* FROM s LEFT JOIN covered v ON v.lang = s.lang AND v.phrase = s.phrase WHERE v.f IS NULL OR 100 * v.f < 80 * a),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
    "op13_jaccard_join": r"""
        WITH RECURSIVE toks AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN w ELSE w[i:i + 2] END AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM toks WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
            FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (
            SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
        edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach(node, least) AS (
            SELECT doc_id, doc_id FROM documents
            UNION SELECT e.b, r.least FROM reach r JOIN edges e ON e.a = r.node WHERE r.least < e.b),
        found AS (SELECT node, min(least) AS component_id FROM reach GROUP BY node)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
        FROM documents d LEFT JOIN sizes USING (doc_id) JOIN found ON node = d.doc_id""",
}
