"""The operators over their whole tables as named queries, with SQL counterparts where SQL has one."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlast.llm import (divergence, fingerprints, hnsw, langid, lm, manifest, neardup, packing, pieces, quality, sharding,
                         token_counts, warc)
from outlast.llm.settings import configure
from outlast.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run):
    def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return run(spark, sf_dir)

    QUERIES[run.__name__] = configured
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_tokenizer() -> str:
    return vocabulary_file("word_bpe_49k.json")


@query
def op1_hnsw_nearest(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return hnsw.nearest(rows, F.col("vec_id") % 20 == 0, neighbours=20)


@query
def op2_minhash_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


@query
def op4_deleted_interpolation(spark, sf_dir):
    return lm.score_documents(table(spark, sf_dir, "documents"))


@query
def op5_consistent_weighted_sampling(spark, sf_dir):
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


@query
def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit_languages(docs))


@query
def op7_warc_zstd(spark, sf_dir):
    folder = f"{shared_folder(spark)}/warc-{uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder).drop("path", "url")


def edits_of(docs: DataFrame) -> DataFrame:
    """Four edits for every document: words changed, words repeated, an end added, a beginning cut."""
    size = F.length(F.coalesce("text", F.lit("")))

    def edit(at, cut, put):
        return F.struct(F.floor(at).cast("int").alias("at"), F.lit(cut).alias("cut"), put.alias("put"))

    return docs.select("doc_id", "text", F.array(
        edit(size / 3, 12, F.lit(" changed  words")), edit(size * 2 / 3, 0, F.coalesce(F.substring("text", 1, 20), F.lit(""))),
        edit(size, 0, F.lit("\nThe end.")), edit(F.lit(0), 3, F.lit(""))).alias("edits"))


@query
def op8_edit_aware_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts.edited_counts(edits_of(table(spark, sf_dir, "documents")),
                                      vocabulary_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op9_aho_corasick_pieces(spark, sf_dir):
    return pieces.round_trip(table(spark, sf_dir, "documents"), vocabulary_file("piece_bpe_32k.model"))


@query
def op10_bounded_space_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer())


@query
def op11_hypergeometric_shards(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


@query
def op12_merkle_manifest(spark, sf_dir):
    return manifest.manifest(table(spark, sf_dir, "documents"))


@query
def op13_source_divergence(spark, sf_dir):
    return divergence.divergence(table(spark, sf_dir, "documents"))


ORACLES["op2_minhash_near_duplicates"] = r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]]
        ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
    FROM worded),
classes AS (SELECT list_sort(s) AS s, min(doc_id) AS class, len(any_value(s)) AS n FROM sets GROUP BY list_sort(s)),
posts AS (SELECT class, n, unnest(s) AS shingle FROM classes),
pairs AS (
    SELECT a.class AS a, b.class AS b
    FROM posts a JOIN posts b ON a.shingle = b.shingle AND a.class < b.class
        AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT class AS a, class AS b FROM classes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
labels AS (SELECT a AS class, min(b) AS label FROM reach GROUP BY a)
SELECT d.doc_id, len(d.s) AS n_shingles,
       CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE l.label END AS component_id,
       coalesce(d.doc_id = CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE l.label END, false) AS kept
FROM sets d LEFT JOIN classes c ON list_sort(d.s) = c.s LEFT JOIN labels l ON c.class = l.class
"""

ORACLES["op7_warc_zstd"] = r"""
WITH hashed AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h,
           min(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS first_id
    FROM pages)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(
           list_transform(range(5), lambda b: ((strpos('0123456789abcdef', substr(h, 1 + (i * 5 + b) // 4, 1)) - 1)
                                               >> (3 - (i * 5 + b) % 4)::INT & 1) << (4 - b)::INT)) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN CAST(first_id AS DOUBLE) END AS refers_to  -- as a frame holds nullable integers
FROM hashed
"""

ORACLES["op13_source_divergence"] = r"""
WITH docs AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents),
words AS (SELECT doc, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counted AS (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(c) AS n FROM counted GROUP BY ALL),
grouped AS (SELECT g.lang, g.source, coalesce(n, 0) AS n, coalesce(v, 0) AS v
           FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN totals USING (lang, source) LEFT JOIN sizes USING (lang)),
dense AS (
    SELECT g.lang, g.source, term, coalesce(c, 0) AS c,
           CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 5) // (g.n + 5 * g.v) AS BIGINT) AS p
    FROM grouped g JOIN kept USING (lang) LEFT JOIN counted USING (lang, source, term)),
whole AS (
    SELECT lang, term, CAST(1 + CAST(1000000000 AS HUGEINT) * (sum(c) + 5)
                            // (sum(sum(c)) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS BIGINT) AS q
    FROM dense GROUP BY lang, term),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
    FROM grouped a JOIN grouped b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN dense x ON x.lang = a.lang AND x.source = a.source
    LEFT JOIN dense y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
    GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM dense JOIN whole USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
    SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value,
           row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
    UNION ALL
    SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

ORACLES["op12_merkle_manifest"] = r"""
WITH RECURSIVE chosen AS (
    SELECT *, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                     coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
           -- the parity of the CRC-32 of the decimal id, whose bits the last step inverts
           list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT), lambda crc, byte: list_reduce(
               range(8)::UBIGINT[], lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END::UBIGINT), xor(crc, byte)),
               4294967295::UBIGINT) % 2 = 1 AS even
    FROM documents),
hashed AS (
    SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, replace(text, chr(10), '') AS cut,
           CASE WHEN even THEN sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) ELSE leaf END AS tampered
    FROM chosen),
numbered AS (
    SELECT doc_id, leaf, tampered, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
           row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
    FROM hashed),
levels(tree, lvl, idx, n, h) AS (
    SELECT tree, 0, idx, n, leaf FROM numbered
    UNION ALL
    SELECT tree, lvl + 1, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY idx))
    FROM levels WHERE n > 1 GROUP BY tree, lvl, idx // 3),
subroots AS (SELECT tree, lvl, h FROM levels WHERE n = 1),
tops(lvl, idx, n, h) AS (
    SELECT 0, tree, count(*) OVER (), h FROM subroots
    UNION ALL
    SELECT lvl + 1, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY idx))
    FROM tops WHERE n > 1 GROUP BY lvl, idx // 3),
runs AS (SELECT tree, lvl, idx // 3 AS run, list(h ORDER BY idx) AS hs FROM levels WHERE n > 1 GROUP BY ALL),
top_runs AS (SELECT lvl, idx // 3 AS run, list(h ORDER BY idx) AS hs FROM tops WHERE n > 1 GROUP BY ALL),
climb(doc_id, leaf, tree, lvl, idx, folded, proof) AS (
    SELECT doc_id, leaf, tree, 0, idx, tampered, '' FROM numbered
    UNION ALL
    SELECT c.doc_id, c.leaf, c.tree, c.lvl + 1, c.idx // 3,
           sha256(array_to_string(hs[:c.idx % 3] || [c.folded] || hs[c.idx % 3 + 2:], '')),
           c.proof || array_to_string(hs[:c.idx % 3] || hs[c.idx % 3 + 2:], '')
    FROM climb c JOIN runs r ON r.tree = c.tree AND r.lvl = c.lvl AND r.run = c.idx // 3),
top_climb(doc_id, leaf, subroot, lvl, idx, folded, proof) AS (
    SELECT doc_id, leaf, s.h, 0, c.tree, folded, proof FROM climb c JOIN subroots s ON s.tree = c.tree AND s.lvl = c.lvl
    UNION ALL
    SELECT c.doc_id, c.leaf, c.subroot, c.lvl + 1, c.idx // 3,
           sha256(array_to_string(hs[:c.idx % 3] || [c.folded] || hs[c.idx % 3 + 2:], '')),
           c.proof || array_to_string(hs[:c.idx % 3] || hs[c.idx % 3 + 2:], '')
    FROM top_climb c JOIN top_runs r ON r.lvl = c.lvl AND r.run = c.idx // 3)
SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.h AS verified
FROM top_climb c JOIN (SELECT lvl, h FROM tops WHERE n = 1) t ON t.lvl = c.lvl
"""
