"""Registered queries of the training-data operators, on the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    chat, collocations, decontamination, embedding_dedup, licenses, merkle, mixing, packing, pii, quality, sharding,
    simhash, topk,
)
from tidemark.session import prepare

SHARDS = 24
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of documents that every label calls good and none calls toxic."""
    good = F.min((F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0))
    return labels.groupBy("doc_id").agg(good.alias("good")).where("good").select("doc_id")


@registered
def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


@registered
def op2_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


@registered
def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"))


@registered
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels")))
    return judged.drop("row")


@registered
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


@registered
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


@registered
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_sequences(table(spark, sf_dir, "documents"), TOKENIZER)


@registered
def op8_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(table(spark, sf_dir, "documents"), SHARDS)


@registered
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


@registered
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"), chat.schema_table(spark))


@registered
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


@registered
def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@registered
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


SQL["op3_topk_search"] = """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

SQL["op1_embedding_dedup"] = """
WITH RECURSIVE usable AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND label IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
    SELECT a AS node, b AS other FROM links
    UNION
    SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other
), roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
counts AS (SELECT a AS node, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(root, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(root, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN roots r ON r.node = e.vec_id LEFT JOIN counts c ON c.node = e.vec_id
"""

SQL["op11_merkle_manifest"] = """
WITH RECURSIVE field AS (
    SELECT doc_id, lang, text, n_chars, source, row_number() OVER () AS row,
           list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
               lambda s, c: list_reduce(list_concat([xor(s, c)], [0, 0, 0, 0, 0, 0, 0, 0]),
                   lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)) AS crc
    FROM documents
), hashed AS (
    SELECT doc_id, lang, row, tampered,
           sha256(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
               || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')
               || coalesce(strlen(body) || ':' || body, '-')) AS leaf
    FROM (SELECT *, false AS tampered, text AS body FROM field
          UNION ALL
          SELECT *, true, CASE WHEN xor(crc, 4294967295) % 3 = 0
                          THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END FROM field)
), leaves AS (
    SELECT a.doc_id, a.lang, a.leaf, b.leaf AS touched,
           row_number() OVER (PARTITION BY a.lang ORDER BY a.doc_id NULLS FIRST, a.leaf) - 1 AS pos
    FROM hashed a JOIN hashed b ON a.row = b.row AND NOT a.tampered AND b.tampered
), tree AS (
    SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM leaves GROUP BY lang
    UNION ALL
    SELECT lang, level + 1, list_transform(range(CAST(ceil(len(nodes) / 8) AS BIGINT)), lambda i: sha256(array_to_string(nodes[i * 8 + 1 : i * 8 + 8], '')))
    FROM tree WHERE len(nodes) > 1
), subroots AS (
    SELECT lang, level AS height, nodes[1] AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS unit
    FROM tree WHERE len(nodes) = 1
), top AS (
    SELECT 0 AS level, list(subroot ORDER BY unit) AS nodes FROM subroots
    UNION ALL
    SELECT level + 1, list_transform(range(CAST(ceil(len(nodes) / 8) AS BIGINT)), lambda i: sha256(array_to_string(nodes[i * 8 + 1 : i * 8 + 8], '')))
    FROM top WHERE len(nodes) > 1
), steps AS (
    SELECT l.lang, l.pos, t.level, t.nodes, l.pos // CAST(pow(8, t.level) AS BIGINT) AS place
    FROM leaves l JOIN tree t ON l.lang IS NOT DISTINCT FROM t.lang WHERE len(t.nodes) > 1
    UNION ALL
    SELECT l.lang, l.pos, s.height + t.level, t.nodes, s.unit // CAST(pow(8, t.level) AS BIGINT)
    FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN top t ON len(t.nodes) > 1
), siblings AS (
    SELECT lang, pos, level, array_to_string(nodes[place - place % 8 + 1 : place], '') AS before,
           array_to_string(nodes[place + 2 : place - place % 8 + 8], '') AS after
    FROM steps
), proofs AS (
    SELECT lang, pos, count(*) AS n, string_agg(before || after, '' ORDER BY level) AS proof FROM siblings GROUP BY lang, pos
), folded AS (
    SELECT lang, pos, 0 AS level, touched AS node FROM leaves
    UNION ALL
    SELECT f.lang, f.pos, f.level + 1, sha256(s.before || f.node || s.after)
    FROM folded f JOIN siblings s ON f.lang IS NOT DISTINCT FROM s.lang AND f.pos = s.pos AND f.level = s.level
), ends AS (SELECT lang, pos, arg_max(node, level) AS folded_root FROM folded GROUP BY lang, pos)
SELECT l.doc_id, l.leaf, s.subroot, r.nodes[1] AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, e.folded_root,
       e.folded_root = r.nodes[1] AS verified
FROM leaves l
JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
JOIN top r ON len(r.nodes) = 1
JOIN ends e ON l.lang IS NOT DISTINCT FROM e.lang AND l.pos = e.pos
LEFT JOIN proofs p ON l.lang IS NOT DISTINCT FROM p.lang AND l.pos = p.pos
"""

SQL["op12_decontamination"] = r"""
WITH docs AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
), items AS (
    SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, words[i + 1 : i + 10] AS win, len(words[i + 1 : i + 10]) AS n
    FROM (SELECT item_id, words, unnest(range(greatest(len(words) - 9, 1))) AS i FROM items WHERE len(words) > 0)
), sizes AS (SELECT DISTINCT n FROM windows),
places AS (
    SELECT row, n, i, words[i + 1 : i + n] AS win
    FROM (SELECT row, words, n, unnest(range(len(words) - n + 1)) AS i FROM docs, sizes WHERE len(words) >= n)
), hits AS (SELECT p.row, p.i, p.n, w.item_id FROM places p JOIN windows w ON p.win = w.win),
covered AS (
    SELECT row, count(DISTINCT word) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS word FROM hits) GROUP BY row
), named AS (
    SELECT row, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
    FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY row
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (row) LEFT JOIN named USING (row)
"""

SQL["op13_collocations"] = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, regexp_extract_all(part, '[^\x20\x09]+') AS words
    FROM (SELECT lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part FROM documents)
), grams AS (
    SELECT lang, words[i + 1 : i + size] AS gram, count(*) AS a
    FROM (SELECT lang, words, size, unnest(range(len(words) - size + 1)) AS i
          FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(words) >= size)
    GROUP BY lang, gram
), totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM grams WHERE len(gram) = 1 GROUP BY lang),
candidates AS (SELECT lang, gram, len(gram) AS size, a FROM grams WHERE len(gram) >= 2 AND a >= 30),
cuts AS (
    SELECT c.lang, c.gram, c.a, k, l.a AS l, r.a AS r, CAST(2000000 * CAST(c.a AS HUGEINT) // (CAST(l.a AS HUGEINT) + r.a) AS BIGINT) AS score
    FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
    JOIN grams l ON l.lang = c.lang AND l.gram = c.gram[1 : k] JOIN grams r ON r.lang = c.lang AND r.gram = c.gram[k + 1 : size]
), lowest AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) AS nth FROM cuts) WHERE nth = 1
), inside AS (
    SELECT DISTINCT lang, gram[i + 1 : i + s] AS gram, a AS longer
    FROM (SELECT *, unnest(range(size - s + 1)) AS i FROM (SELECT *, unnest(range(2, size)) AS s FROM candidates))
), dropped AS (
    SELECT DISTINCT c.lang, c.gram FROM candidates c JOIN inside i ON i.lang = c.lang AND i.gram = c.gram
    WHERE 100 * CAST(i.longer AS HUGEINT) >= 80 * CAST(c.a AS HUGEINT)
), ranked AS (
    SELECT lang, array_to_string(gram, ' ') AS phrase, a, l, r, score,
           row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(gram, ' '))) AS rank
    FROM lowest ANTI JOIN dropped USING (lang, gram)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
