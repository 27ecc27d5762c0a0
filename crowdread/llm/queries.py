"""One query per operator for large text corpora, over whole tables, and SQL forms where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crowdread.llm import (
    byte_bpe, decontaminate, importance, licences, minhash, packing, phrase_dedup, pii, prefix_trie, quality, quantised, rules,
    suffix_dedup,
)

#: Conversations of op13 begin with turns of the conversation whose id is the next lower multiple of five.
REBUILT_SHARED = "crc32(CAST(CAST(conv_id AS STRING) AS BINARY)) % 9"
REBUILT_FROM = "conv_id - conv_id % 5"
REBUILT_TURNS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(spans: str) -> Column:
    """kind:start:end of all spans, in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.found(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter(F.col("base.kind"), lambda x: x == F.lit(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return rows.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(table(spark, sf_dir, "documents"))


def op3_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantised.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = phrase_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = byte_bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return rows.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = prefix_trie.sequences(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.rebuilt(convs, REBUILT_SHARED, REBUILT_FROM, REBUILT_TURNS))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_licences": op2_licences,
    "op3_quantised": op3_quantised,
    "op4_quality": op4_quality,
    "op5_minhash": op5_minhash,
    "op6_rules": op6_rules,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_phrase_dedup": op8_phrase_dedup,
    "op9_packing": op9_packing,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_importance": op11_importance,
    "op12_decontaminate": op12_decontaminate,
    "op13_prefix_trie": op13_prefix_trie,
}
WORD_LISTS = r"""words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents)"""

#: Contributions to a CRC-32 over GF(2): of byte b with d bytes behind it (z), and of the first register over n bytes (i).
CRC_TABLES = """
        crc_bits(k, b, z) AS (
            SELECT 0, range::BIGINT, range::BIGINT FROM range(256)
            UNION ALL SELECT k + 1, b, CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384) ELSE z >> 1 END FROM crc_bits WHERE k < 8),
        crc_table AS MATERIALIZED (SELECT b, z FROM crc_bits WHERE k = 8),
        crc_z(d, b, z) AS (
            SELECT 0, b, z FROM crc_table
            UNION ALL SELECT d + 1, c.b, xor(t.z, c.z >> 8) FROM crc_z c JOIN crc_table t ON t.b = c.z & 255 WHERE d < (SELECT max(n) FROM crc_sizes)),
        crc_i(n, z) AS (
            SELECT 0, 4294967295
            UNION ALL SELECT n + 1, xor(t.z, c.z >> 8) FROM crc_i c JOIN crc_table t ON t.b = c.z & 255 WHERE n < (SELECT max(n) FROM crc_sizes))"""


def crc_of(strings: str) -> str:
    """SQL for (s, crc) of the distinct strings s of a table; its bytes are taken from the hexadecimal form."""
    return f"""
        crc_strings AS MATERIALIZED (SELECT DISTINCT s, hex(encode(s)) AS x FROM {strings}),
        crc_sizes AS MATERIALIZED (SELECT DISTINCT len(x) // 2 AS n FROM crc_strings), {CRC_TABLES},
        crc_bytes AS (
            SELECT s, len(x) // 2 AS n, len(x) // 2 - 1 - p AS d, ('0x' || substr(x, 2 * p + 1, 2))::BIGINT AS b
            FROM (SELECT s, x, unnest(range(len(x) // 2)) AS p FROM crc_strings)),
        crcs AS MATERIALIZED (
            SELECT s, xor(xor(bit_xor(crc_z.z), any_value(crc_i.z)), 4294967295) AS crc
            FROM crc_bytes JOIN crc_z USING (d, b) JOIN crc_i USING (n) GROUP BY s)"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"



def plain_words(table: str, key: str) -> str:
    """SQL for the words of letters and digits of every text."""
    return rf"""SELECT {key}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM {table}"""


ORACLE: dict[str, str] = {
    "op3_quantised": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
        counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(l.b, vec_id)) AS component_id,
            vec_id = least(vec_id, coalesce(l.b, vec_id)) AS kept
        FROM embeddings LEFT JOIN counts c ON c.a = vec_id LEFT JOIN least l ON l.a = vec_id""",
    "op5_minhash": f"""
        WITH RECURSIVE {WORD_LISTS.replace("coalesce(text, '')", f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")},
        shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[p : p + 2], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS p FROM words WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b
            FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
            JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
        reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id,
            doc_id = least(doc_id, coalesce(b, doc_id)) AS kept
        FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON a = doc_id""",
    "op8_phrase_dedup": f"""
        WITH {WORD_LISTS},
        windows AS (
            SELECT doc_id, p, array_to_string(w[p : p + 12], ' ') AS phrase
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM words)),
        firsts AS (SELECT phrase, min(doc_id) AS first_doc FROM windows GROUP BY phrase),
        gone AS (
            SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i
            FROM windows JOIN firsts USING (phrase) WHERE first_doc < doc_id),
        single AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
            FROM single ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM words LEFT JOIN kept USING (doc_id)""",
    "op11_importance": f"""
        WITH RECURSIVE sizes_of AS (SELECT unnest([1, 2, 3]) AS n),
        doc_words AS MATERIALIZED ({plain_words("documents", "doc_id")}),
        item_words AS MATERIALIZED ({plain_words("benchmark", "item_id")}),
        doc_features AS MATERIALIZED (
            SELECT doc_id, array_to_string(w[p : p + n - 1], ' ') AS s
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM doc_words, sizes_of)),
        item_features AS MATERIALIZED (
            SELECT array_to_string(w[p : p + n - 1], ' ') AS s
            FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS p FROM item_words, sizes_of)),
        features AS (SELECT s FROM doc_features UNION SELECT s FROM item_features), {crc_of("features")},
        corpus AS (SELECT crc % 10000 AS bucket, count(*)::DOUBLE AS n FROM doc_features JOIN crcs USING (s) GROUP BY bucket),
        target AS (SELECT crc % 10000 AS bucket, count(*)::DOUBLE AS n FROM item_features JOIN crcs USING (s) GROUP BY bucket),
        totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM corpus) AS s_all, (SELECT coalesce(sum(n), 0) FROM target) AS t_all),
        gains AS MATERIALIZED (
            SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * (s_all + 10000) / ((c.n + 1) * (t_all + 10000))))::BIGINT AS gain
            FROM corpus c LEFT JOIN target t USING (bucket), totals),
        weights AS (
            SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight
            FROM doc_features JOIN crcs USING (s) JOIN gains ON bucket = crc % 10000 GROUP BY doc_id),
        scored AS MATERIALIZED (
            SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM doc_words LEFT JOIN weights USING (doc_id)),
        ranks AS (
            SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN r <= 5 * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranks USING (doc_id)""",
    "op12_decontaminate": f"""
        WITH doc_words AS MATERIALIZED ({plain_words("documents", "doc_id")}),
        item_words AS MATERIALIZED ({plain_words("benchmark", "item_id")}),
        windows AS (
            SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS s
            FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM item_words WHERE len(w) > 0)),
        lengths AS (SELECT DISTINCT n FROM windows),
        runs AS (
            SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS s
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM doc_words, lengths)),
        found AS MATERIALIZED (SELECT doc_id, p, n, item_id FROM runs JOIN windows USING (n, s)),
        hits AS (
            SELECT doc_id, count(DISTINCT i) AS n_hit
            FROM (SELECT doc_id, unnest(range(p, p + n)) AS i FROM (SELECT DISTINCT doc_id, p, n FROM found)) GROUP BY doc_id),
        names AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
            n_hit IS NOT NULL AS contaminated
        FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN names USING (doc_id)""",
    "op13_prefix_trie": f"""
        WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS c, conv_id::VARCHAR AS s FROM conversations), {crc_of("ids")},
        convs AS MATERIALIZED (SELECT c, crc % 9 AS h FROM ids JOIN crcs USING (s)),
        turns AS MATERIALIZED (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k
            FROM conversations),
        parts AS (
            SELECT c, 0 AS part, k, role, text FROM convs JOIN turns ON conv_id = c - c % 5 WHERE k <= h
            UNION ALL SELECT c, 1, k, role, text FROM convs JOIN turns ON conv_id = c WHERE k > h),
        rebuilt AS (
            SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, k) AS d, text, strlen(role) || ':' || strlen(text) || ':' || role || text AS t FROM parts),
        prefixes AS MATERIALIZED (
            SELECT c, d, strlen(text) AS size, sha256(string_agg(t, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS node FROM rebuilt
            UNION ALL SELECT c, 0, 0, '' FROM convs),
        lengths AS (SELECT c, max(d) AS last FROM prefixes GROUP BY c),
        nodes AS MATERIALIZED (
            SELECT node, any_value(d) AS depth, min(p.c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
                coalesce(string_agg(p.c::VARCHAR, ',' ORDER BY p.c) FILTER (WHERE d = last), '') AS ends
            FROM prefixes p JOIN lengths USING (c) GROUP BY node),
        up AS MATERIALIZED (
            SELECT DISTINCT b.node, a.node AS parent
            FROM prefixes b JOIN prefixes a ON a.c = b.c AND a.d = b.d - 1),
        children AS (SELECT parent AS node, count(*) AS n FROM up GROUP BY parent),
        subtrees AS (
            SELECT a.node AS top, sum(n.saved) AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves
            FROM nodes n JOIN prefixes b ON b.node = n.node AND b.c = n.conv_id
            JOIN prefixes a ON a.c = b.c AND a.d <= b.d LEFT JOIN children k ON k.node = n.node GROUP BY a.node)
        SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, t.leaves AS n_leaves,
            t.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
        FROM nodes n JOIN subtrees t ON t.top = n.node LEFT JOIN up USING (node) LEFT JOIN nodes m ON m.node = up.parent
        LEFT JOIN children k ON k.node = n.node""",
}
