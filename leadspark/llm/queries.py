"""The registered queries of this package and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.llm import mih, mixing, negatives, ngram, ppm, quality, repair, rlz, simhash, tiling, token_counts, toxicity, warc
from leadspark.llm.common import table

#: Vocabulary file of the token counts, by name in the public tokenizers package.
VOCABULARY = "byte_bpe_50k.json"


def op1_ppm(spark: SparkSession, folder: str) -> DataFrame:
    return ppm.scores(table(spark, folder, "documents"))


def op2_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    return mih.nearest(table(spark, folder, "embeddings"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, folder, "pages"))


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "source", "lang", "text", "rate", "copies", "copy", "shuffle_key")


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.groups(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


def op8_relative_lz(spark: SparkSession, folder: str) -> DataFrame:
    return rlz.digest(table(spark, folder, "documents"))


def op9_string_tiling(spark: SparkSession, folder: str) -> DataFrame:
    return tiling.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_ngram_rules(spark: SparkSession, folder: str) -> DataFrame:
    return ngram.rules(table(spark, folder, "documents"))


def op12_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, folder, "embeddings"))


def op13_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repaired(table(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ppm, op2_multi_index, op3_warc, op4_mixing, op5_simhash, op6_toxicity, op7_token_counts, op8_relative_lz,
        op9_string_tiling, op10_quality, op11_ngram_rules, op12_negatives, op13_repair,
    )
}

ORACLES: dict[str, str] = {
    "op3_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        k AS (SELECT payload_digest, payload_bytes, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id < keeper THEN keeper END AS refers_to
        FROM p LEFT JOIN k USING (payload_digest, payload_bytes)""",
    "op4_mixing": """
        WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
        t AS (SELECT sum(n) AS all_n, sum(sqrt(n)) AS all_weight FROM s),
        r AS (SELECT source, round(sqrt(n) / all_weight * all_n / n, 9) AS rate FROM s, t),
        cdf AS (
            SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS reached
            FROM r, (SELECT CAST(range AS DOUBLE) AS k FROM range(0, 400)) WHERE k <= ceil(rate + 12 * sqrt(rate) + 20) - 1),
        d AS (
            SELECT *, CAST(CAST('0x' || substr(md5('42|' || doc_id || '|1'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
            FROM documents JOIN r USING (source)),
        c AS (
            SELECT d.doc_id, d.source, d.lang, d.text, d.rate, CAST(count(*) AS INTEGER) AS copies
            FROM d JOIN cdf ON cdf.source = d.source AND d.u >= cdf.reached GROUP BY ALL)
        SELECT doc_id, source, lang, text, rate, copies, CAST(copy AS INTEGER) AS copy,
            md5('42|order|' || doc_id || '|' || copy) AS shuffle_key
        FROM (SELECT *, unnest(range(0, copies)) AS copy FROM c)""",
    "op8_relative_lz": r"""
        WITH w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
        g AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50),
        h AS (SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + 49), ' ')) AS win FROM g),
        f AS (SELECT win, min(doc_id) AS first_doc FROM h GROUP BY win),
        hit AS (SELECT doc_id, i FROM h JOIN f USING (win) WHERE doc_id > first_doc),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM hit),
        gl AS (SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id),
        k AS (
            SELECT doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
                CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda x, j: NOT list_contains(gone, j)) END AS kept
            FROM w LEFT JOIN gl USING (doc_id))
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
            sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k""",
    "op12_negatives": """
        WITH u AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: isfinite(x))) = len(embedding)),
        s AS (
            SELECT a.vec_id AS anchor_id, u.vec_id, u.label = a.label AS alike, CAST(list_dot_product(a.v, u.v) AS BIGINT) AS score
            FROM u JOIN u a ON a.vec_id % 50 = 0 AND a.vec_id <> u.vec_id),
        p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER pair AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        WINDOW pair AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER pair <= 3""",
    "op13_repair": r"""
        WITH RECURSIVE k AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
        c AS (
            SELECT k.*, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(key[i]) AS BIGINT))),
                lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(0, 8)), lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)))) % 20 AS fault FROM k),
        d AS (
            SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
                CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
            FROM c WHERE fault <> 0),
        n AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || ':' || text)) AS i,
                regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS trimmed FROM d),
        m AS (
            SELECT *, CASE WHEN trimmed = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS flaw,
                left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
        facts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (flaw = 'blank') AS blank,
                count(*) FILTER (flaw = 'duplicate') AS duplicate, count(*) FILTER (flaw = 'truncated') AS truncated,
                count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
            FROM m GROUP BY conv_id),
        step(state, op, cost, written, after) AS (VALUES
            ('0', 's', 0, '', 's'), ('0', 'u', 0, '', 'u'), ('s', 'u', 0, '', 'u'), ('a', 'u', 0, '', 'u'), ('u', 'a', 0, '', 'a'),
            ('0', 'a', 2, 'user:', 'a'), ('s', 'a', 2, 'user:', 'a'), ('a', 'a', 2, 'user:', 'a'), ('u', 'u', 2, 'assistant:', 'u')),
        best AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS i, '0' AS state, {'cost': 0, 'audit': '', 'out': CAST([] AS VARCHAR[])} AS way FROM facts
            UNION ALL
            SELECT conv_id, i, state, min(way) FROM (
                SELECT b.conv_id, m.i, b.state, {'cost': (b.way).cost + 3, 'audit': (b.way).audit || 'D', 'out': (b.way).out} AS way
                FROM best b JOIN m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.i = b.i + 1
                UNION ALL
                SELECT b.conv_id, m.i, s.after, {
                    'cost': (b.way).cost + s.cost + CASE WHEN m.initial = s.op THEN 0 ELSE 2 END + CASE WHEN m.flaw = 'truncated' THEN 1 ELSE 0 END,
                    'audit': (b.way).audit || CASE WHEN s.cost > 0 THEN 'I' ELSE '' END || CASE WHEN m.initial = s.op THEN 'K' ELSE 'R' END,
                    'out': list_concat((b.way).out, CASE WHEN s.cost > 0 THEN [s.written] ELSE [] END,
                        [CASE WHEN m.initial = s.op THEN m.role WHEN s.op = 'u' THEN 'user' ELSE 'assistant' END || ':' || m.text])} AS way
                FROM best b JOIN m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.i = b.i + 1 JOIN step s ON s.state = b.state
                WHERE m.flaw NOT IN ('blank', 'duplicate') AND (s.op <> 's' OR m.initial = 's'))
            GROUP BY ALL),
        final AS (
            SELECT f.conv_id, min(CASE b.state
                WHEN 's' THEN {'cost': (way).cost + 4, 'audit': (way).audit || 'II', 'out': list_concat((way).out, ['user:', 'assistant:'])}
                WHEN 'u' THEN {'cost': (way).cost + 2, 'audit': (way).audit || 'I', 'out': list_concat((way).out, ['assistant:'])}
                ELSE way END) AS way
            FROM facts f JOIN best b ON b.conv_id IS NOT DISTINCT FROM f.conv_id AND b.i = f.n GROUP BY f.conv_id)
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
            coalesce(illegal, 0) AS illegal, CAST(coalesce((way).cost, 0) AS BIGINT) AS cost, coalesce((way).audit, '') AS audit,
            sha256(coalesce(array_to_string((way).out, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o
        LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN final w ON w.conv_id IS NOT DISTINCT FROM o.conv_id""",
}
