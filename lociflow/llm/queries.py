"""The registered query of each operator, with SQL where it can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm import brown, chat_collapse, decontam, divergence, jaccard, langid, packing, pii, quality, sharding, simhash, vector_codes, warc
from lociflow.llm.common import read, shared_dir


def op1_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_collapse.collapse(read(spark, sf_dir, "conversations"))


def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    warc.write(read(spark, sf_dir, "pages"), f"{folder}/warc")
    return warc.resolve(warc.read(spark, f"{folder}/warc"), folder)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "_language.held_out", "_language.lang_pred", "_language.score", "_language.n_words")


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.surrogate(read(spark, sf_dir, "documents"), key="a deployment sets its own secret", counted="n_entities")
    return found.select("doc_id", "text", "n_entities")


def op5_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_pow2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read(spark, sf_dir, "documents"), sharding.tree_of(16), sharding.grown(sharding.tree_of(16), 16))


def op9_vertical_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(read(spark, sf_dir, "documents"), k=3, percent=90).drop("text_key", "root")


def op10_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(read(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read(spark, sf_dir, "embeddings"))


def op13_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(read(spark, sf_dir, "documents"), k=3, radius=3)


QUERIES = {f.__name__: f for f in (op1_chat_snapshots, op2_warc_salvage, op3_language_id, op4_pii_surrogates, op5_spaced_seeds, op6_pow2_packing, op7_quality_rules, op8_hash_tree_shards, op9_vertical_join, op10_brown_classes, op11_source_divergence, op12_vector_codes, op13_simhash_balls)}

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

ORACLES: dict[str, str] = {
    "op1_chat_snapshots": """
        WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, list({'r': r, 't': t} ORDER BY turn NULLS FIRST, r, t) AS x FROM t GROUP BY 1),
        d AS (SELECT x, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY x),
        p AS (SELECT DISTINCT x[1:k] AS x FROM (SELECT x, unnest(range(1, len(x))) AS k FROM d))
        SELECT conv_id, len(x)::BIGINT AS n_turns, n_copies,
            array_to_string(list_transform(x, lambda m: '<|im_start|>' || replace(m.r, '<|', '< |') || chr(10) || replace(m.t, '<|', '< |') || '<|im_end|>' || chr(10)), '') AS chat
        FROM d ANTI JOIN p USING (x)""",
    "op7_quality_rules": f"""
        WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
        g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w), h AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM g),
        twice AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        r AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM twice) GROUP BY 1),
        m AS (SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
            len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
        v AS (SELECT doc_id, lang, unnest([1, 2, 3]) AS rule, unnest([n_symbols, n_dup_lines, n_repeat_words]) AS top, unnest([word_chars, n_lines, n_words]) AS bottom, base_failed FROM b),
        good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY 1 HAVING min(quality) = 1),
        k AS (SELECT lang, rule, cut, count(*) AS n, count(*) FILTER (bottom > 0 AND 1000 * top >= cut * bottom) AS k
            FROM v SEMI JOIN good USING (doc_id) CROSS JOIN (SELECT unnest({list(quality.CUTOFFS)}) AS cut) WHERE NOT base_failed GROUP BY 1, 2, 3),
        t AS (SELECT lang, rule, cut, CASE WHEN k >= n * 0.02 THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.02) + (n - i) * ln(0.98)))) END AS tail,
            0.05 / ((SELECT count(*) FROM (SELECT DISTINCT lang FROM k)) * 36) AS level FROM k),
        cuts AS (SELECT lang, rule, min(cut) AS cut FROM t WHERE tail <= level GROUP BY 1, 2),
        bad AS (SELECT doc_id, min(rule) AS rule FROM v JOIN cuts USING (lang, rule) WHERE bottom > 0 AND 1000 * top >= cut * bottom GROUP BY 1)
        SELECT b.* EXCLUDE (lang), CASE WHEN base_failed THEN 'base' ELSE ['symbols', 'dup_lines', 'repeats'][rule] END AS rejected_by, NOT base_failed AND rule IS NULL AS kept FROM b LEFT JOIN bad USING (doc_id)""",
    "op9_vertical_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, list_transform({_WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        reach AS (SELECT a AS doc_id, a AS root FROM e UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.doc_id)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(min(reach.root), d.doc_id) AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY 1, 2""",
    "op5_spaced_seeds": """
        WITH tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL),
        item AS (SELECT min(item_id) AS item_id, t AS w FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM benchmark) GROUP BY t HAVING len(t) > 0),
        d AS (SELECT doc_id, unnest(range(1, len(t) - 9)) AS p, t FROM tok),
        dp AS (SELECT doc_id, p, 0 AS m, concat_ws(' ', t[p], t[p + 1], t[p + 3], t[p + 6], t[p + 7], t[p + 9], t[p + 10]) AS h FROM d
            UNION ALL SELECT doc_id, p, 1, concat_ws(' ', t[p], t[p + 2], t[p + 3], t[p + 7], t[p + 11], t[p + 12]) FROM d WHERE p <= len(t) - 12),
        i AS (SELECT item_id, unnest(range(1, len(w) - 9)) AS q, w FROM item),
        iq AS (SELECT item_id, q, 0 AS m, concat_ws(' ', w[q], w[q + 1], w[q + 3], w[q + 6], w[q + 7], w[q + 9], w[q + 10]) AS h FROM i
            UNION ALL SELECT item_id, q, 1, concat_ws(' ', w[q], w[q + 2], w[q + 3], w[q + 7], w[q + 11], w[q + 12]) FROM i WHERE q <= len(w) - 12),
        hit AS (SELECT DISTINCT doc_id, item_id, p - q AS shift FROM dp JOIN iq USING (m, h)),
        laid AS (SELECT doc_id, item_id, len(w) AS item_tokens, list_transform(w, lambda x, j: CASE WHEN j + shift >= 1 AND t[j + shift] = x THEN 1 ELSE 0 END) AS same
            FROM hit JOIN tok USING (doc_id) JOIN item USING (item_id)),
        best AS (SELECT *, list_max(list_transform(range(1, item_tokens - least(13, item_tokens) + 2), lambda s: list_sum(same[s:s + least(13, item_tokens) - 1]))) AS b FROM laid)
        SELECT doc_id, item_id, max(list_sum(same))::BIGINT AS matched, max(item_tokens)::BIGINT AS item_tokens
        FROM best WHERE b >= ceil(0.8 * least(13, item_tokens)) GROUP BY doc_id, item_id""",
    "op11_source_divergence": """
        WITH t AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM t),
        k AS (SELECT lang, term, count(*) AS ln FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
        v AS (SELECT lang, count(*) AS v, sum(ln) AS lt FROM k GROUP BY 1),
        g AS (SELECT lang, source, coalesce(v, 0) AS v, lt FROM (SELECT DISTINCT lang, source FROM t) LEFT JOIN v USING (lang)),
        c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
        s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2),
        x AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (coalesce(total, 0) + 5 * v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (ln + 5)) // (lt + 5 * v)::HUGEINT AS q
            FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
        f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                LEFT JOIN x ON x.lang = a.lang AND x.source = a.source LEFT JOIN x y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY 1, 2, 4
            UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM x WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM f QUALIFY part = 'pair' OR rank <= 50""",
    "op12_vector_codes": """
        WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (SELECT r, pos, v[pos * (len(v) // 16) + 1 : (pos + 1) * (len(v) // 16)] AS part FROM k, (SELECT unnest(range(16)) AS pos)),
        d AS MATERIALIZED (SELECT pos, part, count(*) AS m FROM p GROUP BY 1, 2),
        c0 AS MATERIALIZED (SELECT pos, r - 1 AS e, part AS c FROM p WHERE r <= 64),
        a0 AS MATERIALIZED (SELECT d.pos, part, m, arg_min(e, list_sum(list_transform(list_zip(part, c), lambda z: (z[1] - z[2]) ** 2))::BIGINT * 64 + e) AS e FROM d JOIN c0 USING (pos) GROUP BY 1, 2, 3),
        u0 AS (SELECT pos, e, j, floor(sum(x * m)::DECIMAL(38, 0) / sum(m))::BIGINT AS x FROM (SELECT pos, e, m, unnest(part) AS x, unnest(range(len(part))) AS j FROM a0) GROUP BY 1, 2, 3),
        c1 AS MATERIALIZED (SELECT pos, e, coalesce(n, c) AS c FROM c0 LEFT JOIN (SELECT pos, e, list(x ORDER BY j) AS n FROM u0 GROUP BY 1, 2) USING (pos, e)),
        a1 AS MATERIALIZED (SELECT d.pos, part, m, arg_min(e, list_sum(list_transform(list_zip(part, c), lambda z: (z[1] - z[2]) ** 2))::BIGINT * 64 + e) AS e FROM d JOIN c1 USING (pos) GROUP BY 1, 2, 3),
        u1 AS (SELECT pos, e, j, floor(sum(x * m)::DECIMAL(38, 0) / sum(m))::BIGINT AS x FROM (SELECT pos, e, m, unnest(part) AS x, unnest(range(len(part))) AS j FROM a1) GROUP BY 1, 2, 3),
        c2 AS MATERIALIZED (SELECT pos, e, coalesce(n, c) AS c FROM c1 LEFT JOIN (SELECT pos, e, list(x ORDER BY j) AS n FROM u1 GROUP BY 1, 2) USING (pos, e)),
        a2 AS MATERIALIZED (SELECT d.pos, part, min(list_sum(list_transform(list_zip(part, c), lambda z: (z[1] - z[2]) ** 2))::BIGINT * 64 + e) AS x FROM d JOIN c2 USING (pos) GROUP BY 1, 2),
        o AS (SELECT r, string_agg(format('{:02x}', x % 64), '' ORDER BY pos) AS code, sum(x // 64)::BIGINT AS error FROM p JOIN a2 USING (pos, part) GROUP BY 1)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
            (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY pos, e)) FROM c2) AS codebooks_sha256 FROM k JOIN o USING (r)""",
}
