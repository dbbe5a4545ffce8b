"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers

from roomledger.llm import (
    ann,
    bpe,
    common,
    dedup,
    divergence,
    langid,
    near,
    negatives,
    packing,
    repeats,
    secrets,
    token_orc,
    toxicity,
    warc,
)

QUERIES = {}
END_ID = 2


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_exact_dedup(spark, sf_dir):
    return dedup.duplicates(spark, common.table(spark, sf_dir, "documents"))


@query
def op2_string_kernel(spark, sf_dir):
    documents, labels = (common.table(spark, sf_dir, name) for name in ("documents", "labels"))
    return toxicity.scored(spark, documents, labels)


@query
def op3_warc(spark, sf_dir):
    folder = common.scratch(spark, "warc")
    archives = warc.write(spark, common.table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder, archives)


@query
def op4_token_orc(spark, sf_dir):
    out = common.scratch(spark, "tokens")
    path = public_tokenizers.path("word_bpe_49k.json")
    token_orc.write(spark, common.table(spark, sf_dir, "documents"), path, out, END_ID)
    return token_orc.index(spark, out)


@query
def op5_dimension_scan(spark, sf_dir):
    return ann.nearest(spark, common.table(spark, sf_dir, "embeddings"))


@query
def op6_entropy_secrets(spark, sf_dir):
    return secrets.scan(spark, common.table(spark, sf_dir, "documents"))


@query
def op7_hamming_join(spark, sf_dir):
    return near.near_duplicates(spark, common.table(spark, sf_dir, "documents"), words=3, percent=85)


@query
def op8_language_spans(spark, sf_dir):
    return langid.labelled(spark, common.table(spark, sf_dir, "documents"))


@query
def op9_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.round_trip(spark, common.table(spark, sf_dir, "documents"), path)


@query
def op10_best_two_fit(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(spark, common.table(spark, sf_dir, "documents"), path, END_ID)


@query
def op11_suffix_trees(spark, sf_dir):
    return repeats.without_repeats(spark, common.table(spark, sf_dir, "documents"), words=35)


@query
def op12_hard_negatives(spark, sf_dir):
    return negatives.hard_negatives(spark, common.table(spark, sf_dir, "embeddings"))


@query
def op13_source_divergence(spark, sf_dir):
    return divergence.audit(spark, common.table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op1_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op3_warc": """
        WITH payloads AS (
            SELECT page_id, url, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes,
                   max(page_id) OVER (PARTITION BY coalesce(html, '')) AS original
            FROM pages
        )
        SELECT page_id, payload_bytes, sha1(html) AS payload_digest, url,
               CASE WHEN payload_bytes >= 1000 AND page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < original THEN original END AS refers_to
        FROM payloads
    """,
    "op7_hamming_join": r"""
        WITH RECURSIVE spoken AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), listed AS (
            SELECT doc_id, CASE
                WHEN len(w) = 0 THEN []
                WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
            END AS runs
            FROM spoken
        ), shingles AS (
            SELECT doc_id, unnest(list_distinct(runs)) AS shingle FROM listed
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), shared AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
            FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
            GROUP BY x.doc_id, y.doc_id
        ), links AS (
            SELECT a, b FROM shared
            JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
            WHERE 100 * shared.n >= 85 * (p.n + q.n - shared.n)
        ), steps AS (
            SELECT a, b FROM links UNION ALL SELECT b, a FROM links
        ), reached AS (
            SELECT doc_id, doc_id AS node FROM documents
            UNION
            SELECT reached.doc_id, steps.b FROM reached JOIN steps ON reached.node = steps.a
        ), least AS (
            SELECT doc_id, min(node) AS component_id FROM reached GROUP BY doc_id
        )
        SELECT least.doc_id, coalesce(sizes.n, 0) AS n_shingles, component_id, least.doc_id = component_id AS kept
        FROM least LEFT JOIN sizes ON sizes.doc_id = least.doc_id
    """,
    "op11_suffix_trees": r"""
        WITH spoken AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), windows AS (
            SELECT doc_id, i, w[i : i + 34] AS words
            FROM spoken, unnest(range(1, len(w) - 33)) AS starts(i)
        ), several AS (
            SELECT words FROM windows GROUP BY words HAVING count(*) > 1
        ), gone AS (
            SELECT DISTINCT doc_id, i + step AS place
            FROM windows SEMI JOIN several USING (words), range(35) AS steps(step)
        ), placed AS (
            SELECT doc_id, unnest(range(1, len(w) + 1)) AS place, unnest(w) AS word FROM spoken
        ), stay AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept, count(*) AS n
            FROM placed ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id
        )
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM spoken LEFT JOIN stay USING (doc_id)
    """,
    "op12_hard_negatives": """
        WITH sound AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, r.vec_id AS row_id, a.label = r.label AS positive,
                   CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * r.v[i])) AS BIGINT) AS score
            FROM sound a JOIN sound r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id AND len(a.v) = len(r.v)
        ), positives AS (
            SELECT anchor_id, row_id AS positive_id, score AS positive_score
            FROM scored WHERE positive
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= 5
        )
        SELECT anchor_id, positive_id,
               CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, row_id) AS INTEGER) AS rank,
               row_id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scored USING (anchor_id)
        WHERE NOT positive AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY rank <= 10
    """,
    "op13_source_divergence": r"""
        WITH docs AS (
            SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ), spoken AS (
            SELECT doc_id, lang, source, unnest(terms) AS term FROM docs
        ), kept AS (
            SELECT lang, term, count(*) AS n FROM spoken GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 10
        ), langs AS (
            SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n) AS HUGEINT) AS total FROM kept GROUP BY lang
        ), counts AS (
            SELECT lang, source, term, count(*) AS n FROM spoken SEMI JOIN kept USING (lang, term) GROUP BY ALL
        ), groups AS (
            SELECT DISTINCT lang, source FROM docs
        ), totals AS (
            SELECT lang, source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS total
            FROM groups LEFT JOIN counts USING (lang, source) GROUP BY lang, source
        ), shares AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                   1 + 1000000000 * CAST(coalesce(c.n, 0) + 2 AS HUGEINT) // (g.total + 2 * l.v) AS p,
                   1 + 1000000000 * CAST(k.n + 2 AS HUGEINT) // (l.total + 2 * l.v) AS q
            FROM totals g JOIN langs l USING (lang) JOIN kept k USING (lang)
            LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), sums AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
            GROUP BY a.lang, a.source, b.source
        ), pairs AS (
            SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
        ), parts AS (
            SELECT lang, source, 'pair' AS part, item, value FROM pairs
            UNION ALL
            SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q
        )
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
               CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM parts
        QUALIFY part = 'pair' OR rank <= 10
    """,
}
