"""SQL with the same results as the queries of this folder, where SQL can tell them."""

from __future__ import annotations

import math

from tripmill.llm.common import UPPER
from tripmill.llm.licences import PHRASES, TEMPLATES, THRESHOLD

_LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"


def _licences() -> str:
    """Phrases by position; of each window of words from a template's token on, as long as
    the notice and a quarter more (two words at least), the distinct tokens it shares."""
    starts = []
    for phrase in PHRASES:
        words = phrase.split()
        hit = " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(words))
        starts.append(f"list_filter(range(1, len(w) + 1), lambda i: coalesce({hit}, false))")
    templates = []
    for label, template in TEMPLATES.items():
        words = template.split()
        tokens = set(words)
        need = math.ceil(THRESHOLD * len(tokens) - 1e-9)
        length = len(words) + max(2, math.ceil(len(words) / 4))
        templates += [f"('{label}', '{token}', {need}, {length}, {len(tokens)})" for token in sorted(tokens)]
    labels = ", ".join(f"CASE WHEN len(s{k}) > 0 THEN '{label}' END" for k, label in enumerate(PHRASES.values()))
    return f"""
        WITH words AS (
            SELECT doc_id, {_LOWERED} AS content,
                   regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM documents
        ), found AS (
            SELECT *, {", ".join(f"{start} AS s{k}" for k, start in enumerate(starts))} FROM words
        ), base AS (
            SELECT *, list_concat({", ".join(f"s{k}" for k in range(len(starts)))}) AS places,
                   list_filter([{labels}], lambda x: x IS NOT NULL) AS base_list
            FROM found
        ), templates AS (
            SELECT * FROM (VALUES {", ".join(templates)}) AS t(label, token, need, length, size)
        ), placed AS (
            SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS place FROM words
        ), shared AS (
            SELECT doc_id, label, need, size, count(DISTINCT token) OVER (
                PARTITION BY doc_id, label ORDER BY place RANGE BETWEEN CURRENT ROW AND length - 1 FOLLOWING
            ) AS overlap
            FROM placed JOIN templates USING (token)
        ), contained AS (
            SELECT doc_id, list(DISTINCT label) AS labels, max(overlap / size) AS containment
            FROM shared WHERE overlap >= need GROUP BY doc_id
        )
        SELECT doc_id, len(w) AS n_words, len(places) AS n_base,
               list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
               array_to_string(list_sort(list_distinct(base_list)), ',') AS base_labels,
               array_to_string(list_sort(list_distinct(list_concat(base_list, coalesce(labels, [])))), ',') AS labels,
               CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(containment, 0.0)::DOUBLE END AS score
        FROM base LEFT JOIN contained USING (doc_id)
    """


# CTEs that give t, the table of CRC-32 (polynomial 0xEDB88320), as a list, and the
# unsigned checksum of a text by it.
_CRC_TABLE = """
    bits(i, k, c) AS (
        SELECT range, 0, range FROM range(256)
        UNION ALL
        SELECT i, k + 1, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) FROM bits WHERE k < 8
    ), crc_table AS (
        SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
    )
"""


def _crc32(text: str) -> str:
    bytes_ = (
        f"list_transform(range(1, (len(hex({text})) // 2)::BIGINT + 1), "
        f"lambda k: ('0x' || substr(hex({text}), 2 * k - 1, 2))::BIGINT)"
    )
    step = "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce({bytes_}, {step}, 4294967295), 4294967295)"


def _merkle(levels: int = 7, upper_levels: int = 3) -> str:
    """Trees of up to 8 ** levels documents a language and 8 ** upper_levels languages."""

    def field(value: str) -> str:
        return f"coalesce(octet_length(encode({value}::VARCHAR))::VARCHAR || ':' || {value}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"

    lowered = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    parts = []
    for name, count in (("a", levels), ("b", upper_levels)):
        if name == "b":
            roots = " UNION ALL ".join(f"SELECT tree, h FROM a{k} WHERE n = 1" for k in range(levels + 1))
            parts.append(f"subroots AS ({roots})")
            parts.append(
                "b0 AS (SELECT '' AS tree, tree AS name, row_number() OVER (ORDER BY tree) - 1 AS r, "
                "count(*) OVER () AS n, h FROM subroots)"
            )
        for k in range(count):
            parts.append(
                f"{name}{k + 1} AS (SELECT tree, r // 8 AS r, (n + 7) // 8 AS n, sha256(string_agg(h, '' ORDER BY r)) AS h "
                f"FROM {name}{k} WHERE n > 1 GROUP BY tree, r // 8, n)"
            )
            parts.append(
                f"s{name}{k} AS (SELECT x.tree, x.r, "
                "coalesce(string_agg(y.h, '' ORDER BY y.r) FILTER (y.r < x.r), '') AS low, "
                "coalesce(string_agg(y.h, '' ORDER BY y.r) FILTER (y.r > x.r), '') AS high "
                f"FROM {name}{k} x JOIN {name}{k} y ON x.tree = y.tree AND x.r // 8 = y.r // 8 "
                "WHERE x.n > 1 GROUP BY x.tree, x.r)"
            )
    # Every level adds its siblings to the proof and folds them into the digest so far.
    steps = [("a", k, "f.tree", f"f.r // {8**k}") for k in range(levels)]
    steps += [("b", k, "''", f"f.place // {8**k}") for k in range(upper_levels)]
    parts.append(
        "f0 AS (SELECT leaf.*, s.h AS subroot, b0.r AS place, '' AS proof, coalesce(tampered, leaf) AS folded "
        "FROM leaf JOIN subroots s USING (tree) JOIN b0 ON b0.name = leaf.tree)"
    )
    for number, (name, k, tree, r) in enumerate(steps):
        parts.append(
            f"f{number + 1} AS (SELECT f.* REPLACE (proof || coalesce(low || high, '') AS proof, "
            "CASE WHEN low IS NULL THEN folded ELSE sha256(low || folded || high) END AS folded) "
            f"FROM f{number} f LEFT JOIN s{name}{k} s ON s.tree = {tree} AND s.r = {r})"
        )
    tops = " UNION ALL ".join(f"SELECT h FROM b{k} WHERE n = 1" for k in range(upper_levels + 1))
    return f"""
        WITH RECURSIVE {_CRC_TABLE}, hashed AS (
            SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf('text')} AS leaf,
                   CASE WHEN {_crc32('doc_id::VARCHAR')} % 3 = 0 THEN {leaf(lowered)} END AS tampered
            FROM documents, crc_table
        ), leaf AS (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r,
                   count(*) OVER (PARTITION BY tree) AS n
            FROM hashed
        ), a0 AS (
            SELECT tree, r, n, leaf AS h FROM leaf
        ), {", ".join(parts)}, root AS ({tops})
        SELECT doc_id, leaf, subroot, root.h AS root, sha256(proof) AS proof_sha256,
               folded AS folded_root, folded = root.h AS verified
        FROM f{len(steps)}, root
    """


def _importance() -> str:
    """Features of whole texts, without regard to lines."""
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    pairs = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    noise = "('0x' || substr(sha256('7:' || doc_id::VARCHAR), 1, 8))::BIGINT"
    return f"""
        WITH RECURSIVE {_CRC_TABLE}, texts AS (
            SELECT doc_id, regexp_extract_all({_LOWERED}, '{word}') AS w FROM documents
        ), goals AS (
            SELECT regexp_extract_all({_LOWERED}, '{word}') AS w FROM benchmark
        ), used AS (
            SELECT doc_id, unnest(list_concat(w, {pairs})) AS feature FROM texts
        ), wanted AS (
            SELECT unnest(list_concat(w, {pairs})) AS feature FROM goals
        ), features AS (
            SELECT feature, ({_crc32('feature')} % 10000)::INT AS bucket
            FROM (SELECT feature FROM used UNION SELECT feature FROM wanted), crc_table
        ), corpus AS (
            SELECT bucket, count(*) AS s FROM used JOIN features USING (feature) GROUP BY bucket
        ), target AS (
            SELECT bucket, count(*) AS t FROM wanted JOIN features USING (feature) GROUP BY bucket
        ), totals AS (
            SELECT (SELECT count(*) FROM used) AS all_s, (SELECT count(*) FROM wanted) AS all_t
        ), gains AS (
            SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)
                                           / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain
            FROM corpus LEFT JOIN target USING (bucket), totals
        ), weighed AS (
            SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
            FROM used JOIN features USING (feature) JOIN gains USING (bucket) GROUP BY doc_id
        ), scored AS (
            SELECT doc_id, len(w)::BIGINT AS n_words, greatest(2 * len(w) - 1, 0)::BIGINT AS n_features,
                   coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln(({noise} + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM texts LEFT JOIN weighed USING (doc_id)
        ), ranked AS (
            SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
            FROM scored WHERE n_words >= 20
        )
        SELECT doc_id, n_features, weight, score,
               CASE WHEN place <= 25 * n // 100 THEN place END AS rank, n_words
        FROM scored LEFT JOIN ranked USING (doc_id)
    """


# All queries against all rows. Components are summed as whole numbers.
_TOP_K = """
    WITH points AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id,
               list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
        FROM points q, points c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
    )
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

ORACLE_SQL = {
    "op13_top_k_search": _TOP_K,
    "op11_importance_resampling": _importance(),
    "op12_merkle_manifest": _merkle(),
    "op6_near_dedup": f"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, unnest(
                CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                     WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' ' || len(w)] ELSE [] END
            ) AS shingle
            FROM words
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), links AS (
            SELECT a.doc_id AS a, b.doc_id AS b
            FROM shingles a JOIN shingles b USING (shingle)
            JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
            WHERE a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, x.n, y.n
            HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
        ), reach AS (
            SELECT doc_id, doc_id AS other FROM documents
            UNION
            SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
        ), roots AS (
            SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM roots LEFT JOIN sizes USING (doc_id)
    """,
    "op7_warc": """
        WITH payloads AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), firsts AS (
            SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id
            FROM payloads
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first_id <> page_id THEN first_id END AS refers_to
        FROM firsts
    """,
    "op8_licence_scan": _licences(),
    "op9_exact_dedup": f"""
        WITH lowered AS (
            SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS content
            FROM documents
        )
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(content) AS text_sha256
        FROM lowered
        WINDOW same AS (PARTITION BY content)
    """,
}
