"""The operators' queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, jaccard, languages, licenses, mixing, negatives, neighbours, packed, quality, separators, toxicity, warc
from .common import ship, table

Query = Callable[[SparkSession, str], DataFrame]


def _query(name: str, run: Callable[[DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return run(table(spark, sf_dir, name))

    return query


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_adaptive_dimension_scan": _query("embeddings", neighbours.nearest),
    "op2_tree_concatenation": _query("documents", bpe.round_trip_digests),
    "op3_splitting_tree": _query("documents", mixing.taken),
    "op4_separator_scan": _query("documents", separators.document_token_counts),
    "op5_diagonal_voting": _query("documents", licenses.scan),
    "op6_levenshtein_lexicon": op6,
    "op7_bit_packing": _query("documents", lambda docs: packed.read(packed.write(docs))),
    "op8_chunked_records": _query("pages", warc.page_records),
    "op9_mcd_outliers": _query("documents", quality.quality),
    "op10_prefix_tree": _query("documents", jaccard.groups),
    "op11_rabin_karp_phrases": _query("documents", collocations.collocations),
    "op13_hyperdimensional_profiles": _query("documents", languages.predict),
    "op12_kronecker_negatives": _query("embeddings", lambda e: negatives.mine(e, negatives.shifted_label())),
}

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(s, {5 * g + 1}, 5))::INTEGER >> {shift}) & 31), 1)" for g in range(8) for shift in (15, 10, 5, 0)
)



def _licenses_sql() -> str:
    """The votes by band, and the longest chain of a band's points by recursion over chain lengths."""
    rows = [(words, label, "true", 1.0) for words, label in licenses.PHRASES] + [(words, label, "false", share) for words, label, share in licenses.NOTICES]
    values = ", ".join(f"({k}, '{label}', {base}, {share}::DOUBLE, string_split('{words}', ' '))" for k, (words, label, base, share) in enumerate(rows))
    telling = ", ".join(f"('{label}', '{pair}')" for label, pairs in licenses.TELLING.items() for pair in pairs)
    letters = "abcdefghijklmnopqrstuvwxyz"
    return f"""
        WITH RECURSIVE t AS (SELECT *, len(w) - 1 AS pairs FROM (VALUES {values}) AS t(template, label, base, share, w)),
        tp AS (SELECT template, label, base, share, pairs, unnest(range(pairs)) AS place, w FROM t),
        tq AS (SELECT * EXCLUDE (w), w[place + 1] AS ta, w[place + 2] AS tb FROM tp),
        tell AS (SELECT q.template, q.place, q.ta || ' ' || q.tb AS pair FROM tq q JOIN (VALUES {telling}) AS x(label, pair) ON x.label = q.label AND x.pair = q.ta || ' ' || q.tb WHERE NOT q.base),
        needs AS (SELECT template, count(DISTINCT pair) AS needs FROM tell GROUP BY template),
        d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{letters.upper()}', '{letters}'), '{licenses.WORD}') AS w FROM documents),
        p AS (SELECT r, i, w[i + 1] AS a, w[i + 2] AS b FROM (SELECT r, w, unnest(range(len(w) - 1)) AS i FROM d)),
        h AS (SELECT p.r, p.i, q.template, q.label, q.base, q.share, q.pairs, q.place, tell.pair AS tells FROM p JOIN tq q ON p.a = q.ta AND p.b = q.tb LEFT JOIN tell ON tell.template = q.template AND tell.place = q.place),
        v AS (SELECT *, unnest(CASE WHEN base THEN [i - place] ELSE [floor((i - place) / {licenses.SHIFT}::DOUBLE)::BIGINT, floor((i - place) / {licenses.SHIFT}::DOUBLE)::BIGINT - 1] END) AS band FROM h),
        g AS (SELECT r, template, label, base, share, pairs, band, count(DISTINCT place) AS places, min(i) AS start, count(DISTINCT tells) AS told FROM v GROUP BY ALL),
        m AS (SELECT g.*, NOT base AND places / pairs::DOUBLE >= share AND told = coalesce(needs, 0) AS may FROM g LEFT JOIN needs USING (template)),
        c AS (SELECT DISTINCT v.r, v.template, v.band, v.i, v.place, 1 AS n FROM v JOIN m USING (r, template, band) WHERE m.may
              UNION SELECT v.r, v.template, v.band, v.i, v.place, c.n + 1 FROM c JOIN v ON v.r = c.r AND v.template = c.template AND v.band = c.band AND v.i > c.i AND v.place > c.place),
        k AS (SELECT r, template, band, max(n) AS chain FROM c GROUP BY ALL),
        f AS (SELECT m.*, base AND places = pairs AS whole, CASE WHEN may THEN chain ELSE places END / pairs::DOUBLE AS covered FROM m LEFT JOIN k USING (r, template, band)),
        n AS (SELECT *, may AND covered >= share AS noticed FROM f)
        SELECT d.doc_id, len(any_value(d.w))::BIGINT AS n_words, count(*) FILTER (whole)::BIGINT AS n_base, min(start) FILTER (whole)::BIGINT AS first_word, max(start) FILTER (whole)::BIGINT AS last_word,
          coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (whole)), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (whole OR noticed)), ','), '') AS labels,
          coalesce(max(CASE WHEN whole OR noticed THEN covered ELSE covered / 4 END), 0::DOUBLE) AS score
        FROM d LEFT JOIN n USING (r) GROUP BY d.r, d.doc_id"""


def _jaccard_sql(words: int = jaccard.SHINGLE_WORDS, percent: int = jaccard.PERCENT) -> str:
    """Shingles joined to shingles, and all that links reach."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return f"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{letters.upper()}', '{letters}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' '))) END AS g FROM d),
        e AS (SELECT r, unnest(g) AS x FROM s),
        c AS (SELECT a.r AS p, b.r AS q, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.r <> b.r GROUP BY ALL),
        l AS (SELECT p, q FROM c JOIN s a ON a.r = p JOIN s b ON b.r = q WHERE 100 * n >= {percent} * (len(a.g) + len(b.g) - n)),
        t AS (SELECT r AS a, r AS b FROM s UNION SELECT t.a, l.q FROM t JOIN l ON l.p = t.b)
        SELECT a.doc_id, len(any_value(a.g))::BIGINT AS n_shingles, min(b.doc_id) AS component_id FROM t JOIN s a ON a.r = t.a JOIN s b ON b.r = t.b GROUP BY a.r, a.doc_id"""


def _collocations_sql() -> str:
    """All n-grams counted as text."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return f"""
        WITH p AS (SELECT lang, regexp_extract_all(x, '[^\\x20\\x09]+') AS w FROM (
               SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{letters.upper()}', '{letters}'), '[.,;:!?\\x0A-\\x0D]')) AS x FROM documents)),
        g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (SELECT unnest(range(1, {collocations.LONGEST + 1})) AS m))),
        f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {collocations.LEAST}),
        n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
        c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2),
        k AS (SELECT *, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
        s AS (SELECT k.lang, k.phrase, k.a, k.k, x.a AS l, y.a AS r, ((2000000::HUGEINT * k.a) // (x.a + y.a))::BIGINT AS score
              FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.x JOIN f y ON y.lang = k.lang AND y.phrase = k.y),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        i AS (SELECT lang, array_to_string(w[i:i + z - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, w, a, z, unnest(range(1, m - z + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS z FROM c)) GROUP BY ALL),
        t AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer::HUGEINT < {collocations.KEPT_PERCENT} * b.a::HUGEINT),
        o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t)
        SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= {collocations.MOST}"""


def _negatives_sql() -> str:
    """All anchors against all rows."""
    return f"""
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({negatives.SCALE} * x::DOUBLE)) AS e FROM embeddings
               WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.r AS a, a.vec_id AS anchor_id, a.label = b.label AS same, b.r AS b, b.vec_id AS id, list_dot_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r),
        p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id)::INTEGER AS nth FROM s WHERE same QUALIFY nth <= {negatives.POSITIVES}),
        n AS (SELECT p.anchor_id, p.id AS positive_id, p.nth AS positive_rank, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
                     row_number() OVER (PARTITION BY p.a, p.nth ORDER BY s.score DESC, s.id)::INTEGER AS rank
              FROM p JOIN s ON s.a = p.a AND NOT s.same AND {negatives.LEAST_PERCENT} * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank FROM n WHERE rank <= {negatives.NEGATIVES}"""


ORACLES: dict[str, str] = {
    "op12_kronecker_negatives": _negatives_sql(),
    "op11_rabin_karp_phrases": _collocations_sql(),
    "op10_prefix_tree": _jaccard_sql(),
    "op5_diagonal_voting": _licenses_sql(),
    "op8_chunked_records": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
             q AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS f FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id IS NOT DISTINCT FROM f THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id IS NOT DISTINCT FROM f THEN NULL ELSE f END AS refers_to
        FROM q""",
}
