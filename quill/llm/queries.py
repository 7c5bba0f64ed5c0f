"""The queries opN_<name> over the driver's tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.llm import asof, decontaminate, html_extract, language, licenses, line_dedup, lm_score, packing, prefix_trie, simhash, token_counts, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"), with_runs=True).select("doc_id", "text", "n_lines_removed")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_score(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations")).drop("path")


def op13_feature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.features(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_decontaminate, op3_packing, op4_language_id, op5_toxicity, op6_line_dedup, op7_html_extract, op8_simhash, op9_topk, op10_token_counts, op11_lm_scoring, op12_prefix_trie, op13_feature_join)
}

_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op1_license_scan": licenses.oracle(),
    "op2_decontaminate": rf"""
        WITH dw AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        bw AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_ASCII_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
        bn AS (SELECT item, w, least(len(w), 10) AS n FROM bw WHERE len(w) > 0),
        bk AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
        sizes AS (SELECT DISTINCT n FROM bk),
        dk AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
               FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
        found AS (SELECT doc_id, item, dk.n, i FROM dk JOIN bk USING (n, k)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM found)) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
        SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN hit ON dw.doc_id = hit.doc_id LEFT JOIN items ON dw.doc_id = items.doc_id""",
    "op9_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
                   WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    # crc32 bit by bit over the digits of an id; a prefix is named by the digest of its JSON.
    "op12_prefix_trie": r"""
        WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
        l AS (SELECT c, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, sha256(length(role)::VARCHAR || ':' || role || text)) AS own FROM t GROUP BY c),
        h AS (SELECT c, own, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ord(substr(c::VARCHAR, i::INT, 1))::BIGINT)),
                lambda x, y: list_reduce(list_prepend(xor(x, y), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: xor(a >> 1, 3988292384 * (a & 1))))) % 4 AS h FROM l),
        p AS (SELECT h.c, list_concat(coalesce(list_slice(b.own, 1, h.h), []), list_slice(h.own, h.h + 1, len(h.own))) AS path FROM h LEFT JOIN l b ON b.c = h.c - h.c % 20),
        d AS (SELECT c, path, len(path) AS len, unnest(range(0, len(path) + 1)) AS d FROM p),
        k AS (SELECT c, d, len, sha256(to_json(list_slice(path, 1, d))::VARCHAR) AS key, CASE WHEN d > 0 THEN sha256(to_json(list_slice(path, 1, d - 1))::VARCHAR) END AS parent,
                CASE WHEN d > 0 THEN len(regexp_extract_all(path[d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words FROM d),
        n AS (SELECT key, any_value(parent) AS parent, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
                sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = len), '')) AS ends_sha256 FROM k GROUP BY key),
        m AS (SELECT n.*, (SELECT count(*) FROM n b WHERE b.parent = n.key) AS n_children FROM n),
        s AS (SELECT DISTINCT a.key AS top, b.key AS sub FROM k a JOIN k b ON a.c = b.c AND a.d <= b.d),
        u AS (SELECT top, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens FROM s JOIN m ON m.key = sub GROUP BY top)
        SELECT m.conv_id, m.depth, a.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
        FROM m JOIN u ON top = m.key LEFT JOIN m a ON a.key = m.parent""",
    "op13_feature_join": """
        WITH n AS (SELECT doc_id, source, n_chars, lang, list_transform(range(4), lambda i: ('0x' || substr(sha256(doc_id::VARCHAR), 8 * i::INT + 1, 8))::BIGINT) AS h FROM documents),
        v AS (SELECT *, h[1] % 200000 AS event, h[1] % 200000 - 60 + h[2] % 1200 AS arrival, h[1] % 200000 + h[3] % 900 AS expiry FROM n WHERE doc_id IS NOT NULL AND source IS NOT NULL),
        o AS (SELECT doc_id, min(source) AS source FROM documents GROUP BY doc_id),
        a AS (SELECT row_number() OVER () AS r, l.doc_id, ('0x' || substr(sha256(l.doc_id::VARCHAR), 25, 8))::BIGINT % 200000 AS t, o.source FROM labels l LEFT JOIN o ON l.doc_id = o.doc_id),
        w AS (SELECT r, v.doc_id AS version_id, t - event AS age, v.n_chars, v.lang, row_number() OVER (PARTITION BY r ORDER BY event DESC, arrival DESC, v.doc_id DESC, v.n_chars DESC NULLS LAST, v.lang DESC NULLS LAST) AS place
              FROM a JOIN v ON v.source = a.source AND event <= t AND arrival <= t AND t < expiry)
        SELECT a.doc_id, t, version_id, age, CASE WHEN version_id IS NULL THEN 'none' WHEN age > 20 THEN 'stale' ELSE 'fresh' END AS status,
               CASE WHEN age <= 20 THEN n_chars END AS n_chars, CASE WHEN age <= 20 THEN lang END AS lang
        FROM a LEFT JOIN w ON a.r = w.r AND place = 1""",
    # A chunk begins after a line that ends one, and on either side of a long line; beside chunks, the least runs of lines of 25 words from each line on and back from each.
    "op6_line_dedup": r"""
        WITH l AS (SELECT doc_id, text, i, ls[i] AS line, len(regexp_extract_all(ls[i], '[^ \t\n\r\f\v]+')) AS n
                   FROM (SELECT doc_id, text, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text <> ''))),
        h AS (SELECT *, n >= 25 AS long, CASE WHEN n >= 25 THEN 0 ELSE ('0x' || substr(md5(line), 1, 8))::BIGINT END AS own FROM l),
        e AS (SELECT *, long OR (own + 31 * coalesce(lag(own) OVER w, 0)) % 2 = 0 AS ends FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        s AS (SELECT *, (long OR coalesce(lag(ends) OVER w, true))::INT AS starts FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        c AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) AS chunk FROM s),
        w AS (SELECT doc_id, i, n, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS cw FROM l),
        up AS (SELECT doc_id, cw, min(i) AS i FROM w GROUP BY doc_id, cw),
        down AS (SELECT doc_id, cw - n AS p, max(i) AS s FROM w GROUP BY doc_id, cw - n),
        spans AS (SELECT doc_id, min(i) AS a, count(*) AS m FROM c GROUP BY doc_id, chunk HAVING sum(n) >= 25 OR count(*) > 1 AND sum(n) >= 8
                  UNION SELECT f.doc_id, f.i, up.i - f.i + 1 FROM w f ASOF JOIN up ON f.doc_id = up.doc_id AND f.cw - f.n + 25 <= up.cw WHERE f.n > 0
                  UNION SELECT f.doc_id, down.s, f.i - down.s + 1 FROM w f ASOF JOIN down ON f.doc_id = down.doc_id AND f.cw - 25 >= down.p WHERE f.n > 0),
        b AS (SELECT spans.doc_id, a, m, sha256(array_to_string(list_slice(string_split(text, chr(10)), a::INT, (a + m - 1)::INT), chr(10))) AS body FROM spans JOIN documents d ON d.doc_id = spans.doc_id),
        f AS (SELECT *, row_number() OVER p AS place, first_value(doc_id) OVER p AS first_doc, first_value(a) OVER p AS first_a FROM b WINDOW p AS (PARTITION BY body ORDER BY doc_id, a)),
        gone AS (SELECT DISTINCT doc_id, unnest(CASE WHEN doc_id = first_doc AND a < first_a + m THEN range(first_a + m, a + m) ELSE range(a, a + m) END) AS i FROM f WHERE place > 1),
        r AS (SELECT l.doc_id, count(gone.i) AS removed, string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL) AS body FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id)
        SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.body, '') END AS text, coalesce(r.removed, 0)::BIGINT AS n_lines_removed
        FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id""",
}
