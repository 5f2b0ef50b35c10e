"""The queries of this subpackage, each over whole tables, and their DuckDB SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sizes, word_count

    docs = table(spark, sf_dir, "documents")
    out = mix_sizes(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op3_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import components

    out = components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_embedding_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneser_ney import report

    return report(table(spark, sf_dir, "documents"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import report

    return report(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import report

    return report(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import report

    return report(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .trie import report

    return report(table(spark, sf_dir, "conversations"))


def op12_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import align

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import decode, encode

    path = public_tokenizers.path("word_bpe_49k.json")
    out = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "ids"), path)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_license_scan, op3_simhash_components, op4_toxicity, op5_decontaminate, op6_line_dedup,
        op7_repeated_passages, op8_embedding_components, op9_quality, op10_kneser_ney, op11_conversation_trie, op12_align_tokenizers, op13_bpe,
    )
}
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_DECONTAMINATE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w FROM documents),
b AS (SELECT * FROM (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT rid, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
       FROM (SELECT rid, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d JOIN ks ON len(w) >= k)),
hit AS (SELECT rid, i, k, item_id FROM dw JOIN bw USING (k, g)),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(generate_series(i, i + k - 1)) AS p FROM hit) GROUP BY rid),
bi AS (SELECT *, row_number() OVER () AS br FROM b),
bp AS (SELECT br, item_id, j, least(10, len(w)) AS k, array_to_string(list_slice(w, j, j + least(10, len(w)) - 1), ' ') AS g
       FROM (SELECT br, item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS j FROM bi)),
run AS (SELECT rid, br, item_id, k, i, j, i - row_number() OVER (PARTITION BY rid, br, i - j ORDER BY i) AS r FROM dw JOIN bp USING (k, g)),
far AS (SELECT rid, item_id, count(*) + k - 1 AS n, min(i) - 1 AS doc_at, min(j) - 1 AS item_at FROM run GROUP BY rid, br, item_id, k, i - j, r),
top AS (SELECT * FROM far QUALIFY row_number() OVER (PARTITION BY rid ORDER BY n DESC, doc_at, item_id NULLS LAST, item_at) = 1),
its AS (SELECT rid, count(DISTINCT item_id) AS n, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(cov.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(cov.n, 0) > 0 AS contaminated, coalesce(top.n, 0)::BIGINT AS longest, top.doc_at::BIGINT AS longest_at, top.item_id AS longest_item, top.item_at::BIGINT AS longest_item_at
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid) LEFT JOIN top USING (rid)
"""

# lines of a document are in order; documents are told apart by their id
_LINES = r"""
WITH l AS (SELECT doc_id, p, list_distinct(list_filter(regexp_split_to_array(lower(line), '[ \t\x0B\f\r]'), lambda x: x <> '')) AS w
           FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents WHERE text IS NOT NULL)),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, p) AS nr, array_to_string(list_sort(w), ' ') AS s FROM l WHERE len(w) > 0),
sets AS (SELECT s, any_value(w) AS w, min(nr) AS first FROM o GROUP BY s),
t AS (SELECT s, len(w) AS n, unnest(w) AS t FROM sets),
f AS (SELECT t, count(*) AS c FROM t GROUP BY t),
pre AS (SELECT s, n, t FROM (SELECT s, n, t.t, row_number() OVER (PARTITION BY s ORDER BY c, t.t) AS i FROM t JOIN f USING (t)) WHERE i <= n - ceil(0.8 * n - 1e-9) + 1),
pairs AS (SELECT DISTINCT a.s AS a, b.s AS b FROM pre a JOIN pre b ON a.t = b.t AND a.s <> b.s AND b.n BETWEEN 0.8 * a.n - 1e-9 AND 1.25 * a.n + 1e-9),
near AS (SELECT a, min(y.first) AS first FROM pairs JOIN sets x ON x.s = a JOIN sets y ON y.s = b
         WHERE len(list_intersect(x.w, y.w)) >= (len(x.w) + len(y.w)) * (0.8 / 1.8) - 1e-9 GROUP BY a),
gone AS (SELECT doc_id, list_sort(list(p)) AS removed FROM o JOIN sets USING (s) LEFT JOIN near ON near.a = o.s
         WHERE least(sets.first, coalesce(near.first, sets.first)) < nr GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines, coalesce(len(removed), 0)::BIGINT AS n_removed,
       coalesce(removed, [])::INTEGER[] AS removed
FROM documents d LEFT JOIN gone ON d.doc_id IS NOT DISTINCT FROM gone.doc_id
"""

_PASSAGES = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') END AS w FROM documents),
g AS (SELECT rid, doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS g FROM (SELECT rid, doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
c AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g HAVING count(*) > 1),
m AS (SELECT rid, i, least, (coalesce(least, 9223372036854775807) < coalesce(doc_id, 9223372036854775807) OR row_number() OVER (PARTITION BY rid, g ORDER BY i) > 1) AS later FROM g JOIN c USING (g)),
p AS (SELECT rid, count(DISTINCT q) AS n, count(DISTINCT q) FILTER (later) AS n_later FROM (SELECT rid, later, unnest(generate_series(i, i + 49)) AS q FROM m) GROUP BY rid),
f AS (SELECT rid, list_sort(list(DISTINCT least)) AS first_docs FROM m WHERE later AND least IS NOT NULL GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_repeated, coalesce(n_later, 0)::BIGINT AS n_later, coalesce(first_docs, [])::BIGINT[] AS first_docs
FROM d LEFT JOIN p USING (rid) LEFT JOIN f USING (rid)
"""

_EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
      WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
r AS (SELECT a, a AS c FROM (SELECT DISTINCT a FROM e) UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a),
low AS (SELECT a, min(c) AS c FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(low.c, vec_id) AS component_id, coalesce(low.c, vec_id) = vec_id AS kept
FROM v LEFT JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

_CRC = """list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b:
  list_reduce(list_prepend(xor(c, b), [1::BIGINT, 1, 1, 1, 1, 1, 1, 1]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"""

_TRIE = rf"""
WITH own AS (SELECT conv_id, list({{'r': r, 't': t}} ORDER BY turn NULLS FIRST, sha256(r || chr(10) || t)) AS s
             FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
h AS (SELECT conv_id, s, xor({_CRC}, 4294967295) % 4 AS h FROM own),
re AS (SELECT h.conv_id, list_concat(list_slice(coalesce(b.s, []), 1, h), list_slice(h.s, h + 1, len(h.s))) AS s
       FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 20),
m AS (SELECT conv_id, d, list_slice(s, 1, d) AS p, len(s) = d AS ended, CASE WHEN d > 0 THEN s[d].t ELSE '' END AS t
      FROM (SELECT conv_id, s, unnest(generate_series(0, len(s))) AS d FROM re)),
n AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * len(regexp_extract_all(any_value(t), '[^\x20\x09-\x0D]+')) AS own_saved,
             coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '') AS ends FROM m GROUP BY p, d),
kids AS (SELECT list_slice(p, 1, d - 1) AS p, d - 1 AS d, count(*) AS k FROM n WHERE d > 0 GROUP BY ALL),
up AS (SELECT list_slice(n.p, 1, a) AS p, a AS d, count(*) FILTER (kids.k IS NULL) AS leaves, sum(own_saved) AS saved
       FROM (SELECT *, unnest(generate_series(0, d)) AS a FROM n) n LEFT JOIN kids ON kids.p = n.p AND kids.d = n.d GROUP BY ALL)
SELECT n.conv_id, n.d::BIGINT AS depth, par.conv_id AS parent_conv_id, n.n::BIGINT AS n_convs, coalesce(kids.k, 0)::BIGINT AS n_children,
       up.leaves::BIGINT AS n_leaves, up.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN up ON up.p = n.p AND up.d = n.d LEFT JOIN kids ON kids.p = n.p AND kids.d = n.d
LEFT JOIN n par ON n.d > 0 AND par.p = list_slice(n.p, 1, n.d - 1) AND par.d = n.d - 1
"""

#: Random choices (1), trained models (2, 4, 9, 10), 64-bit hashes (3) and tokenizers (12, 13) are beyond SQL.
SQL: dict[str, str] = {"op5_decontaminate": _DECONTAMINATE, "op6_line_dedup": _LINES, "op7_repeated_passages": _PASSAGES, "op8_embedding_components": _EMBEDDINGS, "op11_conversation_trie": _TRIE}
