"""The registered queries opN_<name>, each over its whole table, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bytebpe import token_report
from .collocations import collocations
from .common import read_table
from .decontaminate import decontamination
from .embeddings import embedding_groups
from .licenses import scan_licenses
from .manifest import manifest
from .packing import pack, token_pieces
from .secrets import secret_report
from .sharding import shard_documents
from .simhash import simhash_groups
from .substrings import remove_repeated
from .toxicity import toxicity
from .urls import RULES, url_verdicts


def word_bpe() -> str:
    """The place of the vocabulary file that the registered packing query uses."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def byte_bpe_ranks() -> str:
    """The place of the file of ranks that the registered encoding query uses."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(read_table(spark, sf_dir, "embeddings"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(read_table(spark, sf_dir, "documents"), word_bpe()))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"), 16)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(read_table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_verdicts(read_table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("text_hash")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(read_table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_report(read_table(spark, sf_dir, "documents"), byte_bpe_ranks())


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_toxicity": op5_toxicity,
    "op6_minimax_sharding": op6_minimax_sharding,
    "op7_secret_scan": op7_secret_scan,
    "op8_url_filter": op8_url_filter,
    "op9_decontamination": op9_decontamination,
    "op10_license_scan": op10_license_scan,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_collocations": op13_collocations,
    "pipeline": pipeline,
}

OP8_SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(r_host, r_path, r_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT page_id, host, path,
  (SELECT r_host || r_path FROM r WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) ORDER BY length(r_host || r_path) DESC LIMIT 1) AS rule,
  coalesce((SELECT r_verdict FROM r WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) ORDER BY length(r_host || r_path) DESC LIMIT 1), 'allow') AS verdict
FROM q
"""

OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, sha256(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM win JOIN rep USING (h)),
word AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept FROM embeddings
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a) USING (vec_id) LEFT JOIN (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY a) USING (vec_id)
"""

OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS win FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, n, list_slice(w, i, i + n - 1) AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM bw) ON len(w) >= n)),
hit AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, win)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""

OP11_SQL = """
WITH RECURSIVE raw AS (
  SELECT row_number() OVER () AS r, doc_id, lang, doc_id::VARCHAR AS a, source AS b, lang AS c, n_chars::VARCHAR AS e, text AS t, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u FROM documents),
leaf AS (
  SELECT r, doc_id, lang, sha256(head || coalesce(strlen(t) || ':' || t, '-')) AS leaf, sha256(head || coalesce(strlen(u) || ':' || u, '-')) AS other,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(a, ''), lambda x: ascii(x)::UBIGINT)),
      lambda s, x: list_reduce(list_prepend(xor(s, x), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda y, z: xor(y >> 1, 3988292384::UBIGINT * (y & 1)))), 4294967295::UBIGINT) % 3 = 0 AS tampered
  FROM (SELECT *, coalesce(strlen(a) || ':' || a, '-') || coalesce(strlen(b) || ':' || b, '-') || coalesce(strlen(c) || ':' || c, '-') || coalesce(strlen(e) || ':' || e, '-') AS head FROM raw)),
leaves AS (
  SELECT r, doc_id, leaf, CASE WHEN tampered THEN other ELSE leaf END AS other, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaf),
low(tree, level, i, n, d) AS (
  SELECT tree, 0, i, n, leaf FROM leaves
  UNION ALL SELECT tree, level + 1, i // 8, (max(n) + 7) // 8, sha256(string_agg(d, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY tree, level, i // 8),
top(level, i, n, d) AS (
  SELECT 0, tree - 1, count(*) OVER (), d FROM low WHERE n = 1
  UNION ALL SELECT level + 1, i // 8, (max(n) + 7) // 8, sha256(string_agg(d, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 8),
runs AS (
  SELECT tree, level, i, coalesce(string_agg(d, '') OVER (PARTITION BY tree, level, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(d, '') OVER (PARTITION BY tree, level, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM (SELECT tree, level, i, n, d FROM low UNION ALL SELECT 0, level, i, n, d FROM top) WHERE n > 1),
steps AS (
  SELECT r, row_number() OVER (PARTITION BY r ORDER BY tier, level) AS s, before, after FROM (
    SELECT r, 0 AS tier, level, before, after FROM leaves JOIN runs USING (tree) WHERE runs.i = leaves.i // (8 ** level)::BIGINT
    UNION ALL SELECT r, 1, level, before, after FROM leaves JOIN runs ON runs.tree = 0 WHERE runs.i = (leaves.tree - 1) // (8 ** level)::BIGINT)),
proof AS (SELECT r, sha256(string_agg(before || after, '' ORDER BY s)) AS proof, count(*) AS k FROM steps GROUP BY r),
fold(r, s, d) AS (SELECT r, 0, other FROM leaves UNION ALL SELECT r, steps.s, sha256(before || d || after) FROM fold JOIN steps USING (r) WHERE steps.s = fold.s + 1)
SELECT doc_id, leaf, low.d AS subroot, top.d AS root, coalesce(proof, sha256('')) AS proof_sha256, fold.d AS folded_root, fold.d = top.d AS verified
FROM leaves JOIN low ON low.tree = leaves.tree AND low.n = 1 JOIN top ON top.n = 1 LEFT JOIN proof USING (r) JOIN fold ON fold.r = leaves.r AND fold.s = coalesce(k, 0)
"""

OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS f
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS s(k) WHERE len(w) >= k) GROUP BY ALL),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS p FROM g WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, k, phrase, a, p, j, array_to_string(list_slice(p, 1, j), ' ') AS x, array_to_string(list_slice(p, j + 1, k), ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (SELECT cuts.lang, cuts.k, cuts.phrase, a, p, j, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
      FROM cuts JOIN g x ON x.lang = cuts.lang AND x.phrase = cuts.x JOIN g y ON y.lang = cuts.lang AND y.phrase = cuts.y),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
held AS (SELECT lang, inner_phrase AS phrase, max(a) AS most FROM (
      SELECT lang, a, unnest([array_to_string(list_slice(p, 1, 2), ' '), array_to_string(list_slice(p, 2, 3), ' ')]) AS inner_phrase FROM c WHERE k = 3) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM low JOIN n USING (lang) LEFT JOIN held USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a QUALIFY rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": OP1_SQL, "op2_embedding_dedup": OP2_SQL, "op8_url_filter": OP8_SQL, "op9_decontamination": OP9_SQL, "op13_collocations": OP13_SQL, "op11_merkle_manifest": OP11_SQL}
