"""The registered queries of these operators, over whole tables, and their SQL where SQL can express them."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (
    containment, lattice_links, near_duplicates, packing, personal_data, prefix_trie, quality, repeats, sharding, token_counts, top_k,
    toxicity, vector_codes,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nnpu_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_jump_shards(spark, sf_dir):
    return sharding.shard_rows(_table(spark, sf_dir, "documents"), 24)


def op3_nbsvm_quality(spark, sf_dir):
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_benchmark_containment(spark, sf_dir):
    return containment.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark, sf_dir):
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_personal_data(spark, sf_dir):
    return personal_data.personal_data(_table(spark, sf_dir, "documents"))


def op7_exact_top_k(spark, sf_dir):
    return top_k.exact_top_k(_table(spark, sf_dir, "embeddings"))


def op8_near_duplicates(spark, sf_dir):
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85)


def op9_retrieval_packing(spark, sf_dir):
    return packing.packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_repeated_bytes(spark, sf_dir):
    return repeats.without_repeats(_table(spark, sf_dir, "documents"))


def op11_lattice_links(spark, sf_dir):
    return lattice_links.near_vectors(_table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark, sf_dir):
    return vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_nnpu_toxicity, op2_jump_shards, op3_nbsvm_quality, op4_benchmark_containment, op5_token_counts, op6_personal_data,
        op7_exact_top_k, op8_near_duplicates, op9_retrieval_packing, op10_repeated_bytes, op11_lattice_links, op12_vector_codes,
        op13_prefix_trie,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(string_split_regex(" + _LOWER + ", '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def _shingled(table: str, key: str, k: str) -> str:
    """Rows (key, shingle): distinct runs of k words."""
    return f"""
      SELECT DISTINCT {key}, array_to_string(list_slice(words, i, i + {k} - 1), ' ') AS shingle
      FROM (SELECT *, unnest(range(1, len(words) - {k} + 2)) AS i FROM {table})"""


OP4_SQL = f"""
WITH items AS (SELECT item_id, {_WORDS.format("text")} AS words FROM benchmark WHERE item_id IS NOT NULL),
sized AS (SELECT *, least(5, len(words)) AS k FROM items WHERE len(words) > 0),
parts AS ({_shingled("sized", "item_id", "k")}),
sizes AS (SELECT item_id, count(*) AS n_item FROM parts GROUP BY item_id),
docs AS (SELECT doc_id, {_WORDS.format("text")} AS words FROM documents WHERE doc_id IS NOT NULL),
widths AS (SELECT DISTINCT k FROM sized),
found AS ({_shingled("(SELECT * FROM docs, widths WHERE len(words) >= k)", "doc_id", "k")}),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM found JOIN parts USING (shingle) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM shared JOIN sizes USING (item_id) WHERE 100 * n_shared >= 80 * n_item"""

OP7_SQL = """
WITH kept AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM kept q JOIN kept c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""

OP8_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
sized AS (SELECT *, least(3, len(words)) AS k FROM docs WHERE len(words) > 0),
parts AS ({_shingled("sized", "doc_id", "k")}),
sizes AS (SELECT doc_id, count(*) AS n FROM parts GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM parts a JOIN parts b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(doc_id, low) AS (SELECT a, b FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.low),
lowest AS (SELECT doc_id, min(low) AS low FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) AS kept
FROM docs d LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest USING (doc_id)"""

_WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

OP11_SQL = f"""
WITH RECURSIVE rows AS (SELECT row_number() OVER () AS n, vec_id, CAST(embedding AS DOUBLE[]) AS v, {_WHOLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable FROM embeddings),
normed AS (SELECT n, vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM rows WHERE usable),
links AS (
  SELECT a.n AS a, b.n AS b FROM normed a JOIN normed b ON a.n <> b.n
  WHERE list_sum(list_transform(list_zip(a.v, b.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) / (a.norm * b.norm) >= 0.9),
reach(n, other) AS (SELECT a, b FROM links UNION SELECT reach.n, links.b FROM reach JOIN links ON links.a = reach.other),
lowest AS (SELECT reach.n, min(vec_id) AS low FROM reach JOIN rows ON rows.n = reach.other GROUP BY reach.n),
counted AS (SELECT a AS n, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, low) AS component_id, vec_id IS NOT DISTINCT FROM least(vec_id, low) AS kept
FROM rows LEFT JOIN lowest USING (n) LEFT JOIN counted USING (n)"""


def _assigned(book: str) -> str:
    """Every part with its nearest entry: the least of (distance, entry)."""
    return f"""
      SELECT n, p, x, min(struct_pack(d := list_sum(list_transform(list_zip(x, y), lambda q: (q[1] - q[2]) * (q[1] - q[2]))), e := e)) AS best
      FROM parts JOIN {book} USING (p) GROUP BY n, p, x"""


def _mean(assigned: str, book: str) -> str:
    """The floor of the mean of an entry's parts, place by place; unused entries stay."""
    return f"""
      SELECT p, e, coalesce(z, y) AS y FROM {book} LEFT JOIN (
        SELECT p, e, list(m ORDER BY j) AS z FROM (
          SELECT p, best.e AS e, j, CAST(floor(sum(x[j])::DOUBLE / count(*)) AS BIGINT) AS m
          FROM (SELECT *, unnest(range(1, len(x) + 1)) AS j FROM {assigned}) GROUP BY p, best.e, j) GROUP BY p, e) USING (p, e)"""


OP12_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS n, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {_WHOLE}),
parts AS (SELECT n, p, list_slice(v, p * len(v) // 16 + 1, (p + 1) * len(v) // 16) AS x FROM kept, (SELECT unnest(range(16)) AS p)),
book0 AS (SELECT p, n AS e, x AS y FROM parts WHERE n < 64),
near0 AS ({_assigned("book0")}), book1 AS ({_mean("near0", "book0")}),
near1 AS ({_assigned("book1")}), book2 AS ({_mean("near1", "book1")}),
near2 AS ({_assigned("book2")}),
coded AS (SELECT n, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near2 GROUP BY n),
digest AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (n), digest"""

_CRC32 = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST({c} AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))))"""

OP13_SQL = f"""
WITH rows AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(concat(len(coalesce(role, '')), ':', role, text)) AS token
  FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, token) - 1 AS pos FROM rows),
convs AS (SELECT DISTINCT c, c - c % 100 AS base, {_CRC32.format(c="c")} % 6 AS h FROM rows),
mixed AS (
  SELECT convs.c, 0 AS own, pos, token, text FROM convs JOIN turns ON turns.c = base AND pos < h
  UNION ALL SELECT convs.c, 1, pos, token, text FROM convs JOIN turns ON turns.c = convs.c AND pos >= h),
placed AS (SELECT c, token, text, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS d FROM mixed),
paths AS (
  SELECT c, 0 AS d, '' AS path, NULL AS above, 0 AS size FROM convs
  UNION ALL SELECT c, d, string_agg(token, ',') OVER w, string_agg(token, ',') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), len(text)
  FROM placed WINDOW w AS (PARTITION BY c ORDER BY d)),
lengths AS (SELECT c, max(d) AS len FROM paths GROUP BY c),
nodes AS (
  SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, any_value(coalesce(above, '')) AS above, any_value(size) AS size,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = len), '')) AS ends_sha256
  FROM paths JOIN lengths USING (c) GROUP BY path, d),
counted AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes k WHERE k.d = n.d + 1 AND k.above = n.path) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.path = n.above AND p.d = n.d - 1)
SELECT a.conv_id, CAST(a.d AS BIGINT) AS depth, a.parent_conv_id, a.n_convs, a.n_children, CAST(count_if(b.n_children = 0) AS BIGINT) AS n_leaves,
  CAST(sum((b.n_convs - 1) * b.size) AS BIGINT) AS saved_tokens, a.ends_sha256
FROM counted a JOIN counted b ON b.d >= a.d AND (a.d = 0 OR b.path = a.path OR starts_with(b.path, a.path || ',')) GROUP BY ALL"""

ORACLE = {
    "op4_benchmark_containment": OP4_SQL, "op7_exact_top_k": OP7_SQL, "op8_near_duplicates": OP8_SQL, "op11_lattice_links": OP11_SQL,
    "op12_vector_codes": OP12_SQL, "op13_prefix_trie": OP13_SQL,
}
