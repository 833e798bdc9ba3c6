"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from .sql_text import OP11, OP12, OP13, crc_table

#: op1: quadratic rounds modulo 2^31-1; coefficients follow from the seed by x -> 48271 x, every fifth value.
_PRIME = 2147483647


def _coefficients(seed: int, rounds: int) -> list[list[int]]:
    values, x = [], seed % (_PRIME - 1) + 1
    for i in range(1, rounds * 15 + 1):
        x = x * 48271 % _PRIME
        if i % 5 == 0:
            values.append(x)
    return [values[i : i + 3] for i in range(0, len(values), 3)]


def _feistel(source: str, value: str) -> str:
    """A SELECT that adds q, the image of value, to the rows of source (which has a and b)."""
    q = f"SELECT *, {value} // b AS l0, {value} % b AS r0 FROM {source}"
    for i, (x2, x1, x0) in enumerate(_coefficients(20261201, 6)):
        x = f"{'l' if i % 2 else 'r'}{i}"
        f = f"(({x} * {x} % {_PRIME} * {x2} + {x} * {x1} + {x0}) % {_PRIME})"
        left, right = (f"l{i}", f"(r{i} + {f}) % b") if i % 2 else (f"(l{i} + {f}) % a", f"r{i}")
        q = f"SELECT *, {left} AS l{i + 1}, {right} AS r{i + 1} FROM ({q})"
    return f"SELECT n, a, b, id, l6 * b + r6 AS q FROM ({q})"


OP1 = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), slim AS (
  SELECT doc_id, length(h) // 2 + 1 AS size,
    xor(list_reduce([4294967295] || list_transform(range(length(h) // 2),
      lambda i: ('0x' || substr(h, 2 * i::BIGINT + 1, 2))::BIGINT),
      lambda c, x: xor(c // 256, {crc_table()}[1 + xor(c % 256, x)])), 4294967295) AS text_crc32
  FROM docs
), placed AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS id FROM slim
), dims AS (
  SELECT n, a, (n + a - 1) // a AS b FROM (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM slim)
), walk AS (
  {_feistel("(SELECT id, n, a, b FROM placed, dims)", "id")}
  UNION ALL
  {_feistel("(SELECT id, n, a, b, q AS v FROM walk WHERE q >= n)", "v")}
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law,
  (q % 16)::INTEGER AS shard, (q // 16)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed JOIN walk USING (id) WHERE q < n
"""

OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(
    list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])), lambda x, y: x + y)) AS score
  FROM v AS q, v AS c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score
FROM pairs QUALIFY rank <= 10
"""

OP6 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT rid, doc_id, unnest(k) AS k, generate_subscripts(k, 1) AS i FROM (
    SELECT rid, doc_id, list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' ')) AS k
    FROM d WHERE len(w) >= 20)
), ranked AS (
  SELECT rid, i, rank() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, i) > 1 AS again FROM win
), covered AS (
  SELECT DISTINCT rid, unnest(range(i, i + 20)) AS pos FROM ranked WHERE again
), each_word AS (
  SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d
), kept AS (
  SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM each_word ANTI JOIN covered USING (rid, pos) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

OP7 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def all_sql() -> dict[str, str]:
    return {
        "op1_feistel_shards": OP1, "op4_block_join_neighbours": OP4, "op6_rlz_substring_dedup": OP6, "op7_stream_exact_dedup": OP7,
        "op11_range_line_dedup": OP11, "op12_four_russians_repair": OP12, "op13_composed_spelling": OP13,
    }
