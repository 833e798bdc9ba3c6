"""DuckDB twins of the operators on lines, conversations and spelling."""

from __future__ import annotations


def crc_table() -> list[int]:
    """The byte table of the reflected polynomial 0xEDB88320."""
    table = []
    for v in range(256):
        for _ in range(8):
            v = v >> 1 ^ (0xEDB88320 if v & 1 else 0)
        table.append(v)
    return table


def _crc32(text: str) -> str:
    """The checksum of a text's UTF-8 bytes, as an expression."""
    h = f"hex(encode({text}))"
    return f"""xor(list_reduce([4294967295] || list_transform(range(length({h}) // 2),
      lambda i: ('0x' || substr({h}, 2 * i::BIGINT + 1, 2))::BIGINT),
      lambda c, x: xor(c // 256, {crc_table()}[1 + xor(c % 256, x)])), 4294967295)"""


OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(doc_id, -9223372036854775808) AS did, doc_id, coalesce(text, '') AS text FROM documents
), line AS (
  SELECT rid, did, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line
), judged AS (
  SELECT *, length(key) >= 10 AND did > min(did) OVER (PARTITION BY key) AS dropped FROM keyed
), kept AS (
  SELECT rid, count(*)::BIGINT AS n_lines, (count(*) FILTER (dropped))::BIGINT AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '') AS text FROM judged GROUP BY rid
)
SELECT doc_id, n_lines, n_dropped, sha256(kept.text) AS kept_sha256 FROM d JOIN kept USING (rid)
"""


def _op12_step() -> str:
    """The states' least (cost, edits) behind a row: s1 to s4 are nothing yet, after system, after user, after assistant."""

    def best(*options: str) -> str:
        return f"list_min(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))"

    def move(state: str, cost: str, edit: str, when: str = "true") -> str:
        return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {state}.c + {cost}, 'e': {state}.e || '{edit}'}} END"

    may = "sym <> 'x'"
    rows = {
        "r1": best(move("p1", "3", "D")),
        "r2": best(move("p2", "3", "D"), move("p1", "cut", "K", "sym = 's'")),
        "r3": best(move("p3", "3", "D"), *[move(p, "cut", "K", "sym = 'u'") for p in ("p1", "p2", "p4")],
                   *[move(p, "2 + cut", "R", may) for p in ("p1", "p2", "p4")]),
        "r4": best(move("p4", "3", "D"), move("p3", "cut", "K", "sym = 'a'"), move("p3", "2 + cut", "R", may)),
    }
    # Up to two rows may be put in behind a row: user behind nothing, system and assistant, assistant behind user.
    once = {"s1": "r1", "s2": "r2", "s3": best("r3", *[move(r, "2", "I") for r in ("r1", "r2", "r4")])}
    twice = {"s4": best("r4", move("r3", "2", "I"), move("s3", "2", "I"))}
    q = "joined"
    for level in (rows, once, twice):
        q = f"(SELECT *, {', '.join(f'{v} AS {k}' for k, v in level.items())} FROM {q})"
    return f"SELECT conv_id, n, i, s1, s2, s3, s4 FROM {q}"


OP12 = rf"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fate FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM base
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i,
    CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS own,
    regexp_replace(text, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS inner_text FROM damaged
), faulty AS (
  SELECT *, CASE WHEN inner_text = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(inner_text, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(own) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM placed
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, (count(*) FILTER (fault = 'blank'))::BIGINT AS blank,
    (count(*) FILTER (fault = 'duplicate'))::BIGINT AS duplicate, (count(*) FILTER (fault = 'truncated'))::BIGINT AS truncated,
    (count(*) FILTER (prior IS NOT NULL AND prior || own NOT IN ('su', 'ua', 'au')))::BIGINT AS illegal, max(i) AS n
  FROM faulty GROUP BY conv_id
), symbols AS (
  SELECT conv_id, i, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' ELSE own END AS sym,
    (fault IS NOT DISTINCT FROM 'truncated')::BIGINT AS cut FROM faulty
), path AS (
  SELECT conv_id, n, 0::BIGINT AS i, {{'c': 0::BIGINT, 'e': ''}} AS s1, NULL::STRUCT(c BIGINT, e VARCHAR) AS s2,
    {{'c': 2::BIGINT, 'e': 'I'}} AS s3, {{'c': 4::BIGINT, 'e': 'II'}} AS s4 FROM counts
  UNION ALL
  SELECT * FROM (
    WITH joined AS (
      SELECT p.conv_id, p.n, y.i, y.sym, y.cut, p.s1 AS p1, p.s2 AS p2, p.s3 AS p3, p.s4 AS p4
      FROM path AS p JOIN symbols AS y ON y.conv_id IS NOT DISTINCT FROM p.conv_id AND y.i = p.i + 1
    ) {_op12_step()})
), done AS (
  SELECT conv_id, list_min(list_filter([s1, s4], lambda x: x IS NOT NULL)) AS best FROM path WHERE i = n
), edits AS (
  SELECT conv_id, unnest(string_split(best.e, '')) AS edit, generate_subscripts(string_split(best.e, ''), 1) AS nth FROM done WHERE best.e <> ''
), counted AS (
  SELECT *, sum((edit <> 'I')::INTEGER) OVER (PARTITION BY conv_id ORDER BY nth) AS i FROM edits
), out AS (
  SELECT e.conv_id, e.nth, e.edit, y.role, y.text, row_number() OVER (PARTITION BY e.conv_id ORDER BY e.nth) AS place
  FROM counted AS e LEFT JOIN faulty AS y ON y.conv_id IS NOT DISTINCT FROM e.conv_id AND y.i = e.i AND e.edit <> 'I' WHERE e.edit <> 'D'
), led AS (
  SELECT *, first_value((edit = 'K' AND left(role, 1) = 's')::INTEGER) OVER (PARTITION BY conv_id ORDER BY place) AS led FROM out
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
    CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY nth) AS text FROM led GROUP BY conv_id
), ids AS (
  SELECT DISTINCT conv_id FROM conversations
)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(done.best.c, 0)::BIGINT AS cost, coalesce(done.best.e, '') AS audit, sha256(coalesce(texts.text, '')) AS repaired_sha256
FROM ids LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM ids.conv_id
  LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM ids.conv_id
"""

OP13 = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT run, n, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM counted
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word,
    sum(n)::BIGINT AS n FROM hashed GROUP BY 1 HAVING sum(n) >= 2 AND length(word) >= 7
), cuts AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), without AS (
  SELECT word, n, i, left(word, i - 1) AS head, substr(word, i + 1) AS tail FROM cuts
), near AS (
  SELECT a.word, b.word AS other, b.n FROM without AS a JOIN without AS b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION
  SELECT w.word, c.word, c.n FROM without AS c JOIN words AS w ON w.word = c.head || c.tail
  UNION
  SELECT c.word, w.word, w.n FROM without AS c JOIN words AS w ON w.word = c.head || c.tail
), told AS (
  SELECT word, count(*)::BIGINT AS n_near, max(n) AS best_n, min(struct_pack(less := -n, other := other)).other AS best FROM near GROUP BY word
), forms AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form,
    CASE WHEN best_n >= 10 * n THEN best_n END::BIGINT AS form_n FROM words LEFT JOIN told USING (word)
), chain AS (
  SELECT word, word AS at FROM forms
  UNION ALL
  SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.at WHERE forms.form IS NOT NULL
), roots AS (
  SELECT chain.word, chain.at AS root FROM chain JOIN forms ON forms.word = chain.at WHERE forms.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""
