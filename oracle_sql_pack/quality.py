"""SQL twins of the noise, cleaning, validation and profile queries."""

from __future__ import annotations

from oracle_sql_pack.base import SEED, chance, drawn, key_drawn, quote
from oracle_sql_pack.generated import N, with_tables
from wareloom.functions.draws import constant_draw
from wareloom.operators.quality import amount_factor, null_rate

RATE, HIGH = 0.10, 0.50

COUNTRY = [
    ("USA", ["USA", "US", "United States", "U.S.A.", "U.S.", "America", "usa"]),
    ("UK", ["UK", "United Kingdom", "Great Britain", "GB", "England"]),
    ("Canada", ["Canada", "CA", "CAN", "canada"]),
]


def title(c: str) -> str:
    return (rf"array_to_string(list_transform(regexp_extract_all({c}, '(\p{{L}}+|[^\p{{L}}]+)', 1), "
            "lambda r: upper(r[1]) || lower(r[2:])), '')")


def case(c: str, h: str, rate: float) -> str:
    return (f"CASE WHEN {chance(h, rate * 0.3)} THEN CASE {h} % 3 WHEN 0 THEN upper({c}) WHEN 1 THEN lower({c}) "
            f"ELSE {title(c)} END ELSE {c} END")


def typo(c: str, h: str, rate: float) -> str:
    pos = f"(1 + ({h} // 3) % (length({c}) - 2))"
    return f"""CASE WHEN {chance(h, rate * 0.1)} AND length({c}) >= 3 THEN CASE {h} % 3
      WHEN 0 THEN substr({c}, 1, {pos}) || substr({c}, {pos} + 2, 1) || substr({c}, {pos} + 1, 1) || substr({c}, {pos} + 3)
      WHEN 1 THEN substr({c}, 1, {pos}) || substr({c}, {pos} + 2)
      ELSE substr({c}, 1, {pos} + 1) || substr({c}, {pos} + 1) END ELSE {c} END"""


def space(c: str, h: str, rate: float) -> str:
    return (f"CASE WHEN {chance(h, rate * 0.15)} THEN CASE {h} % 3 WHEN 0 THEN '  ' || {c} WHEN 1 THEN {c} || '  ' "
            f"ELSE replace({c}, ' ', '  ') END ELSE {c} END")


def null_text(c: str, h: str, rate: float) -> str:
    return (f"CASE WHEN {chance(h, rate)} THEN CASE WHEN {h} % 100 < 55 THEN NULL WHEN {h} % 100 < 75 THEN '' "
            f"WHEN {h} % 100 < 90 THEN 'N/A' ELSE 'null' END ELSE {c} END")


def null_value(c: str, h: str, rate: float) -> str:
    return f"CASE WHEN {chance(h, rate)} THEN NULL ELSE {c} END"


def inject_customer(rate: float) -> str:
    src = drawn("SELECT * FROM customer", "quality", "c_custkey",
                ["case:c_name", "case:c_mktsegment", "typo:c_name", "space:c_name", "space:c_mktsegment",
                 "null:c_name", "null:c_acctbal", "null:c_mktsegment"])
    r = {c: null_rate(c, rate, True) for c in ("c_name", "c_acctbal", "c_mktsegment")}
    return f"""
    SELECT c_custkey, c_nationkey, {null_text('c_name', 'h_null_c_name', r['c_name'])} AS c_name,
           {null_value('c_acctbal', 'h_null_c_acctbal', r['c_acctbal'])} AS c_acctbal,
           {null_text('c_mktsegment', 'h_null_c_mktsegment', r['c_mktsegment'])} AS c_mktsegment
    FROM (SELECT * REPLACE ({space('c_name', 'h_space_c_name', rate)} AS c_name,
                            {space('c_mktsegment', 'h_space_c_mktsegment', rate)} AS c_mktsegment)
      FROM (SELECT * REPLACE ({typo('c_name', 'h_typo_c_name', rate)} AS c_name)
        FROM (SELECT * REPLACE ({case('c_name', 'h_case_c_name', rate)} AS c_name,
                                {case('c_mktsegment', 'h_case_c_mktsegment', rate)} AS c_mktsegment) FROM ({src}))))"""


def duplicates(table: str, number: str, rate: float, cols: str = "t.*") -> str:
    """Rows of a table plus its copies; ``number`` is the zero-based row number."""
    n = f"(SELECT count(*) FROM {table})"
    k = f"floor({n} * {rate * 0.02}::DOUBLE)::BIGINT"
    picks = f"""SELECT pick, row_number() OVER (PARTITION BY pick ORDER BY id) AS c FROM (
        SELECT id, h % {n} AS pick FROM ({key_drawn(f"SELECT unnest(range({k})) AS id", "quality.duplicates", "id", "h")}))"""
    return f"""
    SELECT {cols}, 0::BIGINT AS _copy_no FROM {table} t UNION ALL
    SELECT {cols}, c AS _copy_no FROM {table} t JOIN ({picks}) p ON {number} = p.pick"""


def inject_orders(rate: float) -> str:
    cols = ["o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    src = drawn(duplicates("orders", "o_orderkey", rate), "quality", "o_orderkey",
                ["amount:o_totalprice"] + [f"null:{c}" for c in cols], sub="_copy_no")
    r = {c: null_rate(c, rate, False) for c in cols}
    amount = (f"CASE WHEN {chance('h_amount_o_totalprice', rate * 0.03)} "
              f"THEN o_totalprice * {amount_factor(SEED, 'o_totalprice')}::DOUBLE ELSE o_totalprice END")
    return f"""
    SELECT o_orderkey, o_custkey, {null_text('o_orderstatus', 'h_null_o_orderstatus', r['o_orderstatus'])} AS o_orderstatus,
           {null_value(f'({amount})', 'h_null_o_totalprice', r['o_totalprice'])} AS o_totalprice,
           {null_value('o_orderdate', 'h_null_o_orderdate', r['o_orderdate'])} AS o_orderdate,
           {null_text('o_orderpriority', 'h_null_o_orderpriority', r['o_orderpriority'])} AS o_orderpriority, _copy_no
    FROM ({src})"""


LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def identified_lineitem() -> str:
    """Line items with the key of content and copy number."""
    def text(c):
        if c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"):
            return f"CAST({c}::DECIMAL(24,6) AS VARCHAR)"
        if c == "l_shipdate":
            return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"
        return f"{c}::VARCHAR"

    cells = ", ".join(f"coalesce(length({text(c)})::VARCHAR || ':' || {text(c)}, '-')" for c in LINE)
    digest = f"md5(concat_ws('|', {cells}))"
    src = (f"SELECT *, ('0x' || substr({digest}, 1, 15))::BIGINT AS _print, "
           f"row_number() OVER (PARTITION BY {', '.join(LINE)}) AS _dup_no FROM lineitem")
    from oracle_sql_pack.base import _states
    return (f"SELECT * EXCLUDE (_a, _b, _print, _dup_no), ((_a << 20) | (_b >> 12)) AS _row_key "
            f"FROM ({_states(src, 'identity', '_print', '_dup_no', SEED)})")


def negative_lines(rate: float) -> str:
    src = drawn(identified_lineitem(), "quality", "_row_key", ["negative:l_quantity"])
    return f"""SELECT * EXCLUDE (_row_key, h_negative_l_quantity) REPLACE (
        CASE WHEN {chance('h_negative_l_quantity', rate * 0.03)} THEN -abs(l_quantity) ELSE l_quantity END AS l_quantity) FROM ({src})"""


def keyless_lines() -> str:
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    ranked = (f"SELECT *, row_number() OVER (ORDER BY h_rank, _row_key) - 1 AS _no FROM "
              f"({key_drawn(identified_lineitem(), 'quality.row order', '_row_key', 'h_rank')})")
    src = drawn(duplicates("ranked", "_no", RATE), "quality", "_row_key",
                ["negative:l_quantity"] + [f"null:{c}" for c in cols], sub="_copy_no")
    r = {c: null_rate(c, RATE, False) for c in cols}
    qty = f"(CASE WHEN {chance('h_negative_l_quantity', RATE * 0.03)} THEN -abs(l_quantity) ELSE l_quantity END)"
    out = [f"{null_value(qty, 'h_null_l_quantity', r['l_quantity'])} AS l_quantity"]
    for c in cols[1:]:
        f = null_text if c in ("l_returnflag", "l_linestatus") else null_value
        out.append(f"{f(c, f'h_null_{c}', r[c])} AS {c}")
    return f"""WITH ranked AS ({ranked})
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {', '.join(out)}, _copy_no FROM ({src})"""


def sales_body() -> str:
    cols = ["quantity", "unit_price", "discount", "revenue"]
    src = drawn(duplicates("fact_sales", "sale_id - 1", RATE), "quality", "sale_id",
                ["negative:quantity", "amount:revenue"] + [f"null:{c}" for c in cols], sub="_copy_no")
    r = {c: null_rate(c, RATE, False) for c in cols}
    qty = f"(CASE WHEN {chance('h_negative_quantity', RATE * 0.03)} THEN -abs(quantity) ELSE quantity END)"
    rev = (f"(CASE WHEN {chance('h_amount_revenue', RATE * 0.03)} THEN "
           f"(revenue * {amount_factor(SEED, 'revenue')}::DECIMAL(5,4))::DECIMAL(18,2) ELSE revenue END)")
    return f"""SELECT sale_id, date_key, customer_key, product_key, store_key,
        {null_value(qty, 'h_null_quantity', r['quantity'])} AS quantity,
        {null_value('unit_price', 'h_null_unit_price', r['unit_price'])} AS unit_price,
        {null_value('discount', 'h_null_discount', r['discount'])} AS discount,
        {null_value(rev, 'h_null_revenue', r['revenue'])} AS revenue FROM ({src})"""


COUNTRIES = """SELECT c_custkey, CASE n_nationkey WHEN 0 THEN 'USA' WHEN 1 THEN 'UK' WHEN 2 THEN 'Canada' ELSE n_name END AS country
    FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def country_noise() -> str:
    src = drawn(COUNTRIES, "quality", "c_custkey", ["country"])
    whens = " ".join(
        f"WHEN country IN ({', '.join(quote(s) for s in names)}) THEN ([{', '.join(quote(s) for s in names)}])[h_country % {len(names)} + 1]"
        for _, names in COUNTRY)
    return f"SELECT c_custkey, CASE WHEN NOT {chance('h_country', HIGH * 0.2)} THEN country {whens} ELSE country END AS country FROM ({src})"


def clean_missing(c: str) -> str:
    return f"CASE WHEN upper(trim({c}, ' ')) IN ('', 'N/A', 'NULL') THEN NULL ELSE {c} END"


ORDERS_SHIPPED = """SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS order_date,
    (SELECT min(l_shipdate)::DATE::VARCHAR FROM lineitem WHERE l_orderkey = o_orderkey) AS ship_date FROM orders"""


def orphans() -> str:
    shift = 1000 + constant_draw(SEED, "orphan", "o_custkey") % 9000
    src = key_drawn("SELECT o_orderkey, o_custkey FROM orders", "orphan:o_custkey", "o_orderkey", "h")
    return (f"SELECT o_orderkey, CASE WHEN {chance('h', 0.02)} THEN (SELECT max(o_custkey) FROM orders) + {shift} "
            f"ELSE o_custkey END AS o_custkey FROM ({src})")


def single_noise(table: str, key: str, columns: dict) -> str:
    """columns: output column -> (draw name, function, rate or None for the null rule)."""
    src = drawn(f"SELECT * FROM {table}", "quality", key, [d for d, _, _ in columns.values()])
    names = [f"h_{d.replace(':', '_')}" for d, _, _ in columns.values()]
    rep = ", ".join(f"{f(c, 'h_' + d.replace(':', '_'), r)} AS {c}" for c, (d, f, r) in columns.items())
    return f"SELECT * EXCLUDE ({', '.join(names)}) REPLACE ({rep}) FROM ({src})"


def date_formats() -> str:
    src = drawn("SELECT o_orderkey, o_orderdate::DATE AS d FROM orders", "quality", "o_orderkey", ["format:order_date"])
    formats = ["%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%Y/%m/%d", "%d-%m-%Y", "%B %d, %Y"]
    whens = " ".join(f"WHEN {i} THEN strftime(d, '{f}')" for i, f in enumerate(formats))
    return (f"SELECT o_orderkey, CASE WHEN {chance('h_format_order_date', RATE)} THEN CASE h_format_order_date % 6 {whens} END "
            f"ELSE d::VARCHAR END AS order_date FROM ({src})")


def time_travel() -> str:
    src = key_drawn(ORDERS_SHIPPED, "time travel:order_date:ship_date", "o_orderkey", "h")
    return (f"SELECT o_orderkey, order_date, CASE WHEN {chance('h', 0.2)} "
            f"THEN (order_date::DATE - (h % 10 + 1)::INTEGER)::VARCHAR ELSE ship_date END AS ship_date FROM ({src})")


def dedupe(keep: str) -> str:
    src = inject_orders(HIGH)
    cols = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    if keep == "merge":
        firsts = ", ".join(f"arg_min({c}, _copy_no) FILTER ({c} IS NOT NULL) AS {c}" for c in cols)
        return f"SELECT o_orderkey, {firsts}, min(_copy_no) AS _copy_no FROM ({src}) GROUP BY o_orderkey"
    order = "_copy_no" + (" DESC" if keep == "last" else "")
    return f"SELECT * FROM ({src}) QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY {order}) = 1"


def iqr(table: str, col: str, k: float) -> str:
    return f"""SELECT q1, q3, q1 - (q3 - q1) * {k}::DOUBLE AS low, q3 + (q3 - q1) * {k}::DOUBLE AS high FROM (
        SELECT max({col}) FILTER (r = greatest(1, ceil(0.25 * n))) AS q1, max({col}) FILTER (r = greatest(1, ceil(0.75 * n))) AS q3
        FROM (SELECT {col}, row_number() OVER (ORDER BY {col}) AS r, count(*) OVER () AS n FROM {table}))"""


def group_iqr(source: str, col: str, group: list[str], k: float) -> str:
    g = ", ".join(group)
    return f"""SELECT {g}, n AS n_rows, q1, q3, q1 - (q3 - q1) * {k}::DOUBLE AS low, q3 + (q3 - q1) * {k}::DOUBLE AS high FROM (
        SELECT {g}, max(n) AS n, max({col}) FILTER (r = greatest(1, ceil(0.25 * n))) AS q1, max({col}) FILTER (r = greatest(1, ceil(0.75 * n))) AS q3
        FROM (SELECT {g}, {col}, row_number() OVER (PARTITION BY {g} ORDER BY {col}) AS r, count(*) OVER (PARTITION BY {g}) AS n
              FROM {source} WHERE {col} IS NOT NULL) GROUP BY {g})"""


def share_check(name: str, table: str, value: str, weights: dict) -> str:
    """Chi-square of the declared weights; its limit is the quantile of the normal deviate 3.29 by Wilson and Hilferty."""
    total, free = sum(weights.values()), len(weights) - 1
    listed = ", ".join(f"({quote(v)}, {w}::DOUBLE / {total})" for v, w in weights.items())
    return f"""SELECT '{name}' AS check_name, 'chi-square' AS kind, sum(n)::BIGINT AS n_rows, coalesce(sum(n) FILTER (share IS NULL), 0)::BIGINT AS n_outside,
        round(sum(n::DOUBLE * n / (inside * share)) - max(inside), 6) AS statistic,
        round({free} * pow(1 - 2 / (9.0::DOUBLE * {free}) + 3.29::DOUBLE * sqrt(2 / (9.0::DOUBLE * {free})), 3), 6) AS limit_value
        FROM (SELECT n, share, sum(n) FILTER (share IS NOT NULL) OVER () AS inside
              FROM (SELECT {value} AS v, count(*) AS n FROM {table} GROUP BY 1) LEFT JOIN (VALUES {listed}) AS d(w, share) ON v = w)"""


def curve_check(name: str, table: str, curve: str) -> str:
    """Distance of the cumulative counts from the declared ones at the edges of 64 equally likely bins."""
    return f"""SELECT '{name}' AS check_name, 'distance' AS kind, sum(n)::BIGINT AS n_rows, coalesce(sum(n) FILTER (b < 0), 0)::BIGINT AS n_outside,
        round(max(greatest(abs(below / inside - (b + 1) / 64.0::DOUBLE), abs((below - n) / inside - b / 64.0::DOUBLE))) FILTER (b >= 0), 6) AS statistic,
        round(2.04::DOUBLE / sqrt(max(inside)), 6) AS limit_value
        FROM (SELECT b, n, sum(n) FILTER (b >= 0) OVER (ORDER BY b) AS below, (sum(n) FILTER (b >= 0) OVER ())::DOUBLE AS inside
              FROM (SELECT CASE WHEN u BETWEEN 0 AND 1 THEN least(floor(u * 64), 63)::INTEGER ELSE -1 END AS b, count(*) AS n
                    FROM (SELECT {curve} AS u FROM {table}) GROUP BY 1))"""


DISTRIBUTIONS = [
    share_check("return flag", "lineitem", "l_returnflag", {"A": 1, "N": 1, "R": 1}),
    share_check("line status", "lineitem", "l_linestatus", {"F": 1, "O": 1}),
    share_check("line number", "lineitem", "l_linenumber", {i: 1 for i in range(1, 8)}),
    share_check("quantity", "lineitem", "l_quantity::INTEGER", {i: 1 for i in range(1, 51)}),
    share_check("discount, half at both ends", "lineitem", "round(l_discount * 100)::INTEGER", {i: 1 if i in (0, 10) else 2 for i in range(11)}),
    share_check("discount, all alike", "lineitem", "round(l_discount * 100)::INTEGER", {i: 1 for i in range(11)}),
    curve_check("price, even from 900 to 105000", "lineitem", "(l_extendedprice - 900) / 104100::DOUBLE"),
    share_check("event type", "events", "event_type", {e: 1 for e in ("click", "error", "purchase", "signup", "view")}),
    curve_check("value, exponential around 50", "events", "1 - exp(value / -50::DOUBLE)"),
    curve_check("value, even to 500", "events", "value / 500::DOUBLE"),
]


GIVEN_NUMERIC = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"],
    "customer": ["c_custkey", "c_nationkey", "c_acctbal"], "supplier": ["s_suppkey", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_size", "p_retailprice"], "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    "events": ["event_id", "user_id", "value"],
    "documents": ["doc_id", "n_chars"], "embeddings": ["vec_id", "label"], "pages": ["page_id"],
    "benchmark": ["item_id"], "labels": ["doc_id", "quality", "toxic"], "conversations": ["conv_id", "turn"],
}
GIVEN_TEXT = {
    "region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"],
    "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_returnflag", "l_linestatus"], "events": ["event_type", "props"],
    "documents": ["text", "lang", "source"], "embeddings": [], "pages": ["url", "html"], "benchmark": ["text"],
    "labels": [], "conversations": ["role", "text"],
}
GIVEN_COLUMNS = {
    "region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": LINE, "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"], "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"], "benchmark": ["item_id", "text"], "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}


def missing(name: str, source: str, cols: list[str], texts: list[str]) -> str:
    nulls = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in cols)
    spelled = " + ".join(f"count(*) FILTER ({c} IN ('', 'N/A', 'null'))" for c in texts) or "0::BIGINT"
    return f"""SELECT '{name}' AS table_name, ({nulls})::BIGINT AS n_missing, ({spelled})::BIGINT AS n_sentinels,
        (count(*) * {len(cols)})::BIGINT AS n_cells,
        CASE WHEN count(*) > 0 THEN ({nulls})::DOUBLE * 100 / (count(*) * {len(cols)}) ELSE 0.0 END AS pct_missing FROM ({source})"""


def quality_sql() -> dict[str, str]:
    c_rates = {c: null_rate(c, HIGH, True) for c in ("c_name", "c_acctbal", "c_mktsegment")}
    o_rates = {c: null_rate(c, HIGH, False) for c in ("o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")}
    amount = lambda c, h, r: f"CASE WHEN {chance(h, r * 0.03)} THEN {c} * {amount_factor(SEED, c)}::DOUBLE ELSE {c} END"
    text_dirty = f"""SELECT * REPLACE ({space('c_name', 'h_space_c_name', HIGH)} AS c_name,
            {space('c_mktsegment', 'h_space_c_mktsegment', HIGH)} AS c_mktsegment)
        FROM (SELECT * REPLACE ({case('c_name', 'h_case_c_name', HIGH)} AS c_name, {case('c_mktsegment', 'h_case_c_mktsegment', HIGH)} AS c_mktsegment)
        FROM ({drawn('SELECT * FROM customer', 'quality', 'c_custkey', ['case:c_name', 'case:c_mktsegment', 'space:c_name', 'space:c_mktsegment'])}))"""
    tidy = lambda c: title(f"regexp_replace(trim({c}, ' '), ' +', ' ', 'g')")
    cc_known = " ".join(
        f"WHEN upper(trim(country, ' ')) IN ({', '.join(sorted({quote(s.upper()) for s in names}))}) THEN '{std}'" for std, names in COUNTRY)
    imputed = f"SELECT c_custkey, c_nationkey, {clean_missing('c_name')} AS c_name, c_acctbal, {clean_missing('c_mktsegment')} AS c_mktsegment FROM ({inject_customer(HIGH)})"
    noisy_orders = single_noise("orders", "o_orderkey", {
        c: (f"null:{c}", null_text if c in ("o_orderstatus", "o_orderpriority") else null_value, r) for c, r in o_rates.items()})
    gappy_orders = (f"SELECT * REPLACE ({clean_missing('o_orderstatus')} AS o_orderstatus, {clean_missing('o_orderpriority')} AS o_orderpriority) "
                    f"FROM ({noisy_orders})")
    ecom = N["ecommerce"]
    orphan_shift = 1000 + constant_draw(SEED, "orphan", "customer_key") % 9000
    orphaned_orders = (f"SELECT * REPLACE (CASE WHEN {chance('h', 0.02)} THEN {ecom['customers']} + {orphan_shift} ELSE customer_key END AS customer_key) "
                       f"FROM ({key_drawn('SELECT * FROM fact_orders', 'orphan:customer_key', 'order_id', 'h')})")

    def fk(table, col, source, parent, key):
        return (f"SELECT '{table}' AS table_name, '{col}' AS fk, count(DISTINCT {col}) AS orphan_keys, count({col}) AS orphan_rows "
                f"FROM ({source}) c WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = c.{col})")

    fks = [
        ("fact_orders", "date_key", orphaned_orders, "dim_date", "date_key"),
        ("fact_orders", "customer_key", orphaned_orders, "dim_customer", "customer_key"),
        ("fact_orders", "channel_key", orphaned_orders, "dim_channel", "channel_key"),
        ("fact_order_items", "order_id", "SELECT * FROM fact_order_items", "fact_orders", "order_id"),
        ("fact_order_items", "product_key", "SELECT * FROM fact_order_items", "dim_product", "product_key"),
        ("fact_web_events", "date_key", "SELECT * FROM fact_web_events", "dim_date", "date_key"),
        ("fact_web_events", "customer_key", "SELECT * FROM fact_web_events", "dim_customer", "customer_key"),
        ("fact_web_events", "product_key", "SELECT * FROM fact_web_events WHERE product_key IS NOT NULL", "dim_product", "product_key"),
        ("fact_web_events", "channel_key", "SELECT * FROM fact_web_events", "dim_channel", "channel_key"),
    ]
    rules = {
        "ships before it is ordered": "l_shipdate < o_orderdate", "quantity not positive": "l_quantity <= 0",
        "discount outside 0..1": "NOT l_discount BETWEEN 0 AND 1", "unknown status": "o_orderstatus NOT IN ('O', 'F', 'P')",
        "line worth more than its order": "l_extendedprice > o_totalprice", "return flag missing": "l_returnflag IS NULL",
    }
    joined = "lineitem JOIN orders ON l_orderkey = o_orderkey"
    overview = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, {len(c)} AS n_columns FROM {t}" for t, c in GIVEN_COLUMNS.items())
    return {
        "q_case": single_noise("customer", "c_custkey", {c: (f"case:{c}", case, HIGH) for c in ("c_name", "c_mktsegment")}),
        "q_typo": single_noise("part", "p_partkey", {"p_name": ("typo:p_name", typo, HIGH)}),
        "q_whitespace": single_noise("part", "p_partkey", {c: (f"space:{c}", space, HIGH) for c in ("p_name", "p_brand", "p_type")}),
        "q_country": country_noise(),
        "q_duplicates": duplicates("orders", "o_orderkey", HIGH),
        "q_duplicates_sparse_key": "WITH ranked AS (SELECT * EXCLUDE (h), row_number() OVER (ORDER BY h, event_id) - 1 AS _no FROM ("
            + key_drawn("SELECT * FROM events", "quality.row order", "event_id", "h") + "))\n"
            + duplicates("ranked", "_no", HIGH, "event_id, ts, user_id, event_type, value, props"),
        "q_negative_qty": negative_lines(HIGH),
        "q_amount_error": single_noise("orders", "o_orderkey", {"o_totalprice": ("amount:o_totalprice", amount, HIGH)}),
        "q_nulls": single_noise("customer", "c_custkey", {
            "c_name": ("null:c_name", null_text, c_rates["c_name"]), "c_acctbal": ("null:c_acctbal", null_value, c_rates["c_acctbal"]),
            "c_mktsegment": ("null:c_mktsegment", null_text, c_rates["c_mktsegment"])}),
        "q_nulls_fact": noisy_orders,
        "q_inject_dim": inject_customer(RATE),
        "q_inject_fact": inject_orders(RATE),
        "q_inject_fact_keyless": keyless_lines(),
        "q_inject_sales": with_tables("retail", ["fact_sales"], sales_body()),
        "q_date_formats": date_formats(),
        "l_time_travel": time_travel(),
        "l_orphans": orphans(),
        "clean_text": f"SELECT c_custkey, {tidy('c_name')} AS c_name, c_nationkey, c_acctbal, {tidy('c_mktsegment')} AS c_mktsegment FROM ({text_dirty})",
        "clean_country": f"SELECT c_custkey, CASE {cc_known} ELSE trim(country, ' ') END AS country FROM ({country_noise()})",
        "clean_nulls": f"""WITH d AS ({imputed})
            SELECT c_custkey, c_nationkey, coalesce(c_name, 'UNKNOWN') AS c_name,
                   coalesce(c_acctbal, (SELECT sum(c_acctbal::DECIMAL(38,6))::DOUBLE / count(c_acctbal) FROM d)) AS c_acctbal,
                   coalesce(c_mktsegment, (SELECT c_mktsegment FROM d WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS c_mktsegment
            FROM d""",
        "clean_nulls_by_group": f"""WITH d AS ({gappy_orders}), status AS (
              SELECT o_custkey, o_orderstatus AS v FROM d WHERE o_orderstatus IS NOT NULL GROUP BY o_custkey, o_orderstatus
              QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderstatus) = 1
            ), price AS (
              SELECT o_custkey, max(o_totalprice) FILTER (r = greatest(1, ceil(0.5 * n))) AS v FROM (
                SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS r,
                       count(*) OVER (PARTITION BY o_custkey) AS n FROM d WHERE o_totalprice IS NOT NULL) GROUP BY 1
            ), priority AS (
              SELECT o_custkey, o_orderpriority AS v FROM d WHERE o_orderpriority IS NOT NULL GROUP BY o_custkey, o_orderpriority
              QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) = 1
            )
            SELECT d.* REPLACE (coalesce(o_orderstatus, status.v) AS o_orderstatus, coalesce(o_totalprice, price.v) AS o_totalprice,
              coalesce(o_orderpriority, priority.v) AS o_orderpriority,
              last_value(o_orderdate IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o_orderdate)
            FROM d LEFT JOIN status ON d.o_custkey = status.o_custkey LEFT JOIN price ON d.o_custkey = price.o_custkey
              LEFT JOIN priority ON d.o_custkey = priority.o_custkey""",
        "clean_nulls_last_known": f"""WITH d AS (SELECT * REPLACE ({clean_missing('o_orderstatus')} AS o_orderstatus) FROM ({noisy_orders}))
            SELECT * REPLACE (
              last_value(o_orderstatus IGNORE NULLS) OVER before AS o_orderstatus, last_value(o_totalprice IGNORE NULLS) OVER before AS o_totalprice,
              coalesce(o_orderdate, (SELECT o_orderdate FROM d WHERE o_orderdate IS NOT NULL ORDER BY 1 LIMIT 1
                OFFSET (SELECT greatest(1, ceil(0.5 * count(o_orderdate))) - 1 FROM d))) AS o_orderdate)
            FROM d WINDOW before AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        "clean_dropna": f"SELECT * FROM ({imputed}) WHERE c_name IS NOT NULL AND c_mktsegment IS NOT NULL",
        "clean_negative_qty": f"SELECT * REPLACE (abs(l_quantity) AS l_quantity) FROM ({negative_lines(HIGH)})",
        "clean_dedupe": dedupe("first"), "clean_dedupe_last": dedupe("last"), "clean_dedupe_merge": dedupe("merge"),
        "val_pk": "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
        "val_fk": f"SELECT o_custkey AS orphan_key, count(*) AS n_rows FROM ({orphans()}) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 1",
        "val_fk_report": with_tables("ecommerce", ["dim_date", "dim_customer", "dim_product", "dim_channel", "fact_orders", "fact_order_items", "fact_web_events"],
                                     " UNION ALL ".join(fk(*f) for f in fks)),
        "val_calc": with_tables("retail", ["fact_sales"], f"""
            SELECT *, (unit_price * quantity - discount)::DECIMAL(18,2) AS expected FROM ({sales_body()})
            WHERE abs(revenue - (unit_price * quantity - discount)) > 0.01"""),
        "val_outliers": f"""WITH f AS ({iqr('lineitem', 'l_extendedprice', 0.45)})
            SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, f WHERE l_extendedprice < low OR l_extendedprice > high""",
        "val_outliers_by_supplier": f"""WITH f AS ({group_iqr('lineitem', 'l_extendedprice', ['l_suppkey'], 0.4)})
            SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, low, high FROM lineitem JOIN f USING (l_suppkey)
            WHERE l_extendedprice < low OR l_extendedprice > high""",
        "val_fences_by_status": group_iqr("lineitem", "l_extendedprice", ["l_returnflag", "l_linestatus"], 1.5),
        "val_distribution": "SELECT *, n_outside = 0 AND statistic <= limit_value AS ok FROM (" + " UNION ALL ".join(DISTRIBUTIONS) + ")",
        "val_iqr": iqr("orders", "o_totalprice", 1.5),
        "val_rules": " UNION ALL ".join(
            f"SELECT '{n}' AS rule, count(*) FILTER ({p}) AS n_violations, count(*) AS n_rows FROM {joined}" for n, p in rules.items()),
        "rep_total_rows": f"SELECT sum(n_rows)::BIGINT AS total_rows FROM ({overview})",
        "rep_overview": overview,
        "rep_numeric_stats": " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, '{c}' AS column_name, min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value, "
            f"sum({c}::DECIMAL(24,6))::DOUBLE / count({c}) AS mean_value FROM {t}" for t, cs in GIVEN_NUMERIC.items() for c in cs),
        "rep_missing": " UNION ALL ".join(missing(t, f"SELECT * FROM {t}", GIVEN_COLUMNS[t], GIVEN_TEXT[t]) for t in GIVEN_COLUMNS),
        "rep_missing_dirty": missing("customer", inject_customer(HIGH), GIVEN_COLUMNS["customer"], GIVEN_TEXT["customer"])
            + " UNION ALL " + missing("orders", f"SELECT * EXCLUDE (_copy_no) FROM ({inject_orders(HIGH)})", GIVEN_COLUMNS["orders"], GIVEN_TEXT["orders"]),
    }
