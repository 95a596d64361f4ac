"""Changes and checks on the large tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.wire import wire_row
from tidemark.operators import constraints as con, evolve as ev
from workload.registry import query

_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"
_DUCK_TIME = "'%Y-%m-%d %H:%M:%S.%f'"


def _text_times(df):
    """Times as text, so that both engines print them alike."""
    times = [f.name for f in df.schema if f.dataType.typeName().startswith("timestamp")]
    return df.withColumns({c: F.date_format(c, _TIME) for c in times})


@query(
    "evolve_add",
    f"""SELECT * REPLACE (strftime(l_shipdate, {_DUCK_TIME}) AS l_shipdate), 'direct' AS l_channel,
      CAST(NULL AS BIGINT) AS l_batch FROM lineitem""",
)
def evolve_add(s):
    wider = ev.add_column(s.table("lineitem"), "l_channel", "string", "direct")
    return _text_times(ev.add_column(wider, "l_batch", "bigint"))


@query(
    "evolve_rename",
    f"""SELECT o_orderkey AS order_id, o_custkey, o_orderstatus AS status, o_totalprice,
      strftime(o_orderdate, {_DUCK_TIME}) AS o_orderdate, o_orderpriority FROM orders""",
)
def evolve_rename(s):
    renamed = ev.rename_columns(s.table("orders"), {"o_orderkey": "order_id", "o_orderstatus": "status"})
    return _text_times(renamed)


@query(
    "evolve_cast",
    f"""SELECT * REPLACE (CAST(try_cast(l_extendedprice AS DECIMAL(6,2)) AS STRING) AS l_extendedprice,
        try_cast(l_quantity AS INTEGER) AS l_quantity, strftime(l_shipdate, {_DUCK_TIME}) AS l_shipdate),
      CASE WHEN try_cast(l_extendedprice AS DECIMAL(6,2)) IS NULL AND l_extendedprice IS NOT NULL THEN 'l_extendedprice' ELSE '' END AS rejected
    FROM lineitem""",
)
def evolve_cast(s):
    """All columns, so that a cast that touched another one would show."""
    changed = ev.change_types(s.table("lineitem"), {"l_extendedprice": "decimal(6,2)", "l_quantity": "int"})
    shown = {"l_extendedprice": F.col("l_extendedprice").cast("string"), "rejected": F.array_join("rejected", ",")}
    return _text_times(changed.withColumns(shown))


@query("evolve_drop", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def evolve_drop(s):
    return ev.drop_columns(s.table("lineitem"), "l_returnflag", "l_linestatus", "l_shipdate")


@query(
    "evolve_recreate",
    f"""SELECT strftime(o_orderdate, {_DUCK_TIME}) AS placed_at, o_orderkey, CAST(o_custkey AS STRING) AS customer,
      CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS STRING) AS total FROM orders""",
)
def evolve_recreate(s):
    shape = [
        ("placed_at", "timestamp_ntz", F.col("o_orderdate")),
        ("o_orderkey", "bigint", None),
        ("customer", "string", F.col("o_custkey")),
        ("total", "decimal(14,2)", F.col("o_totalprice")),
    ]
    return _text_times(ev.recreate(s.table("orders"), shape)).withColumn("total", F.col("total").cast("string"))


@query(
    "copy_verify",
    """
    SELECT 'reordered' AS side, count(*) AS rows_source, count(*) AS rows_copy, true AS matches FROM lineitem
    UNION ALL SELECT 'altered', count(*), count(*), NOT EXISTS (
      SELECT l_orderkey, l_linenumber, l_tax FROM lineitem EXCEPT ALL
      SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = 50 AND l_linenumber = 7 THEN 0 ELSE l_tax END FROM lineitem) FROM lineitem
    UNION ALL SELECT 'short', count(*), count(*) FILTER (l_quantity <> 50 OR l_linenumber <> 7), count(*) FILTER (l_quantity = 50 AND l_linenumber = 7) = 0 FROM lineitem""",
)
def copy_verify(s):
    """A faithful copy in another column order, one with altered and one with lost rows."""
    source = s.table("lineitem")
    columns = source.columns
    odd = (F.col("l_quantity") == 50) & (F.col("l_linenumber") == 7)
    copies = {
        "reordered": source.select(*reversed(columns)),
        "altered": source.withColumn("l_tax", F.when(odd, 0.0).otherwise(F.col("l_tax"))),
        "short": source.where(~odd),
    }
    parts = [
        ev.copy_verify(source, copy, columns).select(F.lit(name).alias("side"), "*")
        for name, copy in copies.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "copy_differences",
    """
    SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.l_linenumber, b.l_linenumber) AS l_linenumber,
      CASE WHEN b.rows IS NULL THEN 'missing' WHEN a.rows IS NULL THEN 'extra' ELSE 'different' END AS state
    FROM (SELECT l_orderkey, l_linenumber, list_sort(list(lineitem)) AS rows FROM lineitem GROUP BY 1, 2) a
    FULL JOIN (SELECT l_orderkey, l_linenumber, list_sort(list(c)) AS rows FROM (
        SELECT * REPLACE (CASE WHEN l_quantity = 50 AND l_linenumber = 7 THEN 0 ELSE l_tax END AS l_tax) FROM lineitem WHERE l_orderkey % 97 <> 0
        UNION ALL SELECT * REPLACE (-l_orderkey AS l_orderkey) FROM lineitem WHERE l_orderkey % 101 = 0) c GROUP BY 1, 2) b
    ON a.l_orderkey IS NOT DISTINCT FROM b.l_orderkey AND a.l_linenumber IS NOT DISTINCT FROM b.l_linenumber
    WHERE a.rows IS DISTINCT FROM b.rows""",
)
def copy_differences(s):
    """A copy with altered, lost and added rows: under which keys."""
    source = s.table("lineitem")
    odd = (F.col("l_quantity") == 50) & (F.col("l_linenumber") == 7)
    kept = source.where(F.col("l_orderkey") % 97 != 0).withColumn("l_tax", F.when(odd, 0.0).otherwise(F.col("l_tax")))
    more = source.where(F.col("l_orderkey") % 101 == 0).withColumn("l_orderkey", -F.col("l_orderkey"))
    return ev.copy_differences(source, kept.unionByName(more), ["l_orderkey", "l_linenumber"], source.columns)


@query(
    "wire_rows",
    """SELECT to_json({'event_id': CAST(event_id AS STRING), 'ts': strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ'),
      'user_id': CAST(user_id AS STRING), 'event_type': event_type, 'value': value, 'props': props}) AS row FROM events""",
)
def wire_rows(s):
    events = s.table("events")
    return events.select(wire_row(events.schema).alias("row"))


@query(
    "wire_json_columns",
    """SELECT to_json({'event_id': CAST(event_id AS STRING), 'event_type': event_type, 'props': json(props)}) AS row FROM events""",
)
def wire_json_columns(s):
    """``props`` is kept as text and goes out as the JSON it holds."""
    events = s.table("events").select("event_id", "event_type", "props")
    return events.select(wire_row(events.schema, ["props"]).alias("row"))


# Declared keys and domains --------------------------------------------------------------


@query(
    "wire_nested",
    """SELECT to_json({'event_id': CAST(event_id AS STRING), 'deep': {'big': CAST(user_id + 9007199254740993 AS STRING),
      'at': strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ'), 'by': MAP {event_type: CAST(event_id AS STRING)}}}) AS r FROM events""",
)
def wire_nested(s):
    """Numbers and times inside a struct and a map."""
    deep = F.struct(
        (F.col("user_id") + F.lit(9007199254740993)).alias("big"),
        F.col("ts").alias("at"),
        F.create_map("event_type", "event_id").alias("by"),
    )
    events = s.table("events").select("event_id", deep.alias("deep"))
    return events.select(wire_row(events.schema).alias("r"))


@query(
    "check_pk",
    """SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2
    HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL""",
)
def check_pk(s):
    return con.primary_key_violations(s.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "check_fk",
    """SELECT l_orderkey, count(*) AS n_rows FROM lineitem WHERE l_orderkey IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P') GROUP BY 1""",
)
def check_fk(s):
    """The parent table without the orders still in progress."""
    parent = s.table("orders").where(F.col("o_orderstatus") != "P")
    return con.foreign_key_violations(s.table("lineitem"), ["l_orderkey"], parent, ["o_orderkey"])


@query(
    "check_fk_pair",
    """SELECT l_partkey, l_suppkey, count(*) AS n_rows FROM lineitem WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM lineitem p WHERE p.l_returnflag = 'R' AND p.l_partkey = lineitem.l_partkey AND p.l_suppkey = lineitem.l_suppkey)
    GROUP BY 1, 2""",
)
def check_fk_pair(s):
    """A key of two columns; the returned items act as the parent."""
    items = s.table("lineitem")
    parent = items.where(F.col("l_returnflag") == "R")
    pair = ["l_partkey", "l_suppkey"]
    return con.foreign_key_violations(items, pair, parent, pair)


@query(
    "check_unique",
    f"""SELECT o_custkey, strftime(o_orderdate, {_DUCK_TIME}) AS o_orderdate, count(*) AS n_rows FROM orders
    WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY o_custkey, orders.o_orderdate HAVING count(*) > 1""",
)
def check_unique(s):
    """The key is tested as it is; only what is found is formatted."""
    return _text_times(con.unique_violations(s.table("orders"), ["o_custkey", "o_orderdate"]))


@query(
    "check_not_null",
    """SELECT 'o_orderkey' AS column_name, count(*) FILTER (o_orderkey IS NULL) AS n_nulls FROM orders
    UNION ALL SELECT 'o_orderstatus', count(*) FILTER (o_orderstatus IS NULL OR o_orderstatus = 'P') FROM orders
    UNION ALL SELECT 'o_totalprice', count(*) FILTER (o_totalprice IS NULL) FROM orders""",
)
def check_not_null(s):
    """Orders in progress count as orders without a status."""
    orders = s.table("orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    return con.null_counts(orders, ["o_orderkey", "o_orderstatus", "o_totalprice"])


@query(
    "check_enum",
    """SELECT event_type, count(*) AS n_rows FROM events
    WHERE event_type NOT IN (SELECT event_type FROM events WHERE value > 0 AND event_type <> 'error') GROUP BY 1""",
)
def check_enum(s):
    """The labels are the types seen on events that carry a value."""
    events = s.table("events")
    seen = events.where((F.col("value") > 0) & (F.col("event_type") != "error"))
    labels = seen.select(F.col("event_type").alias("label")).distinct()
    return con.enum_violations(events, "event_type", labels)


# What the catalogues say about two of the tables.
_RULES = {
    "lineitem": [
        con.Declared("primary key", "primary key", ("l_orderkey", "l_linenumber")),
        con.Declared("unique", "one_part_a_day", ("l_partkey", "l_suppkey", "l_shipdate")),
        con.Declared("not null", "l_quantity", ("l_quantity",)),
        con.Declared("enum", "l_returnflag", ("l_returnflag",), ("A", "N")),
        con.Declared("enum", "l_linestatus", ("l_linestatus",), ("O", "F")),
    ],
    "orders": [
        con.Declared("primary key", "primary key", ("o_orderkey",)),
        con.Declared("unique", "one_order_a_day", ("o_custkey", "o_orderdate")),
        con.Declared("not null", "o_totalprice", ("o_totalprice",)),
        con.Declared("enum", "o_orderstatus", ("o_orderstatus",), ("F", "O")),
    ],
}


def _broken_rules() -> str:
    """One text per rule."""
    texts = []
    for table, rules in _RULES.items():
        for r in rules:
            columns = ", ".join(r.columns)
            unset = " OR ".join(f"{c} IS NULL" for c in r.columns)
            labels = ", ".join(f"'{x}'" for x in r.labels)
            where, having = {
                "primary key": ("true", f"count(*) > 1 OR {unset}"),
                "unique": (f"NOT ({unset})", "count(*) > 1"),
                "not null": (unset, "true"),
                "enum": (f"{columns} NOT IN ({labels})", "true"),
            }[r.kind]
            texts.append(
                f"SELECT '{table}' AS table_name, '{r.kind}' AS kind, '{r.name}' AS name, count(*) AS n_keys, sum(n)::BIGINT AS n_rows FROM "
                f"(SELECT {columns}, count(*) AS n FROM {table} WHERE {where} GROUP BY {columns} HAVING {having}) k HAVING count(*) > 0"
            )
    return " UNION ALL ".join(texts)


@query("check_declared", _broken_rules())
def check_declared(s):
    """All keys, unique indexes, set columns and enums of two tables, each table read once."""
    parts = []
    for table, rules in _RULES.items():
        found = con.declared_violations(s.table(table), rules)
        counts = found.groupBy("kind", "name").agg(F.count("*").alias("n_keys"), F.sum("n_rows").alias("n_rows"))
        parts.append(counts.select(F.lit(table).alias("table_name"), "*"))
    return parts[0].unionByName(parts[1])


_GONE = "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IS NOT NULL"
_SHIPPED = f"strftime(l_shipdate, {_DUCK_TIME}) AS l_shipdate"


@query(
    "cascade_delete",
    f"SELECT * REPLACE ({_SHIPPED}) FROM lineitem WHERE l_orderkey IS NULL OR l_orderkey NOT IN ({_GONE})",
)
def cascade_delete(s):
    gone = s.table("orders").where(F.col("o_orderstatus") == "F")
    return _text_times(con.after_delete(s.table("lineitem"), ["l_orderkey"], gone, ["o_orderkey"], "CASCADE"))


@query(
    "set_null_delete",
    f"SELECT * REPLACE (CASE WHEN l_orderkey NOT IN ({_GONE}) THEN l_orderkey END AS l_orderkey, {_SHIPPED}) FROM lineitem",
)
def set_null_delete(s):
    gone = s.table("orders").where(F.col("o_orderstatus") == "F")
    return _text_times(con.after_delete(s.table("lineitem"), ["l_orderkey"], gone, ["o_orderkey"], "SET NULL"))


_CHAIN_KEYS = [
    con.ForeignKey("orders", ("o_custkey",), "customer", ("c_custkey",), "CASCADE"),
    con.ForeignKey("lineitem", ("l_orderkey",), "orders", ("o_orderkey",), "CASCADE"),
    con.ForeignKey("lineitem", ("l_partkey",), "part", ("p_partkey",), "SET NULL"),
]


@query(
    "delete_chain",
    f"""
    WITH gone_orders AS (
      SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)),
    gone_parts AS (SELECT p_partkey FROM part WHERE p_size > 40)
    SELECT * REPLACE (CASE WHEN l_partkey NOT IN (SELECT p_partkey FROM gone_parts WHERE p_partkey IS NOT NULL) THEN l_partkey END AS l_partkey, {_SHIPPED})
    FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM gone_orders WHERE o_orderkey = l_orderkey)""",
)
def delete_chain(s):
    """Customers in debt go with their orders and their lines; large parts leave lines without one."""
    names = ("customer", "orders", "lineitem", "part")
    deleted = {
        "customer": s.table("customer").where(F.col("c_acctbal") < 0).select("c_custkey"),
        "part": s.table("part").where(F.col("p_size") > 40).select("p_partkey"),
    }
    after, _ = con.delete_rows({t: s.table(t) for t in names}, _CHAIN_KEYS, deleted)
    return _text_times(after["lineitem"])


@query(
    "delete_tree",
    """
    WITH RECURSIVE tree AS (
      SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey - o_orderkey % 7 ELSE o_orderkey // 7 END AS parent, o_totalprice FROM orders),
    gone AS (
      SELECT o_orderkey FROM tree WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM tree)
      UNION SELECT tree.o_orderkey FROM tree JOIN gone ON tree.parent = gone.o_orderkey)
    SELECT o_orderkey, parent, o_totalprice FROM tree
    WHERE o_orderkey NOT IN (SELECT o_orderkey FROM gone WHERE o_orderkey IS NOT NULL) OR o_orderkey IS NULL""",
)
def delete_tree(s):
    """Every order hangs on another one of the same table; dear ones fall with all below them."""
    key = F.col("o_orderkey")
    parent = F.when(key % 7 > 0, key - key % 7).otherwise(F.expr("o_orderkey div 7"))
    tree = s.table("orders").select("o_orderkey", parent.alias("parent"), "o_totalprice")
    bound = tree.agg((F.avg("o_totalprice") * 1.9).alias("bound"))
    dear = tree.join(F.broadcast(bound), F.col("o_totalprice") > F.col("bound")).select("o_orderkey")
    own = con.ForeignKey("tree", ("parent",), "tree", ("o_orderkey",), "CASCADE")
    return con.delete_rows({"tree": tree}, [own], {"tree": dear})[0]["tree"]


_ORDER = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
# A later snapshot: rows gone, repriced, moved in priority, and new ones.
_AFTER = """
  SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 23 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
    o_orderdate, CASE WHEN o_orderkey % 29 = 0 THEN 'later' ELSE o_orderpriority END AS o_orderpriority
  FROM {orders} WHERE o_orderkey % 19 <> 0
  UNION ALL SELECT -1 - o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM {orders} WHERE o_orderpriority = '1-URGENT'"""


@query(
    "audit_changes",
    f"""SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey,
      CASE WHEN b.o_orderkey IS NULL THEN 'INSERT' WHEN a.o_orderkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op,
      b.o_totalprice AS old_total, a.o_totalprice AS new_total, b.o_orderpriority AS old_priority, a.o_orderpriority AS new_priority
    FROM (SELECT {_ORDER} FROM orders) b FULL JOIN ({_AFTER.format(orders='orders')}) a ON a.o_orderkey = b.o_orderkey
    WHERE a IS DISTINCT FROM b""",
)
def audit_changes(s):
    """Orders, with all their columns, against a later snapshot."""
    after = s.spark.sql(_AFTER.format(orders=s.dialect.table("orders")))
    return con.audit_changes(s.table("orders"), after, ["o_orderkey"]).select(
        "o_orderkey",
        "op",
        *(
            F.col(f"{row}.{column}").alias(f"{label}_{name}")
            for column, name in (("o_totalprice", "total"), ("o_orderpriority", "priority"))
            for row, label in (("old_row", "old"), ("new_row", "new"))
        ),
    )
