"""Catalog queries: search, paging, details, diffs, retention, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.codecs import preference_key, stored_value
from ..operators import catalog, diff, ranking, retention, textindex
from ..operators.catalog import CatalogQuery
from ..session import table
from ..sources import sinks
from ..sources.snapshots import Snapshots
from ..stores import shared_dir
from .registry import registry

query, QUERIES, ORACLE_SQL = registry()

_SEARCH = CatalogQuery(text="OL", text_columns=("p_name", "p_type", "p_brand"), contains={"p_type": "m"}, flags={"large": True})
_SEARCH_SQL = "FROM part WHERE p_size >= 10 AND p_type ILIKE '%m%' AND (p_name ILIKE '%ol%' OR p_type ILIKE '%ol%' OR p_brand ILIKE '%ol%')"


def _parts(spark, d):
    return table(spark, d, "part").withColumn("large", F.col("p_size") >= 10)


@query(f"SELECT p_partkey, p_name, p_type, p_brand, p_size {_SEARCH_SQL} ORDER BY p_name, p_partkey LIMIT 50 OFFSET 3")
def catalog_search_page(spark, d):
    return catalog.search_page(_parts(spark, d), _SEARCH, ["p_name", "p_partkey"], 50, 3).select("p_partkey", "p_name", "p_type", "p_brand", "p_size")


@query(f"SELECT count(*) AS total {_SEARCH_SQL}")
def catalog_search_count(spark, d):
    return catalog.search_count(_parts(spark, d), _SEARCH)


@query("SELECT count(*) AS total FROM part WHERE false")
def catalog_search_no_keys(spark, d):
    return catalog.search_count(_parts(spark, d), CatalogQuery(keys=(), key_column="p_partkey"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'e') OR contains(lower(p_type), 'brass') OR contains(CAST(p_size AS VARCHAR), 'e')")
def list_filter(spark, d):
    parts = table(spark, d, "part")
    hits = catalog.list_filter(parts, "E", ["p_name", "p_size"]).union(catalog.list_filter(parts, "BRASS", ["p_type"]))
    return hits.select("p_partkey", "p_name").distinct()


@query("""SELECT o.o_orderkey, o.o_orderstatus, coalesce(string_agg(l.l_linenumber || ':' || l.l_partkey, ',' ORDER BY l.l_linenumber, l.l_partkey), '') AS lines
    FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY ALL""")
def catalog_details(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").withColumnRenamed("l_orderkey", "o_orderkey")
    full = catalog.attach(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), lines, ["o_orderkey"], "l_linenumber", ["l_linenumber", "l_partkey"], "children")
    text = F.transform("children", lambda c: F.concat(c["l_linenumber"].cast("string"), F.lit(":"), c["l_partkey"].cast("string")))
    return full.select("o_orderkey", "o_orderstatus", F.array_join(text, ",").alias("lines"))


@query("""SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS orders
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY c_custkey""")
def bulk_attach(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    wanted = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    full = catalog.attach(wanted, orders, ["c_custkey"], "o_orderkey", ["o_orderkey"], "children")
    return full.select("c_custkey", F.size("children").cast("long").alias("n_orders"), F.array_join(F.transform("children", lambda c: c["o_orderkey"].cast("string")), ",").alias("orders"))


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def existing_keys(spark, d):
    rich = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return catalog.existing_keys(table(spark, d, "orders"), rich, "o_custkey")


@query("""SELECT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F'
    GROUP BY o_orderkey HAVING count(*) = 1 ORDER BY o_orderkey LIMIT 1000""")
def advanced_candidates(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return catalog.singletons(table(spark, d, "orders"), lines, "o_orderkey", F.col("o_orderstatus") != "F", 1000)


def _builds(spark, d):
    """A build for each customer and month: its orders' total, and origin by priority."""
    rows = table(spark, d, "orders").groupBy("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return rows.agg(F.max("o_orderkey").alias("generated_at"), F.min("o_orderpriority").alias("p")).select(
        F.col("o_custkey").alias("owner"), F.concat_ws("-", "o_custkey", "month").alias("fingerprint"), "generated_at", F.when(F.col("p").startswith("1"), "IMPORTED").otherwise("INSTALLED").alias("origin"))


_BUILDS_SQL = """builds AS (SELECT o_custkey AS owner, o_custkey || '-' || strftime(o_orderdate, '%Y-%m') AS fingerprint, max(o_orderkey) AS generated_at,
    CASE WHEN min(o_orderpriority) LIKE '1%' THEN 'IMPORTED' ELSE 'INSTALLED' END AS origin FROM orders GROUP BY o_custkey, strftime(o_orderdate, '%Y-%m'))"""


@query(f"WITH {_BUILDS_SQL} SELECT fingerprint AS base_sha, generated_at FROM builds WHERE origin <> 'IMPORTED' AND fingerprint <> '1-1996-01' ORDER BY generated_at DESC, fingerprint LIMIT 1")
def previous_summary(spark, d):
    return catalog.previous_build(_builds(spark, d).withColumnRenamed("fingerprint", "base_sha"), "1-1996-01").select("base_sha", "generated_at")


@query(f"WITH {_BUILDS_SQL} SELECT fingerprint AS base_sha, generated_at FROM builds ORDER BY generated_at DESC, fingerprint LIMIT 1")
def latest_build(spark, d):
    return catalog.previous_build(_builds(spark, d).withColumnRenamed("fingerprint", "base_sha")).select("base_sha", "generated_at")


@query(f"""WITH {_BUILDS_SQL},
    pins AS (SELECT owner, min(fingerprint) AS pin, max(fingerprint) AS front FROM builds GROUP BY owner),
    ranked AS (SELECT b.*, CASE WHEN owner % 2 = 0 AND fingerprint = pin THEN 0 WHEN fingerprint = front THEN 1 WHEN owner % 2 = 1 OR origin <> 'IMPORTED' THEN 2 ELSE 3 END AS class, owner % 2 = 0 AS pinned
        FROM builds b JOIN pins USING (owner)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY owner, class ORDER BY generated_at DESC, fingerprint) AS nth FROM ranked),
    kept AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY class, nth) AS keep_rank FROM placed WHERE NOT pinned OR nth = 1)
    SELECT owner, fingerprint, CAST(keep_rank AS INT) AS keep_rank FROM kept WHERE keep_rank <= CASE WHEN pinned THEN 3 ELSE 2 END OR class <= 1""")
def retention_keep(spark, d):
    builds = _builds(spark, d)
    pins = builds.groupBy("owner").agg(F.min("fingerprint").alias("pin"), F.max("fingerprint").alias("front"))
    df = builds.join(pins, "owner")
    return retention.retained(df, F.col("front"), F.when(F.col("owner") % 2 == 0, F.col("pin")), 3, ("owner",)).select("owner", "fingerprint", "keep_rank")


def _snapshots(spark, d):
    orders = table(spark, d, "orders")
    agg = lambda df: df.groupBy("o_custkey").agg(F.max("o_orderstatus").alias("value_type"), F.min("o_orderpriority").alias("compiled_default"), F.count("*").alias("n"))
    return agg(orders.where("o_orderdate < timestamp_ntz '1996-01-01'")), agg(orders.where("o_orderdate >= timestamp_ntz '1996-01-01' AND o_orderdate < timestamp_ntz '1997-01-01'"))


_SNAP_SQL = """b AS (SELECT o_custkey, max(o_orderstatus) AS value_type, min(o_orderpriority) AS compiled_default, count(*) AS n FROM orders WHERE o_orderdate < '1996-01-01' GROUP BY 1),
    a AS (SELECT o_custkey, max(o_orderstatus) AS value_type, min(o_orderpriority) AS compiled_default, count(*) AS n FROM orders WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1997-01-01' GROUP BY 1)"""
_CHANGES_SQL = f"""WITH {_SNAP_SQL}, x AS (SELECT coalesce(b.o_custkey, a.o_custkey) AS o_custkey, CASE WHEN b.o_custkey IS NULL THEN 'ADDED' WHEN a.o_custkey IS NULL THEN 'REMOVED'
    WHEN b.value_type IS DISTINCT FROM a.value_type OR b.compiled_default IS DISTINCT FROM a.compiled_default THEN 'CHANGED' END AS kind FROM b FULL JOIN a ON a.o_custkey = b.o_custkey)"""


@query(f"{_CHANGES_SQL} SELECT * FROM x WHERE kind IS NOT NULL")
def editable_delta(spark, d):
    return diff.delta(*_snapshots(spark, d), ["o_custkey"], ["value_type", "compiled_default"]).select("o_custkey", "kind")


@query(f"{_CHANGES_SQL} SELECT * FROM x WHERE kind IS NOT NULL")
def editable_changes(spark, d):
    return diff.editable_changes(*_snapshots(spark, d), "o_custkey", ["value_type", "compiled_default"])


@query(f"{_CHANGES_SQL} SELECT count(*) FILTER (kind = 'ADDED') AS n_added, count(*) FILTER (kind = 'REMOVED') AS n_removed, count(*) FILTER (kind = 'CHANGED') AS n_changed FROM x")
def change_summary(spark, d):
    return diff.change_summary(diff.delta(*_snapshots(spark, d), ["o_custkey"], ["value_type", "compiled_default"]))


@query(f"""{_CHANGES_SQL}, y AS (SELECT x.*, CASE WHEN a.o_custkey IS NOT NULL THEN a.value_type || '|' || a.compiled_default ELSE b.value_type || '|' || b.compiled_default END AS t FROM x LEFT JOIN a USING (o_custkey) LEFT JOIN b USING (o_custkey))
    SELECT o_custkey, kind FROM y WHERE kind IS NOT NULL AND contains(lower(t), 'urg')""")
def delta_filter(spark, d):
    changes = diff.delta(*_snapshots(spark, d), ["o_custkey"], ["value_type", "compiled_default"])
    return diff.delta_filter(changes, "URG", ["value_type", "compiled_default"]).select("o_custkey", "kind")


def _catalog(df):
    """A snapshot in the shape of a catalog."""
    ready = df.withColumns({"confidence": F.when(F.col("n") >= 6, "AMBIGUOUS").otherwise("UNIQUE_GETTER"), "signatures": F.when(F.col("n") % 3 > 0, F.array((F.col("n") % 3).cast("string"))).otherwise(F.array().cast("array<string>")), "static_site": F.col("n") % 2 == 1})
    return ready.drop("n")


_CAT_SQL = "SELECT *, CASE WHEN n >= 6 THEN 'AMBIGUOUS' ELSE 'UNIQUE_GETTER' END AS confidence, n % 3 AS sig, n % 2 = 1 AS static_site FROM"


@query(f"""WITH {_SNAP_SQL}, o AS ({_CAT_SQL} b), c AS ({_CAT_SQL} a) SELECT coalesce(o.o_custkey, c.o_custkey) AS o_custkey, CASE WHEN o.o_custkey IS NULL THEN 'ADDED' WHEN c.o_custkey IS NULL THEN 'REMOVED'
    WHEN c.confidence = 'AMBIGUOUS' THEN 'AMBIGUOUS' WHEN o.value_type <> c.value_type THEN 'TYPE_CHANGED' WHEN o.compiled_default <> c.compiled_default THEN 'DEFAULT_CHANGED'
    WHEN o.sig > 0 AND c.sig = 0 AND c.static_site THEN 'MOVED_TO_REGISTRY' WHEN o.sig <> c.sig THEN 'REMAPPED' ELSE 'PRESERVED' END AS kind FROM o FULL JOIN c ON c.o_custkey = o.o_custkey""")
def catalog_diff(spark, d):
    return diff.catalog_diff(*map(_catalog, _snapshots(spark, d)), ["o_custkey"])


@query(f"WITH {_SNAP_SQL} SELECT coalesce(b.o_custkey, a.o_custkey) AS o_custkey, CASE WHEN b.o_custkey IS NULL THEN 'promoted' WHEN a.o_custkey IS NULL THEN 'demoted' ELSE 'confirmed' END AS side FROM b FULL JOIN a ON a.o_custkey = b.o_custkey")
def key_report(spark, d):
    return diff.key_report(*_snapshots(spark, d), "o_custkey")


@query(f"WITH {_SNAP_SQL} SELECT count(*) AS pairs, count(*) FILTER (b.value_type IS DISTINCT FROM a.value_type) AS renamed, count(*) FILTER (b.n IS DISTINCT FROM a.n) AS resized FROM b JOIN a USING (o_custkey)")
def getter_compat(spark, d):
    return diff.pair_compatibility(*_snapshots(spark, d), ["o_custkey"], {"renamed": "value_type", "resized": "n"})


@query("""SELECT count(*) AS total, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (json_extract_string(props, '$.k') = '7') AS sevens,
    count(*) FILTER (event_type = 'view') + count(*) FILTER (json_extract_string(props, '$.k') = '8') AS preserved FROM events""")
def run_summary(spark, d):
    df = table(spark, d, "events").withColumn("metadata", F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("type"), "event_type")))
    return catalog.run_summary(df, "metadata", {"clicks": ("type", "click"), "errors": ("type", "error"), "sevens": ("k", "7"), "preserved": [("type", "view"), ("k", "8")]})


@query("SELECT DISTINCT user_id FROM events WHERE (event_type = 'error' AND value > 50) OR (event_type = 'view' AND value < 5)")
def pending_keys(spark, d):
    bad = (F.col("event_type") == "error") & (F.col("value") > 50)
    return catalog.pending_keys(table(spark, d, "events"), bad, (F.col("event_type") == "view") & (F.col("value") < 5), "user_id")


@query("""SELECT p_partkey, coalesce(CAST(q AS INT), p_size) AS p_size, coalesce(f, p_brand) AS p_brand FROM part
    LEFT JOIN (SELECT l_partkey, max(l_linenumber) AS q, min(l_returnflag) AS f FROM lineitem WHERE l_quantity > 40 GROUP BY 1) ON l_partkey = p_partkey""")
def deep_resolve_merge(spark, d):
    updates = table(spark, d, "lineitem").where("l_quantity > 40").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_linenumber").alias("p_size"), F.min("l_returnflag").alias("p_brand"))
    return catalog.merge_results(table(spark, d, "part").select("p_partkey", "p_size", "p_brand"), updates, ["p_partkey"], ["p_size", "p_brand"])


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
    UNION ALL SELECT o_orderkey, 0, 0.0 FROM orders WHERE o_orderstatus = 'P'""")
def replace_children(spark, d):
    new = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.lit(0.0).alias("l_quantity"))
    return catalog.replace_children(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), new, ["l_orderkey"])


@query("""SELECT user_id, event_type AS key, event_id AS base_sha FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type, event_id) AS n FROM events) WHERE n = 1""")
def historical_names(spark, d):
    events = table(spark, d, "events")
    return catalog.latest_names(events.select("user_id", F.col("event_type").alias("key"), F.col("event_id").alias("base_sha")), events.select(F.col("event_id").alias("base_sha"), F.col("ts").alias("generated_at")), "user_id")


@query("""SELECT 'p_brand' AS dimension, p_brand AS value, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY p_size
    UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY p_type""")
def inventory_counts(spark, d):
    return diff.count_report(table(spark, d, "part"), ["p_brand", "p_size", "p_type"])


@query("""WITH k AS (SELECT n_name AS key, 'nation' AS kind, 0 AS s FROM nation UNION ALL SELECT r_name, 'region', 1 FROM region UNION ALL SELECT DISTINCT c_mktsegment, 'segment', 2 FROM customer)
    SELECT key, kind FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s, kind) AS n FROM k) WHERE n = 1""")
def union_distinct(spark, d):
    return catalog.union_distinct([
        table(spark, d, "nation").select(F.col("n_name").alias("key"), F.lit("nation").alias("kind")),
        table(spark, d, "region").select(F.col("r_name").alias("key"), F.lit("region").alias("kind")),
        table(spark, d, "customer").select(F.col("c_mktsegment").alias("key"), F.lit("segment").alias("kind")).distinct(),
    ], ["key"])


@query("""SELECT o_custkey, o_orderkey, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_orderdate, o_orderkey) AS rank FROM orders) WHERE rank <= 12""")
def top_evidence(spark, d):
    order = [F.desc(F.col("o_orderstatus") == "F"), "o_orderdate", "o_orderkey"]
    return ranking.top_n(table(spark, d, "orders"), ["o_custkey"], order, 12).select("o_custkey", "o_orderkey", "rank")


@query("""SELECT l_suppkey, l_returnflag, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY f, l_returnflag) - 1 AS INT) AS dense_id FROM (SELECT l_suppkey, l_returnflag, min(l_orderkey) AS f FROM lineitem GROUP BY ALL)""")
def dense_ids(spark, d):
    return ranking.dense_ids(table(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag", "l_orderkey")


@query("""SELECT '"' || p_partkey || '","' || replace(p_name, '"', '""') || '","' || coalesce(CAST(p_size AS VARCHAR), '') || '"' AS line FROM part
    UNION ALL SELECT 'p_partkey,p_name,p_size'""")
def export_csv(spark, d):
    return sinks.csv_lines(table(spark, d, "part"), ["p_partkey", "p_name", "p_size"])


@query("""SELECT '{"p_partkey":' || p_partkey || ',"p_brand":"' || p_brand || '","p_size":' || p_size || '}' AS line FROM part""")
def export_json(spark, d):
    return sinks.json_rows(table(spark, d, "part"), ["p_partkey", "p_brand", "p_size"])


@query("""SELECT n_regionkey, '{"schemaVersion":3,"region":' || n_regionkey || ',"mappings":[' || string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']}' AS profile FROM nation GROUP BY n_regionkey""")
def profile_json(spark, d):
    header = {"schemaVersion": F.lit(3), "region": F.col("n_regionkey")}
    return sinks.profile_json(table(spark, d, "nation"), header, ["n_regionkey"], ["n_nationkey", "n_name"], "n_nationkey")


# --- retries ----------------------------------------------------------------

_RETRY = catalog.RetryRule(exhausted=("k", "7"), attempted="again", strategy=("type", "click"), reason=("user", ("1", "2", "3")), limitation=("type", "error"))
_RETRY_SQL = """WITH r AS (SELECT *, json_extract_string(props, '$.k') = '7' AS out_, CASE WHEN event_id % 2 = 0 THEN 'yes' END AS again FROM events),
    t AS (SELECT *, value > 20 AND out_ AND again IS NULL AS inconclusive, event_type <> 'click' AND ((out_ AND user_id IN (1, 2, 3)) OR event_type = 'error') AS due FROM r)"""


def _retries(spark, d):
    more = F.create_map(F.lit("type"), "event_type", F.lit("user"), F.col("user_id").cast("string"))
    again = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("again"), F.lit("yes"))).otherwise(F.create_map().cast("map<string,string>"))
    return table(spark, d, "events").withColumns({"metadata": F.map_concat(F.from_json("props", "map<string,string>"), more, again), "editable": F.col("value") > 20})


@query(f"{_RETRY_SQL} SELECT event_id FROM t WHERE inconclusive ORDER BY event_id LIMIT 40")
def inconclusive_keys(spark, d):
    return catalog.ordered_keys(_retries(spark, d), _RETRY.inconclusive(F.col("editable")), "event_id", 40)


@query(f"{_RETRY_SQL} SELECT event_id FROM t WHERE due")
def retry_keys(spark, d):
    return _retries(spark, d).where(_RETRY.retry()).select("event_id")


@query(f"{_RETRY_SQL} SELECT count(*) FILTER (inconclusive) + count(*) FILTER (due) AS actionable FROM t")
def actionable_count(spark, d):
    return catalog.actionable_count(_retries(spark, d), _RETRY.inconclusive(F.col("editable")), _RETRY.retry())


@query(f"{_RETRY_SQL} SELECT DISTINCT user_id FROM t WHERE inconclusive OR due")
def pending_users(spark, d):
    return catalog.pending_keys(_retries(spark, d), _RETRY.inconclusive(F.col("editable")), _RETRY.retry(), "user_id")


# --- stored tables -----------------------------------------------------------


def _identifiers(spark, d):
    """Orders as identifiers of the build that their status and year make."""
    o = table(spark, d, "orders")
    return o.select(F.concat_ws("-", "o_orderstatus", F.year("o_orderdate")).alias("base_sha"), F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("key"), "o_custkey", (F.col("o_totalprice") > 200000).alias("editable"))


_IDS_SQL = "ids AS (SELECT o_orderstatus || '-' || year(o_orderdate) AS base_sha, 'k' || o_orderkey AS key, o_custkey, o_totalprice > 200000 AS editable, o_orderkey FROM orders)"


@query(f"WITH {_IDS_SQL} SELECT base_sha, key, CASE WHEN base_sha LIKE 'P%' THEN 0 ELSE o_custkey END AS o_custkey FROM ids")
def put_builds(spark, d):
    path = shared_dir(spark)
    rows = _identifiers(spark, d).drop("editable")
    catalog.put(rows, path)
    catalog.put(rows.where("base_sha LIKE 'P%'").withColumn("o_custkey", F.lit(0).cast("bigint")), path)
    return catalog.load(spark, path).select("base_sha", "key", "o_custkey")


@query("SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS INT) AS ordinal, l_partkey FROM lineitem")
def child_rows(spark, d):
    parents = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("lines"))
    return catalog.children_of(parents, ["l_orderkey"], "lines").select("l_orderkey", "ordinal", "l_partkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'UNKNOWN' END AS kind, false AS reviewed FROM orders")
def upgraded_rows(spark, d):
    old = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("kind"))
    return catalog.upgraded(old, {"kind": "UNKNOWN", "reviewed": False})


@query(f"WITH {_BUILDS_SQL} SELECT fingerprint, CASE WHEN origin = 'IMPORTED' AND fingerprint = '1-1996-01' THEN 'INSTALLED' ELSE origin END AS origin FROM builds")
def import_origins(spark, d):
    return _builds(spark, d).select("fingerprint", catalog.imported_origin(F.col("origin"), F.col("fingerprint"), "1-1996-01").alias("origin"))


@query(f"WITH {_BUILDS_SQL}, p AS (SELECT min(fingerprint) AS f FROM builds) SELECT fingerprint AS base_sha, CASE WHEN fingerprint = f THEN 'INSTALLED' ELSE origin END AS origin FROM builds, p")
def pinned_builds(spark, d):
    builds = _builds(spark, d).withColumnRenamed("fingerprint", "base_sha")
    return catalog.pin(builds, builds.agg(F.min("base_sha")).first()[0]).select("base_sha", "origin")


@query(f"WITH {_IDS_SQL}, last AS (SELECT base_sha FROM ids GROUP BY 1 ORDER BY max(o_orderkey) DESC, base_sha LIMIT 3) SELECT base_sha, key FROM ids WHERE base_sha IN (SELECT base_sha FROM last)")
def pruned_builds(spark, d):
    rows = _identifiers(spark, d).withColumn("n", F.substring("key", 2, 20).cast("bigint"))
    kept = rows.groupBy("base_sha").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "base_sha").limit(3)
    return catalog.prune(rows, kept).select("base_sha", "key")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS base_sha, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey AS VARCHAR) ELSE o_orderpriority END AS base_apk_sha FROM orders WHERE o_orderkey = 7")
def build_summary(spark, d):
    builds = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("base_sha"), F.when(F.col("o_orderstatus") == "F", " ").otherwise(F.col("o_orderpriority")).alias("base_apk_sha"))
    return catalog.summary(builds, "7")


@query("""WITH b AS (SELECT o_orderstatus || '-' || year(o_orderdate) AS base_sha, max(o_orderkey) AS g FROM orders GROUP BY 1), c AS (SELECT base_sha FROM b WHERE base_sha <> 'none' ORDER BY g DESC, base_sha LIMIT 1)
    SELECT base_sha, key, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber), '') AS getters FROM (SELECT o_orderstatus || '-' || year(o_orderdate) AS base_sha, 'k' || o_orderkey AS key, o_orderkey FROM orders WHERE o_totalprice > 200000) JOIN c USING (base_sha)
    LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def baseline_mappings(spark, d):
    rows = _identifiers(spark, d)
    builds = rows.groupBy("base_sha").agg(F.max(F.substring("key", 2, 20).cast("bigint")).alias("generated_at")).withColumn("origin", F.lit("INSTALLED"))
    lines = table(spark, d, "lineitem").select(F.concat(F.lit("k"), F.col("l_orderkey").cast("string")).alias("key"), F.col("l_linenumber").alias("ordinal"))
    getters = lines.join(rows.select("key", "base_sha"), "key")
    found = catalog.baseline(builds, rows, getters, "none")
    return found.select("base_sha", "key", F.array_join(F.transform("getters", lambda g: g["ordinal"].cast("string")), ",").alias("getters"))


@query("SELECT p_partkey, p_name, NULL AS p_brand FROM part")
def compact_rows(spark, d):
    return catalog.compact(table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), ("p_brand",))


@query("SELECT DISTINCT p_name, 'override.' || substr(sha256(p_name), 1, 40) AS preference_key FROM part WHERE p_name LIKE 'c%'")
def by_preference_key(spark, d):
    parts = table(spark, d, "part").select(F.col("p_name").alias("key")).distinct()
    wanted = parts.where("key LIKE 'c%'").select(preference_key(F.col("key")).alias("preference_key"))
    return catalog.by_preference(parts, wanted).select(F.col("key").alias("p_name"), "preference_key")


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) // 250 AS page FROM orders")
def export_pages(spark, d):
    return catalog.export_pages(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 250).select("o_orderkey", "page")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 250 OFFSET 500")
def key_slice(spark, d):
    return catalog.key_slice(table(spark, d, "orders"), ["o_totalprice", "o_orderkey"], 500, 250).select("o_orderkey")


# --- documents ---------------------------------------------------------------

_BACKUP_SQL = """b AS (SELECT s_nationkey, s_name, 'override.' || substr(sha256(s_name), 1, 40) AS pref, CASE s_suppkey % 4 WHEN 0 THEN 'INT:' || s_suppkey WHEN 1 THEN 'STRING:a:b' WHEN 2 THEN 'INT:x' ELSE 'LONG:5' END AS raw, s_suppkey % 3 = 0 AS held, s_suppkey FROM supplier)"""


def _backups(spark, d):
    m = F.col("s_suppkey") % 4
    raw = F.when(m == 0, F.concat(F.lit("INT:"), F.col("s_suppkey").cast("string"))).when(m == 1, "STRING:a:b").when(m == 2, "INT:x").otherwise("LONG:5")
    rows = table(spark, d, "supplier").select("s_nationkey", F.concat(F.lit("B"), "s_nationkey").alias("build"), F.col("s_name").alias("key"), preference_key(F.col("s_name")).alias("preference_key"), raw.alias("raw"), F.when(F.col("s_suppkey") % 3 == 0, "OLD").alias("reason"))
    return sinks.backup_documents(rows, ["s_nationkey"], "build")


@query(f"""WITH {_BACKUP_SQL} SELECT s_nationkey, '{{"schemaVersion":3,"buildFingerprintSha256":"B' || s_nationkey || '","overrides":{{' || coalesce(string_agg('"' || s_name || '":"' || raw || '"', ',' ORDER BY s_name) FILTER (NOT held), '')
    || '}},"suspended":{{' || coalesce(string_agg('"' || pref || '":{{"raw":"' || raw || '","identifier":"' || s_name || '"}}', ',' ORDER BY pref) FILTER (held), '') || '}}}}' AS document FROM b GROUP BY s_nationkey""")
def backup_documents(spark, d):
    return _backups(spark, d)


@query(f"""WITH {_BACKUP_SQL} SELECT s_nationkey, NULL AS preference_key, NULL AS name, NULL AS raw, 'WRONG_DOCUMENT' AS verdict FROM b WHERE s_nationkey % 5 = 0 GROUP BY 1
    UNION ALL SELECT s_nationkey, pref, s_name, raw, CASE WHEN held THEN 'RESTORED' WHEN raw = 'INT:x' THEN 'REJECTED' ELSE 'ACCEPTED' END FROM b WHERE s_nationkey % 5 > 0 AND NOT (held AND raw = 'INT:x')""")
def backup_import(spark, d):
    build = F.when(F.col("s_nationkey") % 5 == 0, "other").otherwise(F.concat(F.lit("b"), F.col("s_nationkey").cast("string")))
    return sinks.import_backup(_backups(spark, d), ["s_nationkey"], build, lambda rows: rows.withColumn("reason", F.when(stored_value(F.col("raw")).isNull(), "INVALID")))


_INVENTORY_SQL = """g AS (SELECT o_custkey, o_orderkey, 'm' || o_orderpriority[1] AS method FROM orders), f AS (SELECT o_custkey, method, min(o_orderkey) AS first FROM g GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY first, method) - 1 AS n FROM f)"""


def _inventories(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 2 == 0).alias("editable"), F.array(F.struct(F.concat(F.lit("m"), F.left("o_orderpriority", F.lit(1))).alias("name"))).alias("getters"))
    return sinks.inventory_documents(rows, ["o_custkey"], ["editable"], {"schemaVersion": F.lit(4)}, "name")


@query(f"""WITH {_INVENTORY_SQL}, m AS (SELECT o_custkey, string_agg('{{"name":"' || method || '"}}', ',' ORDER BY n) AS methods FROM n GROUP BY 1),
    i AS (SELECT o_custkey, string_agg('{{"key":' || o_orderkey || ',"editable":' || (o_orderkey % 2 = 0) || ',"getters":[' || n || ']}}', ',' ORDER BY o_orderkey) AS ids FROM g JOIN n USING (o_custkey, method) GROUP BY 1)
    SELECT o_custkey, '{{"schemaVersion":4,"methods":[' || methods || '],"identifiers":[' || ids || ']}}' AS document FROM m JOIN i USING (o_custkey)""")
def inventory_documents(spark, d):
    return _inventories(spark, d)


@query("SELECT o_custkey, '{\"key\":\"' || o_orderkey || '\",\"getters\":[{\"name\":\"m' || o_orderpriority[1] || '\"}]}' AS line FROM orders WHERE o_orderkey % 2 = 0")
def compact_fixture(spark, d):
    ids = "array<struct<key:string,namespace:string,value_type:string,compiled_default:string,confidence:string,editable:boolean,getters:array<int>>>"
    read = _inventories(spark, d).select("o_custkey", F.from_json("document", f"struct<methods:array<struct<name:string>>,identifiers:{ids}>").alias("d")).select("o_custkey", "d.methods", "d.identifiers")
    return sinks.compact_rows(read, ["o_custkey"])


@query("SELECT p_partkey, p_name FROM part WHERE p_size > 30")
def export_scope(spark, d):
    parts = table(spark, d, "part").withColumn("editable", F.col("p_size") > 30)
    return sinks.scoped(parts, "EDITABLE").select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name, p_size FROM part")
def published_slot(spark, d):
    root = shared_dir(spark)
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    sinks.publish(rows.limit(0), root, lambda r: True)
    sinks.publish(rows, root, lambda r: not r.isEmpty())
    return sinks.published(spark, root)


@query("""WITH k AS (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (0, 3) OR n_nationkey = (SELECT max(n_nationkey) FROM nation WHERE n_nationkey % 3 <> 1 AND n_nationkey NOT IN (0, 3)))
    SELECT 'builds' AS part, n_name AS base_sha, 1::BIGINT AS n FROM k UNION ALL SELECT 'identifiers', n_name, count(*) FROM k JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name
    UNION ALL SELECT 'getters', n_name, count(*) FROM k JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY n_name UNION ALL SELECT 'before', n_name, count(*) FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name""")
def snapshot_prune(spark, d):
    """Nations as builds, stored with their customers and orders as one change; retention then prunes all three at once.
    The version before it can still be read."""
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("base_sha"))
    key, third = F.col("n_nationkey"), F.col("n_nationkey") % 3
    builds = nation.select("base_sha", (key * 10).alias("generated_at"), F.when(third == 0, "INSTALLED").when(third == 1, "IMPORTED").otherwise("LEGACY").alias("origin"))
    customers = table(spark, d, "customer").join(nation, F.col("c_nationkey") == key).select("base_sha", "c_custkey", F.col("c_name").alias("key"))
    orders = table(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("base_sha", "key", F.col("o_orderkey").alias("ordinal"))
    store = Snapshots(spark, shared_dir(spark))
    before = store.put({"builds": builds, "identifiers": customers, "getters": orders})
    kept = retention.retained(store.read("builds").withColumnRenamed("base_sha", "fingerprint"), "NATION_3", "NATION_0", 3)
    now = store.prune([r[0] for r in kept.select("fingerprint").collect()])  # three builds at most
    parts = [("builds", now), ("identifiers", now), ("getters", now), ("identifiers", before)]
    counts = [store.read(t, v).groupBy("base_sha").agg(F.count("*").alias("n")).select(F.lit("before" if v == before else t).alias("part"), "base_sha", "n") for t, v in parts]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_name ILIKE '%old w%' OR p_type ILIKE '%old w%'")
def indexed_search(spark, d):
    """A substring search over posting lists of trigrams that were written before."""
    part, path = table(spark, d, "part"), f"{shared_dir(spark)}/index"
    textindex.write_index(part, path, "p_partkey", ("p_name", "p_type"))
    return textindex.indexed_search(part, spark.read.parquet(path), "p_partkey", ("p_name", "p_type"), "OLD w").select("p_partkey", "p_name", "p_type")


@query("""SELECT 'old w' AS text, (SELECT count(*) FROM part WHERE EXISTS (SELECT 1 FROM (VALUES (lower(p_name)), (lower(p_type))) t(x) WHERE contains(x, 'old') AND contains(x, 'ld ') AND contains(x, 'd w'))) AS n_read, (SELECT count(*) FROM part WHERE p_name ILIKE '%old w%' OR p_type ILIKE '%old w%') AS n_found
    UNION ALL SELECT 'ed', (SELECT count(*) FROM part), (SELECT count(*) FROM part WHERE p_name ILIKE '%ed%' OR p_type ILIKE '%ed%')""")
def indexed_search_report(spark, d):
    part, path = table(spark, d, "part"), f"{shared_dir(spark)}/index"
    textindex.write_index(part, path, "p_partkey", ("p_name", "p_type"))
    return textindex.search_report(part, spark.read.parquet(path), "p_partkey", ("p_name", "p_type"), ["old w", "ed"])


@query("""WITH u AS (SELECT n_name AS key, n_nationkey AS number, NULL AS note, 0 AS s FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_name, NULL, 'region' || n_regionkey, 1 FROM nation WHERE n_nationkey > 5 UNION ALL SELECT DISTINCT c_mktsegment, NULL, NULL, 2 FROM customer)
    SELECT key, number, note FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s) AS n FROM u) WHERE n = 1""")
def union_unlike(spark, d):
    nation = table(spark, d, "nation")
    return catalog.union_unlike([
        nation.where("n_nationkey < 10").select(F.col("n_name").alias("key"), F.col("n_nationkey").alias("number")),
        nation.where("n_nationkey > 5").select(F.col("n_name").alias("key"), F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("note")),
        table(spark, d, "customer").select(F.col("c_mktsegment").alias("key")),
    ], ["key"])
