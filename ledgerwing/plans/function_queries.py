"""Scalar rules over words, names and values of the tables."""

from __future__ import annotations

import io
import struct
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..functions import classify, codecs, digests, requests, rules, text
from ..functions.classify import Test, rule
from ..session import table
from ..sources import archives, reader, texts, wire
from ..stores import shared_dir
from .registry import registry

query, QUERIES, ORACLE_SQL = registry()

#: Words that make a name read-only; the last two only as words of their own.
BLOCKED = ["steel", "promo", "econ", "tin"]

# An invented scheme of identifiers, and the rules that go with it.
NAMESPACES = (
    rule("SWITCH", has="~~"), rule("SCREEN", starts=("ui.", "view.")), rule("CONFIG", shape="cfg/.+"), rule("ACTION", has_folded=".ACT."),
    rule("CONSTANT", shape="[A-Z][A-Z0-9]*(_[A-Z0-9]+)+"), rule("WEB", word=("http", "https")),
)
KINDS = (
    rule("SETTING", column="namespace", is_=("SWITCH", "CONFIG")), rule("SCREEN_PART", Test("namespace", "is_", "SCREEN"), not_ends="Ring"), rule("VERB", column="namespace", is_="ACTION"),
    rule("NAME", shape="[A-Z]+"), rule("NAME", Test("namespace", "is_", "CONSTANT")),
)
ROLES = (rule("KEY", Test("registered", "true", True)), rule("LABEL", column="namespace", is_="SCREEN"), rule("ENUM", shape="[A-Z_]+"))
ROLE_KINDS = {"LABEL": "SCREEN_PART", "ENUM": "NAME"}
_KIND_SQL = """CASE WHEN namespace IN ('SWITCH', 'CONFIG') THEN 'SETTING' WHEN namespace = 'SCREEN' AND NOT ends_with(key, 'Ring') THEN 'SCREEN_PART' WHEN namespace = 'ACTION' THEN 'VERB'
    WHEN regexp_full_match(key, '[A-Z]+') OR namespace = 'CONSTANT' THEN 'NAME' ELSE 'OTHER' END"""
_ROLE_SQL = "CASE WHEN p_partkey % 7 = 0 THEN 'KEY' WHEN namespace = 'SCREEN' THEN 'LABEL' WHEN regexp_full_match(key, '[A-Z_]+') THEN 'ENUM' ELSE 'UNKNOWN' END"


def _keys(spark, d):
    """Identifiers made from parts' names: camel case, acronyms, separators, a trailing line break."""
    parts = table(spark, d, "part")
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    shapes = [
        F.concat(F.lit("ui."), a, F.initcap(b)), F.concat(a, F.lit("_"), b, F.lit("~~on")), F.concat(F.lit("HTTP"), F.initcap(a), F.lit("_"), b, F.lit("42Times")), F.concat(F.lit("cfg/"), a),
        F.concat(F.upper(a), F.lit("_"), F.upper(b)), F.col("p_name"), F.concat(a, F.lit(".act."), b), F.concat(F.upper(b), F.lit("\n")),
    ]
    made = rules.first_match([(F.col("p_size") % 9 == k, v) for k, v in enumerate(shapes)], F.upper(b))
    df = parts.select("p_partkey", "p_size", "p_type", made.alias("key"), (F.col("p_partkey") % 7 == 0).alias("registered"))
    return df.withColumn("namespace", classify.classify(NAMESPACES, "TEXT")).withColumn("kind", classify.classify(KINDS, "OTHER"))


_KEYS_SQL = f"""k0 AS (SELECT p_partkey, p_size, p_type, p_name, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part),
    k AS (SELECT *, CASE p_size % 9 WHEN 0 THEN 'ui.' || a || upper(b[1]) || b[2:] WHEN 1 THEN a || '_' || b || '~~on' WHEN 2 THEN 'HTTP' || upper(a[1]) || a[2:] || '_' || b || '42Times' WHEN 3 THEN 'cfg/' || a
        WHEN 4 THEN upper(a) || '_' || upper(b) WHEN 5 THEN p_name WHEN 6 THEN a || '.act.' || b WHEN 7 THEN upper(b) || chr(10) ELSE upper(b) END AS key FROM k0),
    ns AS (SELECT *, CASE WHEN contains(key, '~~') THEN 'SWITCH' WHEN starts_with(key, 'ui.') THEN 'SCREEN' WHEN starts_with(key, 'cfg/') AND length(key) > 4 THEN 'CONFIG' WHEN contains(key, '.act.') THEN 'ACTION'
        WHEN regexp_full_match(key, '[A-Z]+_[A-Z]+') THEN 'CONSTANT' WHEN starts_with(key, 'HTTP') THEN 'WEB' ELSE 'TEXT' END AS namespace FROM k),
    n AS (SELECT *, {_KIND_SQL} AS kind, {_ROLE_SQL} AS role FROM ns)"""


@query(f"WITH {_KEYS_SQL} SELECT p_partkey, key, namespace, kind FROM n")
def namespace_kind(spark, d):
    return _keys(spark, d).select("p_partkey", "key", "namespace", "kind")


@query(f"""WITH {_KEYS_SQL} SELECT p_partkey, role, CASE WHEN role = 'KEY' AND namespace IN ('SWITCH', 'CONFIG') THEN namespace WHEN role = 'LABEL' THEN 'SCREEN_PART' WHEN role = 'ENUM' THEN 'NAME' ELSE kind END AS occurrence FROM n""")
def occurrence_role(spark, d):
    df = _keys(spark, d).withColumn("role", classify.classify(ROLES, "UNKNOWN"))
    kind = classify.registered_kind(F.col("role"), F.col("namespace"), "KEY", ROLE_KINDS, ("SWITCH", "CONFIG"), F.col("kind"))
    return df.select("p_partkey", "role", kind.alias("occurrence"))


@query(f"WITH {_KEYS_SQL} SELECT p_partkey FROM n WHERE length(key) BETWEEN 4 AND 12 AND regexp_full_match(key, '[A-Za-z][A-Za-z0-9_.:/-]+') AND (p_size > 20 OR registered_ = 1)".replace("registered_ = 1", "p_partkey % 7 = 0"))
def technical_literals(spark, d):
    literal = (rule("LITERAL", Test("registered", "true", True), shape="[A-Za-z][A-Za-z0-9_.:/-]{3,11}"), rule("LITERAL", Test("p_size", "at_most", 20, negated=True), shape="[A-Za-z][A-Za-z0-9_.:/-]{3,11}"))
    return _keys(spark, d).where(classify.classify(literal).isNotNull()).select("p_partkey")


@query("""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'BOOLEAN' WHEN 1 THEN 'LONG' WHEN 2 THEN 'OBJECT' WHEN 3 THEN 'OBJECT' WHEN 4 THEN 'STRING' ELSE 'UNKNOWN' END AS value_type,
    CASE WHEN p_size % 6 = 1 AND p_type = 'PROMO' THEN 'CHOICE_LONG' ELSE CASE p_size % 6 WHEN 0 THEN 'BOOLEAN' WHEN 1 THEN 'LONG' WHEN 2 THEN 'OBJECT' WHEN 3 THEN 'OBJECT' WHEN 4 THEN 'STRING' ELSE 'UNKNOWN' END END AS semantic FROM part""")
def value_types(spark, d):
    given = rules.first_match([(F.col("p_size") % 6 == k, v) for k, v in enumerate(["Z", "J", "Lcom/acme/X;", "[I", "Ljava/lang/String;"])], "?")
    kind = classify.descriptor_type(given, {"Z": "BOOLEAN", "J": "LONG", "Ljava/lang/String;": "STRING"})
    df = table(spark, d, "part").withColumn("value_type", kind)
    return df.select("p_partkey", "value_type", classify.classify([rule("CHOICE_LONG", Test("value_type", "is_", "LONG"), column="p_type", is_="PROMO")], F.col("value_type")).alias("semantic"))


@query("""WITH e AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' ELSE 'NONE' END AS getter, CASE WHEN p_partkey % 7 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS identity, p_size FROM part)
    SELECT p_partkey, CASE WHEN p_brand = 'Brand#7' THEN 'PROVEN' ELSE getter END AS getter, identity, concat_ws(',', CASE WHEN p_partkey % 7 = 0 THEN 'registered' END, CASE WHEN p_size % 3 = 0 THEN 'one getter' END, CASE WHEN p_brand = 'Brand#7' THEN 'flow' END) AS evidence,
    CASE WHEN p_size % 3 = 1 THEN 'many getters' ELSE '' END AS ambiguities, (p_brand = 'Brand#7' OR getter = 'HIGH') AS firm FROM e JOIN part USING (p_partkey, p_size)""")
def evidence_strengths(spark, d):
    df = table(spark, d, "part").withColumns({"registered": F.col("p_partkey") % 7 == 0, "getters": F.when(F.col("p_size") % 3 == 0, "one").when(F.col("p_size") % 3 == 1, "many").otherwise("none")})
    getter, identity = [rule("HIGH", column="getters", is_="one"), rule("LOW", column="getters", is_="many")], [rule("HIGH", Test("registered", "true", True)), rule("MEDIUM")]
    first = classify.evidence({"getter": getter, "identity": identity}, [rule("registered", Test("registered", "true", True)), rule("one getter", column="getters", is_="one")], [rule("many getters", column="getters", is_="many")])
    flow = classify.evidence({"getter": [rule("PROVEN", column="p_brand", is_="Brand#7")], "identity": []}, [rule("flow", column="p_brand", is_="Brand#7")], [])
    df = df.withColumns({"e1": first, "e2": flow}).withColumn("e", classify.merged_evidence(F.col("e1"), F.col("e2"), ("getter", "identity")))
    return df.select("p_partkey", "e.getter", "e.identity", F.array_join("e.evidence", ",").alias("evidence"), F.array_join("e.ambiguities", ",").alias("ambiguities"), classify.at_least(F.col("e.getter"), "HIGH").alias("firm"))


_SUSPICIOUS = (rule("FORMATTING", shape=r"(?s).*[=\n\r].*|(?s)\s.*|(?s).*\s"), rule("DUMP_ONLY", Test("getters", "is_", ("dump", "toString"), array=True, every=True)), rule("UNREGISTERED", Test("kind", "is_", "UNKNOWN"), Test("editable", "true", True)))
_REASONS = (rule("SAFETY", column="p_type", is_="PROMO"), rule("KIND", Test("kind", "is_", ("SETTING", "NAME"), negated=True)), rule("TYPE", Test("p_size", "at_most", 10)))


@query(f"""WITH {_KEYS_SQL}, x AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'SETTING' ELSE kind END AS kind, key, p_type, p_size, p_size % 2 = 0 AS editable, CASE p_size % 4 WHEN 0 THEN 1 ELSE 0 END AS dumps FROM n),
    y AS (SELECT *, CASE WHEN contains(key, chr(10)) THEN 'FORMATTING' WHEN dumps = 1 THEN 'DUMP_ONLY' WHEN kind = 'OTHER' AND editable THEN 'UNREGISTERED' END AS suspicion FROM x),
    z AS (SELECT *, editable AND suspicion IS NULL AND kind <> 'SCREEN_PART' AS ok FROM y)
    SELECT p_partkey, kind, suspicion, CASE WHEN suspicion IS NULL THEN 'DIRECT' ELSE 'CATALOG_ONLY' END AS resolution, ok AS editable, CASE WHEN ok THEN NULL WHEN suspicion IS NOT NULL THEN 'SUSPICIOUS_DISCOVERY' WHEN p_type = 'PROMO' THEN 'SAFETY'
    WHEN kind NOT IN ('SETTING', 'NAME') THEN 'KIND' WHEN p_size <= 10 THEN 'TYPE' END AS editability_reason FROM z""")
def normalized_identifiers(spark, d):
    df = _keys(spark, d).withColumns({
        "occurrence_kinds": F.when(F.col("p_partkey") % 5 == 0, F.array(F.lit("SETTING"), F.lit("UNKNOWN"))).otherwise(F.array(F.lit("A"), F.lit("B"))),
        "editable": F.col("p_size") % 2 == 0, "resolution": F.lit("DIRECT"), "getters": F.when(F.col("p_size") % 4 == 0, F.array(F.lit("dump"), F.lit("toString"))).otherwise(F.array(F.lit("dump"), F.lit("get"))),
    })
    out = classify.normalized(df, KINDS, _SUSPICIOUS, (rule("x", column="kind", is_="SCREEN_PART"),), _REASONS)
    return out.select("p_partkey", F.when(F.col("kind") == "UNKNOWN", "OTHER").otherwise(F.col("kind")).alias("kind"), "suspicion", "resolution", "editable", "editability_reason")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN NULL WHEN p_type = 'PROMO' THEN 'SAFETY_POLICY' WHEN p_size < 10 THEN 'ENTITY' WHEN p_size < 15 THEN 'ENUM_DOMAIN' WHEN p_size < 20 THEN 'TYPE'
    WHEN p_size < 30 THEN 'MAPPING' ELSE 'NO_POINT' END AS reason FROM part""")
def editability_reason(spark, d):
    table_ = [
        rule(None, Test("editable", "true", True)), rule("SAFETY_POLICY", column="p_type", is_="PROMO"), rule("ENTITY", column="kind", not_is_="SETTING"), rule("ENUM_DOMAIN", column="value_type", is_="ENUM"),
        rule("TYPE", column="value_type", not_is_=("INT", "LONG")), rule("MAPPING", column="resolution", not_is_=("DIRECT", "REVIEWED")),
    ]
    size = F.col("p_size")
    df = table(spark, d, "part").withColumns({
        "editable": size % 2 == 0, "kind": F.when(size < 10, "TEXT").otherwise("SETTING"), "value_type": rules.first_match([(size < 15, "ENUM"), (size < 20, "BYTES")], "INT"), "resolution": F.when(size < 30, "AMBIGUOUS").otherwise("DIRECT"),
    })
    return df.select("p_partkey", classify.classify(table_, "NO_POINT").alias("reason"))


@query("""SELECT p_partkey, CASE WHEN contains(p_name, 'cold') THEN 'CHECK' WHEN p_size % 5 = 0 THEN 'LOGS' WHEN contains(lower(p_name), 'ring') THEN 'VIEW' WHEN p_size <= 8 THEN 'THIN' ELSE 'PLAIN' END AS category FROM part""")
def method_category(spark, d):
    calls = F.array(F.lit("La/B;->c()V"), F.when(F.col("p_size") % 5 == 0, "Lx/Journal;->write(I)V").otherwise("Lx/Y;->z()V"))
    df = table(spark, d, "part").withColumns({"class_name": F.concat(F.lit("Lcom/"), F.initcap("p_name"), F.lit(";")), "calls": calls})
    return df.select("p_partkey", classify.classify([
        rule("CHECK", column="class_name", has_folded="cold"), rule("LOGS", Test("calls", "has", "Lx/Journal;", array=True)), rule("VIEW", column="class_name", has_folded=("ring", "window")), rule("THIN", column="p_size", at_most=8),
    ], "PLAIN").alias("category"))


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'old') AND p_size % 2 = 0")
def capability_names(spark, d):
    name = F.concat(F.lit("is"), F.initcap("p_name"), F.when(F.col("p_size") % 2 == 0, "()Z").otherwise("()I"))
    return table(spark, d, "part").where(classify.capability_name(name, "OLD")).select("p_partkey")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN 'Lp/' || p_partkey || ';' END AS owner, CASE WHEN p_size % 3 > 0 THEN 'get' END AS name, CASE WHEN p_size % 3 > 0 THEN '(I)' || CASE WHEN p_size % 3 = 1 THEN 'Z' ELSE 'J' END END AS descriptor FROM part""")
def role_references(spark, d):
    ref = F.concat(F.lit("Lp/"), "p_partkey", rules.first_match([(F.col("p_size") % 3 == 1, ";->get(I)Z"), (F.col("p_size") % 3 == 2, ";->get(I)J")], ";get(I)Z"))
    return table(spark, d, "part").select("p_partkey", requests.role_reference(ref).alias("r")).select("p_partkey", "r.owner", "r.name", "r.descriptor")


@query("""SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_id END AS millis, CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'B' END AS route FROM events""")
def request_routes(spark, d):
    tail = rules.first_match([(F.col("event_type") == "click", "|A"), (F.col("event_type") == "view", "|B"), (F.col("event_type") == "error", "|C"), (F.col("event_type") == "signup", "|A\n")], "")
    token = F.concat(F.lit("v1|"), F.col("event_id").cast("string"), F.lit("|01234567-89ab-cdef-0123-456789abcdef"), tail)
    return table(spark, d, "events").select("event_id", requests.request_millis(token, ("A", "B")).alias("millis"), requests.request_route(token, ("A", "B")).alias("route"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'ABSENT' WHEN p_size % 5 = 1 THEN 'INVALID' WHEN p_size % 5 = 2 THEN 'BUILD_MISMATCH' WHEN p_size % 5 = 3 THEN 'TARGET_MISMATCH' ELSE 'ACTIVE' END AS status FROM part""")
def decision_status(spark, d):
    m = F.col("p_size") % 5
    text = F.concat(F.lit('{"build":"'), F.when(m == 2, "old").otherwise("b1"), F.lit('","target":"'), F.when(m == 3, "x").otherwise(F.col("p_brand")), F.lit('"}'))
    record = rules.first_match([(m == 0, None), (m == 1, "not json")], text)
    return table(spark, d, "part").select("p_partkey", requests.decision_status(record, {"build": F.lit("b1"), "target": F.col("p_brand")}).alias("status"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'PRESSED' WHEN 'view' THEN 'SEEN' ELSE 'OTHER' END AS label FROM events""")
def status_labels(spark, d):
    return table(spark, d, "events").select("event_id", classify.looked_up(F.col("event_type"), {"click": "PRESSED", "view": "SEEN"}, "OTHER").alias("label"))


@query("""SELECT p_partkey, '[["brand","' || p_brand || '"],["size","' || p_size || '"]]' AS pairs, p_brand AS from_pairs, p_brand AS from_object FROM part""")
def json_maps(spark, d):
    made = codecs.pairs_of(F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand")))
    either = lambda text: F.element_at(codecs.map_of(text), "brand")
    df = table(spark, d, "part").withColumns({"pairs": made, "object": F.to_json(F.struct(F.col("p_brand").alias("brand")))})
    return df.select("p_partkey", "pairs", either(F.col("pairs")).alias("from_pairs"), either(F.col("object")).alias("from_object"))


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name || CASE WHEN p_size % 2 = 0 THEN '_%' ELSE 'x%' END), 'd_%')")
def literal_like(spark, d):
    name = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.when(F.col("p_size") % 2 == 0, "_%").otherwise("x%"))
    whole = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, "_%").otherwise("x%"))
    return table(spark, d, "part").where(text.contains_ignoring_case(whole, "D_%") & name.isNotNull()).select("p_partkey")


@query("""SELECT p_partkey, '(' || p_brand || 'I)' || p_type AS call, p_type AS field, 'static (' || p_brand || 'I)' || p_type AS method, CASE WHEN p_size % 2 = 0 THEN 'Ljava/' || p_size END AS anchor,
    CASE WHEN p_size % 3 = 0 THEN 'java.' || p_size ELSE 'Ljava/' || p_size END AS dotted FROM part""")
def member_shapes(spark, d):
    owner = F.concat(F.when(F.col("p_size") % 2 == 0, "Ljava/").otherwise("Lq/"), "p_size")
    member = F.concat(owner, F.lit("->m("), "p_brand", F.lit("I)"), "p_type")
    cls = F.concat(F.lit("Ljava/"), "p_size", F.when(F.col("p_size") % 3 == 0, ";").otherwise(""))
    return table(spark, d, "part").select(
        "p_partkey", text.call_shape(member).alias("call"), text.field_shape(F.concat(owner, F.lit("->f:"), "p_type")).alias("field"), text.method_shape(F.col("p_type"), F.array("p_brand", F.lit("I")), F.lit(True)).alias("method"),
        text.stable_owner(member, ("Ljava/", "Landroid/")).alias("anchor"), text.dotted_class(cls).alias("dotted"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN CAST(p_size AS VARCHAR) END AS value, CASE WHEN p_size % 3 = 0 THEN 'LITERAL' WHEN p_size % 3 = 1 THEN 'ARGUMENT' END AS source FROM part""")
def default_precedence(spark, d):
    m = F.col("p_size") % 3
    found = codecs.first_default({"LITERAL": F.when(m == 0, F.col("p_brand")), "ARGUMENT": F.when(m <= 1, F.col("p_size").cast("string")), "NEARBY": F.lit(None)})
    return table(spark, d, "part").select("p_partkey", found.alias("f")).select("p_partkey", "f.value", "f.source")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'INT' ELSE 'UNKNOWN' END AS value_type, p_size > 20 AS editable, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) END AS compiled_default, p_brand AS brand FROM part""")
def row_decode(spark, d):
    stored = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "INT").otherwise("BOGUS").alias("value_type"), (F.col("p_size") > 20).cast("int").alias("editable"), F.col("p_size").cast("string").alias("compiled_default"),
        F.when(F.col("p_size") % 4 == 0, F.to_json(F.struct(F.col("p_brand").alias("brand")))).otherwise(codecs.pairs_of(F.create_map(F.lit("brand"), F.col("p_brand")))).alias("metadata"))
    rows = codecs.decoded_rows(stored, {"value_type": (codecs.TYPES, "UNKNOWN")}, ("editable",), ("metadata",), ("compiled_default", "value_type"))
    return rows.select("p_partkey", "value_type", "editable", "compiled_default", F.element_at("metadata", "brand").alias("brand"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN NULL ELSE p_name END AS text FROM part")
def base64_payloads(spark, d):
    plain = F.base64(F.col("p_name").cast("binary"))
    m = F.col("p_size") % 4
    coded = rules.first_match([(m == 0, plain), (m == 1, F.regexp_replace(plain, "=+$", "")), (m == 2, F.translate(plain, "+/", "-_"))], F.concat(plain, F.lit("\n")))
    return table(spark, d, "part").select("p_partkey", texts.base64_payload(coded).cast("string").alias("text"))


@query("""WITH s AS (SELECT s_suppkey, s_suppkey % 4 AS m FROM supplier) SELECT s_suppkey, 1 AS number, 'REPEATED' AS error FROM s WHERE m = 1 UNION ALL SELECT s_suppkey, 2, 'WIRE_TYPE' FROM s WHERE m = 2 UNION ALL SELECT s_suppkey, 9, 'UNKNOWN_FIELD' FROM s WHERE m = 3""")
def wire_schema_errors(spark, d):
    m = F.col("s_suppkey") % 4
    data = rules.first_match([(m == 0, F.unhex(F.lit("08011203616263"))), (m == 1, F.unhex(F.lit("080108021203616263"))), (m == 2, F.unhex(F.lit("08011007")))], F.unhex(F.lit("08011203616263480A")))
    rows = wire.decode(table(spark, d, "supplier").withColumn("payload", data), "s_suppkey", "payload")
    schema = spark.createDataFrame([(1, "VARINT", False), (2, "LENGTH_DELIMITED", True)], "number int, wire_type string, repeated boolean")
    return wire.schema_errors(rows, schema, "s_suppkey")


@query("SELECT s_suppkey, '1' AS path, 2 AS n FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, '2/1', 2 FROM supplier WHERE s_suppkey % 3 = 1")
def wire_repeats(spark, d):
    m = F.col("s_suppkey") % 3
    data = rules.first_match([(m == 0, F.unhex(F.lit("08010802"))), (m == 1, F.unhex(F.lit("120408010802")))], F.unhex(F.lit("0801")))
    return wire.repeated_fields(wire.decode(table(spark, d, "supplier").withColumn("payload", data), "s_suppkey", "payload"), "s_suppkey")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 < 2 THEN 2 END AS n_fields, s_suppkey % 2 = 1 OR s_suppkey % 3 = 2 AS editable FROM supplier""")
def wire_enriched(spark, d):
    payload = F.base64(F.unhex(F.lit("08011203616263")))
    df = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, "app_config_x").otherwise("plain").alias("key"), F.when(F.col("s_suppkey") % 3 == 2, "INT").when(F.col("s_suppkey") % 3 == 1, "BYTES").otherwise("STRING").alias("value_type"),
        F.lit(True).alias("editable"), payload.alias("value"))
    return wire.enriched(df, "s_suppkey", "key", "value_type", "value", ("config", "proto")).select("s_suppkey", "n_fields", "editable")


@query("SELECT 'name.' || c_custkey AS key, c_name AS value FROM customer WHERE c_custkey % 3 = 0")
def preference_snapshot(spark, d):
    rows = table(spark, d, "customer").select(F.concat(F.when(F.col("c_custkey") % 3 == 1, "other.").otherwise("name."), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("value"), F.when(F.col("c_custkey") % 3 == 2, "long").otherwise("string").alias("kind"))
    return texts.preferences(rows, "key", "value", "name.")


def _archives(spark, d):
    """(path, content): a zip archive for each nation, of its suppliers' files; those of region 4 are broken."""
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    files = rows.groupBy("n_nationkey", "n_regionkey").agg(F.array_sort(F.collect_list("s_name")).alias("names"))

    @F.pandas_udf("binary")
    def zipped(names: pd.Series, region: pd.Series) -> pd.Series:
        def one(items, r):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                for k, name in enumerate(items):
                    z.writestr(("res/" if k % 2 else "classes") + name + ".dex", name * 3)
            return b"no archive" if r == 4 else out.getvalue()

        return pd.Series([one(n, r) for n, r in zip(names, region, strict=True)])

    return files.select(F.concat(F.lit("a/"), F.col("n_nationkey").cast("string"), F.lit(".apk")).alias("path"), zipped("names", "n_regionkey").alias("content"))


_FILES_SQL = """f AS (SELECT 'a/' || n_nationkey || '.apk' AS archive, n_regionkey, s_name, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_name) - 1 AS k, count(*) OVER (PARTITION BY n_nationkey) AS n
    FROM supplier JOIN nation ON s_nationkey = n_nationkey), g AS (SELECT *, CASE WHEN k % 2 = 1 THEN 'res/' ELSE 'classes' END || s_name || '.dex' AS name FROM f)"""


@query(f"""WITH {_FILES_SQL} SELECT archive, CAST(k AS INT) AS ordinal, name, sha256(s_name || s_name || s_name) AS sha256, NULL AS error FROM g WHERE n_regionkey <> 4 UNION ALL SELECT DISTINCT archive, -1, '', NULL, 'BadZipFile' FROM g WHERE n_regionkey = 4""")
def archive_entries(spark, d):
    return archives.entries_of(_archives(spark, d)).select("archive", "ordinal", "name", "sha256", "error")


@query(f"""WITH {_FILES_SQL} SELECT archive, name, NULL AS error FROM g WHERE n_regionkey <> 4 AND n <= 3 UNION ALL SELECT DISTINCT archive, NULL, CASE WHEN n_regionkey = 4 THEN 'BadZipFile' ELSE 'limit' END FROM g WHERE n_regionkey = 4 OR n > 3""")
def archive_limits(spark, d):
    return archives.accepted(archives.entries_of(_archives(spark, d)), count=3).select("archive", "name", "error")


@query(f"WITH {_FILES_SQL} SELECT archive, name AS key, 'RESOURCE_NAME' AS namespace FROM g WHERE n_regionkey <> 4 AND k % 2 = 1")
def archive_resources(spark, d):
    return archives.resource_paths(archives.entries_of(_archives(spark, d), pattern="^res/"))


def _stored(files, folder):
    """Files (path, content) written into a shared folder, each under its last name."""
    from pyarrow import fs

    def write(parts):
        system, place = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(place, recursive=True)
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                with system.open_output_stream(f"{place}/{path.rpartition('/')[2]}") as out:
                    out.write(bytes(content))
            yield part[["path"]]

    files.mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()
    return folder


@query(f"""WITH {_FILES_SQL} SELECT archive, name AS member, CAST(3 * length(s_name) AS BIGINT) AS size, sha256(s_name || s_name || s_name) AS sha256, NULL AS error FROM g WHERE n_regionkey <> 4 AND k % 2 = 1""")
def archive_members(spark, d):
    """Members of the nations' archives under res/, by the data source; the condition is pushed into it."""
    spark.dataSource.register(reader.ArchiveSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    folder = _stored(_archives(spark, d), f"{shared_dir(spark)}/archives")
    rows = spark.read.format("archive").load(f"{folder}/*.apk").where(F.col("member").startswith("res/"))
    return rows.select(F.concat(F.lit("a/"), F.substring_index("path", "/", -1)).alias("archive"), "member", "size", F.sha2("content", 256).alias("sha256"), "error")


def _resource_table(kinds, keys, values, rows):
    """A resource table with one package: rows (type number from 1, key number, value number), and a value that only
    another language has for each odd key."""
    chunk = lambda kind, head, body=b"": struct.pack("<HHI", kind, 8 + len(head), 8 + len(head) + len(body)) + head + body

    def pool(strings):
        raw = [s.encode("utf-16-le") for s in strings]
        data = b"".join(struct.pack("<H", len(r) // 2) + r + b"\0\0" for r in raw)
        starts = [sum(len(r) + 4 for r in raw[:k]) for k in range(len(raw))]
        return chunk(1, struct.pack("<IIIII", len(strings), 0, 0, 28 + 4 * len(strings), 0), struct.pack(f"<{len(strings)}I", *starts) + data + b"\0" * (-len(data) % 4))

    def kind(number, own, language):
        entries = b"".join(struct.pack("<HHIHBBI", 8, 0, key, 8, 0, 3, value) for key, value in own)
        head = struct.pack("<BBHII", number, 0, 0, len(own), 48 + 4 * len(own)) + struct.pack("<I", 28) + language.ljust(24, b"\0")
        return chunk(0x201, head, struct.pack(f"<{len(own)}I", *range(0, 16 * len(own), 16)) + entries)

    body = pool(kinds) + pool(keys)
    for number in range(1, len(kinds) + 1):
        own = [(key, value) for n, key, value in rows if n == number]
        body += kind(number, [(key, 0) for key, _ in own if key % 2], b"\0\0\0\0de") + kind(number, own, b"")
    package = chunk(0x200, struct.pack("<I", 1) + b"\0" * 256 + struct.pack("<IIIII", 288, 0, 288 + len(pool(kinds)), 0, 0), body)
    texts_ = pool(values)
    return struct.pack("<HHII", 2, 12, 12 + len(texts_) + len(package), 1) + texts_ + package


@query("""SELECT 'n' || s_nationkey AS archive, (CASE WHEN s_acctbal < 3000 THEN 'low' ELSE 'high' END) || '/s' || s_suppkey AS key, 'STRING' AS kind, s_name AS value, CASE WHEN place % 2 = 1 THEN 2 ELSE 1 END AS n_configs
    FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS place FROM supplier)""")
def resource_entries(spark, d):
    """Each nation's suppliers as a binary resource table, read back entry by entry."""
    rows = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name", (F.col("s_acctbal") < 3000).alias("low")))).alias("r"))

    @F.pandas_udf("binary")
    def packed(groups: pd.Series) -> pd.Series:
        return pd.Series([_resource_table(["low", "high"], [f"s{r['s_suppkey']}" for r in g], [r["s_name"] for r in g], [(1 if r["low"] else 2, k, k) for k, r in enumerate(g)]) for g in groups])

    tables = rows.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("archive"), packed("r").alias("content"))
    return archives.resources(tables).withColumn("n_configs", F.col("n_configs").cast("int"))


@query("""SELECT s_nationkey, s_suppkey, CASE WHEN s_suppkey = lo THEN 'base' ELSE 'split-' || (row_number() OVER (PARTITION BY s_nationkey, s_suppkey = lo ORDER BY s_suppkey) - 1) END AS part
    FROM (SELECT *, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS lo FROM supplier)""")
def split_parts(spark, d):
    least = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("lo"))
    rows = table(spark, d, "supplier").join(least, "s_nationkey")
    return archives.split_names(rows, ["s_nationkey"], F.col("s_suppkey") == F.col("lo"), "s_suppkey").select("s_nationkey", "s_suppkey", "part")


@query("SELECT DISTINCT 'service/' || p_type AS key, 'MANIFEST_COMPONENT' AS namespace FROM part")
def manifest_components(spark, d):
    return archives.manifest_components(table(spark, d, "part").withColumn("family", F.lit("service")), "family", "p_type")


@query("""SELECT n_nationkey, s_name AS key, CASE WHEN s_suppkey % 2 = 0 THEN 'm' || s_nationkey ELSE 'z' END AS getter FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey < 3""")
def inventory_read(spark, d):
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    ids = F.array_sort(F.collect_list(F.struct(F.col("s_name").alias("key"), F.array((F.col("s_suppkey") % 2).cast("int")).alias("getters"))))
    methods = F.array(F.struct(F.concat(F.lit("m"), "n_nationkey").alias("method_name")), F.struct(F.lit("z").alias("method_name")))
    docs = rows.groupBy("n_nationkey", "n_regionkey").agg(ids.alias("identifiers")).select("n_nationkey", F.to_json(F.struct((F.col("n_regionkey") + 2).alias("schemaVersion"), F.col("n_nationkey").cast("string").alias("base_sha"), methods.alias("methods"), "identifiers")).alias("text"))
    parsed = docs.select(F.from_json("text", texts.INVENTORY).alias("d")).select("d.*")
    return texts.inventory_rows(parsed).select(F.col("base_sha").cast("int").alias("n_nationkey"), "key", F.col("getters")[0]["method_name"].alias("getter"))


@query("""WITH t AS (SELECT p_partkey, p_name || ' ' || p_type AS x FROM part), m AS (SELECT p_partkey, x, CASE WHEN contains(lower(x), 'steel') THEN 'steel' WHEN contains(lower(x), 'promo') THEN 'promo'
    WHEN regexp_matches(lower(x), '(^|[^a-z0-9])econ([^a-z0-9]|$)') THEN 'econ' WHEN regexp_matches(lower(x), '(^|[^a-z0-9])tin([^a-z0-9]|$)') THEN 'tin' END AS token FROM t)
    SELECT p_partkey, CASE WHEN token IS NOT NULL THEN 'token:' || token WHEN contains(lower(x), 'copper') THEN 'denied' END AS reason FROM m""")
def safety_policy(spark, d):
    name = F.concat_ws(" ", "p_name", "p_type")
    return table(spark, d, "part").select("p_partkey", classify.policy_reason(name, BLOCKED, ("econ", "tin"), "copper", ["an exact name"]).alias("reason"))


@query("SELECT p_partkey, 'override.' || substr(sha256(p_name), 1, 40) AS pref, 'name.' || substr(sha256(p_name), 1, 40) AS name_key, true AS managed FROM part")
def preference_key(spark, d):
    df = table(spark, d, "part").withColumn("pref", codecs.preference_key(F.col("p_name")))
    return df.select("p_partkey", "pref", codecs.name_key(F.col("pref")).alias("name_key"), codecs.managed_key(F.col("pref")).alias("managed"))


@query("""SELECT s_nationkey, sha256('versionCode=' || s_nationkey || chr(10) || string_agg(s_name || '=' || sha256(CAST(s_suppkey AS VARCHAR)), chr(10) ORDER BY s_name, CAST(s_suppkey AS VARCHAR))) AS fingerprint
    FROM supplier GROUP BY s_nationkey""")
def build_fingerprint(spark, d):
    parts = table(spark, d, "supplier").select("s_nationkey", F.col("s_nationkey").alias("version"), "s_name", F.sha2(F.col("s_suppkey").cast("string").cast("binary"), 256).alias("sha"), F.col("s_suppkey").cast("string").alias("path"))
    return digests.build_fingerprint(parts, ["s_nationkey"], "version", "s_name", "sha", "path")


@query("""SELECT quality, sha256(unhex(string_agg(printf('%08x', strlen(CAST(doc_id AS VARCHAR))) || lower(hex(CAST(doc_id AS VARCHAR))) || printf('%08x', strlen('q' || toxic)) || lower(hex('q' || toxic)), '' ORDER BY CAST(doc_id AS VARCHAR)))) AS digest FROM labels GROUP BY quality""")
def framed_digest(spark, d):
    df = table(spark, d, "labels").select("quality", F.col("doc_id").cast("string").alias("k"), F.concat(F.lit("q"), "toxic").alias("v"))
    return digests.framed_digest(df, ["quality"], "k", "v")


@query("SELECT p_brand, sha256(string_agg(DISTINCT p_type, chr(10) ORDER BY p_type)) AS digest FROM part GROUP BY p_brand")
def set_digest(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(digests.set_digest("p_type").alias("digest"))


_RAW = "CASE WHEN c_custkey % 6 = 0 THEN 'BOOLEAN:true' WHEN c_custkey % 6 = 1 THEN 'INT:' || CAST(c_custkey * 3000000 AS VARCHAR) WHEN c_custkey % 6 = 2 THEN 'LONG:' || c_name WHEN c_custkey % 6 = 3 THEN 'STRING:a:' || c_name WHEN c_custkey % 6 = 4 THEN 'OTHER:1' ELSE 'BOOLEAN:True' END"


@query(f"""WITH r AS (SELECT c_custkey, {_RAW} AS raw FROM customer) SELECT c_custkey, CASE WHEN raw LIKE 'OTHER%' THEN NULL ELSE split_part(raw, ':', 1) END AS kind,
    CASE WHEN raw LIKE 'STRING:%' THEN substr(raw, 8) WHEN raw = 'BOOLEAN:true' THEN 'true' WHEN raw LIKE 'INT:%' AND c_custkey * 3000000 <= 2147483647 THEN substr(raw, 5) END AS value FROM r""")
def typed_override_validate(spark, d):
    df = table(spark, d, "customer").select("c_custkey", F.expr(_RAW.replace("VARCHAR", "STRING")).alias("raw"))
    return df.select("c_custkey", codecs.stored_type(F.col("raw")).alias("kind"), codecs.stored_value(F.col("raw")).alias("value"))


@query("SELECT s_suppkey, s_suppkey * 3 BETWEEN -128 AND 127 AS b, s_suppkey * 1000 BETWEEN -32768 AND 32767 AS s, s_suppkey * 1000 BETWEEN 0 AND 65535 AS c FROM supplier")
def narrow_ranges(spark, d):
    fit = lambda x, desc: codecs.fits_descriptor(F.lit("INT"), F.lit(desc), (F.col("s_suppkey") * x).cast("string"))
    return table(spark, d, "supplier").select("s_suppkey", fit(3, "()B").alias("b"), fit(1000, "()S").alias("s"), fit(1000, "()C").alias("c"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'false' END AS value FROM supplier")
def default_normalize(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", codecs.normalized_default(F.when(F.col("s_suppkey") % 2 == 0, "1").otherwise("0"), F.lit("BOOLEAN")).alias("value"))


@query()
def default_bits(spark, d):
    bits = F.xxhash64("s_suppkey").cast("string")
    return table(spark, d, "supplier").select("s_suppkey", codecs.default_from_bits(bits, F.lit("DOUBLE"), F.lit("BITS"), ("BITS",)).alias("value"))


@query("SELECT o_orderkey, CASE WHEN min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) END AS flag FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def singleton_type(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return table(spark, d, "orders").join(lines, "o_orderkey").groupBy("o_orderkey").agg(rules.single_or_null("l_returnflag").alias("flag"))


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN CAST(event_id * 10 AS BIGINT) END AS millis FROM events""")
def request_parse(spark, d):
    token = F.concat(F.when(F.col("event_type") == "click", "v1|").otherwise("v2|"), (F.col("event_id") * 10).cast("string"), F.lit("|01234567-89ab-cdef-0123-456789abcdef"))
    return table(spark, d, "events").select("event_id", requests.request_millis(token).alias("millis"))


@query("SELECT p_partkey, 'com.acme.' || p_partkey AS dotted, '(I)Z' AS shape, 'Lcom/acme/' || p_partkey || ';' AS owner FROM part")
def member_names(spark, d):
    name = F.concat(F.lit("Lcom/acme/"), "p_partkey", F.lit(";"))
    call = F.concat(name, F.lit("->get(I)Z"))
    return table(spark, d, "part").select("p_partkey", text.dotted_class(name).alias("dotted"), text.call_shape(call).alias("shape"), text.owner(call).alias("owner"))


@query(f"""WITH {_KEYS_SQL}, c AS (SELECT p_partkey, regexp_replace(regexp_replace(key, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g') AS cut FROM n)
    SELECT p_partkey, array_to_string(list_filter(string_split_regex(lower(cut), '[^a-z0-9]+'), lambda x: x <> ''), ' ') AS words FROM c""")
def name_words(spark, d):
    return _keys(spark, d).select("p_partkey", F.array_join(text.words_of(F.col("key")), " ").alias("words"))


@query("""WITH f AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([A-Za-z]+)', 1)) AS flag FROM pages) SELECT flag, count(*) AS n, CASE WHEN count(*) = 1 THEN 'UNIQUE' ELSE 'AMBIGUOUS' END AS status FROM f GROUP BY flag""")
def html_flags(spark, d):
    found = table(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="/([A-Za-z]+)'), F.lit(1))).alias("flag"))
    return found.groupBy("flag").agg(F.count("*").alias("n"), F.when(F.count("*") == 1, "UNIQUE").otherwise("AMBIGUOUS").alias("status"))


@query("""SELECT 'Flag' || p_size || '__on' AS flag, min('Lp/C' || p_partkey || ';') AS class_name, 'get' || p_size AS method, CASE WHEN count(*) = 1 THEN 'UNIQUE' ELSE 'AMBIGUOUS' END AS status FROM part GROUP BY p_size""")
def smali_profile(spark, d):
    body = F.concat(F.lit(".class public Lp/C"), "p_partkey", F.lit(";\n.method public get"), "p_size", F.lit('()Z\n const-string v0, "Flag'), "p_size", F.lit('__on"\n.end method\n'))
    return texts.flags_of(table(spark, d, "part").select(F.col("p_partkey").alias("file"), body.alias("value")), "value", "file")


@query("SELECT s_suppkey, '1' AS path, 'VARINT' AS wire_type, CAST(s_suppkey AS VARCHAR) AS value FROM supplier UNION ALL SELECT s_suppkey, '2', 'LENGTH_DELIMITED', s_name FROM supplier")
def protobuf_wire(spark, d):
    name = F.col("s_name").cast("binary")
    size = F.unhex(F.lpad(F.hex(F.octet_length("s_name")), 2, "0"))
    septet = lambda k, more: F.unhex(F.lpad(F.hex(F.shiftright("s_suppkey", 7 * k).bitwiseAND(127) + 128 * more), 2, "0"))
    payload = F.concat(F.unhex(F.lit("08")), *[septet(k, int(k < 4)) for k in range(5)], F.unhex(F.lit("12")), size, name)
    return wire.decode(table(spark, d, "supplier").withColumn("payload", payload), "s_suppkey", "payload").select("s_suppkey", "path", "wire_type", "value")


@query("SELECT event_id, event_type AS name FROM events WHERE event_type <> 'error'")
def event_lines(spark, d):
    line = texts.event_line("LOG ", F.create_map(F.lit("event"), F.col("event_type"), F.lit("id"), F.col("event_id").cast("string")))
    lines = table(spark, d, "events").select(F.when(F.col("event_type") == "error", F.lit("noise")).otherwise(line).alias("value"))
    got = texts.events(lines, "LOG ")
    return got.select(F.element_at("fields", "id").cast("long").alias("event_id"), "name")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'INT:' || p_size WHEN p_size % 3 = 1 THEN 'STRING:' || p_name || ':x' ELSE 'BOOLEAN:maybe' END AS raw, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS VARCHAR) WHEN p_size % 3 = 1 THEN p_name || ':x' END AS value,
    'name.' || sha256(p_name)[:40] AS name_key, 'override.' || sha256(p_name)[:40] AS value_key FROM part""")
def value_round_trip(spark, d):
    """Values written as TYPE:value and read back, the value's key from its name's."""
    size = F.col("p_size") % 3
    kind = F.when(size == 0, "INT").when(size == 1, "STRING").otherwise("BOOLEAN")
    value = F.when(size == 0, F.col("p_size").cast("string")).when(size == 1, F.concat("p_name", F.lit(":x"))).otherwise("maybe")
    raw = codecs.serialize(kind, value)
    name = codecs.name_key(codecs.preference_key(F.col("p_name")))
    return table(spark, d, "part").select("p_partkey", raw.alias("raw"), codecs.stored_value(raw).alias("value"), name.alias("name_key"), codecs.value_key(name).alias("value_key"))


@query("SELECT 'k' || p_partkey AS key, p_type AS type, CAST(p_size AS VARCHAR) AS default_value, 'g' || p_brand AS getter, CAST(1 + p_size % 2 AS INT) AS n_getters FROM part")
def compatibility_fixture(spark, d):
    """A file of identifiers for each brand, written as JSON and read back with its nested getters."""
    getter = F.struct(F.concat(F.lit("g"), "p_brand").alias("name"), F.lit("()I").alias("descriptor"), F.array().cast("array<string>").alias("parameters"))
    entry = F.struct(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_type").alias("type"), F.col("p_size").cast("string").alias("compiledDefault"), F.array_repeat(getter, (1 + F.col("p_size") % 2).cast("int")).alias("getters"))
    files = table(spark, d, "part").groupBy("p_brand").agg(F.to_json(F.collect_list(entry)).cast("binary").alias("content")).select(F.concat("p_brand", F.lit(".json")).alias("path"), "content")
    rows = texts.compatibility_rows(spark, _stored(files, f"{shared_dir(spark)}/fixtures"))
    return rows.select("key", "type", F.col("compiledDefault").alias("default_value"), F.col("getters")[0]["name"].alias("getter"), F.size("getters").alias("n_getters"))
