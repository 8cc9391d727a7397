"""Small vectors for rules whose edges the tables don't reach."""

import io
import json
import struct
import tempfile
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerwing.functions import classify, codecs, digests, requests, rules, text
from ledgerwing.operators import catalog, dataflow, graph, matching, overrides, ranking, retention
from ledgerwing.sources import archives, sinks, texts, wire
from ledgerwing.streaming import gates


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) and not isinstance(v, bool) else 'boolean' if isinstance(v, bool) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(("kind", "raw", "want"), [
    ("BOOLEAN", "true", "true"), ("BOOLEAN", "TRUE", None), ("INT", "2147483647", "2147483647"), ("INT", "2147483648", None), ("INT", " 5", None), ("INT", "+7", "7"), ("LONG", "-9223372036854775808", "-9223372036854775808"),
    ("LONG", "9223372036854775808", None), ("DOUBLE", "NaN", None), ("DOUBLE", "1e400", None), ("DOUBLE", "1.5", "1.5"), ("FLOAT", "1e39", None), ("STRING", "", ""), ("BYTES", "x", None),
    ("INT", "12\n", None), ("LONG", "12\n", None), ("DOUBLE", " 1.5 ", "1.5"), ("FLOAT", "2", "2.0"), ("DOUBLE", "1e3d", "1000.0"), ("BOOLEAN", "true\n", None), ("STRING", "a\n", "a\n"),
])
def test_values(spark, kind, raw, want):
    assert one(spark, codecs.validate(F.lit(kind), F.col("v")), v=raw) == want


def test_stored_values_split_at_the_first_colon(spark):
    assert one(spark, codecs.stored_value(F.col("v")), v="STRING:a:b:") == "a:b:"
    assert one(spark, codecs.stored_type(F.col("v")), v="STRING") is None
    assert one(spark, codecs.default_from_bits(F.col("v"), F.lit("DOUBLE"), F.lit("s"), ("s",)), v="4610334938539176755") == "1.7"
    assert one(spark, codecs.default_from_bits(F.col("v"), F.lit("FLOAT"), F.lit("s"), ("s",)), v="2139095040") == "2139095040"
    assert one(spark, codecs.default_from_bits(F.col("v"), F.lit("FLOAT"), F.lit("t"), ("s",)), v="1065353216") == "1065353216"
    for text_ in ('[["a","1"],["b","2"]]', '{"a":"1","b":"2"}'):
        assert one(spark, codecs.pairs_of(codecs.map_of(F.col("v"))), v=text_) == '[["a","1"],["b","2"]]'


@pytest.mark.parametrize(("name", "want"), [("WirelessLatency", None), ("useSSLNow", "ssl"), ("my_token_x", "token"), ("AuthTls", "auth"), ("plain", None), (None, None)])
def test_blocked_tokens(spark, name, want):
    col = classify.blocked_token(F.col("v"), ["auth", "ssl", "tls", "token"], ("ssl", "tls"))
    assert spark.createDataFrame([(name,)], "v string").select(col).first()[0] == want


def test_name_words(spark):
    assert one(spark, F.array_join(text.words_of(F.col("v")), " "), v="HTTPServer__maxIO_42Times") == "http server max io 42 times"
    assert one(spark, text.dotted_class(F.col("v")), v="La/b/C;") == "a.b.C" and one(spark, text.dotted_class(F.col("v")), v="La/b/C;\n") == "La/b/C;\n"
    assert one(spark, text.csv_field(F.col("v")), v='a"b') == '"a""b"'


def test_search_takes_text_literally(spark):
    df = spark.createDataFrame([("a_b", "x"), ("aXb", "x"), ("c%", "A_B")], "key string, kind string")
    q = catalog.CatalogQuery(text="A_b", text_columns=("key", "kind"))
    assert [r["key"] for r in catalog.search(df, q).orderBy("key").collect()] == ["a_b", "c%"]


def test_rule_tables(spark):
    rows = [("x.GO.y", "T", "VERB"), ("ab\n", "T", "OTHER"), ("AB", "T", "NAME"), ("cfg/a", "C", "SET"), ("zz", None, "OTHER"), ("useHTTPNow", "T", "WEB"), (None, None, "OTHER")]
    df = spark.createDataFrame(rows, "key string, n string, want string")
    table = [classify.rule("SET", column="n", is_="C"), classify.rule("VERB", has_folded=".go."), classify.rule("NAME", shape="[A-Z]+"), classify.rule("WEB", classify.Test("n", "is_", "T"), word="http"), classify.rule("NEVER", shape="[a-z]+", not_has="z")]
    assert all(r["got"] == r["want"] for r in df.select("want", classify.classify(table, "OTHER").alias("got")).collect())
    assert one(spark, rules.strongest([F.col("a"), F.col("b")], classify.STRENGTHS), a="LOW", b="PROVEN") == "PROVEN"
    lists = spark.createDataFrame([(["dump", "get"],), (["dump"],), ([],), (None,)], "g array<string>")
    every = lists.select(classify.Test("g", "is_", "dump", array=True, every=True).holds().alias("h"), classify.Test("g", "is_", "dump", array=True).holds().alias("s"))
    assert [tuple(r) for r in every.collect()] == [(False, True), (True, True), (False, False), (False, False)]


@pytest.mark.parametrize(("name", "want"), [("HTTP2Server", "http2 server"), ("HTTP2x", "http2x"), ("aB", "a b"), ("ABc", "a bc"), ("abc42Def", "abc42 def"), ("IO", "io"), ("", ""), ("--", ""), ("ÉaB", "a b"), ("A1B2", "a1 b2")])
def test_words(spark, name, want):
    assert one(spark, F.array_join(text.words_of(F.col("v")), " "), v=name) == want


def test_whole_texts_end_where_they_end(spark):
    """A line break at the end is part of a text."""
    uuid = "01234567-89ab-cdef-0123-456789abcdef"
    for tail, ok in (("", True), ("\n", False)):
        assert (one(spark, requests.request_millis(F.col("v")), v=f"v1|5|{uuid}{tail}") is not None) == ok
        assert (one(spark, requests.request_route(F.col("v"), ("A",)), v=f"v1|5|{uuid}|A{tail}") is not None) == ok
        assert one(spark, codecs.managed_key(F.col("v")), v="override." + "a" * 40 + tail) == ok
        assert (one(spark, texts.base64_payload(F.col("v")), v="YWJj" + tail) is not None) == ok


def test_empty_bundles_have_no_error(spark):
    rows = spark.createDataFrame([("a", {}, "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"), ("b", {}, "x")], "k string, entries map<string,string>, sha256 string")
    assert [tuple(r) for r in sinks.bundle_errors(rows, ["k"], ("override.",)).collect()] == [("b", "CHECKSUM")]


def test_large_inputs_are_rows(spark, monkeypatch):
    monkeypatch.setattr(wire, "MAX_BYTES", 3)
    df = spark.createDataFrame([(1, bytes([8, 1])), (2, bytes([8, 1, 16, 1])), (3, bytes([255])), (4, None)], "k int, p binary")
    got = {r["k"]: (r["wire_type"], r["size"]) for r in wire.decode(df, "k", "p").collect()}
    assert got[1] == ("VARINT", None) and got[3] == ("INVALID", 1) and 4 not in got and len(got) == 3


def test_hubs_are_dealt(spark, monkeypatch):
    from ledgerwing import stores

    monkeypatch.setattr(stores, "LIGHT", 5)
    edges = spark.createDataFrame([(0, k) for k in range(1, 60)] + [(200 + k, 201 + k) for k in range(30)] + [(59, 300)], "a long, b long")
    want = {k: 0 for k in [*range(60), 300]} | {200 + k: 200 for k in range(31)}
    assert {r["node"]: r["root"] for r in graph.components(edges).collect()} == want


def test_retention(spark):
    rows = [("installed", 10, "INSTALLED"), ("new", 20, "INSTALLED"), ("archive", 30, "IMPORTED"), ("old", 5, "LEGACY")]
    df = spark.createDataFrame(rows, "fingerprint string, generated_at long, origin string")
    names = lambda **k: [r["fingerprint"] for r in retention.retained(df, **k).orderBy("keep_rank").collect()]
    assert names(foreground="archive", pinned="new", limit=3) == ["new", "archive", "installed"]
    assert names(foreground="new", pinned="new", limit=3) == ["new", "installed", "archive"]
    assert names(foreground="old", pinned=None, limit=3) == ["old", "archive"]
    assert names(foreground="old", pinned="gone", limit=1) == ["old"]


def test_suspended_rows_claim_nothing(spark):
    df = spark.createDataFrame([("a", "t", "X"), ("b", "t", None), ("c", "t", None)], "k string, token string, reason string")
    assert {r["k"]: r["reason"] for r in overrides.claim(df, ["token"], "k").collect()} == {"a": "X", "b": None, "c": "SUSPENDED_TARGET_COLLISION"}


def test_assignment_needs_a_margin(spark):
    rows = [(1, "a", "x", 90), (1, "a", "y", 80), (1, "b", "x", 85), (1, "b", "y", 30), (2, "c", "z", 64), (3, "d", "u", 70), (3, "d", "v", 60)]
    df = spark.createDataFrame(rows, "component int, l_node string, r_node string, score int")
    got = {(r["l_node"], r["r_node"]): r["accepted"] for r in matching.assign(df).collect()}
    assert got == {("a", "y"): True, ("b", "x"): True, ("c", "z"): False, ("d", "u"): False}


def test_budgeted_search_counts_scheduled_nodes(spark):
    edges = spark.createDataFrame([(1, 2, 0), (1, 3, 1), (2, 4, 0), (3, 4, 0), (4, 1, 0), (4, 5, 1)], "src int, dst int, ordinal int")
    start = spark.createDataFrame([(1, 1)], "root int, node int")
    rows = graph.budgeted_search(start, edges, 4, 9).orderBy("place").collect()
    assert [(r["node"], r["depth"], r["exhausted"]) for r in rows] == [(1, 0, True), (2, 1, True), (3, 1, True), (4, 2, True)]
    assert not graph.budgeted_search(start, edges, 99, 9).first()["exhausted"]
    assert {r["node"]: r["root"] for r in graph.components(spark.createDataFrame([(5, 9), (9, 2), (7, 8)], "a int, b int")).collect()} == {2: 2, 5: 2, 9: 2, 7: 7, 8: 7}


def test_dataflow(spark):
    schema = "m int, idx int, op string, opcode string, register int, ref string, literal string"
    rows = [
        (1, 0, "INVOKE", "invoke", None, "A->b()Z", None), (1, 1, "MOVE_RESULT", "move-result", 0, None, None), (1, 2, "IF", "if-eqz", 0, None, None), (1, 3, "CONST", "const", 1, None, "7"), (1, 4, "RETURN", "return", 1, None, None),
        (2, 0, "INVOKE", "invoke", None, "A->c()Z", None), (2, 1, "MOVE_RESULT", "move-result", 0, None, None), (2, 2, "CONST", "const", 0, None, "1"), (2, 3, "RETURN", "return", 0, None, None),
        (3, 0, "CONST", "const", 4, None, "5"), (3, 1, "KEY", "const-string", 5, None, None), (3, 2, "INVOKE", "invoke", None, "r", None), (3, 3, "CONST", "const", 6, None, "9"),
    ]
    df = spark.createDataFrame(rows, schema)
    assert [tuple(r) for r in dataflow.branch_decisions(df, ["m"]).collect()] == [(1, 2, "A->b()Z", "if-eqz", "TRUE_FALLS_THROUGH")]
    assert {r["m"]: r["value"] for r in dataflow.returned_constant(df, ["m"]).collect()} == {1: "7", 2: "1"}
    assert [tuple(r) for r in dataflow.nearby_literal(df, ["m"]).collect()] == [(3, 1, "5")]


def test_registration_clobbered(spark):
    schema = "m int, idx int, op string, opcode string, reads array<int>, writes int, literal string, ref string"
    make = lambda m, *ops: [(m, k, op[0], *op) for k, op in enumerate(ops)]
    good = [("STRING", None, 0, "key", None), ("NUMERIC", None, 1, "3", None), ("MOVE", [0], 2, None, None), ("INVOKE", [2, 1], 3, None, None)]
    rows = make(1, *good, ("PUT", [3], None, None, "f")) + make(2, *good, ("OTHER", None, 3, None, None), ("PUT", [3], None, None, "g")) + make(3, ("STRING", None, 0, "key", None), ("PUT", [0], None, None, "h"))
    code = spark.createDataFrame([(m, k, op, opcode, *rest) for m, k, opcode, op, *rest in rows], schema)
    steps = code.selectExpr("m", "idx", "idx + 1 AS next")
    assert [tuple(r) for r in dataflow.registrations(code, steps, ["m"]).collect()] == [(1, "f", "key", "3", "RESOLVED")]


EVENTS = "p string, seq long, ts_ms long, event string, enabled boolean, eligible boolean, session int, live_enabled boolean"


def log(*events):
    return [("p", k, ts, name, True, ok, None, True) for k, (name, ts, ok) in enumerate(events)]


GATE_CASES = [
    (log(("READY", 1000, True), ("MEDIA", 1500, True), ("ACTIVITY", 2000, True), ("CONSUME", 4799, True), ("CONSUME", 4800, True), ("CONSUME", 4900, True)), ["WAIT", "DISPATCH", "ALREADY_ATTEMPTED"]),
    (log(("CONSUME", 1, True), ("READY", 10, True), ("CONSUME", 20, True), ("ACTIVITY", 30, True), ("ACTIVITY", 40, True), ("CONSUME", 4000, True)), ["NO_SESSION", "NO_ACTIVITY", "NAVIGATION_OBSERVED"]),
    (log(("READY", 0, True), ("ACTIVITY", 10, True), ("CONSUME", 12_001, True), ("END", 13_000, True), ("CONSUME", 14_000, True)), ["STALE", "NO_SESSION"]),
    (log(("READY", 0, True), ("ACTIVITY", 10, True), ("MEDIA", 20, False), ("CONSUME", 5000, True)), ["NO_ELIGIBLE_MEDIA"]),
]


@pytest.mark.parametrize(("rows", "want"), GATE_CASES)
def test_gate_in_batch(spark, rows, want):
    got = gates.gate_batch(spark.createDataFrame(rows, EVENTS), "p").orderBy("seq").collect()
    assert [r["decision"] for r in got] == want


def test_gate_windows_against_the_state_machine(spark):
    import random

    rng = random.Random(5)
    names = ["READY", "END", "ACTIVITY", "MEDIA", "NAVIGATION", "MANUAL", "CONSUME", "CONSUME", "ACTIVITY", "READY"]
    rows = [(f"p{rng.randint(0, 9)}", k, k * rng.choice([700, 900]), rng.choice(names), rng.random() < 0.8, rng.random() < 0.7, rng.choice([None, None, 1, 2]), rng.random() < 0.9) for k in range(900)]
    df = spark.createDataFrame(rows, EVENTS)
    want = replayed(rows)
    got = [tuple(r)[:5] for r in gates.gate_batch(df, "p").collect()]
    assert sorted(got) == sorted(want) and len({w[-1] for w in want}) >= 8


def replayed(rows):
    """Decisions by looking back over a key's events at each attempt."""
    out = []
    for p in sorted({r[0] for r in rows}):
        own, since, number, is_open = sorted((r for r in rows if r[0] == p), key=lambda r: (r[2], r[1])), [], 0, False
        spent = False
        for r in own:
            if r[3] == "END" or (r[3] == "READY" and not is_open):
                number, is_open, since, spent = number + 1, r[3] == "READY", [r], False
            elif r[3] != "CONSUME":
                since.append(r)
            else:
                seen = [e for e in since if e[3] == "ACTIVITY"] if is_open else []
                media = [e[5] for e in since if e[3] == "MEDIA"]
                moved = any(e[3] == "MANUAL" or (e[3] in ("ACTIVITY", "NAVIGATION") and e[1] > seen[0][1]) for e in since) if seen else False
                consent = is_open and since[0][4] and r[7]
                if not is_open:
                    got = "NO_SESSION"
                elif r[6] is not None and r[6] != number:
                    got = "SESSION_CHANGED"
                elif not seen:
                    got = "NO_ACTIVITY"
                elif spent:
                    got = "ALREADY_ATTEMPTED"
                elif consent and r[2] - seen[0][2] < 2800:
                    got = "WAIT"
                else:
                    spent = True
                    late = not 0 <= r[2] - since[0][2] <= 12_000
                    got = "DISABLED" if not consent else "STALE" if late else "NAVIGATION_OBSERVED" if moved else "DISPATCH" if media and media[-1] else "NO_ELIGIBLE_MEDIA"
                out.append((p, r[1], r[2], number, got))
    return out


def test_gate_on_a_stream(spark):
    """Sessions settle without a further event of their own, over a restart, and as in batch."""
    import random

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(6)
    names = ["READY", "END", "ACTIVITY", "MEDIA", "NAVIGATION", "MANUAL", "CONSUME", "ACTIVITY", "READY"]
    rows = [(f"p{rng.randint(0, 3)}", k, k * 700, rng.choice(names), rng.random() < 0.8, rng.random() < 0.7, None, True) for k in range(60)]
    rows += [("quiet", 900, 100, "READY", True, True, None, True), ("quiet", 901, 150, "MEDIA", True, True, None, True), ("quiet", 902, 200, "ACTIVITY", True, True, None, True)]
    rng.shuffle(rows)
    parts = [sorted(rows, key=lambda r: r[2] + rng.randint(0, 3000))[k::1][i : i + 21] for k in [0] for i in range(0, len(rows), 21)]
    parts.append([("clock", 999, 400_000, "END", True, True, None, True)])  # only moves the watermark
    source, target, state = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))

    def run(files):
        for part in files:
            spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(EVENTS).parquet(source)
            q = gates.gate_stream(stream, "p", "60 seconds").writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start()
            q.awaitTermination()

    try:
        run(parts)  # each part is a query of its own, started from the checkpoint
        got = spark.read.parquet(target).collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    want = gates.gate_batch(gates.timed_attempts(spark.createDataFrame(rows, EVENTS), "p"), "p").collect()
    key = lambda rows_: sorted((r["p"], r["ts_ms"], r["seq"], r["session"], r["decision"], r["timed"]) for r in rows_)
    assert key(got) == key(want)
    assert ("quiet", 3000, 902, 1, "DISPATCH", True) in key(got)


def test_upserts_once(spark):
    """Batches that are repeated after a restart change nothing; the last row of a key stays."""
    from ledgerwing.sources.snapshots import Snapshots

    source, root, state = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))
    schema = "base_sha string, key string, seq long, v string"
    store = Snapshots(spark, root)
    for part in ([("b1", "x", 1, "old"), ("b1", "y", 2, "y")], [("b1", "x", 3, "new"), ("b1", "x", 4, "newest"), ("b2", "z", 5, "z")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        q = gates.upsert_sink(spark.readStream.schema(schema).parquet(source), store, "results", ["key"], state, "resolve", ["seq"]).trigger(availableNow=True).start()
        q.awaitTermination()
    rows = lambda: sorted((r["base_sha"], r["key"], r["v"]) for r in store.read("results").collect())
    assert rows() == [("b1", "x", "newest"), ("b1", "y", "y"), ("b2", "z", "z")]
    version = store.manifest().version
    again = spark.createDataFrame([("b1", "x", 1, "old")], schema)
    assert store.upsert("results", again, ["key"], "resolve", 1) == version and rows()[0] == ("b1", "x", "newest")


def test_snapshots_change_as_one(spark, monkeypatch):
    from ledgerwing.sources import snapshots

    store = snapshots.Snapshots(spark, tempfile.mkdtemp(prefix="spark-"))
    make = lambda *rows: spark.createDataFrame(list(rows), "base_sha string, key string, v int")
    tables = lambda b, v: {"builds": make((b, "b", v)), "identifiers": make((b, "k1", v), (b, "k2", v)), "getters": make((b, "k1", v))}
    for b, v in (("s 1/=", 1), ("s2", 2), ("s3", 3)):
        store.put(tables(b, v))
    first = store.manifest().version
    assert store.read("identifiers", build="s 1/=").count() == 2 and store.read("identifiers").count() == 6

    whole = snapshots.Snapshots._write

    def broken(self, table, rows, order):
        if table == "getters":
            raise OSError("disk")
        return whole(self, table, rows, order)

    monkeypatch.setattr(snapshots.Snapshots, "_write", broken)
    with pytest.raises(OSError):
        store.put(tables("s2", 9))
    monkeypatch.undo()
    assert store.manifest().version == first and {r["v"] for r in store.read("identifiers", build="s2").collect()} == {2}
    store.put(tables("s2", 9))
    assert {r["v"] for r in store.read("identifiers", build="s2").collect()} == {9} and {r["v"] for r in store.read("identifiers", first, "s2").collect()} == {2}
    store.prune(["s2"])
    assert [store.read(t).count() for t in ("builds", "identifiers", "getters")] == [1, 2, 1]

    other = snapshots.Snapshots(spark, store.root)  # a writer that comes between reading and claiming
    claim, meddled = snapshots.Snapshots._claim, []

    def between(build):
        def late(self, manifest):
            if not meddled:
                meddled.append(1)
                monkeypatch.undo()
                other.put(tables(build, 5))
            return claim(self, manifest)

        monkeypatch.setattr(snapshots.Snapshots, "_claim", late)

    between("s4")
    store.put(tables("s5", 5))
    assert {r["base_sha"] for r in store.read("builds").collect()} == {"s2", "s4", "s5"}
    meddled.clear()
    between("s2")
    with pytest.raises(snapshots.Conflict):
        store.put(tables("s2", 7))
    assert {r["v"] for r in store.read("identifiers", build="s2").collect()} == {5}
    with pytest.raises(ValueError):
        store.put({"builds": make(("s9", "b", 1)), "identifiers": make(("s8", "k", 1))})
    assert store.vacuum(1) and store.read("identifiers").count() == 6


def test_requests(spark):
    u = "01234567-89ab-cdef-0123-456789abcdef"
    rows = [(1, 100, f"v1|100|{u}"), (2, 110, f"v1|100|{u}"), (3, 120, "bad"), (4, 130, "bad"), (5, 20_000, f"v1|7000|{u}"), (6, 20_001, f"v1|20000|{u}")]
    df = spark.createDataFrame(rows, "seq int, ts long, token string").withColumn("k", F.lit(1))
    got = gates.request_decisions(df, ["k"], ["seq"], "ts", "token", F.lit(True), F.lit(True)).orderBy("seq").collect()
    assert [r["decision"] for r in got] == ["ACCEPTED", "NO_CHANGE", "INVALID", "NO_CHANGE", "EXPIRED", "ALREADY_ATTEMPTED"]
    assert one(spark, requests.request_route(F.col("v"), ("A", "B")), v=f"v1|5|{u}|B") == "B"
    assert one(spark, requests.request_millis(F.col("v"), ("A", "B")), v=f"v1|5|{u}") is None
    assert one(spark, requests.decision_status(F.col("v"), {"key": F.lit("a"), "type": F.lit("INT")}), v='{"key":"a","type":"LONG"}') == "TYPE_MISMATCH"
    assert one(spark, requests.role_reference(F.col("v"))["name"], v="La/B;->go(I)V") == "go"


def test_sessions_open_once(spark):
    df = spark.createDataFrame([(k, e) for k, e in enumerate("xRRaExRE")], "seq int, e string").withColumn("k", F.lit(1))
    got = gates.sessions(df, ["k"], ["seq"], F.col("e") == "R", F.col("e") == "E").orderBy("seq").collect()
    assert [r["session_id"] for r in got] == [None, 1, 1, 1, 1, None, 2, 2]


def test_archives(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("classes.dex", b"d1")
        z.writestr("other.txt", b"no")
    with zipfile.ZipFile(f"{root}/a.zip", "w") as z:
        z.writestr("classes2.dex", b"d2")
        z.writestr("base.apk", inner.getvalue())
    with open(f"{root}/broken.zip", "wb") as f:
        f.write(b"not a zip")
    rows = archives.entries(spark, root, r"^classes\d*\.dex$")
    got = sorted((r["name"], r["size"], r["error"]) for r in rows.collect())
    assert got == [("", None, "BadZipFile"), ("base.apk!classes.dex", 2, None), ("classes2.dex", 2, None)]
    assert [r["within"] for r in archives.bounded(rows.where("error IS NULL"), total=3).orderBy("name").collect()] == [True, False]


def test_archive_source(spark):
    from ledgerwing.sources import reader

    root = tempfile.mkdtemp(prefix="spark-")
    with zipfile.ZipFile(f"{root}/a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in (("res/x", b"x" * 5000), ("res/", b""), ("other", b"o"), ("big", b"b" * 90_000)):
            z.writestr(name, body)
    with zipfile.ZipFile(f"{root}/b.zip", "w") as z:
        z.writestr("res/y", b"yy")
        z.writestr("res/z", b"qrst")
    raw = bytearray(open(f"{root}/b.zip", "rb").read())
    raw[raw.index(b"qrst")] ^= 1
    open(f"{root}/b.zip", "wb").write(raw)
    open(f"{root}/c.zip", "wb").write(b"no archive")
    spark.dataSource.register(reader.ArchiveSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("archive").option("maxBytes", 50_000).option("partitionBytes", 10).load(f"{root}/*.zip")
    got = {(r["path"][-5:], r["member"]): (bytes(r["content"] or b""), r["error"]) for r in df.collect()}
    assert got == {("a.zip", "res/x"): (b"x" * 5000, None), ("a.zip", "other"): (b"o", None), ("a.zip", "big"): (b"", "TOO_LARGE"), ("b.zip", "res/y"): (b"yy", None), ("b.zip", "res/z"): (b"", "DAMAGED"), ("c.zip", None): (b"", "NOT_AN_ARCHIVE")}
    few = df.where("member LIKE 'res/%' AND size < 10")
    assert {r["member"] for r in few.collect()} == {"res/y", "res/z"} and df.where("member = 'other'").rdd.getNumPartitions() == 1 < df.rdd.getNumPartitions()


def test_trigram_search_equals_the_scan(spark):
    import random

    from ledgerwing.operators import textindex

    rng = random.Random(4)
    rows = [(k, "".join(rng.choice("abAB %_é") for _ in range(rng.randint(0, 9))) if k % 7 else None, rng.choice(["abc", "İx", ""])) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    path = tempfile.mkdtemp(prefix="spark-")
    textindex.write_index(df, path, "id", ("a", "b"))
    index = spark.read.parquet(path)
    for text in ("ab", "aba", "B %", "%_é", "bab ab", "", "zzz", "éÉ"):
        scan = catalog.search(df, catalog.CatalogQuery(text=text, text_columns=("a", "b"))) if text else df.where("a IS NOT NULL OR b IS NOT NULL")
        assert sorted(r["id"] for r in textindex.indexed_search(df, index, "id", ("a", "b"), text).collect()) == sorted(r["id"] for r in scan.collect()), text


def resource_table():
    def chunk(kind, head, body=b""):
        return struct.pack("<HHI", kind, 8 + len(head), 8 + len(head) + len(body)) + head + body

    def pool(*strings):
        data, places = b"", []
        for s in strings:
            places.append(len(data))
            data += bytes([len(s), len(s)]) + s.encode() + b"\0"
        data += b"\0" * (-len(data) % 4)
        return chunk(1, struct.pack("<IIIII", len(strings), 0, 0x100, 28 + 4 * len(strings), 0), struct.pack(f"<{len(strings)}I", *places) + data)

    entry = lambda key, kind, raw: struct.pack("<HHIHBBI", 8, 0, key, 8, 0, kind, raw)
    config = lambda lang: struct.pack("<I", 28) + bytes([lang]) + b"\0" * 23
    kind = lambda cfg, *es: chunk(0x201, struct.pack("<BBHII", 1, 0, 0, len(es), 20 + len(cfg) + 4 * len(es)) + cfg, struct.pack(f"<{len(es)}I", *(16 * k for k in range(len(es)))) + b"".join(es))
    types, keys = pool("bool"), pool("flag", "name")
    blank = b"\0" * 28
    body = types + keys + kind(config(1), entry(0, 0x12, 0)) + kind(blank, entry(0, 0x12, 1), entry(1, 0x03, 0))
    package = chunk(0x200, struct.pack("<I", 1) + b"\0" * 256 + struct.pack("<IIIII", 288, 0, 288 + len(types), 0, 0), body)
    return struct.pack("<HHII", 2, 12, 12 + len(pool("hi")) + len(package), 1) + pool("hi") + package


def test_resources(spark):
    df = spark.createDataFrame([("a", resource_table()), ("b", b"junk")], "archive string, content binary")
    got = sorted(tuple(r) for r in archives.resources(df).collect())
    assert got == [("a", "bool/flag", "BOOLEAN", "true", 2), ("a", "bool/name", "STRING", "hi", 1)]


def test_wire(spark):
    nested = b"\x08\x96\x01"
    rows = [(1, b"\x08\x05\x12\x02hi" + b"\x1a" + bytes([len(nested)]) + nested + b"\x08\x06"), (2, b"\x0b"), (3, b"\x12\x05hi"), (4, None), (5, b"\x09" + b"\x01" + b"\0" * 7)]
    df = wire.decode(spark.createDataFrame(rows, "k int, b binary"), "k", "b")
    got = [(r["k"], r["path"], r["wire_type"], r["value"]) for r in df.where("depth >= 0").collect()]
    assert got == [(1, "1", "VARINT", "5"), (1, "2", "LENGTH_DELIMITED", "hi"), (1, "3", "LENGTH_DELIMITED", None), (1, "3/1", "VARINT", "150"), (1, "1", "VARINT", "6"), (5, "1", "FIXED64", "1")]
    assert sorted((r["k"], r["wire_type"]) for r in df.where("depth < 0").collect()) == [(2, "INVALID"), (3, "INVALID")]
    assert [tuple(r) for r in wire.repeated_fields(df, "k").collect()] == [(1, "1", 2)]
    schema = spark.createDataFrame([(1, "VARINT", False), (2, "VARINT", False), (3, "LENGTH_DELIMITED", True)], "number int, wire_type string, repeated boolean")
    assert sorted(tuple(r) for r in wire.schema_errors(df.where("k = 1"), schema, "k").collect()) == [(1, 1, "REPEATED"), (1, 2, "WIRE_TYPE")]
    assert one(spark, F.hex(texts.base64_payload(F.col("v"))), v="AP_-") == "00FFFE"


def test_smali(spark):
    body = '.class public Lp/A;\n.method public a()Z\n const-string v0, "F__x"\n.end method\n.method b()I\n const-string v0, "F__y"\n.end method\n.method c()Z\n const-string v1, "F__z"\n const-string v1, "F__z"\n.end method\n'
    df = spark.createDataFrame([(body, "1"), ('.method a()Z\n const-string v0, "F__w"\n.end method\n', "2")], "value string, file string")
    assert sorted((r["flag"], r["method"], r["status"]) for r in texts.flags_of(df, "value", "file").collect()) == [("F__x", "a", "UNIQUE"), ("F__z", "c", "AMBIGUOUS")]


def test_publish_two_slots(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    assert sinks.current_slot(spark, root) is None
    assert [sinks.publish(spark.range(n), root, lambda df: df.count() > 0) for n in (1, 2)] == ["a", "b"]
    with pytest.raises(ValueError):
        sinks.publish(spark.range(0), root, lambda df: df.count() > 0)
    assert sinks.published(spark, root).count() == 2


def test_exports(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    df = spark.createDataFrame([(k, f'n"{k}') for k in range(511)], "k int, name string")
    sinks.write_csv(df, f"{root}/csv", ["k", "name"], ["k"])
    lines = [r["value"] for r in spark.read.text(f"{root}/csv/part=0-header").union(spark.read.text(f"{root}/csv/part=1-rows")).collect()]
    assert lines[0] == "k,name" and sorted(lines[1:])[0] == '"0","n""0"' and len(lines) == 512
    sinks.write_json_lines(df, f"{root}/json", ["k", "name"], ["k"])
    assert spark.read.json(f"{root}/json").count() == 511


def test_catalog_put_replaces_one_build(spark):
    root = tempfile.mkdtemp(prefix="spark-") + "/t"
    catalog.put(spark.createDataFrame([("a", "k1"), ("b", "k2")], "base_sha string, key string"), root)
    catalog.put(spark.createDataFrame([("a", "k3")], "base_sha string, key string"), root)
    assert sorted((r["base_sha"], r["key"]) for r in catalog.load(spark, root).collect()) == [("a", "k3"), ("b", "k2")]
    assert catalog.upgraded(catalog.load(spark, root, "b")).first()["kind"] == "UNKNOWN"


def test_inventory(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/i.json"
    method = {"dex": "classes.dex", "class_name": "La;", "method_name": "m", "descriptor": "()Z"}
    with open(path, "w") as f:
        json.dump({"schemaVersion": 3, "base_sha": "s", "methods": [method], "identifiers": [{"key": "k", "getters": [0]}, {"key": "l"}]}, f)
    rows = {r["key"]: r for r in texts.inventory(spark, path).collect()}
    assert rows["k"]["getters"][0]["method_name"] == "m" and rows["l"]["getters"] == [] and rows["l"]["editable"] is False


def test_build_fingerprint_tells_equal_names_apart(spark):
    df = spark.createDataFrame([("b", 1, "split", "h1", "p1"), ("b", 1, "split", "h2", "p2"), ("b", 1, "base", "h0", "p0")], "b string, version int, name string, sha string, path string")
    got = digests.build_fingerprint(df, ["b"], "version", "name", "sha", "path").first()["fingerprint"]
    import hashlib

    assert got == hashlib.sha256(b"versionCode=1\nbase=h0\nsplit=h1\nsplit#2=h2").hexdigest()


def test_once_and_dense(spark):
    df = spark.createDataFrame(pd.DataFrame({"k": [1, 1, 1], "v": ["b", "a", "b"], "o": [0, 1, 2]}))
    assert {r["v"]: r["dense_id"] for r in ranking.dense_ids(df, ["k"], "v", "o").collect()} == {"b": 0, "a": 1}


def test_assign_solves_large_components(spark):
    rows = [("ties", a, b, 70) for a in range(13) for b in range(100, 113)] + [("fit", 20 + k, 200 + k, 90) for k in range(12)] + [("two", 50, 300, 90), ("two", 51, 300, 70)]
    rows += [("long", 1000 + k, 5000 + k + j, 90 - 30 * j) for k in range(3000) for j in (0, 1)]
    got = matching.assign(spark.createDataFrame(rows, "component string, l_node long, r_node long, score int")).collect()
    by = {r["l_node"]: r for r in got}
    assert len(got) == len(by) == 13 + 12 + 2 + 3000
    assert all(by[a]["ambiguous"] and by[a]["score"] == 70 for a in range(13)) and len({by[a]["r_node"] for a in range(13)}) == 13
    assert all(by[20 + k]["accepted"] and by[20 + k]["r_node"] == 200 + k for k in range(12))
    assert by[50]["accepted"] and by[51]["ambiguous"] and by[51]["r_node"] is None
    assert all(by[1000 + k]["accepted"] and by[1000 + k]["r_node"] == 5000 + k for k in range(3000))


@pytest.mark.parametrize("whole", [False, True])
def test_assignment_by_brute_force(whole):
    """Totals and margins against all assignments, with and without everyone having a place."""
    import itertools
    import random

    from ledgerwing.operators.assignment import Assignment

    rng = random.Random(11)
    for _ in range(400):
        n, m = (k := rng.randint(1, 5), k) if whole else (rng.randint(1, 5), rng.randint(1, 5))
        weight = {(a, b): rng.randint(0, rng.choice([3, 9, 40])) for a in range(n) for b in range(m) if whole or rng.random() < 0.7}
        lift = 10_000 if whole else 0
        best = Assignment(n, m, [(a, b, w + lift) for (a, b), w in weight.items()])

        def total(barred=None):
            return max((sum(weight[a, b] for a, b in enumerate(p) if b is not None) for p in itertools.product(*[[b for b in [*range(m), *([] if whole else [None])] if b is None or (a, b) in weight and (a, b) != barred] for a in range(n)])  # noqa: B023
                        if len({b for b in p if b is not None}) == sum(b is not None for b in p)), default=float("-inf"))

        assert sum(weight[p] for p in best.pairs()) == total()
        for p, cost in best.margins(15).items():
            assert cost == min(15, total() - total(p))


def test_global_assignment_takes_all_parts(spark):
    from ledgerwing.plans import override_queries as oq

    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    keyed = {(r["old_id"], r["new_id"]): r["score"] for r in oq._candidates(parts, parts).collect()}
    every = oq._members(parts, "old").join(oq._members(parts, "new"), "p_brand").select("old_id", "new_id", matching.structural_score("old", "new").alias("score"))
    assert keyed == {(r["old_id"], r["new_id"]): r["score"] for r in every.where(f"score >= {matching.MIN_SCORE}").collect()}
    got = oq.global_assignment(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len({r["l_node"] for r in got}) == len({a for a, _ in keyed})
    taken = [r["r_node"] for r in got if r["r_node"] is not None]
    assert len(taken) == len(set(taken))


def test_searches_start_from_all_suppliers_over_all_lines(spark):
    from ledgerwing.plans import graph_queries as gq

    d = "/root/testdata/sf0.001"
    lines = {(r[0], r[1]) for r in spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_partkey").collect()}
    suppliers = {r[0] for r in spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey").collect()}
    rows = gq.targeted_search(spark, d).where("depth <= 1").collect()
    assert {r["root"] for r in rows if r["depth"] == 0} == suppliers
    assert {(r["root"], -1 - r["node"]) for r in rows if r["depth"] == 1} == lines
    near = {}
    for r in gq.budgeted_bfs(spark, d).where("depth = 1").collect():
        near.setdefault(r["root"], set()).add(-1 - r["node"])
    for s in suppliers:  # the first is the start, and parts come in order of -p_partkey
        assert near.get(s, set()) == set(sorted((p for q, p in lines if q == s), reverse=True)[:63])


def test_families_by_brute_force(spark):
    import itertools
    import random

    rng = random.Random(7)
    schema = "family string, owner string, tokens array<string>, incoming map<string,int>, outgoing map<string,int>, n_methods int"
    make = lambda f, side: [(f, f"{side}{k}", rng.sample("abcdef", 3), {x: rng.randint(1, 3) for x in rng.sample("uvw", 2)}, {x: rng.randint(1, 3) for x in rng.sample("xyz", 2)}, rng.randint(1, 4)) for k in range(4)]
    old, new = [r for f in "pq" for r in make(f, "o")], [r for f in "pq" for r in make(f, "n")]
    old += [("odd", "o1", ["a"], {}, {}, 1)]
    got = {(r["family"], r["l_owner"]): r for r in matching.assign_families(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect()}
    assert got["odd", "o1"]["r_owner"] is None and len(got) == 9

    def like(a, b):
        total = lambda x, y: sum(min(x.get(k, 0), y.get(k, 0)) for k in {*x, *y}) / max(1e-12, sum(max(x.get(k, 0), y.get(k, 0)) for k in {*x, *y}))
        tokens = len({*a[2]} & {*b[2]}) / len({*a[2]} | {*b[2]})
        return int(tokens * 35 + total(a[3], b[3]) * 40 + total(a[4], b[4]) * 25 + 1e-9) + (15 if abs(a[5] - b[5]) <= 1 else 0)

    for f in "pq":
        left, right = ([r for r in rows if r[0] == f] for rows in (old, new))
        orders = {p: sum(like(left[i], right[p[i]]) for i in range(4)) for p in itertools.permutations(range(4))}
        top = max(orders.values())
        picked = tuple(int(got[f, x[1]]["r_owner"][1:]) for x in left)
        assert orders[picked] == top
        for i, x in enumerate(left):
            rest = max(v for p, v in orders.items() if p[i] != picked[i])
            assert got[f, x[1]]["score"] == like(x, right[picked[i]]) and got[f, x[1]]["accepted"] == (top - rest >= matching.FAMILY_MARGIN)


def test_similar_sets_by_brute_force(spark):
    import random

    rng = random.Random(3)
    sets = {k: set(rng.sample(range(25), rng.randint(1, 8))) for k in range(80)} | {100: set()}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "owner int, tokens array<int>")
    for num, den in ((1, 2), (8, 10)):
        want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])}
        assert want and {(r["l"], r["r"]) for r in matching.similar_sets(df, num, den).collect()} == want


def test_control_flow(spark):
    """A loop, a merge of two keys, a move and a transformation on the way to a field."""
    schema = "m int, idx int, op string, opcode string, reads array<int>, writes int, ref string, literal string"
    rows = [
        (1, 0, "GET", "sget", None, 0, "A.x", None), (1, 1, "TRANSFORM", "int-to-long", [0], 1, None, None), (1, 2, "MOVE", "move", [1], 2, None, None), (1, 3, "PUT", "sput", [2], None, "B.y", None), (1, 4, "RETURN", "return", [2], None, None, None),
        (2, 0, "GET", "sget", None, 0, "A.x", None), (2, 1, "IF", "if-eqz", None, None, None, None), (2, 2, "GET", "sget", None, 0, "A.z", None), (2, 3, "RETURN", "return", [0], None, None, None), (2, 4, "PUT", "sput", [0], None, "B.y", None),
        (3, 0, "GET", "sget", None, 0, "A.x", None), (3, 1, "MOVE", "move", [0], 0, None, None), (3, 2, "IF", "goto", None, None, None, None), (3, 3, "RETURN", "return", [0], None, None, None),
    ]
    code = spark.createDataFrame(rows, schema)
    edges = spark.createDataFrame([(1, k, k + 1) for k in range(4)] + [(2, 0, 1), (2, 1, 2), (2, 1, 3), (2, 2, 3), (2, 0, 4)] + [(3, 0, 1), (3, 1, 2), (3, 2, 1), (3, 2, 3)], "m int, idx int, next int")
    assert {tuple(r) for r in dataflow.proven_returns(code, edges, ["m"]).collect()} == {(3, "A.x")}
    stored = {(r["m"], r["target"], r["source"]): (r["trail"], r["certain"]) for r in dataflow.stored_values(code, edges, ["m"], "GET").collect()}
    assert stored == {(1, "B.y", "A.x"): (["int-to-long"], True), (2, "B.y", "A.x"): ([], True)}


def test_invoke_outcomes(spark):
    from ledgerwing.plans.graph_queries import CALL_RULES

    schema = "m int, idx int, op string, opcode string, reads array<int>, writes int, ref string, literal string, receiver int"
    cases = [("IF", None, "BRANCHED"), ("APUT", None, "STORED_ARRAY_OR_COLLECTION"), ("INVOKE", 0, "USED_AS_RECEIVER"), ("INVOKE", None, "FORWARDED_ARGUMENT"), ("ODD", None, "UNSUPPORTED_OPCODE"), ("TRANSFORM", None, "TRANSFORMED")]
    rows = [r for m, (op, receiver, _) in enumerate(cases) for r in ((m, 0, "INVOKE", "i", None, 0, None, None, None), (m, 1, op, "o", [0], 1 if op == "TRANSFORM" else None, None, None, receiver))]
    rows += [(50, 0, "INVOKE", "i", None, None, None, None, None), (50, 1, "RETURN", "r", None, None, None, None, None), (51, 0, "INVOKE", "i", None, 0, None, None, None), (51, 1, "GET", "g", None, 0, None, None, None), (52, 0, "INVOKE", "i", None, 0, None, None, None), (52, 1, "NOP", "n", None, None, None, None, None)]
    code = spark.createDataFrame(rows, schema)
    edges = code.where("idx = 0").selectExpr("m", "idx", "1 AS next")
    got = {(r["m"], r["idx"]): r["outcome"] for r in dataflow.invoke_outcomes(code, edges, ["m"], CALL_RULES).collect()}
    assert all(got[m, 0] == want for m, (_, _, want) in enumerate(cases)), got
    assert got[50, 0] == "RESULT_NOT_CAPTURED" and got[51, 0] == "CAPTURED_THEN_OVERWRITTEN" and got[52, 0] == "CAPTURED_BUT_UNUSED"


def test_exports_need_an_unchanged_build(spark):
    root = tempfile.mkdtemp()
    seen = iter(["a", "b"])
    with pytest.raises(RuntimeError):
        sinks.export_unchanged(spark, f"{root}/x", lambda: next(seen), lambda p: spark.range(3).write.parquet(p))
    import os

    assert os.listdir(root) == []
    sinks.export_unchanged(spark, f"{root}/x", lambda: "a", lambda p: spark.range(3).write.parquet(p))
    assert os.listdir(root) == ["x"] and spark.read.parquet(f"{root}/x").count() == 3


def test_bits_against_the_standard_library(spark):
    import random

    rng = random.Random(2)
    values = [rng.uniform(-1e9, 1e9) for _ in range(50)]
    df = spark.createDataFrame([(str(struct.unpack("<q", struct.pack("<d", v))[0]), v) for v in values], "bits string, want double")
    got = df.select("want", codecs.default_from_bits(F.col("bits"), F.lit("DOUBLE"), F.lit("BITS"), ("BITS",)).cast("double").alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_layers_by_brute_force(spark):
    import hashlib

    edges = [(1, 2), (2, 3), (3, 4), (4, 1), (4, 5), (6, 7)]
    nodes = {k: f"t{k % 3}" for k in range(1, 8)}
    near = {k: {b for a, b in [*edges, *[(b, a) for a, b in edges]] if a == k} for k in nodes}
    got = {(r["node"], r["depth"]): r for r in matching.neighbourhood(spark.createDataFrame(list(nodes.items()), "node int, token string"), spark.createDataFrame(edges, "src int, dst int")).collect()}
    want = {}
    for k in nodes:
        seen, layer = {k}, {k}
        for depth in range(3):
            if layer:
                tokens = sorted({nodes[x] for x in layer})
                want[k, depth] = (len(layer), sum(len(near[x]) for x in layer), hashlib.sha256("\n".join(tokens).encode()).hexdigest(), set(tokens))
            layer = {y for x in layer for y in near[x]} - seen
            seen |= layer
    assert {k: (r["n_nodes"], r["n_edges"], r["digest"], set(r["tokens"])) for k, r in got.items()} == want
    layers = spark.createDataFrame([tuple(got[k]) for k in got], next(iter(got.values())).__fields__)
    for r in matching.layer_scores(layers, layers).collect():
        total = 0
        for depth, weight in matching.LAYER_WEIGHTS.items():
            a, b = want.get((r["l_node"], depth)), want.get((r["r_node"], depth))
            if a and b and a[3] & b[3]:
                total += int(weight * len(a[3] & b[3]) / len(a[3] | b[3])) + (3 if a[0] == b[0] else 0) + (2 if a[1] == b[1] else 0)
        assert r["score"] == min(200, total)
