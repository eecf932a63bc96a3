import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from reference_eval import truth

from weir import queries as Q
from weir.errors import AggregateUpdateRequiresOldRow, MissingImage, TruncateRequiresReset, UnknownTableId, WalParseError
from weir.model import Catalog, EventBuilder, TableDef, event_schema
from weir.operators import aggregate as A
from weir.operators.aggregate import aggregate_deltas, epochs, running_totals
from weir.operators.dispatch import affected, dispatch, notifications
from weir.operators.registry import Registry, Request
from weir.sources import pgoutput as P
from weir.sources.common import SEQ_STEP, message_of, typed_events
from weir.sources.json_formats import debezium, maxwell, wal2json_v1, wal2json_v2
from weir.store import Config, Store, load_config, merge_shards, save_config

PARCELS = TableDef(1, ("parcels", "public.parcels"), (("parcel_id", "L"), ("weight", "D"), ("distance", "D"), ("depot", "S")), ("parcel_id",))
NAMES = [n for n, _ in PARCELS.columns]


def row(*v):
    return dict(zip(NAMES, v, strict=True))


def frame(spark, events):
    return spark.createDataFrame(events, event_schema(PARCELS))


def golden_registry():
    r = Registry(Catalog([PARCELS]))
    for c, w in enumerate(["weight >= 12.5", "depot LIKE 'north%'", "distance < 300 AND weight < 4", "parcel_id IN (70, 71)"], 1):
        r.register(Request(c, f"SELECT * FROM parcels WHERE {w}"))
    return r


def test_golden_scenario(spark):
    b = lambda n: EventBuilder(PARCELS, n)
    events = [
        b(11).insert().new(row(70, 12.5, 900.0, "north-2")).build(),
        b(12).insert().new(row(80, 3.0, 299.0, "south")).build(),
        b(13).update().old(row(70, 12.5, 900.0, "north-2")).new(row(70, 13.0, 900.0, "north-2")).changed(["weight"]).build(),
        b(14).update().old(row(80, 3.0, 299.0, "south")).new(row(80, 3.0, 299.0, "northern")).changed(["depot"]).build(),
        b(15).update().old(row(80, 3.0, 299.0, "northern")).new(row(80, 3.0, 301.0, "northern")).changed(["distance"]).build(),
        b(16).delete().old(row(70, 13.0, 900.0, "north-2")).build(),
        b(17).truncate().build(),
        b(18).update().new(row(71, 50.0, 1.0, None)).build(),
        b(19).update().old({"parcel_id": 80}).new(row(80, 1.0, 10.0, "north")).build(),
    ]
    d = dispatch(frame(spark, events), golden_registry(), 1)
    got = {r["seq"]: (r["inserted"], r["deleted"], r["updated"]) for r in notifications(d).collect()}
    assert got == {
        11: ([1, 2, 4], [], []),
        12: ([3], [], []),
        13: ([], [], [1]),
        14: ([2], [], []),
        15: ([], [3], []),
        16: ([], [1, 2, 4], []),
        17: ([], [1, 2, 3, 4], []),
        18: ([], [], [1, 4]),
        19: ([], [], [2, 3]),
    }
    assert {tuple(r) for r in affected(d).where("seq IN (13, 15)").collect()} == {(13, 1)}


def test_templates_joins_and_single_filters_agree_with_the_evaluator(spark):
    rnd = random.Random(3)
    wheres = [f"parcel_id = {k}" for k in range(20)] + [f"weight BETWEEN {k} AND {k + 3}" for k in range(20)] + [f"parcel_id = {k} OR depot = 'l{k % 4}'" for k in range(20)] + [f"distance > {k} AND depot = 'l{k % 3}'" for k in range(10)] + ["depot IS NULL", "NOT (weight < 10)"]
    r = Registry(Catalog([PARCELS]))
    for c, w in enumerate(wheres):
        r.register(Request(c, f"SELECT * FROM parcels WHERE {w}"))
    rows = [row(rnd.randrange(22), rnd.choice([None, rnd.random() * 25]), rnd.random() * 12, rnd.choice([None, "l0", "l1", "l2", "l3"])) for _ in range(60)]
    olds, news = rows[:30], rows[30:]
    events = [EventBuilder(PARCELS, n).update().old(o).new(w).build() for n, (o, w) in enumerate(zip(olds, news, strict=True))]
    got = {tuple(x) for x in dispatch(frame(spark, events), r, 1).collect()}
    want = set()
    for n, (o, w) in enumerate(zip(olds, news, strict=True)):
        for p in r.by_id.values():
            was, now = truth(p.where, o) is True, truth(p.where, w) is True
            for b in r.bindings.values():
                if b.predicate_id == p.predicate_id and (was or now):
                    want.add((n, b.consumer_id, "updated" if was and now else "inserted" if now else "deleted"))
    assert got == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


INF = float("inf")


def test_ranges_lists_and_equalities_are_found_without_nested_loops(spark):
    """Every shape with an equality, a list or a bound, at values in, on, between and far outside the bounds, against the evaluator."""
    rnd = random.Random(8)
    num = lambda: rnd.choice([rnd.randrange(-5, 30), round(rnd.random() * 30, 2)])
    shapes = [
        lambda: f"weight BETWEEN {rnd.randrange(20)} AND {rnd.randrange(25)}",
        lambda: f"weight >= {rnd.randrange(20)} AND weight < {rnd.randrange(25)} AND distance > {rnd.randrange(9)}",
        lambda: f"{rnd.randrange(20)} < parcel_id",
        lambda: f"parcel_id <= {rnd.random() * 20:.2f}",
        lambda: f"parcel_id BETWEEN {rnd.randrange(10)} AND {rnd.randrange(20)} AND parcel_id > {rnd.randrange(15)}",
        lambda: f"parcel_id IN ({rnd.randrange(9)}, {rnd.randrange(9)}, NULL)",
        lambda: f"depot IN ('l{rnd.randrange(5)}', 'l{rnd.randrange(5)}') AND weight > {rnd.randrange(9)}",
        lambda: f"depot = 'l{rnd.randrange(5)}' AND distance < {rnd.randrange(9)} OR weight >= {rnd.randrange(40)} OR parcel_id = {rnd.randrange(20)}",
        lambda: "weight > 9223372036854775807" if rnd.random() < 0.5 else f"weight > {rnd.randrange(3)}",
        lambda: f"distance > 1e308 AND distance < {rnd.randrange(9)}" if rnd.random() < 0.3 else f"distance > -{rnd.randrange(9)} AND distance < {rnd.randrange(9)}",
    ]
    r = Registry(Catalog([PARCELS]))
    for c in range(400):
        r.register(Request(c, f"SELECT * FROM parcels WHERE {shapes[c % len(shapes)]()}"))
    rows = [row(rnd.choice([None, rnd.randrange(-2, 22), (1 << 62) + 1]), rnd.choice([None, num() * 1.0, INF, -INF, float("nan"), 1e300]), rnd.choice([None, num() * 1.0]), rnd.choice([None, "l0", "l1", "l4", "L1", ""])) for _ in range(160)]
    inserts = [EventBuilder(PARCELS, n).insert().new(x).build() for n, x in enumerate(rows[:80])]
    updates = [EventBuilder(PARCELS, 100 + n).update().old(a).new(b).build() for n, (a, b) in enumerate(zip(rows[:80], rows[80:], strict=True))]
    d = dispatch(frame(spark, inserts + updates), r, 1)
    assert "NestedLoop" not in plan_of(d) and "Cartesian" not in plan_of(d)
    want = set()
    for p in r.by_id.values():
        told = [b.consumer_id for b in r.bindings.values() if b.predicate_id == p.predicate_id]
        hit = [truth(p.where, x) is True for x in rows]
        for n in range(80):
            want |= {(n, c, "inserted") for c in told if hit[n]}
            was, now = hit[n], hit[80 + n]
            want |= {(100 + n, c, "updated" if was and now else "inserted" if now else "deleted") for c in told if was or now}
    assert {tuple(x) for x in d.collect()} == want


def test_shapes_without_access_and_large_registries(spark, monkeypatch):
    """Unindexable shapes, and predicates joined by shuffle, give the same."""
    import weir.operators.dispatch as D

    wheres = [f"parcel_id * 2 - {k} > 3" for k in range(8)] + [f"depot LIKE '%{k}'" for k in range(8)] + [f"parcel_id > {k}" for k in range(8)]
    r = Registry(Catalog([PARCELS]))
    for c, w in enumerate(wheres):
        r.register(Request(c, f"SELECT * FROM parcels WHERE {w}"))
    events = frame(spark, [EventBuilder(PARCELS, n).insert().new(row(n, 1.0, 1.0, f"l{n}")).build() for n in range(12)])
    small = {tuple(x) for x in dispatch(events, r, 1).collect()}
    monkeypatch.setattr(D, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(D, "JOIN_CONDITIONS", 1)
    monkeypatch.setattr(D, "MAX_LEVELS", 2)
    assert {tuple(x) for x in dispatch(events, r, 1).collect()} == small
    assert small == {(n, c, "inserted") for n in range(12) for c in range(24) if (c < 8 and n * 2 - c > 3) or (8 <= c < 16 and f"l{n}".endswith(str(c - 8))) or (c >= 16 and n > c - 16)}


def test_aggregate_deltas_replay_to_the_direct_aggregate(spark):
    r = Registry(Catalog([PARCELS]))
    for c, a in enumerate(["COUNT(*)", "COUNT(depot)", "SUM(weight)", "AVG(distance)"]):
        r.register(Request(c, f"SELECT {a} FROM parcels WHERE parcel_id < 5"))
    b = lambda n: EventBuilder(PARCELS, n)
    nan = float("nan")
    events = [
        b(1).insert().new(row(1, 2.0, nan, "x")).build(),
        b(2).insert().new(row(2, None, 4.0, None)).build(),
        b(3).update().old(row(2, None, 4.0, None)).new(row(9, None, 4.0, None)).build(),
        b(4).update().old(row(1, 2.0, nan, "x")).new(row(1, 5.0, 7.0, "x")).build(),
        b(5).delete().old(row(1, 5.0, 7.0, "x")).build(),
    ]
    d = aggregate_deltas(frame(spark, events), r, 1)
    total = {x["consumer_id"]: (x["c"], x["s"]) for x in d.groupBy("consumer_id").agg(F.sum("count_delta").alias("c"), F.sum("sum_delta").alias("s")).collect()}
    assert all(v == (0, 0.0) for v in total.values())
    last = {x["seq"]: x["count_total"] for x in running_totals(d).where("consumer_id = 0").collect()}
    assert last == {1: 1, 2: 2, 3: 1, 5: 0}


def test_strict_errors(spark):
    r = golden_registry()
    r.register(Request(9, "SELECT COUNT(*) FROM parcels"))
    partial = frame(spark, [EventBuilder(PARCELS, 1).update().new(row(1, 1.0, 1.0, "x")).build()])
    with pytest.raises(AggregateUpdateRequiresOldRow):
        aggregate_deltas(partial, r, 1, strict=True)
    with pytest.raises(TruncateRequiresReset):
        aggregate_deltas(frame(spark, [EventBuilder(PARCELS, 1).truncate().build()]), r, 1, strict=True)
    with pytest.raises(UnknownTableId):
        dispatch(partial, r, 5)
    broken = partial.withColumn("new_row", F.lit(None).cast(PARCELS.row_type()))
    with pytest.raises(MissingImage):
        dispatch(broken, r, 1, strict=True)
    assert dispatch(broken, r, 1).count() == 0


def test_running_totals_of_many_events(spark):
    """Spans of unequal sizes, gaps, subscriptions with few events: as plain running sums."""
    rnd = random.Random(5)
    rows = [(seq, sub, 1, "avg", rnd.randrange(-2, 3), float(rnd.randrange(9))) for sub in (1, 2, 3) for seq in sorted(rnd.sample(range(10_000), (700, 3, 90)[sub - 1]))]
    want, totals = {}, {}
    for seq, sub, _, _, c, x in rows:
        totals[sub] = (totals.get(sub, (0, 0.0))[0] + c, totals.get(sub, (0, 0.0))[1] + x)
        want[seq, sub] = totals[sub]
    df = spark.createDataFrame(rows, A.DELTAS)
    for spans in (1, 7, 64):
        assert {(r["seq"], r["subscription_id"]): (r["count_total"], r["sum_total"]) for r in running_totals(df, spans=spans).collect()} == want
    assert running_totals(df.limit(0)).count() == 0


def test_ids_of_other_types(spark, tmp_path):
    r = Registry(Catalog([PARCELS]), consumer_type="string", session_type="string")
    r.register(Request("ann", "SELECT * FROM parcels WHERE weight > 1", session_id="s-1"))
    r.register(Request("bob", "SELECT COUNT(*) FROM parcels"))
    events = frame(spark, [EventBuilder(PARCELS, 1).insert().new(row(1, 2.0, 1.0, "x")).build()])
    assert [tuple(x) for x in dispatch(events, r, 1).collect()] == [(1, "ann", "inserted")]
    assert [x["consumer_id"] for x in aggregate_deltas(events, r, 1).collect()] == ["bob"]
    store = Store(spark, (tmp_path / "s").as_uri())
    store.save(r, 1)
    back = store.load(Catalog([PARCELS]))
    assert {(b.consumer_id, b.session_id) for b in back.bindings.values()} == {("ann", "s-1"), ("bob", None)}
    assert [tuple(x) for x in dispatch(events, back, 1).collect()] == [(1, "ann", "inserted")] and back.unregister_session("s-1").bindings == 1


def test_epochs(spark):
    events = [EventBuilder(PARCELS, n).truncate().build() if n in (3, 6) else EventBuilder(PARCELS, n).insert().new(row(n, 1.0, 1.0, "x")).build() for n in range(1, 8)]
    assert {r["seq"]: r["epoch"] for r in epochs(frame(spark, events)).collect()} == {1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 2, 7: 2}


def test_epochs_of_many_truncates(spark):
    """Truncates as frequent as events, equal and absent places, places that differ beyond a double, several tables; no event is compared with truncates."""
    rnd = random.Random(13)
    kinds = ["insert", "truncate", None]
    rows = [(rnd.choice([None, 10**20, 10**20 + 1, 10**20 + 2, *[rnd.randrange(300) for _ in range(20)]]), rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice(kinds), n) for n in range(900)]
    df = spark.createDataFrame([(None if s is None else Decimal(s), t, k, n) for s, t, k, n in rows], "seq decimal(38,0), table_id int, kind string, n int")
    assert not [x for x in plan_of(epochs(df)).splitlines() if "Join" in x and (">=" in x or "NestedLoop" in x)]
    last = lambda s: (s is None, s or 0)
    want = {n: sum(k2 == "truncate" and t2 == t is not None and last(s2) <= last(s) for s2, t2, k2, _ in rows) for s, t, _, n in rows}
    for spans in (1, 7, 64):
        found = epochs(df, spans)
        assert {r["n"]: r["epoch"] for r in found.collect()} == want and found.columns == [*df.columns, "epoch"]
    assert epochs(df.limit(0)).count() == 0


MESSAGES = {
    wal2json_v1: '{"change":[{"kind":"update","schema":"public","table":"parcels","columnnames":["parcel_id","weight","distance","depot"],"columntypes":["bigint","double","double","text"],"columnvalues":[1,2.5,null,"x"],"oldkeys":{"keynames":["parcel_id"],"keytypes":["bigint"],"keyvalues":[1]}}]}',
    wal2json_v2: '{"action":"U","schema":"public","table":"parcels","columns":[{"name":"parcel_id","type":"bigint","value":1},{"name":"weight","type":"double","value":2.5},{"name":"distance","type":"double","value":null},{"name":"depot","type":"text","value":"x"}],"identity":[{"name":"parcel_id","type":"bigint","value":1}]}',
    debezium: '{"before":{"parcel_id":1},"after":{"parcel_id":1,"weight":2.5,"distance":null,"depot":"x"},"source":{"schema":"public","table":"parcels"},"op":"u"}',
    maxwell: '{"database":"public","table":"parcels","type":"update","data":{"parcel_id":1,"weight":2.5,"distance":null,"depot":"x"},"old":{"weight":1.0}}',
}


@pytest.mark.parametrize("parse", MESSAGES, ids=lambda p: p.__name__)
def test_formats_give_the_same_update(spark, parse):
    df = spark.createDataFrame([(1, MESSAGES[parse]), (2, "null"), (3, "{")], "msg_id long, value string")
    parsed = parse(df, Catalog([PARCELS]))
    rows = {r["msg_id"]: r for r in parsed.collect()}
    assert set(rows) == {1, 3} and rows[3]["error"] == "json" and rows[1]["error"] is None
    e = typed_events(parsed, PARCELS).collect()[0]
    assert tuple(e["new_row"]) == (1, 2.5, None, "x") and e["pk"] == {"parcel_id": "1"} and e["new_missing"] == []
    assert e["changed"] == (["weight"] if parse is maxwell else [])
    with pytest.raises(WalParseError):
        parse(df, Catalog([PARCELS]), strict=True)


def test_one_bad_change_fails_its_transaction(spark):
    good = '{"kind":"insert","schema":"public","table":"parcels","columnnames":["parcel_id"],"columntypes":["bigint"],"columnvalues":[1]}'
    bad = good.replace("[1]", "[1,2]")
    df = spark.createDataFrame([(1, f'{{"change":[{good},{bad}]}}'), (2, f'{{"change":[{good},{good.replace("insert", "message")}]}}')], "msg_id long, value string")
    got = sorted((r["msg_id"], r["error"] or r["kind"]) for r in wal2json_v1(df, Catalog([PARCELS])).collect())
    assert got == [(1, "array_length_mismatch"), (1, "array_length_mismatch"), (2, "insert")]


def test_batches_and_streams_judge_transactions_alike(spark, tmp_path):
    good = '{"kind":"insert","schema":"public","table":"parcels","columnnames":["parcel_id"],"columntypes":["bigint"],"columnvalues":[1]}'
    values = [
        "null",
        "{",
        '{"change":[]}',
        "{}",
        f'{{"change":[{good},{good.replace("message", "x")},{good.replace("bigint", "_int8")}]}}',
        f'{{"change":[{good.replace("insert", "message")},{good}]}}',
        f'{{"change":[{good.replace("[1]", "[1.5]")},{good.replace("parcels", "gone")}]}}',
        f'{{"change":[{good.replace("[1]", "[null]")}]}}',
        '{"change":[{"kind":"insert","schema":"public","table":"parcels","columnnames":[null],"columntypes":["text"],"columnvalues":["x"]}]}',
        '{"change":[{"kind":"truncate","schema":"public","table":"parcels"},{"kind":"delete","schema":"public","table":"parcels"}]}',
    ]
    df = spark.createDataFrame(list(enumerate(values)), "msg_id long, value string")
    batch = sorted((r["msg_id"], r["idx"], r["error"] or r["kind"]) for r in wal2json_v1(df, Catalog([PARCELS])).collect())
    assert batch == [(1, 0, "json"), (3, 0, "missing_field"), (4, 0, "malformed_payload"), (4, 1, "malformed_payload"), (4, 2, "malformed_payload"), (5, 1, "insert"), (6, 0, "type_conversion"), (6, 1, "type_conversion"), (7, 0, "insert"), (8, 0, "missing_field"), (9, 0, "missing_field"), (9, 1, "missing_field")]
    df.write.parquet(str(tmp_path / "in"))
    stream = wal2json_v1(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), Catalog([PARCELS]))
    q = stream.writeStream.format("memory").queryName("v1").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted((r["msg_id"], r["idx"], r["error"] or r["kind"]) for r in spark.table("v1").collect()) == batch
    assert plan_of(wal2json_v1(df, Catalog([PARCELS]))).count("from_json") == 1


def test_positions_do_not_overflow(spark):
    body = MESSAGES[debezium]
    far = [10**13, 2**62, 2**63 - 1]
    parsed = debezium(spark.createDataFrame([(k, body) for k in far], "msg_id long, value string"), Catalog([PARCELS]))
    events = typed_events(parsed.unionByName(parsed.withColumn("idx", F.lit(2**31 - 1))), PARCELS)
    got = sorted((r["m"], r["seq"]) for r in events.select(message_of().alias("m"), "seq").collect())
    assert [m for m, _ in got] == sorted(far * 2) and len({s for _, s in got}) == 6 and [s for _, s in got] == sorted(s for _, s in got)
    told = dispatch(events, golden_registry(), 1).collect()
    assert {int(r["seq"]) // SEQ_STEP for r in told} <= set(far)


def test_pgoutput_in_parallel_is_pgoutput_in_order(spark, monkeypatch):
    """Slots whose relations change, are dropped and come back, against one decoder a slot."""
    rnd = random.Random(13)
    cols = [("parcel_id", 20, True), ("weight", 701, False), ("distance", 1700, False), ("depot", 25, False)]
    rows, want = [], []
    for slot in (None, "a", "b"):
        decoder = P.Decoder(Catalog([PARCELS]))
        for n in range(120):
            order = rnd.sample(cols, 4)
            value = rnd.choice(
                [
                    P.encode_relation(rnd.randrange(3), "public", rnd.choice(["parcels", "parcels", "gone"]), order),
                    P.encode_relation(0, "public", "parcels", cols),
                    P.encode_change("insert", rnd.randrange(3), ["1", "2", "3", "4"]),
                    P.encode_change("update", rnd.randrange(3), ["1", "2", "3", "x"], ["5"], key=True),
                    P.encode_change("delete", rnd.randrange(4), None, ["1", None, None, None]),
                    P.encode_truncate([0, 1, 2]),
                    b"R\0",
                    b"Bzz",
                    b"",
                ]
            )
            rows.append((slot, n, bytearray(value)))
            try:
                want += [(n, k, x[0], str(x[3]), str(x[4])) for k, x in enumerate(decoder.decode(value))]
            except WalParseError as e:
                want.append((n, 0, e.code, "None", "None"))
    df = spark.createDataFrame(rows, "slot string, msg_id long, value binary").repartition(5)
    order = lambda m: None if m is None else {k: m[k] for k in sorted(m)}
    key = lambda xs: sorted((n, k, r, str(order(eval(o))), str(order(eval(w)))) for n, k, r, o, w in xs)  # noqa: E731, S307
    read = lambda: key((r["msg_id"], r["idx"], r["error"] or r["kind"], str(r["old"]), str(r["new"])) for r in P.pgoutput(df, Catalog([PARCELS])).collect())
    assert read() == key(want)
    assert "Exchange" not in plan_of(P.pgoutput(df, Catalog([PARCELS]))).replace("Exchange RoundRobin", "").replace("REPARTITION_BY_NUM", "")
    monkeypatch.setattr(P, "MAX_VERSIONS", 3)
    assert read() == key(want)
    monkeypatch.setattr(P, "MAX_VERSIONS", 10_000)
    monkeypatch.setattr(P, "MAX_RELATIONS", 2)  # the cache would drop some
    assert P._relation_versions(df.select("slot", "msg_id", "value"), Catalog([PARCELS])) is None


def test_pgoutput_decoder_keeps_state_per_slot():
    d = P.Decoder(Catalog([PARCELS]))
    cols = [("parcel_id", 20, True), ("weight", 701, False), ("distance", 1700, False), ("depot", 25, False)]
    assert d.decode(P.encode_relation(5, "public", "parcels", cols)) == []
    new = ["1", "2.5", None, "x"]
    assert d.decode(P.encode_change("insert", 5, new))[0][4] == {"parcel_id": "1", "weight": "2.5", "distance": None, "depot": "x"}
    kind, _, pk, old, _ = d.decode(P.encode_change("update", 5, new, ["7"], key=True))[0]
    assert (kind, pk, old) == ("update", {"parcel_id": "7"}, {"parcel_id": "7"})
    assert d.decode(P.encode_change("delete", 5, None, new))[0][3]["depot"] == "x"
    assert len(d.decode(P.encode_truncate([5, 6]))) == 1
    with pytest.raises(WalParseError):
        P.Decoder(Catalog([PARCELS])).decode(P.encode_change("insert", 5, new))
    with pytest.raises(WalParseError):
        d.decode(P.encode_change("insert", 5, ["one", None, None, None]))


def test_registry_lifecycle():
    r = golden_registry()
    first = r.register(Request(1, "SELECT * FROM public.parcels WHERE 30 < weight"))
    assert first.created_new_predicate
    again = r.register(Request(1, "SELECT * FROM parcels WHERE (30 < weight)"))
    assert again.subscription_id == first.subscription_id and not again.created_new_predicate
    session = r.register(Request(1, "SELECT * FROM parcels WHERE 30 < weight", session_id=4))
    assert session.subscription_id != first.subscription_id
    assert r.unregister_session(4).bindings == 1 and r.unregister_session(4).bindings == 0
    assert r.unregister_query(1, "SELECT * FROM parcels WHERE 30 < weight").predicates == 1
    assert r.subscription_count() == 4 and r.predicate_count(1) == 4


def test_failed_registrations_hold_no_frames():
    found = golden_registry().register_batch(Request(1, s) for s in ("SELECT MIN(weight) FROM parcels", "SELECT * FROM nowhere", "SELECT *"))
    assert [x.code for x in found] == ["unsupported_sql", "unknown_table", "unsupported_sql"]
    assert all(x.__traceback__ is None for x in found)


@pytest.mark.parametrize("key", sorted(Q.STATEMENTS))
def test_statements_are_judged_by_the_tasks(spark, tmp_path, monkeypatch, key):
    """No customer comes to the driver; segments that are absent or need escapes, and a customer without a key."""
    monkeypatch.setattr(Q, "customers", lambda *_: pytest.fail("customers are collected"))
    rows = [(n, (None, "BUILDING", "it's", "{n}")[n % 4]) for n in range(44)] + [(None, "x")]
    spark.createDataFrame(rows, "c_custkey long, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    made = Q.STATEMENTS[key]
    got = {r["statement"]: r["code"] for r in Q.QUERIES[key](spark, str(tmp_path)).collect()}
    assert got == {n: None if n is None else made[n % len(made)][1] for n, _ in rows}


def test_store_round_trip_and_merge(spark, tmp_path):
    r, store = golden_registry(), Store(spark, str(tmp_path / "s"))
    store.save(r, 1)
    (tmp_path / "s" / "table_x").mkdir()
    back = store.load(Catalog([PARCELS]))
    assert {(b.subscription_id, b.consumer_id) for b in back.bindings.values()} == {(b.subscription_id, b.consumer_id) for b in r.bindings.values()}
    assert {p.hash for p in back.by_id.values()} == {p.hash for p in r.by_id.values()} and {p.deps for p in back.by_id.values()} == {p.deps for p in r.by_id.values()}
    assert back.register(Request(99, "SELECT * FROM parcels")).subscription_id == 5
    shard = store.read(PARCELS)
    p, b, report = merge_shards([shard, shard])
    assert (p.count(), b.count(), report["dedup_ratio"]) == (4, 4, 2.0)
    config = Config(str(tmp_path), 7, "best_effort", "x", "mysql")
    save_config(config, str(tmp_path / "c.toml"))
    assert load_config(str(tmp_path / "c.toml")) == config


def test_every_query_has_sql():
    assert set(Q.QUERIES) == set(Q.SQL)


def test_entry_imports_and_lists_queries():
    import __spark_entry__ as e

    assert set(Q.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
