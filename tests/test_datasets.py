"""The verbs on small datasets: versions, omissions, conflicts, evolution, receipts, sources, streams."""

import pytest
from pyspark.sql import functions as F

from tessera.contract import TableContract
from tessera.dataset import Dataset, Destination
from tessera.errors import TesseraError
from tessera.operators import versions
from tessera.operators.joins import asof_join, range_join
from tessera.sources import objects, tables
from tessera.streaming.publish import publish_stream, windowed_totals

ROWS = TableContract((("id", "int64"), ("_year_", "utf8")), ("year",))
PLAIN = TableContract((("id", "int64"),))


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id long, _year_ string")


def test_push_versions(spark, tmp_path):
    d = Dataset(spark, str(tmp_path), "d")
    assert d.latest() == 0 and d.state().count() == 0
    assert d.push({"t": (rows(spark, (1, "2025"), (2, "2026")), ROWS)}).revision == 1
    assert not d.push({"t": (rows(spark, (2, "2026"), (1, "2025")), ROWS)}).changed
    assert d.push({"t": (rows(spark, (1, "2025"), (3, "2026")), ROWS)}).revision == 2
    assert {(r.partition, r.version) for r in d.state().collect()} == {("year=2025", 1), ("year=2026", 2)}
    d.push({"t": (rows(spark, (1, "2025")), ROWS)})
    assert [(r.change, r.partition) for r in d.diff(2).collect()] == [("removed", "year=2026")]
    assert d.read("t", 2).count() == 2 and d.read("t", 2, [{"year": "2026"}]).first().id == 3
    assert d.read("t", 2, []).count() == 0 and d.read("t", 2, [{"year": "1999"}]).count() == 0
    with pytest.raises(TesseraError):
        d.read("t", 2, [{"month": "1"}])
    with pytest.raises(TesseraError):
        d.resolve(9)
    assert d.rollback(1).revision == 4 and sorted(r.id for r in d.read("t").collect()) == [1, 2]
    assert [r.revision for r in d.log().collect()] == [4, 3, 2, 1] and d.verify().count() == 0


def test_push_refuses(spark, tmp_path):
    d = Dataset(spark, str(tmp_path), "d")
    d.push({"a": (spark.range(2), PLAIN), "b": (spark.range(3), PLAIN)})
    with pytest.raises(TesseraError) as e:
        d.push({"a": (spark.range(2), PLAIN)})
    assert e.value.code == "STATE_CONFLICT"
    d.push({"a": (spark.range(2), PLAIN)}, drop=("b",))
    assert {r.table for r in d.state().collect()} == {"a"}
    for bad in (("a/b",), ("UPPER",), (None,)):
        with pytest.raises(TesseraError):
            Dataset(spark, str(tmp_path), "p").push({"t": (rows(spark, (1, *bad)), ROWS)})
    with pytest.raises(TesseraError):
        d.push({"a": (spark.createDataFrame([(None,)], "id long"), PLAIN)}, {"a": ["id"]})
    assert d.latest() == 2


def test_empty_version_is_no_omission(spark, tmp_path):
    d = Dataset(spark, str(tmp_path), "d")
    d.push({"t": (spark.range(2), PLAIN)})
    d.push({"t": (spark.range(0), PLAIN)})
    assert d.state().first().n_rows == 0 and d.read("t").count() == 0


def test_evolution(spark, tmp_path):
    d = Dataset(spark, str(tmp_path), "d")
    wide = TableContract((*ROWS.columns, ("extra", "utf8")), ("year",))
    d.push({"t": (rows(spark, (1, "2025")), ROWS)})
    d.push({"t": (rows(spark, (2, "2026")).withColumn("extra", F.lit("x")), wide)}, infer_omissions=False)
    assert sorted((r.id, r.extra) for r in d.read("t").collect()) == [(1, None), (2, "x")]
    with pytest.raises(TesseraError):
        d.push({"t": (rows(spark, (2, "2026")), ROWS)})


def test_two_publishers_of_one_number(spark, tmp_path):
    d = Dataset(spark, str(tmp_path), "d")
    d.push({"t": (spark.range(2), PLAIN)})
    with pytest.raises(TesseraError) as e:
        d._publish(1, d.state(), {}, "other", "late", {})
    assert e.value.code == "STATE_CONFLICT"


def test_pull_reads_rows_before_any_write(spark, tmp_path):
    d, out = Dataset(spark, str(tmp_path), "d"), Destination(spark, str(tmp_path / "out"))
    one = TableContract((("id", "int64"),))
    d.push({"rows": (spark.createDataFrame([(1,)], "id long"), one), "second": (spark.createDataFrame([(2,)], "id long"), one)})
    plan = {t: {"table": t, "contract": one} for t in ("rows", "second")}
    out.pull(d, plan, attempt="a1")
    sums = {"rows": {**plan["rows"], "sql": "SELECT s.id + (SELECT coalesce(sum(id), 0) FROM target_second) AS id FROM source_rows s"}, "second": {**plan["second"], "sql": "SELECT s.id + (SELECT coalesce(sum(id), 0) FROM target_rows) AS id FROM source_second s"}}
    out.pull(d, sums, write="append", attempt="a2")
    assert [sorted(r.id for r in out.read(t, one).collect()) for t in ("rows", "second")] == [[1, 3], [2, 3]]
    out.pull(d, sums, write="append", attempt="a2")  # a replay changes nothing
    assert out.read("rows", one).count() == 2
    with pytest.raises(TesseraError) as e:
        out.pull(d, plan, attempt="a2")
    assert e.value.code == "REQUEST_MISMATCH"
    with pytest.raises(TesseraError):
        out.pull(d, {"rows": {**plan["rows"], "sql": "SELECT CAST(id AS DOUBLE) AS id FROM source_rows"}})


def test_build_records_inputs(spark, tmp_path):
    a, b = Dataset(spark, str(tmp_path), "a"), Dataset(spark, str(tmp_path), "b")
    a.push({"t": (spark.range(4), PLAIN)})
    total = TableContract((("n", "int64"),))
    b.build({"x": (a, "t", "latest")}, {"n": ("SELECT count(*) AS n FROM input_x", total)})
    assert b.read("n").first().n == 4 and '"revision": 1' in b.notes().first().inputs
    with pytest.raises(TesseraError):
        b.build({"x": (a, "t", 1)}, {"n": ("SELECT count(*) AS other FROM input_x", total)})


def test_pins_and_gc(spark, tmp_path):
    d = Dataset(spark, str(tmp_path), "d")
    for n in (1, 2, 3):
        d.push({"t": (spark.range(n), PLAIN)})
    classes = lambda: {r.version: r["class"] for r in d.gc().collect()}
    assert classes() == {1: "Eligible", 2: "Eligible", 3: "Protected"}
    d.pin(1, "keep")
    d.pin(1, "keep")
    assert classes()[1] == "Protected" and d.gc(3600).where("class = 'Eligible'").count() == 0
    with pytest.raises(TesseraError):
        d.pin(2, "keep")
    d.unpin("keep")
    d.unpin("keep")
    assert classes()[1] == "Eligible"
    with pytest.raises(TesseraError):
        d.pin(1, "keep")


def test_aba(spark):
    history = spark.createDataFrame([("t", "", v, r) for r, v in ((1, 1), (2, 2), (3, 1))] + [("u", "", 5, r) for r in (1, 3)], "table string, partition string, version long, revision long")
    mine = spark.createDataFrame([("t", ""), ("u", "")], "table string, partition string")
    assert {(r.revision, r.table) for r in versions.conflicts(history, 1, mine).collect()} == {(2, "t"), (3, "t"), (2, "u"), (3, "u")}
    assert versions.conflicts(history, 3, mine).count() == 0


def test_asof_and_range(spark):
    left = spark.createDataFrame([("a", 5), ("a", 0), ("b", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 1, "x"), ("a", 4, "y"), ("a", 6, "z")], "k string, u int, v string")
    assert {(r.k, r.t, r.v) for r in asof_join(left, right, ["k"], "t", "u", ["v"]).collect()} == {("a", 5, "y"), ("a", 0, None), ("b", 5, None)}
    pairs = range_join(spark.range(20).withColumnRenamed("id", "p"), spark.createDataFrame([(3, 12), (11, 13)], "lo int, hi int"), "p", "lo", "hi", 5)
    assert {(r.p, r.lo) for r in pairs.collect()} == {(p, 3) for p in range(3, 12)} | {(11, 11), (12, 11)}


def test_objects(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"Id":"1","Owner":{"Name":"A"},"Amount":12345678901234567.5}\n{"Id":"2","Owner":null,"Amount":null}\n')
    pages = objects.read_pages(spark, str(tmp_path / "p.json"), ["Id", "Owner.Name", "Amount"], expected=2)
    out = objects.decode(pages, [{"name": "id", "source": "Id", "type": "int64"}, {"name": "owner", "source": "Owner.Name", "type": "utf8"}])
    assert sorted(map(tuple, out.collect())) == [(1, "A"), (2, None)]
    (tmp_path / "b.csv").write_text('"Id","Note"\n"1","a ""q""\nnext"\n"2",""\n')
    bulk = objects.read_bulk(spark, str(tmp_path / "b.csv"), ["Id", "Note"], expected=2)
    columns = [{"name": "id", "source": "Id", "type": "int64"}, {"name": "note", "source": "Note", "type": "utf8"}]
    assert sorted(map(tuple, objects.decode(bulk, columns, {"note": "null"}).collect())) == [(1, 'a "q"\nnext'), (2, None)]
    with pytest.raises(TesseraError):
        objects.decode(bulk, columns, {"note": "reject"})
    with pytest.raises(TesseraError):
        objects.read_bulk(spark, str(tmp_path / "b.csv"), ["Id"])
    assert objects.transport({"a": "text"}) == "rest" and objects.transport({"a": "decimal_beyond_double"}) == "bulk"


def test_file_hashes(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f/x").write_bytes(b"abc")
    manifest = tables.file_hashes(spark, str(tmp_path / "f")).cache()
    assert manifest.first().sha256.startswith("ba7816bf") and tables.altered_files(spark, str(tmp_path / "f"), manifest).count() == 0
    spark.range(1).createOrReplaceTempView("some_view")
    with pytest.raises(TesseraError):
        tables.catalog_table(spark, "some_view")


def test_stream_publishes_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.range(5).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    d = Dataset(spark, str(tmp_path), "s")
    stream = lambda: spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    publish_stream(stream(), d, "t", PLAIN, ["id"], str(tmp_path / "cp")).awaitTermination()
    spark.range(3, 8).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    publish_stream(stream(), d, "t", PLAIN, ["id"], str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.id for r in d.read("t").collect()) == list(range(8)) and d.latest() == 2


def test_windowed_totals(spark):
    events = spark.createDataFrame([("2026-01-01 00:10:00", "a", 1.5), ("2026-01-01 00:50:00", "a", 2.0), ("2026-01-01 01:00:00", "a", 3.0)], "t string, k string, v double").withColumn("t", F.to_timestamp("t"))
    assert sorted((r.n, float(r.total)) for r in windowed_totals(events, "t", "v", "k").collect()) == [(1, 3.0), (2, 3.5)]


def test_a_run_that_died_before_its_commit_is_never_seen(spark, tmp_path):
    d = Dataset(spark, str(tmp_path), "d")
    d.push({"t": (spark.range(2), PLAIN)})
    state = d.state()
    state.write.parquet(f"{d.path}/states/revision=2/attempt=dead")  # a state without its commit
    assert d.latest() == 1 and d.history().count() == 1 and d.status().first().unpublished == 1
    assert d.push({"t": (spark.range(3), PLAIN)}).revision == 2 and d.read("t").count() == 3


def test_publishers_at_the_same_time(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    d = Dataset(spark, str(tmp_path), "d")
    d.push({"t": (spark.range(2), PLAIN)})
    with ThreadPoolExecutor(3) as pool:  # of different tables: each builds upon the others
        made = list(pool.map(lambda n: Dataset(spark, str(tmp_path), "d").push({f"u{n}": (spark.range(n + 1), PLAIN)}, infer_omissions=False).revision, range(3)))
    assert sorted(made) == [2, 3, 4] and {r.table for r in d.ls().collect()} == {"t", "u0", "u1", "u2"}


def test_pairs_changed_since_the_base_are_a_conflict(spark, tmp_path):
    d = Dataset(spark, str(tmp_path), "d")
    for n in (2, 3, 2):  # the content is back again at revision 3
        d.push({"t": (spark.range(n), PLAIN)})
    with pytest.raises(TesseraError) as e:
        d.push({"t": (spark.range(5), PLAIN)}, base=1)
    assert e.value.code == "STATE_CONFLICT" and d.latest() == 3
    assert d.push({"u": (spark.range(5), PLAIN)}, base=1, infer_omissions=False).revision == 4


def test_builds_read_nothing_but_their_inputs(spark, tmp_path):
    a, b = Dataset(spark, str(tmp_path), "a"), Dataset(spark, str(tmp_path), "b")
    a.push({"t": (spark.range(4), PLAIN)})
    spark.range(3).createOrReplaceTempView("stray")
    for sql in ("SELECT id FROM stray", f"SELECT id FROM parquet.`{a.path}/data`", "SELECT id FROM input_x WHERE id IN (SELECT id FROM stray)", "SELECT try_reflect('java.lang.System', 'exit', 1) AS id FROM input_x", "SELECT CAST(rand() * 9 AS BIGINT) AS id FROM input_x", "SELECT identifier('ra' || 'nd')() AS id FROM input_x", "SELECT id FROM input_x; SELECT 1", "DROP TABLE stray"):
        with pytest.raises(TesseraError):
            b.build({"x": (a, "t", "latest")}, {"n": (sql, PLAIN)})
    b.build({"x": (a, "t", "latest")}, {"n": ("WITH c AS (SELECT id FROM input_x) SELECT id FROM c WHERE 'reflect(' <> ''", PLAIN)})
    assert b.read("n").count() == 4 and "input_x" not in {r.tableName for r in spark.sql("SHOW VIEWS").selectExpr("viewName AS tableName").collect()}


def test_selections_are_checked(spark, tmp_path):
    from tessera.plans.selection import choose

    base = spark.createDataFrame([("t", "a", 1), ("t", "b", 1)], "table string, partition string, version long")
    made = spark.createDataFrame([("t", "a", 2)], "table string, partition string, version long")
    got = {(r.partition, r.version) for r in choose(base, made, "explicit", include=[("t", "a")], empty=[("t", "b")], number=2).collect()}
    assert got == {("a", 2), ("b", 2)}
    for bad in ({"include": [("t", "b")]}, {"include": [("t", "a")], "drop": [("t", "a")]}, {"empty": [("t", "a")], "number": 2}, {"empty": [("t", "b")]}, {"policy": "other"}):
        with pytest.raises(TesseraError):
            choose(base, made, **bad)


def test_prune_deletes_files_and_spares_pins(spark, tmp_path):
    d = Dataset(spark, str(tmp_path), "d")
    for n in (1, 2, 3):
        d.push({"t": (spark.range(n), PLAIN)})
    d.pin(2, "keep")
    before = {r.version: r.bytes for r in d.gc().collect()}
    assert d.prune() == 1 and d.prune() == 0 and before[1] > 0
    found = {r.version: (r["class"], r.bytes > 0) for r in d.gc().collect()}
    assert found == {1: ("AlreadyPruned", False), 2: ("Protected", True), 3: ("Protected", True)}
    assert d.read("t", 2).count() == 2


def test_appends_write_only_what_is_new(spark, tmp_path):
    d, out = Dataset(spark, str(tmp_path), "d"), Destination(spark, str(tmp_path / "out"))
    d.push({"t": (spark.range(2), PLAIN)})
    first = out.pull(d, {"t": {"table": "t", "contract": PLAIN}})["t"]
    second = out.pull(d, {"t": {"table": "t", "contract": PLAIN}}, write="append")["t"]
    assert second[:1] == first and len(second) == 2 and out.read("t", PLAIN).count() == 4
    other = Dataset(spark, str(tmp_path), "other")
    other.push({"t": (spark.range(2), PLAIN)})
    with pytest.raises(TesseraError):
        out.pull(other, {"t": {"table": "t", "contract": PLAIN}})
