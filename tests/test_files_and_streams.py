"""Real files, sinks, jobs and streams."""

from __future__ import annotations

import csv
import json
import os
import random
import tempfile
from datetime import timedelta
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from gleaner.operators import findings as A
from gleaner.operators import files as FD
from gleaner.operators import sequences as SE
from gleaner.operators import statements as ST
from gleaner.plans.jobs import ConsolidateOptions, consolidate, consolidate_tree, find_duplicate_files, plan_downloads
from gleaner.sinks import reports as SK
from gleaner.sources import files as IN
from gleaner.streaming import streams as SS


@pytest.fixture()
def scratch():
    return Path(tempfile.mkdtemp(prefix="gleaner-test-"))


def put(root: Path, name: str, content: str | bytes) -> None:
    target = root / name
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(content.encode() if isinstance(content, str) else content)


@pytest.fixture()
def tree(scratch):
    put(scratch, "test.sql", "SELECT * FROM users;\nUPDATE users SET a = 1 WHERE id = 2;")
    put(scratch, "queries.txt", "notes first\n\nSELECT * FROM orders\n\nthe end")
    put(scratch, "subdir/nested.SQL", "DELETE FROM logs WHERE old = 1;")
    put(scratch, "subdir/latin.log", "SELECT 'caf\xe9' FROM t;".encode("latin-1"))
    put(scratch, ".git/x.sql", "SELECT 1 FROM hidden;")
    put(scratch, "node_modules/y.sql", "SELECT 1 FROM pruned;")
    put(scratch, "big.sql", "SELECT 1 FROM big; " * 100)
    put(scratch, "photo.jpg", b"\xff\xd8\xff")
    return scratch


def test_scan(spark, tree):
    options = IN.ScanOptions(max_bytes=1000)
    rows = {r.relative_path: r for r in IN.scan_files(spark, str(tree), options).collect()}
    assert set(rows) == {"test.sql", "queries.txt", "subdir/nested.SQL", "subdir/latin.log"}
    assert rows["subdir/latin.log"].content == "SELECT 'café' FROM t;" and rows["subdir/latin.log"].encoding == "latin-1"
    nested = rows["subdir/nested.SQL"]
    assert (nested.file_name, nested.extension, nested.line_count) == ("nested.SQL", ".sql", 1)
    assert rows["test.sql"].line_count == 2 and rows["test.sql"].size == 57
    keyed = IN.scan_files(spark, str(tree), IN.ScanOptions(max_bytes=1000, keywords=["update"])).collect()
    assert [r.relative_path for r in keyed] == ["test.sql"]
    assert IN.scan_files(spark, str(tree / "nowhere")).count() == 0
    both = IN.scan_files(spark, [str(tree / "subdir"), str(tree / "nowhere")]).collect()
    assert {r.relative_path for r in both} == {"nested.SQL", "latin.log"}
    everything = IN.scan_files(spark, str(tree), IN.ScanOptions(extensions=None, exclude_dirs=[], max_bytes=None))
    assert everything.count() == 6


def test_size_test_reaches_the_scan(spark, tree):
    plan = IN.scan_files(spark, str(tree), IN.ScanOptions(max_bytes=1000))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "LessThanOrEqual(length" in plan


def test_failures_and_lossy_reading(spark, tree):
    empty = spark.createDataFrame([("empty.sql", 0, bytearray())], "path string, size long, raw binary")
    listed = IN.list_files(spark, str(tree))
    assert [r.reason for r in IN.scan_failures(empty).collect()] == ["empty"]
    failures = {Path(r.path).name: r.reason for r in IN.scan_failures(listed, 1000).collect()}
    assert failures == {"latin.log": "invalid_utf8", "big.sql": "oversize", "photo.jpg": "invalid_utf8"}
    text = {r.relative_path: r.content for r in IN.decode_text(listed, "ignore").collect()}
    assert text["subdir/latin.log"] == "SELECT 'caf' FROM t;"
    replaced = {r.relative_path: r.content for r in IN.decode_text(listed, "replace").collect()}
    assert replaced["subdir/latin.log"] == "SELECT 'caf�' FROM t;"


def test_items(spark, scratch):
    put(scratch, "links.txt", " http://a \n\n\thttp://b\n   \n")
    assert sorted(r.item for r in IN.read_items(spark, str(scratch / "links.txt")).collect()) == ["http://a", "http://b"]


def test_sinks(spark, scratch):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "name string, n int")
    SK.write_csv(df, str(scratch / "csv"))
    rows = [r for p in (scratch / "csv").glob("*.csv") for r in csv.DictReader(p.open())]
    assert sorted(r["name"] for r in rows) == ["a", "b"]
    SK.write_json(df, str(scratch / "json"))
    records = [json.loads(x) for p in (scratch / "json").glob("*.json") for x in p.read_text().splitlines()]
    assert {(r["name"], r["n"]) for r in records} == {("a", 1), ("b", 2)}
    SK.write_lines(df.select("name").orderBy("name"), str(scratch / "text"), single_file=True)
    assert [p.read_text() for p in (scratch / "text").glob("*.txt")] == ["a\nb\n"]
    written = SK.write_reports({"x": df, "y": df, "z": df}, str(scratch), "run1", {"x": "csv", "y": ""})
    assert written == {"x": f"{scratch}/run1/x", "z": f"{scratch}/run1/z"}
    assert spark.read.parquet(written["z"]).count() == 2
    with pytest.raises(ValueError, match="unknown format"):
        SK.write_reports({"x": df}, str(scratch), "run2", {"x": "xlsx"})


def test_consolidate_tree(spark, tree):
    out = str(tree / "out")
    written = consolidate_tree(spark, str(tree), out, "r1", IN.ScanOptions(max_bytes=1000))
    assert {"statements", "findings", "listing", "consolidated", "summary"} <= set(written)
    kinds = {r.query_type: r.n for r in spark.read.parquet(written["type_distribution"]).collect()}
    assert kinds == {"SELECT": 3, "UPDATE": 1, "DELETE": 1}
    stats = spark.read.parquet(written["dedup_stats"]).first()
    assert (stats.total_input, stats.total_unique) == (5, 5)
    listed = spark.read.parquet(written["listing"])
    assert sorted(r.number for r in listed.collect()) == [1, 2, 3, 4, 5]
    assert spark.read.parquet(written["scan_metrics"]).first().scanned == 4
    failures = {Path(r.path).name: r.reason for r in spark.read.parquet(written["failures"]).collect()}
    assert failures.get("latin.log") == "invalid_utf8"
    assert set(consolidate_tree(spark, str(tree / "nowhere"), out, "r2")) == {"scan_metrics", "failures"}


def test_consolidated_text(spark, scratch):
    files = spark.createDataFrame(
        [("a.sql", "select a,b from t;\nselect * from u where x = 1;\ndrop table old_t;")], "source_file string, content string"
    )
    frames = consolidate(files, ConsolidateOptions(near=False))
    SK.write_consolidated(frames["consolidated"], str(scratch / "doc"))
    texts = {p.parent.name: p.read_text() for p in (scratch / "doc").glob("*/*.txt")}
    assert set(texts) == {"section_no=3", "section_no=11"}
    selects = texts["section_no=11"]
    assert "||  Total: 2" in selects and selects.count("\nGO\n") == 1 and "select a, b from t;" in selects
    assert selects.index("select a, b") < selects.index("select * from u")
    limited = consolidate(files, ConsolidateOptions(skip_dedup=True, min_importance=6))
    assert {r.query_type for r in limited["statements"].collect()} == {"SELECT"}
    assert A.browse(frames["statements"], risk="HIGH").count() == 1


def test_counting_reports_move_no_features(spark):
    """The summary alone is that of the whole job, without the columns that it does not count."""
    from gleaner import session

    text = "select a from t where b = 1;\nselect a from t where b = 2;\nupdate u set a = 1;\ndrop table old_t;\ndrop table old_t;"
    files = spark.createDataFrame([("a.sql", text), ("b.sql", text)], "source_file string, content string")
    whole = sorted(consolidate(files)["run_summary"].collect())
    with session.scratch(spark) as cuts:
        assert sorted(consolidate(files, only={"run_summary"})["run_summary"].collect()) == whole
        columns = {c for cut in cuts if os.path.isdir(urlparse(cut).path) for c in spark.read.parquet(cut).columns}
    assert "complexity_score" in columns and not columns & {"normalized_sql", "table_names", "importance_score"}


def test_find_duplicate_files(spark, scratch):
    put(scratch, "a/x.txt", "same")
    put(scratch, "b/x.txt", "same")
    put(scratch, "c/x.txt", "diff")
    put(scratch, "c/other.txt", "same")
    put(scratch, "node_modules/x.txt", "same")
    rows = find_duplicate_files(spark, str(scratch)).collect()
    assert sorted(Path(r.path).parent.name for r in rows) == ["a", "b"]
    by_content = find_duplicate_files(spark, str(scratch), key="content").collect()
    assert sorted(Path(r.path).name for r in by_content) == ["other.txt", "x.txt", "x.txt"]


def test_history(spark, scratch):
    files = spark.createDataFrame([("p", "h1"), ("q", "h1")], "path string, hash string")
    later = spark.createDataFrame([("p", "h2")], "path string, hash string")
    FD.append_history(files, str(scratch / "h"), F.lit("2024-01-01 10:00:00").cast("timestamp"))
    FD.append_history(later, str(scratch / "h"), F.lit("2024-01-02 10:00:00").cast("timestamp"))
    latest = {r.path: r.hash for r in FD.latest_hash(spark.read.parquet(str(scratch / "h"))).collect()}
    assert latest == {"p": "h2", "q": "h1"}


def test_history_of_batches(spark, scratch):
    history = FD.ScanHistory(spark, str(scratch / "h"))
    files = lambda rows: spark.createDataFrame(rows, "path string, hash string")
    at = lambda day: F.lit(f"2024-01-{day:02d} 10:00:00").cast("timestamp")
    state = lambda: {r.path: r.hash for r in history.latest().collect()}
    folders = lambda kind: sorted(p.name for p in (scratch / "h" / kind).iterdir())
    assert history.latest().count() == 0
    history.add(files([("p", "h1"), ("q", "h1")]), "a", at(1))
    history.add(files([("p", "h2")]), "b", at(2))
    for _ in range(2):
        history.add(files([("p", "h2")]), "b", at(2))
    assert state() == {"p": "h2", "q": "h1"} and history.latest().count() == 2
    history.compact()
    assert folders("snapshots") == ["000000001"] and folders("batches") == [] and state() == {"p": "h2", "q": "h1"}
    history.add(files([("p", "other")]), "a", at(9))  # covered, so it adds nothing
    history.add(files([("r", "h3"), ("p", "h0")]), "c", at(1))
    (scratch / "h" / "batches" / "broken").mkdir()  # a batch that did not end
    assert state() == {"p": "h2", "q": "h1", "r": "h3"}
    history.compact()
    history.add(files([("q", "h4")]), "d", at(3))
    assert folders("snapshots") == ["000000002"] and state() == {"p": "h2", "q": "h4", "r": "h3"}
    with pytest.raises(ValueError):
        history.add(files([]), "../x", at(1))


def test_plan_downloads(spark):
    pages = spark.createDataFrame(
        [
            ("http://a.org/", "<a href='p1.html'>x</a><a href='/f.pdf'>f</a><a href='http://b.org/g.pdf'>g</a>"),
            ("http://a.org/p1.html", "<a href='/'>home</a><a href='docs/h.docx?v=1'>h</a><a href='p2.html'>n</a>"),
            ("http://a.org/p2.html", "<a href='/deep.zip'>d</a>"),
        ],
        "url string, html string",
    )
    seeds = spark.createDataFrame([("http://a.org/",)], "url string")
    plan = {r.target_path: r.url for r in plan_downloads(pages, seeds, max_depth=1).collect()}
    assert plan == {"a/f.pdf": "http://a.org/f.pdf", "a/docs/h.docx": "http://a.org/docs/h.docx?v=1"}
    existing = spark.createDataFrame([("a/f.pdf",)], "target_path string")
    deeper = plan_downloads(pages, seeds, max_depth=None, existing=existing).collect()
    assert {r.target_path for r in deeper} == {"a/docs/h.docx", "a/deep.zip"}


def test_plan_downloads_by_content_type(spark):
    pages = spark.createDataFrame(
        [
            ("http://a.org/", "text/html; charset=utf-8", "<a href='/get?id=1'>x</a><img href='/n.pdf' src='/i.png'>"),
            ("http://a.org/get?id=1", "application/pdf", "<a href='/never.pdf'>binary</a>"),
            ("http://a.org/away?id=2", "application/pdf", ""),
        ],
        "url string, content_type string, html string",
    )
    seeds = spark.createDataFrame([("http://a.org/",)], "url string")
    plan = {r.target_path: r.url for r in plan_downloads(pages, seeds).collect()}
    assert plan == {"a/get": "http://a.org/get?id=1"}


def run_stream(df, mode, name):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def test_sequence_stream_equals_batch(spark, scratch):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    labels = events.select(
        F.col("user_id").alias("key"), "ts", F.col("event_type").alias("label"),
        F.expr("CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END").alias("label_order"),
    ).filter("label IN ('view', 'click', 'purchase')")
    labels.repartition(4).write.parquet(str(scratch / "in"))
    expected = ["view", "click", "purchase"]
    batch = {r.key for r in SE.validate_sequence(labels, expected).filter("valid").collect()}
    stream = spark.readStream.schema(labels.schema).option("maxFilesPerTrigger", 1).parquet(str(scratch / "in"))
    table = run_stream(SS.validate_sequence_stream(stream, expected), "complete", "sequence_out")
    assert {r.key for r in table.filter("valid").collect()} == batch and batch


def test_dedup_stream(spark, scratch):
    rows = [(f"SELECT {'  ' * (i % 2)} * FROM t{i % 3}", f"2024-01-01 00:00:{i:02d}") for i in range(30)]
    df = spark.createDataFrame(rows, "raw_sql string, at string").withColumn("at", F.col("at").cast("timestamp"))
    df.repartition(3).write.parquet(str(scratch / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(scratch / "in"))
    table = run_stream(SS.dedup_stream(ST.with_normal_form(stream), "at"), "append", "dedup_out")
    assert table.count() == 3


def test_arrivals(spark, scratch):
    put(scratch, "in/a.txt", "1")
    put(scratch, "in/sub/b.txt", "22")
    rows = run_stream(SS.arrivals(spark, str(scratch / "in")), "append", "arrivals_out").collect()
    assert {(Path(r.path).name, r.size) for r in rows} == {("a.txt", 1), ("b.txt", 2)}


def test_scan_keeps_every_name_and_empty_files(spark, scratch):
    names = ["_init.sql", "pkg/__init__.py", "_arch/x.sql", "a b.sql", "plain.sql", "sub/.env"]
    for name in names:
        put(scratch, name, f"SELECT '{name}' FROM t;")
    put(scratch, "empty.sql", "")
    put(scratch, "pkg/empty.py", b"")
    listed = IN.list_files(spark, str(scratch))
    found = {r.relative_path: bytes(r.raw) for r in listed.collect()}
    assert found == {**{n: f"SELECT '{n}' FROM t;".encode() for n in names}, "empty.sql": b"", "pkg/empty.py": b""}
    scanned = IN.scan_files(spark, str(scratch), IN.ScanOptions(extensions=None))
    assert {r.relative_path for r in scanned.collect()} == set(found) - {"sub/.env"} | {"sub/.env"} and scanned.count() == 8
    assert {r.reason for r in IN.scan_failures(listed).collect()} == {"empty"}


def test_list_tree_level_by_level(spark, scratch):
    names = ["a.txt", "_x/.y/z.sql", "deep/" * 20 + "end.txt", "sp ace/ü.txt", "empty.dat"]
    for name in names:
        put(scratch, name, "" if name == "empty.dat" else "text")
    (scratch / "void").mkdir()
    (scratch / "deep" / "back").symlink_to(scratch)
    (scratch / "other").symlink_to(scratch / "_x")
    rows = IN.list_tree(spark, [str(scratch), f"file://{scratch}/sp ace", f"{scratch}/a.txt", f"{scratch}/gone"]).collect()
    files = {(r.root, r.path): r.size for r in rows if r.kind == "file"}
    below = {(str(scratch), f"file:{scratch}/{n}"): 0 if n == "empty.dat" else 4 for n in [*names, "other/.y/z.sql"]}
    extra = {(f"file://{scratch}/sp ace", f"file:{scratch}/sp ace/ü.txt"): 4, (f"{scratch}/a.txt", f"file:{scratch}/a.txt"): 4}
    assert files == below | extra
    assert {r.path for r in rows if r.kind == "folder" and r.path.endswith("void")} == {f"file:{scratch}/void"}
    assert [r.root for r in rows if r.kind == "error"] == [f"{scratch}/gone"]
    (scratch / "deep" / "back").unlink()  # Spark's own listing goes round it until the name is too long
    spark_names = {r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(scratch)).select("path").collect()}
    listed = IN.list_files(spark, str(scratch), contents=False)
    assert listed.columns == ["path", "root", "relative_path", "size", "modified"]
    found = {r.path: (r.relative_path, r.size, r.modified) for r in listed.collect()}
    assert spark_names <= set(found) == {p for _, p in below}
    with_bytes = {r.path: (r.relative_path, r.size, r.modified) for r in IN.list_files(spark, str(scratch)).drop("raw").collect()}
    assert {p: v[:2] for p, v in with_bytes.items()} == {p: v[:2] for p, v in found.items()}


def test_unreadable_files_keep_their_rows(spark, scratch):
    put(scratch, "a.txt", "same")
    put(scratch, "b c.txt", "same")
    paths = [f"file:{scratch}/a.txt", f"file://{scratch}/b c.txt", "dbfs:/mnt/x.txt", f"{scratch}/gone.txt", "s3n://b/k x.txt"]
    rows = FD.hash_paths(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert len(rows) == 5
    assert rows[0].hash == rows[1].hash and rows[0].hash and rows[0].error is None
    assert all(r.hash is None and r.error for r in rows[2:])


def test_null_keys_lose_no_row(spark):
    from gleaner.operators.dedup import dedup_by_key
    from gleaner.operators.lines import carry_marker
    from gleaner.operators.skew import number_rows

    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4)], "k string, n int")
    tagged = {r.n: (r.is_duplicate, r.group_size) for r in dedup_by_key(rows, "k", ["n"], rows_per_slice=1).collect()}
    assert tagged == {1: (False, 2), 2: (True, 2), 3: (False, 2), 4: (True, 2)}
    numbered = {r.n: (r.number, r.number_total) for r in number_rows(rows, ["k"], ["n"]).collect()}
    assert numbered == {1: (1, 2), 2: (2, 2), 3: (1, 2), 4: (2, 2)}
    lines = spark.createDataFrame([(None, 1, "7"), (None, 2, None), (5, 1, None)], "doc_id long, line_no int, marker string")
    assert {(r.doc_id, r.line_no): r.number for r in carry_marker(lines).collect()} == {(None, 1): "7", (None, 2): "7", (5, 1): None}


def test_sequence_stream_equals_batch_with_other_labels(spark):
    rows = [("k", "red", 1), ("k", "green", 2), ("k", "blue", 3), ("l", "red", 1), ("l", "green", 2), ("m", "green", 1), ("m", "red", 2)]
    order = {"red": 0, "green": 1, "blue": 2}
    labels = spark.createDataFrame([(k, x, t, order[x]) for k, x, t in rows], "key string, label string, ts int, label_order int")
    batch = {r.key: r.valid for r in SE.validate_sequence(labels, ["red", "green"]).collect()}
    assert {r.key: r.valid for r in SS.validate_sequence_stream(labels, ["red", "green"]).collect()} == batch == {"k": False, "l": True, "m": False}


@pytest.mark.parametrize("name", ["in1_list_files", "in1_scan_text", "in9_roots", "in11_tree_failures", "st1_arrivals"])
def test_tree_queries_over_many_bounded_files(spark, monkeypatch, name):
    import duckdb

    from gleaner.catalog import all_queries, ingest
    from tools.check import canonical

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(ingest, "FILE_LINES", 5, raising=False)
    tree = spark.read.text(ingest.document_tree(spark, sf)).groupBy("lang", "source", F.input_file_name().alias("file")).count()
    assert tree.agg(F.max("count")).first()[0] <= 5
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    query = next(q for q in all_queries() if q.name == name)
    got, want = query.run(spark, sf).toPandas(), con.execute(query.sql).df()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def listed(spark, scratch, hour, files):
    rows = [(p, f"2024-05-01 00:00:{m:02d}", s) for p, m, s in files]
    df = spark.createDataFrame(rows, "path string, modified string, size long").withColumn("modified", F.col("modified").cast("timestamp"))
    SS.append_listing(df, str(scratch / "listings"), F.lit(f"2024-05-01 {hour:02d}:00:00"))


def new_changes(spark, scratch):
    """What a restarted stream adds to the changes known so far."""
    out = scratch / "changes"
    before = set(spark.read.parquet(str(out)).collect()) if out.exists() else set()
    with SS.keyed_state(spark):
        query = (
            SS.file_changes(SS.listing_stream(spark, str(scratch / "listings")), timedelta(minutes=90))
            .writeStream.format("parquet")
            .option("path", str(out))
            .option("checkpointLocation", str(scratch / "state"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    rows = set(spark.read.parquet(str(out)).collect()) - before
    state = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    return sorted((r.path, r.change, r.size, r.at.strftime("%H:%M")) for r in rows), state[-1] if state else None


def test_file_changes_over_restarts(spark, scratch):
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        listed(spark, scratch, 10, [("a", 1, 5), ("b", 1, 5), ("b", 1, 5), ("c", 1, 0)])
        assert new_changes(spark, scratch)[0] == [("a", "created", 5, "10:00"), ("b", "created", 5, "10:00"), ("c", "created", 0, "10:00")]
        listed(spark, scratch, 11, [("a", 1, 5), ("b", 2, 5), ("c", 1, 9)])  # b is touched, c grows
        assert new_changes(spark, scratch)[0] == [("b", "modified", 5, "11:00"), ("c", "modified", 9, "11:00")]
        assert new_changes(spark, scratch)[0] == []  # nothing arrived
        listed(spark, scratch, 9, [("a", 0, 1)])  # comes late
        listed(spark, scratch, 12, [("a", 1, 5)])
        assert new_changes(spark, scratch)[0] == []
        listed(spark, scratch, 13, [("a", 1, 5), ("d", 1, 1)])
        found, state = new_changes(spark, scratch)
        assert found == [("b", "deleted", 5, "12:30"), ("c", "deleted", 9, "12:30"), ("d", "created", 1, "13:00")]
        listed(spark, scratch, 14, [("a", 1, 5), ("c", 3, 3), ("d", 1, 1)])
        assert new_changes(spark, scratch)[0] == [("c", "created", 3, "14:00")]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_file_changes_hold_buckets_of_paths(spark, scratch, monkeypatch):
    """The state has an entry and a timer or two per bucket, not per path; every path has its own end."""
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    monkeypatch.setattr(SS.file_changes, "__defaults__", (*SS.file_changes.__defaults__[:-1], 2))
    try:
        listed(spark, scratch, 10, [(f"p{i:02d}", 1, i) for i in range(60)])
        found, state = new_changes(spark, scratch)
        assert found == [(f"p{i:02d}", "created", i, "10:00") for i in range(60)] and state < 20
        listed(spark, scratch, 11, [(f"p{i:02d}", 1, i + (i == 40)) for i in range(20, 60)])
        assert new_changes(spark, scratch)[0] == [("p40", "modified", 41, "11:00")]
        listed(spark, scratch, 12, [(f"p{i:02d}", 1, i + (i == 40)) for i in range(40, 60)])
        listed(spark, scratch, 14, [("p50", 1, 50)])
        found, state = new_changes(spark, scratch)
        gone = [(f"p{i:02d}", "deleted", i + (i == 40), f"{11 + (i >= 20) + (i >= 40)}:30") for i in range(60) if i != 50]
        assert found == gone[:20] + gone[20:40] + gone[40:] and state < 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_sessions_close_and_leave_the_state(spark, scratch):
    """A stream in ten parts gives the closed runs of the batch form, and its state holds open runs only."""
    rng = random.Random(7)
    rows = []
    for part in range(10):
        for key in range(part * 20, part * 20 + 20):  # every key is active in one part
            at = part * 1000
            for _ in range(rng.randrange(1, 9)):
                at += rng.randrange(1, 90)
                rows.append((part, key, at, rng.choice(["view", "click", "purchase", "other"])))
    df = spark.createDataFrame(rows, "part int, key int, at int, label string").withColumn("ts", F.timestamp_seconds(F.col("at") + 1_700_000_000))
    for part in range(10):
        df.where(F.col("part") == part).coalesce(1).write.mode("append").parquet(str(scratch / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(scratch / "in")).withWatermark("ts", "0 seconds")
    expected = ["view", "click", "purchase"]
    query = (
        SS.validate_sessions(stream, "60 seconds", expected)
        .writeStream.format("parquet")
        .option("path", str(scratch / "out"))
        .option("checkpointLocation", str(scratch / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(scratch / "out")).collect()}
    whole = {tuple(r) for r in SS.validate_sessions(df, "60 seconds", expected).collect()}
    end = max(r[2] for r in whole)
    assert got == {r for r in whole if (end - r[2]).total_seconds() >= 60}
    assert any(r[3] for r in got) and len(got) > 150
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert max(held) <= 60 and held[-1] < 20 < len({r[1] for r in rows})


def test_scratch_deletes_all_cuts_but_those_kept(spark):
    from gleaner import session

    durable = session.durable
    with session.scratch(spark) as outer:
        a = durable(spark.range(3))
        with session.scratch(spark) as inner:
            b = durable(spark.range(4))
            c = inner.keep(b.selectExpr("id + 1 AS id"))
        assert not any(os.path.exists(urlparse(f).path) for f in inner) and c.count() == 4 and a.count() == 3
        d = outer.keep(c)
    assert d.count() == 4 and len(outer) == 2 and not any(os.path.exists(urlparse(f).path) for f in outer)
