"""Readers and writers round trip, and refuse what has no single answer."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.sources import delimited as D
from millrace.sources import files as L
from millrace.sources import sinks as W
from millrace.sources.collections import run_spec
from millrace.sources.database import limited_sql, require_read_only, split_target


def test_null_words(spark, tmp_path):
    p = tmp_path / "pay.csv"
    labels = ["card"] * 12 + ["None"] * 8 + ["NA"] * 5 + [""] * 2
    p.write_text("method,amount\n" + "\n".join(f"{m},{'NA' if i % 9 == 0 else i}" for i, m in enumerate(labels)) + "\n")
    df = D.type_columns(D.read_delimited(spark, str(p)))
    assert dict(df.dtypes) == {"method": "string", "amount": "bigint"}
    got = {r["method"]: r["count"] for r in df.groupBy("method").count().collect()}
    assert got == {"card": 12, "None": 8, "NA": 5, None: 2}
    assert df.where("amount is null").count() == 3


@pytest.mark.parametrize("text,rows", [
    ("a;b\n1;2\n3;4\n", 2), ("a\tb\n1\t2\n3\t4\n", 2), ("a|b\n1|2\n3|4\n", 2),
    ("Report on sales\n\nregion,units,revenue\nNorth,1,2\nSouth,3,4\n", 2), ('a,b\n"x, y",1\nz,2\n', 2),
])
def test_delimiters_and_titles(spark, tmp_path, text, rows):
    p = tmp_path / "t.csv"
    p.write_text(text)
    df = D.read_delimited(spark, str(p))
    assert len(df.columns) >= 2 and df.count() == rows


def test_json_rules(spark, tmp_path):
    def read(doc):
        p = tmp_path / f"{abs(hash(json.dumps(doc)))}.json"
        p.write_text(json.dumps(doc))
        return L.read_json(spark, str(p))

    flat = read([{"id": 1, "a": {"b": 2, "c": {"d": "x"}}}, {"id": 2, "a": {"b": 3, "c": {"d": "y"}}}])
    assert sorted(flat.columns) == ["a.b", "a.c.d", "id"] and flat.count() == 2
    assert read({"meta": 1, "rows": [{"x": 1}, {"x": 2}]}).count() == 2
    with pytest.raises(L.UnusableTable, match="repeated groups"):
        read([{"id": 1, "lines": [{"x": 1}]}])
    with pytest.raises(L.UnusableTable, match="2 candidate tables"):
        read({"a": [{"x": 1}], "b": [{"x": 1}]})


def test_xml_rules(spark, tmp_path):
    p = tmp_path / "t.xml"
    p.write_text("<all><row><id>1</id><w><a>x</a></w></row><row><id>2</id><w><a>y</a></w></row></all>")
    assert sorted(L.read_xml(spark, str(p)).columns) == ["id", "w.a"]
    q = tmp_path / "u.xml"
    q.write_text("<all><row><id>1</id><l><x>1</x></l><l><x>2</x></l></row><row><id>2</id><l><x>1</x></l></row></all>")
    with pytest.raises(L.UnusableTable):
        L.read_xml(spark, str(q))


def test_unusable(spark):
    with pytest.raises(L.UnusableTable, match="no rows"):
        L.reject_unusable(spark.createDataFrame([], "a int"), "x")


def test_missing_connectors_say_so(spark, tmp_path):
    with pytest.raises(RuntimeError, match="connector"):
        L.read_with_jar(spark, "avro", str(tmp_path))


def test_staged_write(spark, tmp_path):
    target, rows = str(tmp_path / "t"), spark.range(10)
    assert W.staged_write(rows, target, "a") == 10
    assert W.staged_write(rows, target, "a") == 10
    assert W.read_committed(spark, target).count() == 10
    W.staged_write(rows, target, "b")
    assert W.read_committed(spark, target).count() == 20
    with pytest.raises(W.RefusedWrite):
        W.staged_write(rows.where("id < 0"), target, "c", "overwrite")
    W.staged_write(rows.where("id < 3"), target, "d", "overwrite")
    assert W.read_committed(spark, target).count() == 3


def test_ddl_refuses_durations(spark):
    df = spark.sql("select interval '1' day as d")
    with pytest.raises(W.RefusedWrite):
        W.create_table_sql("t", df.schema)


def test_queries_only_read(spark):
    for sql in ("drop table x", "select 1; delete from x", ""):
        with pytest.raises(ValueError):
            require_read_only(sql)
    assert limited_sql("select 1 as a;", 5, "oracle").endswith("ROWNUM <= 5")
    assert split_target("jdbc:postgresql://h/db#query=select%201") == ("jdbc:postgresql://h/db", "query", "select 1")
    with pytest.raises(ValueError):
        run_spec(spark.range(3), {"stages": [{"out": "x"}]})


def test_first_event_rate_limit(spark, tmp_path):
    from millrace.streaming import ingest, sessions

    rows = [("a", i, float(i * 7 % 300)) for i in range(200)] + [("b", 1000, 5.0)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "k string, event_id long, at_s double").coalesce(1).write.parquet(path)
    stream = ingest.file_stream(spark, path, "*.parquet", "k string, event_id long, at_s double")
    out = ingest.run_available(sessions.first_event_limit(stream, "k", "at_s", 10, 60.0), str(tmp_path / "out"))
    got = {r["event_id"] for r in out.where("allowed").collect()}
    want, state = set(), {}
    for k, e, at in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        start, used = state.get(k, (None, 0))
        if start is None or at - start >= 60:
            start, used = at, 0
        if used < 10:
            want.add(e)
            used += 1
        state[k] = (start, used)
    assert got == want


def test_learned_model_beats_noise(spark):
    import random

    from millrace.operators import modelling as M

    rnd = random.Random(1)
    rows = [(rnd.random(), rnd.choice("ab"), 0, rnd.random() < 0.5) for _ in range(400)]
    rows = [(x, c, int(x + (0.3 if c == "a" else 0) > 0.65), int(n)) for x, c, _, n in rows]
    df = spark.createDataFrame(rows, "x double, c string, y int, noise int")
    good = M.panel_scores(M.train_panel(df.drop("noise"), "y", "binary_classification", only=["logistic_regression"]),
                          df.drop("noise"), "y", "binary_classification")
    assert good.where("metric = 'accuracy'").first()["value"] > 0.9
    folds = spark.createDataFrame([("accuracy", v) for v in (0.5, 0.52, 0.47)], "metric string, value double")
    base = M.baselines(df, "noise", "classification")
    assert M.beats_baseline(folds, base, "accuracy").first()["beats_baseline"] is False


def _lines(spark, tmp_path, data: bytes) -> list[tuple]:
    p = tmp_path / "bytes.csv"
    p.write_bytes(data)
    return sorted(tuple(r) for r in D.read_delimited(spark, str(p)).collect())


def test_no_record_is_lost_or_cut(spark, tmp_path):
    assert _lines(spark, tmp_path, b'id,note\n1,"first\nsecond"\n2,"a ""b"""\n') == [("1", "first\nsecond"), ("2", 'a "b"')]
    assert _lines(spark, tmp_path, b"id,note\n1,x\nid,note\n2,y\n") == [("1", "x"), ("2", "y"), ("id", "note")]


def test_encodings(spark, tmp_path):
    wanted = [("1", "“price” 5 €"), ("2", "caf\xe9")]
    text = "id,note\n" + "\n".join(",".join(r) for r in wanted) + "\n"
    for encoding in ("utf-8", "utf-8-sig", "cp1252", "utf-16"):
        assert _lines(spark, tmp_path, text.encode(encoding)) == wanted, encoding


def test_dates_keep_their_time_and_no_cell_is_emptied(spark, tmp_path):
    p = tmp_path / "days.csv"
    p.write_text("id,at,day,most\n" + "".join(f"{i},2024-01-{i:02d} 10:30:00,2024-01-{i:02d},{'soon' if i == 7 else f'2024-01-{i:02d}'}\n" for i in range(1, 29)))
    df = D.type_columns(D.read_delimited(spark, str(p)))
    assert dict(df.dtypes) == {"id": "bigint", "at": "timestamp_ntz", "day": "date", "most": "string"}
    assert str(df.where("id = 1").first()["at"]) == "2024-01-01 10:30:00" and df.where("most = 'soon'").count() == 1


def plain_rows(text, skip):
    """What Python's parser makes of the text below its first ``skip`` lines; empty cells are missing."""
    import csv
    import io

    body = "".join(text.splitlines(keepends=True)[skip:])
    return sorted(tuple(c or None for c in row) for row in csv.reader(io.StringIO(body, newline="")) if row)


@pytest.mark.parametrize("preamble", [0, 3])
def test_records_of_several_lines_are_read_in_splits(spark, tmp_path, preamble):
    import random

    r = random.Random(preamble)
    lines = ['Report "quarterly', "", "made by hand"][:preamble] + ["id,note,more"]
    for i in range(1500):
        note = r.choice(["plain", 'say ""hi""', "two\nlines", "with, comma", "\n\n", "x" * 700, 'open"" and\nclose""', "id,note,more", '""'])
        more = r.choice(["", "5 inch", f"n{i}", '12" pipe', '"q, ""r"""'])
        lines.append(f'{i},"{note}",{more}')
    lines.append("id,note,more")
    text = "\n".join(lines) + "\n"
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.csv").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    spark.conf.set("spark.sql.files.openCostInBytes", "7000")
    try:
        got = D.read_delimited(spark, str(tmp_path / "t"))
        assert got.columns == ["id", "note", "more"]
        assert spark.read.text(str(tmp_path / "t")).rdd.getNumPartitions() > 20
        assert sorted((tuple(x) for x in got.collect()), key=str) == sorted(plain_rows(text, preamble + 1), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_record_over_many_splits_and_an_open_quote(spark, tmp_path, monkeypatch):
    p = tmp_path / "long.csv"
    inner = "\n".join(f"line {i}" for i in range(3000))
    p.write_text(f'a,b\n1,"{inner}"\n2,"x\ny"\n3,z\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = {x.a: x.b for x in D.read_delimited(spark, str(p)).collect()}
        assert rows == {"1": inner, "2": "x\ny", "3": "z"}
        p.write_text(f'a,b\n1,"{inner}\n2,x\n3,z\n')
        monkeypatch.setattr(D, "LONGEST", 8000)
        with pytest.raises(ValueError, match="not closed"):
            D.read_delimited(spark, str(p), delimiter=",")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_the_header_may_span_lines_and_each_file_has_its_own(spark, tmp_path):
    for name, body in (("a", 'x,1\n"y\nz",2\n'), ("b", "w,3\n")):
        (tmp_path / f"{name}.csv").write_bytes(('"na\nme",n\n' + body).encode("cp1252"))
    rows = D.read_delimited(spark, str(tmp_path))
    assert sorted(map(tuple, rows.collect())) == [("w", "3"), ("x", "1"), ("y\nz", "2")] and rows.columns == ["na me", "n"]


def test_writers_at_once_get_different_numbers(spark, tmp_path, monkeypatch):
    """Both have read the ledger before either commits; each record is taken once, and one job is committed once."""
    import threading

    claimed, met = W._claimed, threading.Barrier(2)
    tries = []

    def together(spark, target, number, record):
        if len(tries) < 2:
            tries.append(number)
            met.wait(60)
        else:
            tries.append(number)
        return claimed(spark, target, number, record)

    monkeypatch.setattr(W, "_claimed", together)
    for jobs, rows in ((("a", "b"), 9), (("c", "c"), 13)):
        tries.clear()
        target, results = str(tmp_path / "t"), []
        writers = [threading.Thread(target=lambda j=j, n=n: results.append(W.staged_write(spark.range(n), target, j))) for j, n in zip(jobs, (4, 5) if rows == 9 else (4, 4), strict=True)]
        for w in writers:
            w.start()
        for w in writers:
            w.join()
        assert len(results) == 2 and tries[0] == tries[1] and W.read_committed(spark, target).count() == rows
    numbers = sorted(r["number"] for r in W.ledger(spark, target).collect())
    assert numbers == [1, 2, 3] and not [p for p in (tmp_path / "t" / "ledger").iterdir() if p.name.startswith(".")]


def test_records_left_empty_are_passed_over(spark, tmp_path):
    target = str(tmp_path / "t")
    W.staged_write(spark.range(3), target, "a")
    (tmp_path / "t" / "ledger" / "000000000002.json").write_text("")
    W.staged_write(spark.range(4), target, "b")
    assert W.read_committed(spark, target).count() == 7
    assert {r["number"] for r in W.ledger(spark, target).collect()} == {1, 3}


def test_large_folders_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    rows = spark.range(3000).select("id", F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, F.col("id").cast("string").substr(1, 1)).alias("k"), F.lit(1).alias("_x"))
    monkeypatch.setattr(W, "estimated_bytes", lambda df: 20 * W.FOLDER_BYTES)
    path = tmp_path / "by"
    W.write_files(rows, str(path), by=["k"])
    files = {p.name: len(list(p.glob("*.parquet"))) for p in path.iterdir() if p.is_dir()}
    assert files["k=hot"] > 5 and max(n for k, n in files.items() if k != "k=hot") <= 3
    back = {(r["id"], r["k"]) for r in spark.read.schema("id long, _x int, k string").parquet(str(path)).collect()}
    assert back == {(r["id"], r["k"]) for r in rows.collect()}
    W.write_files(rows.where("id < 0"), str(tmp_path / "none"), by=["k"])
