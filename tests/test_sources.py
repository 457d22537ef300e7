import json

from rankweave.sources import sinks


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "x,y"), ("2", None)], "id string, name string")
    sinks.write_csv(df, str(tmp_path / "c"), ["name", "id"])
    back = sinks.read_csv(spark, str(tmp_path / "c"))
    assert back.columns == ["name", "id"] and sorted(r.id for r in back.collect()) == ["1", "2"]


def test_result_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"keyword": "k",\n "results": [{"position": 1, "url": "u"}, {"position": 2, "url": "v"}]}')
    got = sinks.read_results(spark, str(tmp_path / "a.json"))
    assert sorted((r.keyword, r.position, r.url) for r in got.collect()) == [("k", 1, "u"), ("k", 2, "v")]


def test_jsonl_files_are_bounded(spark, tmp_path):
    sinks.write_jsonl(spark.range(10).coalesce(1), str(tmp_path / "j"), 3)
    assert len(list((tmp_path / "j").glob("part-*"))) == 4
    assert spark.read.json(str(tmp_path / "j")).count() == 10


def test_dated_lines(spark):
    df = spark.createDataFrame([(1, "2024/01/02,80,good, really\nbad line\n-,x,fine\n2024/01/03,5,")], "id long, payload string")
    got = sinks.parse_dated_lines(df, "payload").collect()
    assert [(r.date, r.score, r.text) for r in got] == [("2024/01/02", 80, "good, really"), ("-", None, "fine")]


def test_jsonl_files_are_bounded_by_bytes(spark, tmp_path):
    rows = [(i, "x" * (i * 37 % 90)) for i in range(60)]
    sinks.write_jsonl_by_bytes(spark.createDataFrame(rows, "id long, t string").repartition(3), str(tmp_path / "b"), ["id"], 400)
    found = [next((tmp_path / "b" / f"file_no={k}").glob("part-*")).read_text() for k in range(1, 1 + len(list((tmp_path / "b").glob("file_no=*"))))]
    assert all(len(x.encode()) <= 400 for x in found) and len(found) > 5
    assert [json.loads(line)["id"] for x in found for line in x.splitlines()] == list(range(60))
    assert all(len(a.encode()) + len(b.splitlines()[0].encode()) + 1 > 400 for a, b in zip(found, found[1:]))


def test_gzip_pages_round_trip(spark, tmp_path):
    rows = [("a", 1, "<p>é</p>"), ("b", 2, None), ("a", 3, "")]
    df = spark.createDataFrame(rows, "c string, k long, h string")
    for _ in range(2):  # a second run replaces the files
        sinks.write_gzip_pages(df.repartition(2), f"file://{tmp_path}/g", "c", "k", "h")
    assert sorted(map(tuple, sinks.read_gzip_pages(spark, f"file://{tmp_path}/g").collect())) == [("a", "1", "<p>é</p>"), ("a", "3", ""), ("b", "2", "")]


def test_csv_keeps_quotes_and_line_breaks(spark, tmp_path):
    df = spark.createDataFrame([("1", 'say "hi", then\ngo \\ on'), ("2", None)], "id string, t string")
    sinks.write_csv(df, str(tmp_path / "q"), ["t", "id"])
    assert sorted((r.id, r.t) for r in sinks.read_csv(spark, str(tmp_path / "q"), multi_line=True).collect()) == [("1", 'say "hi", then\ngo \\ on'), ("2", None)]
