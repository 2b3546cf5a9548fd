"""Small text formats, snapshot documents and the screener."""

import datetime as dt

from panelwright.operators import screener
from panelwright.sources import files


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_lists_and_maps(spark, tmp_path):
    assert sorted(r.ticker for r in files.seed_list(spark, put(tmp_path, "s.txt", "# head\nabc\n\nXYZ # why\nabc\n")).collect()) == ["ABC", "XYZ"]
    assert sorted(map(tuple, files.last_token_map(spark, put(tmp_path, "m.txt", "Real Estate  XLRE\nEnergy XLE # x\n")).collect())) == [("Energy", "XLE"), ("Real Estate", "XLRE")]


def test_csv_formats(spark, tmp_path):
    out = files.sentinel_csv(spark, put(tmp_path, "c.csv", "DATE,V\n2024-01-02,1.5\n2024-01-03,.\n2024-01-04,2\n"))
    assert [(str(r.date), r.value) for r in out.orderBy("date").collect()] == [("2024-01-02", 1.5), ("2024-01-04", 2.0)]
    text = "junk\nOther block\n20200101, 9\n\nAverage Value\n,A,B\n20240102, 1.0,-99.99\n20240103, 2.0, 3\n\n20240104, 7, 7\n"
    got = {(str(r.date), r.place): r.value for r in files.block_csv(spark, put(tmp_path, "b.csv", text), "Average Value").collect()}
    assert got == {("2024-01-02", 0): 1.0, ("2024-01-02", 1): None, ("2024-01-03", 0): 2.0, ("2024-01-03", 1): 3.0}


def test_sections_and_approvals(spark, tmp_path):
    heads = spark.createDataFrame([("Chips", "semis")], "header string, theme string")
    members, unknown = files.sectioned_list(spark, put(tmp_path, "t.txt", "Chips:\naaa\nbbb\naaa\n\nOdd:\nccc\n"), heads)
    assert sorted(map(tuple, members.collect())) == [("semis", "AAA"), ("semis", "BBB")] and [r.header for r in unknown.collect()] == ["Odd"]
    rows = '[{"theme":"semis","ticker":"a","exposure":0.5,"approved_by":"me"},{"theme":"semis","ticker":"b","exposure":1.5,"approved_by":"me"},{"theme":"x","ticker":"c","exposure":0.5,"approved_by":"me"},{"theme":"semis","ticker":"d","exposure":0.5,"approved_by":""}]'
    assert [r.ticker for r in files.approved_members(spark, put(tmp_path, "a.json", rows), heads).collect()] == ["A"]


def test_documents(spark, tmp_path):
    df = spark.createDataFrame([("A", dt.date(2024, 1, 2), 1.0), ("B", None, None)], "ticker string, d date, x double")
    assert tuple(files.write_snapshot(df, f"{tmp_path}/snap").first()) == (2, 2)
    assert sorted(r.d or "" for r in files.read_snapshot(spark, f"{tmp_path}/snap").collect()) == ["", "2024-01-02"]
    files.write_documents(df, f"{tmp_path}/docs")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/docs").collect()) == ['{"ticker":"A","d":"2024-01-02","x":1.0}', '{"ticker":"B"}']
    files.write_documents(df, f"{tmp_path}/shards", "ticker")
    files.write_documents(df.where("ticker = 'A'"), f"{tmp_path}/shards", "ticker")
    assert sorted(p.name for p in (tmp_path / "shards").glob("ticker=*")) == ["ticker=A"]


def test_screener(spark):
    df = spark.createDataFrame([("A", "s", "x,y", "fresh", 2.0), ("B", "s", "x", "stale", 1.0), ("C", "t", "y", "fresh", 3.0), ("D", "s", "", "fresh", None)], "ticker string, sector string, themes string, freshness string, ps double")
    out = [(r.ticker, r.percentile) for r in screener.screener(df, "ps", screener.in_scope("all")).collect()]
    assert out == [("B", None), ("A", 50.0), ("C", 100.0), ("D", None)]
    assert [r.ticker for r in screener.screener(df, "ps", screener.in_scope("theme", "y")).collect()] == ["A", "C"]
    assert [r.ticker for r in screener.screener(df, "ps", screener.in_scope("pinned", ["D"])).collect()] == ["D"]
