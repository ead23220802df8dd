import datetime as dt

from xylem.llm import urls

D = dt.date


def test_entries_hold_while_they_are_listed(spark):
    entries = spark.createDataFrame(
        [("a", "bad.org", "add", D(2024, 1, 10)), ("a", "bad.org", "remove", D(2024, 2, 1)), ("a", "BAD.org", "add", D(2024, 3, 1)), ("b", "x.bad.org", "add", D(2024, 1, 1)), ("b", "x.bad.org", "remove", D(2024, 1, 1)), ("c", "ok.com/en", "add", D(2024, 1, 1)), (None, "bad.org", "add", D(2020, 1, 1)), ("d", None, "add", D(2020, 1, 1)), ("d", "org", "add", None), ("e", "never.com", "remove", D(2020, 1, 1))],
        "list string, key string, action string, listed date",
    )
    cases = [("https://x.bad.org/p", D(2024, 1, 9), 0, None), ("https://x.bad.org/p", D(2024, 1, 10), 1, "bad.org"), ("http://u:p@BAD.ORG:80?q", D(2024, 1, 31), 1, "bad.org"), ("http://bad.org", D(2024, 2, 1), 0, None), ("http://bad.org", D(2024, 3, 1), 1, "bad.org"), ("http://notbad.org", D(2024, 3, 1), 0, None), ("https://ok.com/en/7", D(2024, 1, 1), 1, "ok.com/en"), ("https://ok.com/english", D(2024, 1, 1), 0, None), ("no url", D(2024, 1, 1), 0, None), (None, D(2024, 1, 1), 0, None), ("http://bad.org", None, 0, None), ("", D(2024, 1, 1), 0, None), ("https://x.bad.org/p", D(2024, 1, 10), 1, "bad.org")]
    rows = [(i % 12, u, t, 1, "k") for i, (u, t, *_) in enumerate(cases)]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched date, row long, key string")
    got = sorted((r.page_id, r.blocked, r.key or "") for r in urls.judge(captures, entries).collect())
    assert got == sorted((i % 12, blocked, key or "") for i, (_, _, blocked, key) in enumerate(cases))
    assert urls.judge(captures.limit(0), entries).collect() == []
    assert {r.blocked for r in urls.judge(captures, entries.limit(0)).collect()} == {0}


def test_plan_has_no_python(spark):
    captures = spark.createDataFrame([(1, "http://a.b", D(2024, 1, 1))], "page_id long, url string, fetched date")
    entries = spark.createDataFrame([("a", "b", "add", D(2024, 1, 1))], "list string, key string, action string, listed date")
    plan = urls.judge(captures, entries)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
