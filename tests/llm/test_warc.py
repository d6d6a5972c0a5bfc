from datetime import datetime, timedelta

from telemill.llm import warc

T0 = datetime(2024, 1, 1)
SCHEMA = "record_id string, url string, ts timestamp, kind string, status int, headers map<string,string>, digest string, extra int"


def row(i, kind, day, url="http://www.Example.com/a/", status=None, **headers):
    return (i, url, None if day is None else T0 + timedelta(days=day), kind, status or (200 if kind == "response" else 304), {k.replace("_", "-"): v for k, v in headers.items()}, f"d{i}", 1)


def resolve(spark, *rows):
    return {r.record_id: r for r in warc.resolve(spark.createDataFrame(list(rows), SCHEMA)).collect()}


def test_latest_earlier_response_validators_and_headers(spark):
    got = resolve(
        spark,
        row("r1", "response", 0, etag='"a"', content_length="5", cache_control="old", x="kept"),
        row("r2", "response", 5, url="https://example.com/a?utm_source=f#x", etag='W/"b"', content_type="t"),
        row("r3", "response", 6, status=404),
        row("v1", "revisit", 0.2, etag='W/"a"', content_length="0", cache_control="new"),
        row("v2", "revisit", 9, etag='"b"'),
        row("v3", "revisit", 9, etag='"a"'),
        row("v4", "revisit", 9),
        row("v5", "revisit", -1, etag='"a"'),
        row("v6", "revisit", 5, etag='"a"'),
        row("v7", "revisit", 9, url="http://other/"),
        row("v8", "revisit", None),
        row("v9", "revisit", 9, url=None),
    )
    out = {k: (r.outcome, r.response_id) for k, r in got.items()}
    assert out == {
        "v1": ("resolved", "r1"), "v2": ("resolved", "r2"), "v3": ("mismatch", "r2"), "v4": ("unchecked", "r2"), "v5": ("missing", None), "v6": ("resolved", "r1"), "v7": ("missing", None), "v8": ("missing", None), "v9": ("missing", None),
    }
    assert got["v1"].headers == {"etag": 'W/"a"', "content-length": "5", "cache-control": "new", "x": "kept"} and got["v3"].headers is None


def test_modification_dates_stand_in_for_tags(spark):
    got = resolve(spark, row("r", "response", 0, last_modified="m"), row("a", "revisit", 1, last_modified="m", etag='"x"'), row("b", "revisit", 1, last_modified="n"))
    assert (got["a"].outcome, got["b"].outcome) == ("resolved", "mismatch")


def test_ties_and_no_rows(spark):
    got = resolve(spark, row("r1", "response", 0, etag='"x"'), row("r2", "response", 0, etag='"y"'), row("v", "revisit", 3, etag='"y"'))
    assert got["v"].response_id == "r2"
    assert warc.resolve(spark.createDataFrame([], SCHEMA)).count() == 0
