import pytest
from pyspark.sql import functions as F

from hearthlog.functions import scalars as S
from hearthlog.operators import paging


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("1700000000", "2023-11-14T22:13:20.000Z"), ("1700000000000", "2023-11-14T22:13:20.000Z"), ("2024-05-06", "2024-05-06T00:00:00.000Z"),
        ("2024", "2024-01-01T00:00:00.000Z"), ("05/06/2024", None), ("not-a-date", None), (None, None), ("2024-02-31", None),
    ],
)
def test_parse_time(spark, raw, want):
    assert one(spark, S.parse_time(F.col("c")), c=raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [("May 6, 2024", "2024-05-06T00:00:00.000Z"), ("6 May 2024 15:04", "2024-05-06T15:04:00.000Z"), ("Sept 30, 2019 at 12:05:09 AM", "2019-09-30T00:05:09.000Z"), ("soon", None)],
)
def test_parse_human_date(spark, raw, want):
    assert one(spark, S.parse_human_date(F.col("c")), c=raw) == want


def test_fnv(spark):
    assert one(spark, S.fnv1a32(F.col("c")), c="abc") == "1a47e90b"
    assert one(spark, S.fnv1a32(F.col("c")), c="") == "811c9dc5"


@pytest.mark.parametrize(
    "ref, want",
    [("../media/a%20b.jpg", "media/a b.jpg"), ("../../escape.jpg", None), ("https://x.example/a", None), ("javascript:alert(1)", None), ("//host/a", None), ("./a+b.png?x=1#y", "posts/a+b.png")],
)
def test_resolve_path(spark, ref, want):
    assert one(spark, S.resolve_path(F.lit("posts/page.html"), F.col("c")), c=ref) == want


@pytest.mark.parametrize("path, bad", [("/abs", True), ("C:/x", True), ("a/../../b", True), ("a/b.jpg", False), ("a..b/c", False)])
def test_suspicious(spark, path, bad):
    assert one(spark, S.suspicious_path(F.col("c")), c=path) is bad


def test_like_has_wildcards_and_no_escape(spark):
    assert one(spark, S.contains_ci(F.col("c"), "A_C"), c="xabcx")
    assert one(spark, S.contains_ci(F.col("c"), "a\\b"), c="A\\B")
    assert not one(spark, S.contains_ci(F.col("c"), "ä"), c="Ä")


def test_urls(spark):
    assert one(spark, S.safe_profile_url(F.col("c")), c="https://www.facebook.com/a") == "https://www.facebook.com/a"
    for bad in ("http://www.facebook.com/a", "https://evil.example/facebook.com", "https://u:p@facebook.com/a"):
        assert one(spark, S.safe_profile_url(F.col("c")), c=bad) is None


def test_cursors():
    c = paging.encode_cursor(key="2024-01-01", id="post:é")
    assert paging.decode_cursor(c, "key", "id") == {"key": "2024-01-01", "id": "post:é"}
    assert paging.decode_cursor("%%%", "key") is None and paging.decode_cursor(None, "key") is None and paging.decode_cursor(paging.encode_cursor(key=1), "id") is None
    assert [paging.clamp(x) for x in (None, 0, 7, 1000)] == [20, 1, 7, 100]


def test_pages_follow_each_other(spark):
    posts = spark.createDataFrame([(f"post:{i}", f"2024-01-0{i + 1}" if i else None) for i in range(5)], "id string, created_at string")
    first = paging.page(posts, F.col("created_at"), limit=2)
    second = paging.page(posts, F.col("created_at"), limit=2, cursor=first.next_cursor)
    third = paging.page(posts, F.col("created_at"), limit=2, cursor=second.next_cursor)
    assert [[r["id"] for r in p.items] for p in (first, second, third)] == [["post:4", "post:3"], ["post:2", "post:1"], ["post:0"]]
    assert first.has_more and not third.has_more and third.next_cursor is None
