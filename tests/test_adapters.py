"""The table function of the adapters against the import's own readers, and what it does with hostile files."""

import json

import pytest
from pyspark.sql import functions as F

from hearthlog.sources import adapters, html_records, json_records

PROFILE = {"profile_v2": {"name": {"full_name": "no text"}, "full_name": "Ann Onym", "username": "ann", "joined_at": 1300000000, "profile_uri": 5, "work": [{"company": "Mill", "start_date": "2001"}, ["Farm", {"x": {"y": "Deep"}}]], "languages": {"list": ["de", "fr"]}}}
POST = {"title": "t", "attachments": [{"data": [{"media": {"uri": "z/2.jpg", "creation_timestamp": 7, "media_metadata": {"width": 3.0, "height": True, "duration": 2}}}]}], "b": {"uri": "a/1.png", "type": "photo", "a": {"uri": "c.gif"}}}
PAGE = "<title>T</title><h1>H</h1><section class='_a6-g'><h2>One</h2><div class='_a6-p'>Text &amp; more<img src='m/1.jpg'></div><a href='https://e.x/'>l</a></section><table><tr><th>k</th><td>v</td></tr></table><section class='_a6-g' data-x='1'><h2>Ünï</h2><div class='_a6-p'>" + "ä" * 70_000
FILES = [
    ("a/profile.json", json.dumps(PROFILE)), ("a/post.JSON", json.dumps(POST)), ("a/list.json", json.dumps([PROFILE["profile_v2"], POST])), ("a/page.html", PAGE), ("a/page.htm", "no cards"), ("a/empty.html", ""), ("a/null.json", None), (None, "{}"),
    ("a/broken.json", "{"), ("a/twice.json", '{"name": "A", "name": "B"}'), ("a/nan.json", '{"name": "A", "x": NaN}'), ("a/text.txt", json.dumps(PROFILE)), ("a/number.json", "5"), ("a/empty.json", ""), ("a/deep.json", "[" * 100_000), ("a/profile.json", json.dumps(PROFILE)),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("part", p, t, k) for k, (p, t) in enumerate(FILES)], "part_path string, path string, text string, k_file int").repartition(3)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_equals_the_import(files):
    texts = files.filter("lower(path) LIKE '%.json'").drop("k_file")
    parsed = json_records.parsed(texts)
    got = adapters.told(texts, "profile")
    assert rows(json_records.profile_table(got)) == rows(json_records.profiles(parsed)) and got.count() == 3
    got = adapters.told(texts, "facts")
    assert rows(json_records.fact_table(got)) == rows(json_records.profile_facts(parsed)) and got.count() > 9
    whole = parsed.filter("v IS NOT NULL").select(F.lit("post").alias("owner_type"), F.col("path").alias("owner_id"), F.col("part_path").alias("archive_part_id"), F.col("path").alias("source_path"), F.lit(0).alias("source_index"), F.col("v").alias("item"))
    own = json_records.references(whole).select("source_path", *json_records.REFERENCE)
    assert rows(adapters.told(texts, "references").select(F.col("path").alias("source_path"), *json_records.REFERENCE)) == rows(own) and own.count() == 6
    pages = html_records.pages(files.filter("path LIKE '%.htm%'").select("path", "text"))
    cards = html_records.cards(pages).drop("page_title", "created_at", "section")
    assert rows(adapters.told(files, "cards").select(*cards.columns)) == rows(cards) and cards.count() == 2
    assert rows(adapters.told(files, "page").select("path", "title", "h1", "links", "media", "rows")) == rows(pages.select("path", "title", "h1", "links", "media", "rows"))


def test_one_query_over_all_files(spark, files):
    adapters.register(spark)
    files.createOrReplaceTempView("all_files")
    found = spark.sql("SELECT f.path, r.ref, length(c.body) AS n FROM all_files f LEFT JOIN LATERAL archive_records(f.path, f.text, 'references') r ON true LEFT JOIN LATERAL archive_records(f.path, f.text, 'cards') c ON true")
    told = {(r["path"], r["ref"], r["n"]) for r in found.collect()}
    assert {p for p, _, _ in told} == {p for p, _ in FILES} and ("a/page.html", None, 70_000) in told and ("a/post.JSON", "z/2.jpg", None) in told and ("a/broken.json", None, None) in told
    assert spark.sql("SELECT * FROM archive_records('x.json', '{\"name\": \"N\"}', 'profile')").first()["display_name"] == "N"


def test_other_kinds_are_refused(spark, files):
    adapters.register(spark)
    with pytest.raises(Exception, match="third argument must be one of"):
        adapters.told(files, "posts").collect()
    with pytest.raises(Exception, match="third argument must be one of"):
        spark.sql("SELECT * FROM range(2), LATERAL archive_records('a', 'b', string(id))").collect()


def test_versions_by_format(spark):
    paths = spark.createDataFrame([("a.json",), ("b.HTM",), ("c.txt",), (None,)], "path string")
    assert [r["v"] for r in paths.select(adapters.version_of(F.col("path")).alias("v")).collect()] == [1, 1, None, None]
    assert adapters.adapter_of("x.JSON").format == "json" and adapters.adapter_of("x.png") is None and adapters.adapter_of(None) is None
