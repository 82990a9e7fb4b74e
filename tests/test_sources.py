import json
import zipfile

import pytest
from pyspark.sql import functions as F

from hearthlog.sources import archives, html_records, json_records, zip_source

PAGE = """<html><head><title>T &amp; x</title><style>.no{}</style></head><body><h1>Me</h1>
<table class="_a6_n"><tr><th>Works at</th><td>Acme</td></tr><tr><td>Lived in</td><td>Here</td></tr></table>
<section class="_a6-g"><h2 class="_a6-h">Ann</h2><div class="_a6-p">Hello <b>you<script>var a = "</p>leak";</script></div><div class="_a72d">May 6, 2024 3:04 PM</div><img src="../media/a%20b.jpg"></section>
<section class="_a6-g" data-post-id="post:1"><h2>Bob</h2><div class="_a6-p">tail"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    home = tmp_path_factory.mktemp("parts")
    posts = [{"timestamp": 1700000000, "title": "One", "data": [{"post": "body"}], "attachments": [{"data": [{"media": {"uri": "m/a.jpg", "mime_type": "image/jpeg"}}, {"media": {"uri": "../../x"}}]}], "comments": [{"comment": "hi", "author": {"id": "5", "name": "E"}}], "reactions": [{"actor": {"name": "F"}}]}, {"timestamp": 1}]
    thread = {"title": "Chat", "participants": [{"name": "A"}, {"name": "B"}], "messages": [{"sender_name": "C", "timestamp_ms": 1700000000000, "content": "yo"}, {"sender_name": "A"}]}
    files = {
        "one.zip": {"your_activity/posts/your_posts__1.json": json.dumps(posts), "a/posts/page.html": PAGE, "profile_information/profile.json": json.dumps({"profile_v2": {"name": "Me", "work": [{"company": "Acme"}]}})},
        "two.zip": {"messages/inbox/ab_1/message_1.json": json.dumps(thread), "friends/your_friends.json": json.dumps({"friends_v2": [{"name": "Zed", "timestamp": 1}]}), "m/a.jpg": "x", "comments/c.html": PAGE, "albums/albums.json": json.dumps([{"name": "Alb", "photos": [{"uri": "m/a.jpg"}]}, {"photos": []}]), "bad.json": "{"},
    }
    for name, entries in files.items():
        with zipfile.ZipFile(home / name, "w") as z:
            for path, text in entries.items():
                z.writestr(path, text)
    (home / "three.zip").write_bytes(b"no zip")
    return str(home)


def test_listing(spark, folder):
    listing = zip_source.read_zips(spark, folder).cache()
    assert listing.filter("error IS NOT NULL").count() == 1
    good = listing.filter("path IS NOT NULL")
    assert {(r["section"], r["format"]) for r in archives.candidates(good).collect()} == {("posts", "json"), ("profile", "json"), ("messages", "json"), ("connections", "json"), ("comments", "html"), ("albums", "json")}
    assert archives.detect(good).first()["format"] == "mixed"
    assert archives.manifests(listing).count() == 2 and len(archives.set_fingerprint(archives.manifests(listing)).first()["fingerprint"]) == 8
    wanted = spark.createDataFrame([("x/m/a.jpg",), ("none.png",)], "path string")
    assert {r["path"]: (r["part_path"] or "")[-7:] for r in archives.media_owners(wanted, good).collect()} == {"x/m/a.jpg": "two.zip", "none.png": ""}


def test_json(spark, folder):
    files = json_records.parsed(zip_source.read_zips(spark, folder, "texts").filter("format = 'json'").select("part_path", "path", "text")).cache()
    assert files.filter("v IS NULL").count() == 1
    posts = json_records.posts(files.filter("path LIKE '%posts__1%'")).cache()
    assert [(r["title"], r["body"], r["created_at"], r["author_id"]) for r in posts.collect()] == [("One", "body", "2023-11-14T22:13:20.000Z", "owner")]
    assert [(r["body"], r["author_id"]) for r in json_records.post_comments(posts).collect()] == [("hi", "person:facebook:5")]
    assert [(r["kind"], r["person_name"]) for r in json_records.post_reactions(posts).collect()] == [("Like", "F")]
    owners = lambda df, kind: df.drop("owner_id").withColumn("owner_type", F.lit(kind)).withColumnRenamed("id", "owner_id")
    refs = json_records.references(owners(posts, "post"))
    assert [(r["path"], r["media_type"], r["mime_type"]) for r in json_records.media(refs).collect()] == [("m/a.jpg", "photo", "image/jpeg")]
    assert [r["message"] for r in json_records.unsafe_references(refs).collect()] == ["suspicious media path skipped (../../x)"]
    chat = files.filter("path LIKE 'messages/%'")
    messages = json_records.messages(chat)
    assert [(r["sender_name"], r["body"]) for r in messages.collect()] == [("C", "yo")]
    c = json_records.conversations(chat, messages).first()
    assert (c["title"], c["participant_names"], c["is_group"]) == ("Chat", ["A", "B", "C"], True)
    assert [(r["display_name"], r["relationship_type"]) for r in json_records.connections(files.filter("path LIKE 'friends/%'")).collect()] == [("Zed", "friend")]
    albums = json_records.albums(files.filter("path LIKE 'albums/%'"))
    assert [r["title"] for r in albums.collect()] == ["Alb"] and [r["path"] for r in json_records.media(json_records.references(owners(albums, "album"))).collect()] == ["m/a.jpg"]
    profile = files.filter("path LIKE 'profile%'")
    assert json_records.profiles(profile).first()["display_name"] == "Me"
    assert [(r["category"], r["label"], r["value"]) for r in json_records.profile_facts(profile).collect()] == [("Work", None, "Acme")]


@pytest.mark.parametrize(
    "document, want",
    [
        ({"jobs": [{"company": "A", "type": "full"}, "B"], "family": {"mother": {"name": "M"}, "timestamp": 5}}, [("Work", "full", "A"), ("Work", None, "B"), ("Family", "mother", "M")]),
        ({"languages": 7, "websites": [[" x "]], "hometown": {"deep": {"deeper": {"a": {"b": {"c": "lost"}}}}}}, [("Languages", None, "7"), ("Websites", None, "x")]),
    ],
)
def test_facts_at_any_depth(spark, document, want):
    files = json_records.parsed(spark.createDataFrame([("p", "x.json", json.dumps({"profile_v2": {"name": "N"} | document}))], "part_path string, path string, text string"))
    assert {(r["category"], r["label"], r["value"]) for r in json_records.profile_facts(files).collect()} == set(want)


def test_html(spark):
    files = spark.createDataFrame([("a/posts/page.html", PAGE), ("comments/c.html", PAGE), ("profile_information/p.html", PAGE), ("x.html", None)], "path string, text string")
    pages = html_records.pages(files).cache()
    p = pages.filter("path = 'a/posts/page.html'").first()
    assert (p["title"], p["h1"], len(p["cards"]), p["rows"]) == ("T & x", "Me", 2, [["Works at", "Acme"], ["Lived in", "Here"]])
    assert "leak" not in str(p["cards"]) and p["cards"][0]["body"] == "Hello you" and p["cards"][1]["body"] == "tail"
    records = html_records.records(html_records.cards(pages))
    assert [(r["title"], r["created_at"]) for r in records["posts"].orderBy("source_index").collect()] == [("Ann", "2024-05-06T15:04:00.000Z"), ("Bob", None)]
    assert [r["post_id"] for r in records["comments"].collect()] == ["post:1"] and records["warnings"].first()["n"] == 1
    assert [(r["category"], r["value"]) for r in html_records.profile_facts(pages).orderBy("source_index").collect()] == [("work", "Acme"), ("places_lived", "Here")]
