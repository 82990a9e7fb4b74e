"""An archive of three parts, from ZIP files to pages and hits."""

import json
import zipfile

import pytest

from hearthlog.plans import archive_import
from hearthlog.store import ArchiveStore

POSTS = [
    {"timestamp": 1700000000, "title": "One", "data": [{"post": "body"}], "attachments": [{"data": [{"media": {"uri": "m/a.jpg", "mime_type": "image/jpeg"}}, {"media": {"uri": "../../x.jpg"}}]}], "comments": [{"comment": "hi", "author": {"id": "5", "name": "E"}, "timestamp": 1700000100}], "reactions": [{"actor": {"name": "F"}, "reaction": "Love"}]},
    {"timestamp": 1},
    {"attachments": [{"data": [{"media": {"uri": "m/b.mp4"}}]}], "author": {"id": 9, "name": "Nine"}},
]
THREAD = {"title": "Chat", "participants": [{"name": "A"}, {"name": "B"}], "messages": [{"sender_name": "C", "timestamp_ms": 1700000000000, "content": "yo", "photos": [{"uri": "m/p.png", "creation_timestamp": 1700000000}]}, {"sender_name": "A"}]}
PROFILE = {"profile_v2": {"name": "Me", "id": 77, "username": "me.me", "work": [{"company": "Acme", "start_timestamp": 1700000000}], "languages": ["de", {"name": "en"}], "registration_timestamp": 1600000000}}
CHAT = """<html><head><title>T</title></head><body><h1>Chat two</h1>
<section class="_a6-g"><h2 class="_a6-h _a6-i">Ann</h2><div class="_a6-p">Hello you</div><div class="_a72d">May 6, 2024 3:04 PM</div><img src="../../../m/h.jpg"></section>
<section class="_a6-g"><h2 class="_a6-h _a6-i">Bea</h2><div class="_a6-p">Hi</div></section></body></html>"""
WALL = CHAT.replace("Hello you", "Post text 3 comments").replace('<section class="_a6-g">', '<section class="_a6-g" data-reaction-type="Wow" data-actor="Zoe" data-comment="nice" data-comment-author="Yan">', 1)
ALBUM = "<h1>Trip</h1><img src='../m/1.jpg'><img src='../m/1.jpg'><video src='../m/2.mp4'></video><section class='_a6-g'><div class='_a6-p'>cap</div><img src='../m/3.jpg'></section>"
OWNER = "<h1>Owner</h1><table><tr><th>Works at</th><td>Acme</td></tr><tr><th>Name</th><td>O N</td></tr></table>"
PARTS = {
    "one.zip": {"your_activity/posts/your_posts__1.json": POSTS, "profile_information/profile.json": PROFILE, "a/comments/c.json": {"comments_v2": [{"data": [{"comment": {"comment": "deep"}}], "timestamp": 1700000200}]}, "bad/posts/x.json": "{"},
    "two.zip": {"a/messages/inbox/ab_1/message_1.json": THREAD, "a/messages/inbox/ab_1/message_2.json": {"messages": [{"sender_name": "D", "content": "late"}]}, "connections/friends.json": {"friends_v2": [{"name": "Zed", "timestamp": 1}], "blocked": [{"name": "Bad"}]}, "albums/albums.json": [{"name": "Alb", "photos": [{"uri": "m/a.jpg"}, {"uri": "m/c.jpg"}]}, {"photos": []}]},
    "three.zip": {"a/messages/inbox/two_2/message_1.html": CHAT, "your_facebook_activity/posts/your_posts_1.html": WALL, "photos/album/0.html": ALBUM, "profile_information/p.html": OWNER},
}


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("archive")
    for name, files in PARTS.items():
        with zipfile.ZipFile(home / name, "w") as z:
            for path, x in files.items():
                z.writestr(path, x if isinstance(x, str) else json.dumps(x))
    (home / "four.zip").write_bytes(b"no zip")
    store = ArchiveStore(spark, str(home / "store"))
    told = {r["part_path"].rsplit("/", 1)[1]: r for r in archive_import.import_archive(store, str(home)).collect()}
    return store, told, str(home)


def test_import(archive):
    s, told, home = archive
    assert {n: (r["taken"], r["warnings"]) for n, r in told.items()} == {"one.zip": (True, ["malformed-json: 1", "unsafe-path: 1"]), "two.zip": (True, []), "three.zip": (True, []), "four.zip": (False, ["unreadable-part: 1"])}
    rows = lambda t, *cs: {tuple(r[c] for c in cs) for r in s.table(t).collect()}
    assert rows("posts", "author_id", "title", "body", "created_at") == {("owner", "One", "body", "2023-11-14T22:13:20.000Z"), ("person:facebook:9", None, None, None), ("owner", "Ann", "Post text 3 comments", "2024-05-06T15:04:00.000Z"), ("owner", "Bea", "Hi", None)}
    assert rows("comments", "author_name", "body") == {("E", "hi"), (None, "deep"), ("Yan", "nice")} and rows("reactions", "person_name", "kind") == {("F", "Love"), ("Zoe", "Wow")}
    assert rows("connections", "display_name", "relationship_type") == {("Zed", "friend"), ("Bad", "blocked")}
    assert rows("conversations", "title", "is_group") == {("Chat", True), ("Chat two", False)} and {tuple(r["participant_names"]) for r in s.conversations.collect()} == {("A", "B", "C", "D"), ("Ann", "Bea")}
    assert rows("messages", "sender_name", "body") == {("C", "yo"), ("D", "late"), ("Ann", "Hello you"), ("Bea", "Hi")}
    assert rows("media", "path", "owner_type") == {("m/a.jpg", "post"), ("m/b.mp4", "post"), ("m/a.jpg", "album"), ("m/c.jpg", "album"), ("m/p.png", "message"), ("a/m/h.jpg", "message"), ("photos/m/1.jpg", "album"), ("photos/m/2.mp4", "album"), ("photos/m/3.jpg", "album")}
    assert rows("albums", "title") == {("Alb",), ("Trip",)} and s.album_media.count() == 5
    assert rows("profile_facts", "category", "value") == {("Work", "Acme"), ("Languages", "de"), ("Languages", "en"), ("work", "Acme")}
    people = {r["id"]: r for r in s.people.collect()}
    assert (people["owner"]["display_name"], people["owner"]["username"], people["owner"]["is_archive_owner"], people["owner"]["last_seen"]) == ("Me", "me.me", True, "2024-05-06T15:04:00.000Z")
    assert people["person:messenger:conversation-ab-1:c"]["first_seen"] == "2023-11-14T22:13:20.000Z" and people["person:facebook:5"]["identity_confidence"] == "exact" and len(people) == 14


def test_reading_what_was_imported(archive):
    s, _, home = archive
    assert s.search_page("yo").preparing
    s.run_derived()
    newest = s.posts_page(limit=2).items
    assert [(p["title"], p["author_name"], p["comment_count"], len(p["media"])) for p in newest] == [("Ann", "Me", 1, 0), ("One", "Me", 1, 1)] and newest[1]["comments"][0]["body"] == "hi"
    assert "Work: Acme" in [r["summary"] for r in s.activity_page(limit=50).items] and s.profile()["facebook_id"] == "77"
    assert [r["entity_type"] for r in s.search("yo")] == ["message"] and [m["path"] for m in s.messages_page("conversation:ab-1").items[0]["media"]] == ["m/p.png"]
    assert [r["taken"] for r in archive_import.import_archive(s, home).collect()] == [False] * 4
