"""Imports and builds that stop and go on, damaged and duplicate parts, media across parts, and two writers."""

import json
import shutil
import zipfile

import pytest

from hearthlog.plans import archive_import
from hearthlog.schemas import SCHEMAS
from hearthlog.store import BOOKS, DERIVED, ArchiveStore, Interrupted

PEOPLE = [{"name": "Multipart User"}, {"name": "Archive Friend"}]


def pack(path, files):
    with zipfile.ZipFile(path, "w") as z:
        for name, x in files.items():
            z.writestr(name, x if isinstance(x, str) else json.dumps(x))


def told(df):
    return {r["part_path"].rsplit("/", 1)[1]: r for r in df.collect()}


def dump(store, names):
    return {n: sorted(map(str, store.table(n).collect())) for n in names}


def test_damaged_and_duplicate_parts(spark, tmp_path):
    zips = tmp_path / "zips"
    zips.mkdir()
    pack(zips / "valid-part.zip", {"profile_information/profile_information.json": {"profile_v2": {"name": "Resilient User"}}, "your_facebook_activity/posts/your_posts.json": [{"title": "Valid part survives", "data": [{"post": "text"}]}]})
    shutil.copy(zips / "valid-part.zip", zips / "valid-part-copy.zip")
    (zips / "broken-part.zip").write_text("not a ZIP archive")
    pack(zips / "holiday.zip", {"documents/tax.pdf": "x"})
    s = ArchiveStore(spark, str(tmp_path / "s"))
    got = told(archive_import.import_archive(s, str(zips)))
    taken = {n for n, r in got.items() if r["taken"]}
    assert len(taken & {"valid-part.zip", "valid-part-copy.zip"}) == 1 == len(taken)
    assert got["broken-part.zip"]["warnings"] == ["unreadable-part: 1"] and ["duplicate-part: 1"] in [got[n]["warnings"] for n in ("valid-part.zip", "valid-part-copy.zip")]
    messages = {r["message"] for r in s.table("warnings").collect()}
    assert any(m.startswith("broken-part.zip: ZIP could not be inspected") for m in messages) and any("duplicate ZIP part selected" in m for m in messages) and any(m.startswith("holiday.zip: unsupported") for m in messages)
    assert [r["title"] for r in s.posts_page().items] == ["Valid part survives"]
    assert {(r["section"], r["status"], r["records"]) for r in s.coverage().collect()} == {("posts", "imported", 1), ("profile", "imported", 1)}
    assert {(r["filename"], r["status"]) for r in s.archive_status().collect()} == {(next(iter(taken)), "complete"), (None, "failed")}


def test_media_across_parts_and_reconnection(spark, tmp_path):
    zips = tmp_path / "zips"
    zips.mkdir()
    photo = lambda uri: {"media": {"uri": uri, "mime_type": "image/jpeg"}}
    chat = lambda text, at: {"title": "Shared multipart chat", "participants": PEOPLE, "messages": [{"sender_name": "Archive Friend", "timestamp_ms": at, "content": text}]}
    pack(zips / "1.zip", {"profile_information/profile_information.json": {"profile_v2": {"name": "Multipart User"}}, "your_facebook_activity/posts/your_posts__1.json": [{"timestamp": 1700000100, "title": "Part one post", "attachments": [{"data": [photo("photos/cross-part.jpg"), photo("photos/local-part.jpg"), photo("photos/twice.jpg"), photo("photos/none.jpg")]}]}], "photos/local-part.jpg": "a", "photos/twice.jpg": "b"})
    pack(zips / "2.zip", {"messages/inbox/shared_chat/message_1.json": chat("Message chunk one", 1700000200000), "photos/cross-part.jpg": "c", "x/photos/twice.jpg": "d"})
    pack(zips / "3.zip", {"messages/inbox/shared_chat/message_2.json": chat("Message chunk two", 1700000300000)})
    s = ArchiveStore(spark, str(tmp_path / "s"))
    archive_import.import_archive(s, str(zips))
    ids = {r["filename"]: r["part_id"] for r in s.table("parts").collect()}
    owners = lambda: {r["filename"]: (r["owner_part"], r["connected"]) for r in s.media_sources().collect()}
    assert owners() == {"cross-part.jpg": (ids["2.zip"], True), "local-part.jpg": (ids["1.zip"], True), "twice.jpg": (None, False), "none.jpg": (None, False)}  # two parts have a file that ends so
    assert s.conversations.count() == 1 and [m["body"] for m in s.messages_page("conversation:shared-chat").items] == ["Message chunk two", "Message chunk one"]
    for order in ((1, 2, 0), (0, 2, 1)):
        s.connect({p: None for p in ids.values()})
        assert not any(connected for _, connected in owners().values())
        back = tmp_path / f"back-{order[0]}"
        back.mkdir()
        names = ["1.zip", "2.zip", "3.zip"]
        for k in order[:2]:
            shutil.copy(zips / names[k], back / f"renamed-{k}.zip")
        shutil.copy(zips / names[order[0]], back / "zz-copy.zip")
        pack(back / "other.zip", {"friends/friends.json": []})
        r = archive_import.reconnect(s, str(back))
        assert (r["matched"], r["missing"], r["duplicates"], r["unexpected"]) == (2, 1, 1, 1)
        assert {n for n, (_, there) in owners().items() if there} == ({"cross-part.jpg"} if 1 in order[:2] else set()) | ({"local-part.jpg"} if 0 in order[:2] else set())
        shutil.copy(zips / names[order[2]], back / "last.zip")
        assert archive_import.reconnect(s, str(back))["missing"] == 0 and all(there for n, (_, there) in owners().items() if n not in ("none.jpg", "twice.jpg"))


def test_an_import_goes_on_behind_its_last_batch(spark, tmp_path):
    zips = tmp_path / "zips"
    zips.mkdir()
    pack(zips / "part-1.zip", {"profile_information/profile_information.json": {"profile_v2": {"name": "Resume User"}}, "your_facebook_activity/posts/your_posts.json": [{"title": "Resume post"}]})
    say = lambda k: {"title": "Resumable chat", "participants": PEOPLE, "messages": [{"sender_name": "A", "timestamp_ms": 1700000000000 + k, "content": f"Resumable message {k}"}]}
    pack(zips / "part-2.zip", {f"messages/inbox/resume_chat/message_{k}.json": say(k) for k in range(1, 1201)} | {"messages/inbox/resume_chat/message_1201.json": "{"})
    s = ArchiveStore(spark, str(tmp_path / "s"))
    asked = iter([False, True])
    first = told(archive_import.import_archive(s, str(zips), batch_files=700, stop=lambda: next(asked)))
    assert (first["part-1.zip"]["taken"], first["part-2.zip"]["taken"]) == (True, False)
    assert {r["filename"]: r["status"] for r in s.archive_status().collect()} == {"part-1.zip": "complete", "part-2.zip": "interrupted"}
    assert s.table("files").count() == 700 and s.messages.count() == 698 and not s.session()["complete"]
    done = {r["path"] for r in s.table("files").collect()}
    again = told(archive_import.import_archive(s, str(zips), batch_files=700))
    assert (again["part-1.zip"]["taken"], again["part-2.zip"]["taken"]) == (False, True) and again["part-2.zip"]["warnings"] == ["malformed-json: 1"]
    assert s.messages.count() == 1200 and s.table("files").count() == 1202 and s.session()["complete"] and s.conversations.count() == 1
    read = spark.read.parquet(f"{s.root}/staged/*/wanted").groupBy("path").count().filter("count > 1").collect()
    assert not done & {r["path"] for r in read}  # a file that was committed isn't read again; the 502 others were only planned before
    assert [m["body"] for m in s.messages_page("conversation:resume-chat", limit=1).items] == ["Resumable message 1200"]


def filled(spark, root):
    s = ArchiveStore(spark, root)
    made = lambda t, *rows: spark.createDataFrame([tuple(r.get(f) for f in SCHEMAS[t].names) for r in rows], SCHEMAS[t])
    posts = [{"id": f"post:{i:03}", "author_id": "person:1", "body": f"lake number {i}", "created_at": f"2024-03-05T10:00:{i % 60:02}.000Z"} for i in range(300)]
    people = [{"id": "person:1", "display_name": "Ann"}, {"id": "person:2", "display_name": "bob"}]
    s.import_part("p1", {"people": made("people", *people), "posts": made("posts", *posts), "comments": made("comments", *[{"id": f"c:{i}", "post_id": "post:000", "body": "nice", "created_at": "2024-04-01T00:00:00.000Z"} for i in range(40)])})
    return s, made


def test_builds_go_on_after_every_commit(spark, tmp_path):
    s, made = filled(spark, str(tmp_path / "a"))
    whole, _ = filled(spark, str(tmp_path / "b"))
    whole.run_derived()
    for kind in ("activity", "search"):
        turns = 0
        while True:
            asked = iter([False])
            try:
                s.build(kind, window_rows=120, stop=lambda: next(asked, True))  # noqa: B023
                break
            except Interrupted:
                turns += 1
                assert s.derived_status()[kind] == "interrupted" and s.table("ledger" if kind == "activity" else "postings").count() == 0
        assert turns > 2
    assert dump(s, DERIVED) == dump(whole, DERIVED)
    steps = [(c["job"]["kind"], c["job"]["phase"], c["job"]["cursor"]) for c in s.log.all() if c["job"] and c["tables"]]
    assert len(steps) == len(set(steps)) and len([x for x in steps if x[1] == "posts" and x[0] == "activity"]) == 3
    assert s.build("activity")["status"] == "complete" and len(s.log.all()) == len([*s.log.all()])
    # records that change make a build start anew, and `force` does
    job = s.job("activity")["id"]
    s.import_part("p2", {"posts": made("posts", {"id": "post:new", "body": "late", "created_at": "2024-05-01T00:00:00.000Z"})})
    assert s.derived_status() == {"activity": "pending", "search": "pending"}
    assert s.run_derived()["ledger"] == 341 and s.job("activity")["id"] != job
    job = s.job("activity")["id"]
    assert s.build("activity", force=True)["id"] != job and s.table("ledger").count() == 341


def test_two_writers(spark, tmp_path):
    one, made = filled(spark, str(tmp_path / "a"))
    two = ArchiveStore(spark, str(tmp_path / "a"))
    post = lambda k: {"posts": made("posts", {"id": f"post:w{k}", "body": "x"})}
    lost = []

    def between(write, number, commit):  # another writer commits just before
        if not lost:
            lost.append(True)
            assert two.import_part("p9", post(9))
        return write(number, commit)

    take = one.log.take
    one.log.take = lambda n, c: between(take, n, c)
    assert one.import_part("p8", post(8))  # different parts: both stay
    assert lost and {"post:w8", "post:w9"} <= {r["id"] for r in one.posts.collect()} and one.is_final("p8") and one.is_final("p9")
    lost.clear()
    assert not one.import_part("p9", post(7))
    one.log.take = lambda n, c: (two.import_part("p10", post(10)) if not lost and not lost.append(True) else None, take(n, c))[1]
    assert not one.import_part("p10", post(11))  # the same part: the first wins
    ids = {r["id"] for r in ArchiveStore(spark, one.root).posts.collect()}
    assert "post:w10" in ids and not ids & {"post:w7", "post:w11"}
    # what is compacted while another part arrives loses nothing, and a pinned archive doesn't see it
    pinned = one.pinned()
    lost.clear()
    one.log.take = lambda n, c: (two.import_part("p12", post(12)) if c["same"] and not lost and not lost.append(True) else None, take(n, c))[1]
    one.compact()
    assert lost and one.posts.count() == 304 and len(one._generations("posts")) == 1 and pinned.posts.count() == 303
    numbers = [c["generation"] for c in one.log.all()]
    assert numbers == list(range(1, len(numbers) + 1))
    with pytest.raises(ValueError):
        pinned.mark_part("p1", "failed")
    assert set(BOOKS) & set(SCHEMAS) == set()


def test_profiles_fill_what_earlier_ones_lack(spark, tmp_path):
    s, made = filled(spark, str(tmp_path / "a"))
    s.import_part("p2", {"profiles": made("profiles", {"id": "profile:owner", "display_name": "First", "source_path": "b", "source_index": 1})})
    s.import_part("p3", {"profiles": made("profiles", {"id": "profile:owner", "display_name": "Second", "username": "user", "source_path": "a", "source_index": 0})})
    p = s.profiles.first()
    assert (p["display_name"], p["username"], p["archive_part_id"], p["source_path"], p["source_index"]) == ("First", "user", "p2", "b", 1)


def test_pages_from_one_state(spark, tmp_path):
    s, made = filled(spark, str(tmp_path / "a"))
    talk = [{"id": f"m:{k}", "conversation_id": "conversation:1", "sender_id": "person:2", "sender_name": "bob", "body": str(k), "sent_at": f"2024-01-01T00:00:0{k}.000Z"} for k in range(3)]
    s.import_part("p2", {"messages": made("messages", *talk), "conversations": made("conversations", {"id": "conversation:1", "title": "Talk", "participant_names": ["bob"], "participant_ids": ["person:2"]})})
    thread = s.thread_page("conversation:1", limit=2)
    assert (thread["title"], [m["body"] for m in thread["messages"]], thread["has_more"]) == ("Talk", ["1", "2"], True)
    person = s.person_page("person:1")
    assert person["person"]["post_count"] == 300 and len(person["posts"]) == 5 and person["link"].endswith("Ann")


def test_backfill_of_earlier_records(spark, tmp_path, monkeypatch):
    s = ArchiveStore(spark, str(tmp_path / "a"))
    made = lambda t, *rows: spark.createDataFrame([tuple(r.get(f) for f in SCHEMAS[t].names) for r in rows], SCHEMAS[t])
    chat = {"id": "conversation:1", "title": "Talk", "participant_names": ["Bob É.", "bob é", None], "participant_ids": []}
    talk = [{"id": "m:1", "conversation_id": "conversation:1", "sender_name": "Bob É.", "body": "hi", "sent_at": "2024-01-01T00:00:01.000Z"}, {"id": "m:2", "conversation_id": "conversation:1", "body": "anonymous"}]
    old = {"conversations": made("conversations", chat), "messages": made("messages", *talk), "profiles": made("profiles", {"id": "profile:owner", "person_id": "person:1", "display_name": "Ann", "source_path": "p.json"}), "people": made("people")}
    monkeypatch.setattr("hearthlog.store.FORMAT", 1)
    s._write(old)
    s._write({"posts": made("posts", {"id": "post:1", "body": "x"}, {"id": "post:2", "body": "y", "archive_part_id": "p7"})}, added=frozenset(["posts"]), finals=("p3",))
    monkeypatch.undo()
    s.run_derived()
    before = s.pinned()
    assert s.backfill() == ["conversations", "messages", "people", "posts", "profiles"] and s.backfill() == []
    assert {r["id"]: r["archive_part_id"] for r in s.posts.collect()} == {"post:1": "p3", "post:2": "p7"} and {r["id"]: r["archive_part_id"] for r in before.posts.collect()} == {"post:1": None, "post:2": "p7"}
    legacy = "person:legacy:conversation:1:bob-"
    assert {(r["id"], r["display_name"], r["identity_confidence"], r["is_archive_owner"]) for r in s.people.collect()} == {("person:1", "Ann", "exact", True), (legacy, "Bob É.", "ambiguous", False)}
    assert s.conversations.first()["participant_ids"] == [legacy, legacy, None] and {r["id"]: r["sender_id"] for r in s.messages.collect()} == {"m:1": legacy, "m:2": None}
    assert s.derived_status()["search"] == "pending" and s.is_final("p3")
    # what is stored now is as it should be, and an import that comes in between isn't lost
    assert s.import_part("p4", {"posts": made("posts", {"id": "post:3", "body": "z"})}) and s.backfill() == []
    other = ArchiveStore(spark, str(tmp_path / "b"))
    monkeypatch.setattr("hearthlog.store.FORMAT", 1)
    other._write({"posts": made("posts", {"id": "post:1", "body": "x"})}, finals=("p1",))
    monkeypatch.undo()
    second, take, lost = ArchiveStore(spark, other.root), other.log.take, []
    other.log.take = lambda n, c: (None if lost else (lost.append(1), second.import_part("p2", {"posts": made("posts", {"id": "post:2", "body": "y"})})), take(n, c))[1]
    assert "posts" in other.backfill() and {r["id"]: r["archive_part_id"] for r in other.posts.collect()} == {"post:1": "p1", "post:2": "p2"}


def test_what_is_known_of_parts(spark, tmp_path):
    s = ArchiveStore(spark, str(tmp_path / "s"))
    assert s.identity() is None and s.archive_set() is None and s.coverage_sets()["detected"] == []
    zips = tmp_path / "zips"
    zips.mkdir()
    pack(zips / "1.zip", {"profile_information/profile_information.json": {"profile_v2": {"name": "Ann"}}, "your_facebook_activity/posts/your_posts.json": [{"timestamp": 1709632800, "title": "One", "data": [{"post": "text"}]}]})
    pack(zips / "2.zip", {"your_facebook_activity/posts/your_posts_2.json": "{", "friends_and_followers/friends.json": {"friends_v2": [{"name": "Bob", "timestamp": 1700000000}]}})
    archive_import.import_archive(s, str(zips))
    whole, first = s.archive_set(), s.identity()
    assert (whole["parts"], whole["format"], whole["status"], len(whole["fingerprint"])) == (2, "json", "complete", 8) and whole["bytes"] == sum(r["bytes"] for r in s.table("parts").collect())
    assert (first["filename"], first["entries"]) == ("1.zip", 2) and first["known_entries"]
    s.mark_part("part:none", "skipped")
    sets = s.coverage_sets()
    assert sets.asDict() == {"detected": ["Friends", "Posts", "Profile"], "imported": ["connections", "profile"], "partial": [], "unsupported": [], "malformed": ["posts"], "skipped_parts": ["part:none"]}
    s.run_derived()
    home = s.home_page(3, 5, 2026)
    assert [p["title"] for p in home["posts"].items] == ["One"] and home["people"] == s.people.count() and home["media"] == 0 and home["years"] == ("2023", "2024") and [m["calendar_year"] for m in home["memories"]] == [2024]
