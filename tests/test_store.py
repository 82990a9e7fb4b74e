from pyspark.sql import functions as F

from hearthlog.schemas import SCHEMAS
from hearthlog.store import ArchiveStore


def rows(spark, table, *made):
    fields = SCHEMAS[table].names
    return spark.createDataFrame([tuple(m.get(f) for f in fields) for m in made], SCHEMAS[table])


def test_store(spark, tmp_path):
    s = ArchiveStore(spark, str(tmp_path / "a"))
    assert s.posts_page().items == [] and s.session()["complete"] is False
    people = rows(spark, "people", {"id": "person:1", "display_name": "Ann"}, {"id": "person:2", "display_name": "bob"})
    posts = rows(spark, "posts", *[{"id": f"post:{i}", "author_id": "person:1", "body": f"lake number {i}", "created_at": f"202{i}-03-05T10:00:00.000Z"} for i in range(5)])
    comments = rows(spark, "comments", {"id": "c:1", "post_id": "post:4", "author_id": "person:2", "body": "nice lake", "created_at": "2024-04-01T00:00:00.000Z"})
    profile = rows(spark, "profiles", {"id": "profile:owner", "person_id": "person:1", "display_name": "Ann"})
    assert s.import_part("p1", {"people": people, "posts": posts, "comments": comments, "profiles": profile})
    assert not s.import_part("p1", {"posts": posts})  # complete
    again = rows(spark, "posts", {"id": "post:0", "author_id": "person:2", "body": "other"}, {"id": "post:9", "author_id": "person:2", "body": "new"})
    assert s.import_part("p2", {"posts": again})
    assert s.post("post:0")["body"] == "lake number 0" and s.post("post:0")["archive_part_id"] == "p1"
    first = s.posts_page(limit=2)
    second = s.posts_page(limit=4, cursor=first.next_cursor)
    assert [r["id"] for r in first.items] == ["post:4", "post:3"] and [r["id"] for r in second.items] == ["post:2", "post:1", "post:0", "post:9"] and not second.has_more
    assert (first.items[0]["comment_count"], first.items[0]["author_name"], first.items[1]["comment_count"]) == (1, "Ann", 0)
    assert s.rebuild_activity() == 6 and s.rebuild_search() == 9
    assert [c["body"] for c in first.items[0]["comments"]] == ["nice lake"] and first.items[1]["comments"] == [] and s.post("post:4")["media"] == []
    assert [r["entity_id"] for r in s.search("nice lake")] == ["c:1"] and len(s.search("LAKE", backend="like", kind="post", start="2021-01-01", end="2022-12-31")) == 2 and s.search(" ") == []
    assert [r["calendar_year"] for r in s.memories(3, 5, 2024).collect()] == [2024, 2023, 2022, 2021, 2020]
    assert s.stats()["posts"] == "6" and s.person("person:1")["post_count"] == 5 and s.profile()["display_name"] == "Ann"
    assert [r["id"] for r in s.people_page().items] == ["person:1", "person:2"] and s.activity_page("comment").items[0]["actor_name"] == "bob"
    assert s.import_part("p4", {"posts": rows(spark, "posts", {"id": "post:77", "body": "late lake", "created_at": "2020-01-01T00:00:00.000Z"})})
    assert s.search("late") == [] and s.search_page("late").preparing and s.memories(3, 5, 2024).collect() == [] and s.derived_status() == {"activity": "pending", "search": "pending"}
    assert s.run_derived() == {"ledger": 7, "search_documents": 10} and s.run_derived() == {} and [r["entity_id"] for r in s.search("late LÁKE")] == ["post:77"]
    pages, cursor = [], None
    while True:
        page = s.search_page("lake", limit=2, cursor=cursor)
        pages += [(r["entity_type"], r["entity_id"]) for r in page.items]
        cursor = page.next_cursor
        if not page.has_more:
            break
    assert len(pages) == 7 == len(set(pages)) and sum(page.counts.values()) == 1
    s.compact()
    assert s.post("post:77")["body"] == "late lake" and s.stats()["posts"] == "7"
    s.mark_part("p3", "failed")
    assert s.session()["failed"] == 1 and not s.session()["complete"]
    for page in (s.conversations_page(), s.messages_page("x"), s.media_page("photo"), s.connections_page(), s.albums_page()):
        assert page.items == []
    s.replace({"people": people})
    assert s.posts_page().items == [] and s.people_page().items


def test_no_profile_and_no_records(spark, tmp_path):
    s = ArchiveStore(spark, str(tmp_path / "b"))
    assert s.rebuild_activity() == 0 and s.rebuild_search() == 0 and s.search("x") == []
    s.import_part("p1", {"posts": rows(spark, "posts", {"id": "post:1", "author_id": "owner", "body": "alone", "created_at": "2024-01-02T00:00:00.000Z"})})
    assert [r["id"] for r in s.posts_page().items] == ["post:1"] and s.post("post:1")["author_name"] is None
    assert s.rebuild_activity() == 1 and s.activity_page().items[0]["actor_person_id"] is None
    assert s.profile() is None and s.stats()["posts"] == "1"


def test_parts_merge(spark, tmp_path):
    s = ArchiveStore(spark, str(tmp_path / "c"))
    chat = {"id": "conversation:1", "participant_names": ["A", "B"], "participant_ids": ["a", "b"], "source_path": "x"}
    who = {"id": "person:1", "display_name": "Ann", "first_seen": "2020", "last_seen": "2021", "source_paths": ["p"], "identity_confidence": "inferred"}
    s.import_part("p1", {"conversations": rows(spark, "conversations", chat), "people": rows(spark, "people", who), "posts": rows(spark, "posts", {"id": "post:1", "body": "zz", "source_index": 0, "source_path": "z"})})
    more = chat | {"title": "T", "participant_names": ["B", "C"], "participant_ids": ["b", "c"], "source_path": "y"}
    again = who | {"username": "ann", "first_seen": "2019", "last_seen": "2020", "source_paths": ["q"], "identity_confidence": "exact"}
    s.import_part("p2", {"conversations": rows(spark, "conversations", more), "people": rows(spark, "people", again), "posts": rows(spark, "posts", {"id": "post:1", "body": "aa", "source_index": 5, "source_path": "a"})})
    for _ in range(2):
        c, p = s.conversations.first(), s.people.first()
        assert (c["title"], c["participant_names"], c["participant_ids"], c["is_group"], c["source_path"]) == ("T", ["A", "B", "C"], ["a", "b", "c"], True, "y")
        assert (p["username"], p["first_seen"], p["last_seen"], p["source_paths"], p["identity_confidence"], p["is_archive_owner"]) == ("ann", "2019", "2021", ["p", "q"], "exact", False)
        assert s.posts.first()["body"] == "zz" and s.posts.count() == 1
        s.compact()


def test_pages_of_people(spark, tmp_path):
    """Pages go on behind their cursor, a text narrows them, and numbers are those of the page's own people."""
    s = ArchiveStore(spark, str(tmp_path))
    person = lambda k, name: {"id": f"person:{k}", "display_name": name, "source_path": "x"}
    chat = {"id": "conversation:1", "participant_names": ["a", "b"], "participant_ids": ["person:1", "person:1", "person:2"], "source_path": "x"}
    s.import_part("p1", {"people": rows(spark, "people", person(1, "bea"), person(2, "Abe"), person(3, "Cee"), person(11, "bea")), "conversations": rows(spark, "conversations", chat)})
    first = s.people_page(limit=2)
    assert [(r["id"], r["participation_count"]) for r in first.items] == [("person:2", 1), ("person:1", 1)] and first.has_more
    rest = s.people_page(limit=2, cursor=first.next_cursor)
    assert [(r["id"], r["participation_count"]) for r in rest.items] == [("person:11", 0), ("person:3", 0)] and not rest.has_more
    assert [r["id"] for r in s.people_page(text=" BE ").items] == ["person:2", "person:1", "person:11"] and s.people_page(text="zz").items == []


def test_stored_search(spark, tmp_path):
    """Postings in ranges, phrases, terms and pages that read their own documents only, against plain loops."""
    import random

    from hearthlog.operators import search

    dice = random.Random(5)
    bodies = [" ".join(dice.choice(["a", "a", "b", "the", "lake", "x"]) for _ in range(dice.randrange(60))) for _ in range(120)] + ["a " * 3000, "", None]
    s = ArchiveStore(spark, str(tmp_path / "c"))
    s.import_part("p1", {"posts": rows(spark, "posts", *[{"id": f"post:{k:03}", "body": b} for k, b in enumerate(bodies)])})
    s.run_derived(window_rows=50)
    words = {f"post:{k:03}": (b or "").split() for k, b in enumerate(bodies)}
    for phrase in (["a", "a"], ["the", "lake"], ["a", "b", "a"]):
        n = {i: sum(w[k : k + len(phrase)] == phrase for k in range(len(w))) for i, w in words.items()}
        hits = search.scored(s.table("postings"), s.table("corpus"), "-".join(phrase))
        assert {r["entity_id"] for r in hits.collect()} == {i for i, c in n.items() if c}
    told = {r["term"]: (r["docs"], r["n"]) for r in s.term_statistics().collect()}
    assert told == {t: (sum(t in w for w in words.values()), sum(w.count(t) for w in words.values())) for t in {x for w in words.values() for x in w}}
    assert told == {r["term"]: (r["docs"], r["n"]) for r in search.term_statistics(s.table("search_documents")).collect()}
    page = s.search_page("lake", limit=7)
    wanted = search.documents_of(s.table("search_documents"), [(r["entity_type"], r["entity_id"]) for r in page.items])
    assert {r["entity_id"] for r in wanted.collect()} == {r["entity_id"] for r in page.items} and len(page.items) == 7
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and f"EqualTo(entity_id,{page.items[0]['entity_id']})" in plan
    # a word that every document has is written by several tasks
    many = spark.range(4000).select(F.lit("post").alias("entity_type"), F.col("id").cast("string").alias("entity_id"), F.lit(None).cast("string").alias("title"), F.lit("common").alias("body"), F.lit("").alias("context"), F.lit(None).cast("string").alias("created_at"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = search.stored_postings(many).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 2 and sum(r["count"] for r in tasks) == 4000


def test_first_values_of_groups(spark):
    from hearthlog.operators import merge

    given = spark.createDataFrame([("a", f"p{k % 50:02}") for k in range(500)] + [("b", None), (None, "q")], "k string, v string")
    got = {r["k"]: (r["n"], r["v"]) for r in merge.with_first(given, ["k"], "v", 3, F.count("*").alias("n")).collect()}
    assert got == {"a": (500, ["p00", "p01", "p02"]), "b": (1, []), None: (1, ["q"])}
    assert merge.with_first(given.limit(0), ["k"], "v", 3, F.count("*").alias("n")).collect() == []
    assert "WindowGroupLimit" in merge.with_first(given, ["k"], "v", 3, F.count("*").alias("n"))._jdf.queryExecution().toString()


def test_postings_are_dealt_out_once(spark):
    import math

    from hearthlog.operators import search

    rows = [("post", "1", "A b", "b c, é B", None), ("post", "2", None, "", ""), ("note", "3", "b", "x " * 300 + "É", "b b"), ("post", "4", "c", None, "c")]
    docs = spark.createDataFrame(rows, "entity_type string, entity_id string, title string, body string, context string").withColumn("created_at", F.lit("2020"))
    stored = search.stored_postings(docs)
    assert stored._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    want = {}
    for kind, id_, *texts in rows:
        split = [(t or "").lower().replace("é", "e").replace(",", " ").split() for t in texts]
        for t in {t for w in split for t in w}:
            want[t, kind, id_] = tuple([i for i, x in enumerate(w) if x == t] for w in split), sum(map(len, split))
    got = stored.collect()
    assert {(r["term"], r["entity_type"], r["entity_id"]): ((r["title"], r["body"], r["context"]), r["length"]) for r in got} == want and len(got) == len(want)
    assert stored.schema.simpleString() == spark.createDataFrame([], search.POSTINGS).schema.simpleString()
    # ranks aren't rounded twice
    hits = {r["entity_id"]: r["rank"] for r in search.scored(stored, search.corpus(docs), "x").collect()}
    f, length, mean = 450.0, 304, (6 + 0 + 304 + 2) / 4
    assert abs(hits["3"] + math.log(3.5 / 1.5) * (f * 2.2) / (f + 1.2 * (0.25 + 0.75 * length / mean))) < 1e-12
