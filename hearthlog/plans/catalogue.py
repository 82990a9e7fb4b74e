"""Registered queries over the driver's tables and the DuckDB SQL that they must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hearthlog.functions import scalars as S
from hearthlog.operators import backfill, derived, diagnostics, merge, paging, reads, search
from hearthlog.plans.bindings import CTES, Archive
from hearthlog.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, ctes: str = ""):
    """Registers f(archive); sql sees the entity tables as common table expressions."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Archive(spark, sf_dir))
        if sql:
            SQL[f.__name__] = f"WITH {CTES}{', ' + ctes if ctes else ''}\n{sql}"
        return f

    return register


_LEDGER_PARTS = """
ledger_raw AS (
  SELECT 'activity:profile:' || id AS id, 'profile' AS activity_type, person_id AS actor_person_id, 'profile' AS target_type, id AS target_id, joined_at AS occurred_at, 'Profile: ' || display_name AS summary FROM profiles
  UNION ALL SELECT 'activity:post:' || id, 'post', author_id, 'post', id, created_at, CASE WHEN title <> '' THEN 'Posted “' || title || '”' WHEN body <> '' THEN 'Posted “' || substr(body, 1, 160) || '”' ELSE 'Posted' END FROM posts
  UNION ALL SELECT 'activity:comment:' || id, 'comment', author_id, 'post', post_id, created_at, coalesce('Commented as ' || author_name, 'Commented') || ': “' || substr(body, 1, 160) || '”' FROM comments
  UNION ALL SELECT 'activity:reaction:' || id, 'reaction', person_id, target_type, target_id, created_at, 'Reacted ' || kind || coalesce(' as ' || person_name, '') FROM reactions
  UNION ALL SELECT 'activity:message:' || id, 'message', sender_id, 'conversation', conversation_id, sent_at, 'Message from ' || sender_name || CASE WHEN body <> '' THEN ': “' || substr(translate(body, chr(10) || chr(13), '  '), 1, 160) || '”' ELSE '' END FROM messages
  UNION ALL SELECT 'activity:connection:' || id, 'connection', person_id, 'person', person_id, coalesce(started_at, ended_at), replace(relationship_type, '_', ' ') || ': ' || display_name FROM connections
  UNION ALL SELECT 'activity:album:' || id, 'album', owner_id, 'album', id, coalesce(created_at, updated_at), 'Album: ' || title FROM albums
  UNION ALL SELECT 'activity:media:' || id, 'media', NULL, owner_type, owner_id, timestamp, 'Media: ' || filename FROM media
  UNION ALL SELECT 'activity:profile-fact:' || id, 'profile', 'person:c:1', 'profile', 'profile:owner', coalesce(start_date, end_date), category || ' · ' || label || ': ' || value FROM profile_facts),
ledger AS (
  SELECT *, CAST(substr(occurred_at, 1, 4) AS INT) AS calendar_year, CAST(substr(occurred_at, 6, 2) AS INT) AS calendar_month, CAST(substr(occurred_at, 9, 2) AS INT) AS calendar_day
  FROM ledger_raw WHERE occurred_at IS NOT NULL)"""
_DOCS = """
search_docs AS (
  SELECT 'person' AS entity_type, id AS entity_id, display_name AS title, relationship AS body, facebook_id AS context, NULL AS created_at, NULL AS conversation_id FROM people
  UNION ALL SELECT 'profile-fact', 'fact:' || id, category, concat_ws(' ', label, value), concat_ws(' ', start_date, end_date), coalesce(start_date, end_date), NULL FROM profile_facts
  UNION ALL SELECT 'post', id, title, body, coalesce(created_at, ''), created_at, NULL FROM posts
  UNION ALL SELECT 'comment', id, author_name, body, post_id, created_at, NULL FROM comments
  UNION ALL SELECT 'reaction', id, kind, person_name, target_id, created_at, NULL FROM reactions
  UNION ALL SELECT 'connection', id, display_name, concat_ws(' ', relationship_type, username), coalesce(started_at, ended_at), coalesce(started_at, ended_at), NULL FROM connections
  UNION ALL SELECT 'album', id, title, description, created_at, coalesce(updated_at, created_at), NULL FROM albums
  UNION ALL SELECT 'media', id, filename, caption, path, timestamp, NULL FROM media
  UNION ALL SELECT 'conversation', id, coalesce(title, 'Conversation'), array_to_string(participant_names, ' '), array_to_string(participant_names, ' '), NULL, NULL FROM chats
  UNION ALL SELECT 'message', m.id, coalesce(c.title, 'Conversation'), m.body, concat_ws(' ', m.sender_name, m.sent_at), m.sent_at, m.conversation_id FROM messages m LEFT JOIN chats c ON c.id = m.conversation_id)"""
_FEED = """
feed AS (
  SELECT p.id, p.author_id, p.title, p.body, p.created_at, coalesce(a.display_name, (SELECT display_name FROM profiles)) AS author_name,
         (SELECT count(*) FROM media m WHERE m.owner_type = 'post' AND m.owner_id = p.id) AS media_count,
         (SELECT count(*) FROM comments c WHERE c.post_id = p.id) AS comment_count,
         (SELECT count(*) FROM reactions r WHERE r.target_type = 'post' AND r.target_id = p.id) AS reaction_count
  FROM posts p LEFT JOIN people a ON a.id = p.author_id)"""
_FEED_COLUMNS = ["id", "author_id", "author_name", "title", "body", "created_at", "media_count", "comment_count", "reaction_count"]
_PICK = ", ".join(_FEED_COLUMNS)


# -- filters and projections


@query("SELECT id, author_id, title, body, created_at FROM posts WHERE substr(created_at, 1, 4) = '1996'")
def posts_by_year(a):
    return a.posts.filter(F.substring("created_at", 1, 4) == "1996")


@query("SELECT id, author_id, title, body, created_at FROM posts WHERE author_id = 'person:c:7'")
def posts_by_author(a):
    return a.posts.filter("author_id = 'person:c:7'")


@query("SELECT id, activity_type, occurred_at, summary FROM ledger WHERE translate(summary, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%media: 1_.%'", _LEDGER_PARTS)
def ledger_text_filter(a):
    return derived.ledger(a).filter(S.contains_ci(F.col("summary"), " MEDIA: 1_. ")).select("id", "activity_type", "occurred_at", "summary")


@query("SELECT id, created_at FROM comments WHERE created_at >= '1997-03-01T00:00:00.000Z' AND created_at <= '1997-04-30T23:59:59.999Z'")
def date_range_filter(a):
    return a.comments.filter(F.col("created_at").between("1997-03-01T00:00:00.000Z", "1997-04-30T23:59:59.999Z")).select("id", "created_at")


@query(
    """SELECT x, count(*) AS n FROM (
  SELECT CASE o_orderkey % 4 WHEN 0 THEN '2024' WHEN 1 THEN '12:00' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE NULL END AS x, o_orderkey FROM orders)
WHERE x IS NOT NULL AND regexp_matches(x, '^\\d{4}-\\d{2}-\\d{2}') GROUP BY x"""
)
def valid_date_gate(a):
    k = F.col("o_orderkey") % 4
    x = F.when(k == 0, "2024").when(k == 1, "12:00").when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return a.table("orders").select(x.alias("x")).filter(S.valid_iso(F.col("x"))).groupBy("x").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS k, p_type AS name FROM part WHERE translate(p_name || p_type, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%bolt%'")
def like_ascii_ci(a):
    return a.table("part").filter(S.contains_ci(F.concat("p_name", "p_type"), "BoLt")).select(F.col("p_partkey").alias("k"), F.col("p_type").alias("name"))


@query("SELECT doc_id, substr(regexp_replace(text, '[\\n\\r]', ' ', 'g'), 1, 160) AS summary FROM documents")
def summary_projection(a):
    return a.table("documents").select("doc_id", S.summary(F.col("text")).alias("summary"))


@query("SELECT media_type, count(*) AS n FROM media GROUP BY media_type")
def media_type_classifier(a):
    return a.media.groupBy("media_type").agg(F.count("*").alias("n"))


@query("SELECT id, path FROM media WHERE media_type IN ('photo', 'video', 'audio')")
def media_preview_filter(a):
    return a.media.filter(F.col("media_type").isin("photo", "video", "audio")).select("id", "path")


_CONNECTION_FILES = ["removed_friends.json", "rejected_friend_requests.json", "sent_friend_requests.json", "received_friend_requests.json", "followers.json", "who_youve_FOLLOWING.json", "your_friends.json", "x.json", "blocked_profiles.json", "unfriended.json", "Outgoing.json"]


@query("SELECT c_custkey, ['removed_friend', 'friend', 'outgoing_request', 'incoming_request', 'follower', 'following', 'friend', 'unknown', 'blocked', 'removed_friend', 'outgoing_request'][c_custkey % 11 + 1] AS kind FROM customer")
def connection_type_classifier(a):
    file = F.element_at(F.array(*map(F.lit, _CONNECTION_FILES)), (F.col("c_custkey") % 11 + 1).cast("int"))
    return a.table("customer").select("c_custkey", S.connection_type(file).alias("kind"))


_MEDIA_FILES = ["a.JPG", "b.mp4", "c.oga", "d.xlsx", "e.zip", "f", "video/g.jpg", "h.heic", "files/i.png", "j.pdf", "k.docx", "l.bin"]


@query("SELECT p_partkey, ['photo', 'video', 'audio', 'file', 'file', 'unknown', 'video', 'photo', 'photo', 'file', 'file', 'unknown'][p_partkey % 12 + 1] AS kind FROM part")
def media_kind_classifier(a):
    file = F.element_at(F.array(*map(F.lit, _MEDIA_FILES)), (F.col("p_partkey") % 12 + 1).cast("int"))
    return a.table("part").select("p_partkey", S.media_type(file).alias("kind"))


_SECTION_FILES = {
    "a/profile_information/profile.json": "profile", "a/posts/comments.json": "posts", "your_posts__check_ins_1.html": "posts", "a/messages/inbox/b_1/message_12.html": "messages",
    "messages/friends.json": "connections", "a/comments_and_reactions/comments.json": "comments", "likes_and_reactions_1.json": "reactions", "friends_and_followers/who.json": "connections",
    "x/album/0.html": "albums", "your_videos.json": "albums", "ads/x.json": None, "a/posts/media.txt": None,
}


@query("SELECT p_partkey, ['profile', 'posts', 'posts', 'messages', 'connections', 'comments', 'reactions', 'connections', 'albums', 'albums', NULL, NULL][p_partkey % 12 + 1] AS section FROM part")
def section_classifier(a):
    file = F.element_at(F.array(*map(F.lit, _SECTION_FILES)), (F.col("p_partkey") % 12 + 1).cast("int"))
    return a.table("part").select("p_partkey", S.section(file).alias("section"))


_WARNINGS = ["p.zip · f: unsupported posts JSON shape (skipped).", "Unexpected token } in JSON", "x · y: suspicious media path skipped (../a)", "Media reference not found: b", "Duplicate part", "x · Took 12 s (long)", " "]


@query("SELECT p_partkey, ['unsupported-shape', 'malformed-json', 'unsafe-path', 'missing-media', 'duplicate-part', 'Took # s (path)', 'import-warning'][p_partkey % 7 + 1] AS category FROM part")
def warning_category_classifier(a):
    text = F.element_at(F.array(*map(F.lit, _WARNINGS)), (F.col("p_partkey") % 7 + 1).cast("int"))
    return a.table("part").select("p_partkey", S.warning_category(text).alias("category"))


# -- joins


@query("SELECT id, media_count, comment_count, reaction_count FROM feed", _FEED)
def feed_counts(a):
    return reads.feed(a).select("id", "media_count", "comment_count", "reaction_count")


@query(
    """SELECT p.id, coalesce(a.display_name, (SELECT display_name FROM profiles)) AS author_name
FROM (SELECT id, CASE WHEN CAST(substr(author_id, 10) AS INT) % 3 = 0 THEN 'owner' ELSE author_id END AS author_id FROM posts) p LEFT JOIN people a ON a.id = p.author_id"""
)
def feed_author_fallback(a):
    posts = a.posts.withColumn("author_id", F.when(F.substring_index("author_id", ":", -1).cast("int") % 3 == 0, "owner").otherwise(F.col("author_id")))
    return reads.named(posts, a).select("id", "author_name")


_INBOX = """
last AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY coalesce(sent_at, '') DESC, id DESC) AS rn, count(*) OVER (PARTITION BY conversation_id) AS n FROM messages),
inbox AS (SELECT c.id, c.title, c.is_group, coalesce(l.n, 0) AS message_count, l.body AS latest_text, coalesce(l.sent_at, '') AS latest_sent_at, c.participant_names
  FROM chats c LEFT JOIN last l ON l.conversation_id = c.id AND l.rn = 1)"""


@query("SELECT id, title, is_group, message_count, latest_text, latest_sent_at FROM inbox", _INBOX)
def inbox_latest(a):
    return reads.inbox(a)


@query("SELECT id, message_count FROM inbox WHERE lower(coalesce(title, '')) LIKE '%chat 1%' OR lower(array_to_string(participant_names, ',')) LIKE '%chat 1%' ORDER BY latest_sent_at DESC, id DESC LIMIT 20", _INBOX)
def inbox_filtered_page(a):
    rows = reads.inbox(a, "cHat 1")
    return paging.window_of(rows, F.col("latest_sent_at"), "id", 20).select("id", "message_count")


@query("SELECT conversation_id, id AS message_id FROM messages QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY coalesce(sent_at, '') DESC, id DESC) = 1")
def latest_message_row_number(a):
    w = W.partitionBy("conversation_id").orderBy(F.desc(F.coalesce("sent_at", F.lit(""))), F.desc("id"))
    return a.messages.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("conversation_id", F.col("id").alias("message_id"))


@query("SELECT position, id, path, media_type FROM album_media JOIN media ON media_id = id WHERE album_id = (SELECT min(id) FROM albums)")
def album_detail(a):
    first = F.broadcast(a.albums.agg(F.min("id").alias("album_id")))
    return a.album_media.join(first, "album_id").join(a.media, F.col("media_id") == F.col("id")).select("position", "id", "path", "media_type")


@query("SELECT id, title, media_count, array_to_string(coalesce(ids, []), ',') AS media_ids FROM (SELECT a.id, title, count(media_id) AS media_count, list(media_id ORDER BY position) FILTER (media_id IS NOT NULL) AS ids, coalesce(updated_at, created_at, '') AS k FROM albums a LEFT JOIN album_media m ON m.album_id = a.id GROUP BY ALL) ORDER BY k DESC, id DESC LIMIT 20")
def albums_page(a):
    rows = paging.window_of(reads.albums(a), F.col("sort_at"), "id", 20)
    return rows.select("id", "title", F.col("media_count").cast("long").alias("media_count"), F.array_join("media_ids", ",").alias("media_ids"))


@query(
    """SELECT p.id, count(x.id) AS media_count FROM people p LEFT JOIN (
  SELECT author_id AS person, m.id FROM media m JOIN posts o ON m.owner_type = 'post' AND m.owner_id = o.id
  UNION ALL SELECT a.owner_id, m.id FROM media m JOIN albums a ON m.owner_type = 'album' AND m.owner_id = a.id) x ON x.person = p.id GROUP BY p.id"""
)
def person_media(a):
    return reads.people_rollup(a).select("id", "media_count")


@query("SELECT name, count(*) AS n FROM (SELECT unnest(participant_names) AS name FROM chats) GROUP BY name")
def participation_exact(a):
    return reads.participation(a.conversations)


@query("SELECT p.name, count(*) AS n FROM (SELECT DISTINCT unnest(participant_names) AS name FROM chats) p JOIN chats c ON array_to_string(c.participant_names, ',') LIKE '%' || p.name || '%' GROUP BY p.name")
def participation_theta(a):
    names = a.conversations.select(F.explode("participant_names").alias("name")).distinct()
    texts = a.conversations.select(F.array_join("participant_names", ",").alias("all"))
    return texts.join(F.broadcast(names), F.col("all").contains(F.col("name"))).groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT author_id, post_id FROM (SELECT DISTINCT author_id, post_id FROM comments) c WHERE NOT EXISTS (SELECT 1 FROM reactions r WHERE r.target_id = c.post_id)")
def person_sources_anti(a):
    return a.comments.select("author_id", "post_id").distinct().join(a.reactions.select(F.col("target_id").alias("post_id")), "post_id", "left_anti").select("author_id", "post_id")


@query(
    """SELECT e.id AS expected_id, f.id AS found_id, CASE WHEN e.id IS NOT NULL AND f.id IS NOT NULL THEN 'matched' WHEN f.id IS NULL THEN 'missing'
  WHEN f.fp IN (SELECT p_brand FROM part WHERE p_size < 5) THEN 'duplicate' ELSE 'unexpected' END AS outcome
FROM (SELECT p_partkey AS id, p_brand AS fp, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part WHERE p_size < 5) e
FULL JOIN (SELECT p_partkey AS id, p_brand AS fp, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part WHERE p_size BETWEEN 20 AND 25) f ON e.fp = f.fp AND e.k = f.k"""
)
def part_match_full_outer(a):
    p = a.table("part")
    expected = p.filter("p_size < 5").select(F.col("p_partkey").alias("expected_id"), F.col("p_brand").alias("fingerprint"))
    found = p.filter("p_size BETWEEN 20 AND 25").select(F.col("p_partkey").alias("found_id"), F.col("p_brand").alias("fingerprint"))
    return merge.match_parts(expected, found)


_MARKERS = ["RED", "BOLT", "OL", "GIZMO", "S"]


@query(f"SELECT needle, count(*) AS n FROM part JOIN (SELECT unnest({_MARKERS}) AS needle) ON contains(upper(p_name), needle) GROUP BY needle")
def marker_theta(a):
    needles = a.spark.createDataFrame([(m,) for m in _MARKERS], "needle string")
    return a.table("part").join(F.broadcast(needles), F.upper("p_name").contains(F.col("needle"))).groupBy("needle").agg(F.count("*").alias("n"))


@query("SELECT p.id, count(m.id) AS n, string_agg(m.path, ',' ORDER BY m.id) AS paths FROM posts p JOIN media m ON m.owner_type = 'post' AND m.owner_id = p.id GROUP BY p.id")
def polymorphic_media(a):
    owned = reads.nested(a.media.filter("owner_type = 'post'"), "owner_id", ["id"], ["id", "path"], "media")
    return a.posts.select("id").join(owned.withColumnRenamed("owner_id", "id"), "id").select("id", F.size("media").cast("long").alias("n"), F.array_join(F.col("media.path"), ",").alias("paths"))


@query("SELECT m.id, c.title FROM messages m LEFT JOIN chats c ON c.id = m.conversation_id")
def message_titles_left(a):
    chats = a.conversations.select(F.col("id").alias("conversation_id"), "title")
    return a.messages.join(chats, "conversation_id", "left").select("id", "title")


# -- aggregates


_NAMES = ["profiles", "people", "posts", "comments", "reactions", "connections", "albums", "messages", "media", "profile_facts"]


@query(
    " UNION ALL ".join([f"SELECT '{n}' AS name, CAST(count(*) AS VARCHAR) AS value FROM {n}" for n in _NAMES] + ["SELECT 'conversations', CAST(count(*) AS VARCHAR) FROM chats"])
    + " UNION ALL SELECT 'activity_first', min(occurred_at) FROM ledger UNION ALL SELECT 'activity_last', max(occurred_at) FROM ledger"
    + " UNION ALL SELECT 'activity_years', CAST(count(DISTINCT calendar_year) AS VARCHAR) FROM ledger UNION ALL SELECT 'activities', CAST(count(*) AS VARCHAR) FROM ledger",
    _LEDGER_PARTS,
)
def archive_stats(a):
    return reads.stats(a, derived.ledger(a))


@query("SELECT conversation_id, count(*) AS n, max(coalesce(sent_at, '')) AS latest FROM messages GROUP BY conversation_id")
def conversation_stats(a):
    return a.messages.groupBy("conversation_id").agg(F.count("*").alias("n"), F.max(F.coalesce("sent_at", F.lit(""))).alias("latest"))


@query("SELECT min(occurred_at) AS first_at, max(occurred_at) AS last_at, count(*) AS n FROM ledger", _LEDGER_PARTS)
def ledger_range(a):
    return derived.ledger(a).agg(F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"), F.count("*").alias("n"))


@query("SELECT DISTINCT calendar_year FROM ledger", _LEDGER_PARTS)
def ledger_years_distinct(a):
    return derived.ledger(a).select("calendar_year").distinct()


@query("SELECT id, min(seen) AS first_at, max(seen) AS last_at FROM (SELECT author_id AS id, created_at AS seen FROM posts UNION ALL SELECT author_id, created_at FROM comments UNION ALL SELECT person_id, created_at FROM reactions UNION ALL SELECT sender_id, sent_at FROM messages) GROUP BY id")
def first_last_interaction(a):
    seen = a.posts.select("author_id", "created_at").union(a.comments.select("author_id", "created_at")).union(a.reactions.select("person_id", "created_at")).union(a.messages.select("sender_id", "sent_at"))
    return seen.toDF("id", "at").groupBy("id").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))


@query("SELECT post_id, string_agg(id || '=' || body, ';' ORDER BY created_at, id) AS comments FROM comments GROUP BY post_id")
def nested_comments_ordered(a):
    n = reads.nested(a.comments, "post_id", ["created_at", "id"], ["id", "body"], "c")
    return n.select("post_id", F.array_join(F.transform("c", lambda x: F.concat(x["id"], F.lit("="), x["body"])), ";").alias("comments"))


@query("SELECT target_id, kind, count(*) AS n FROM reactions GROUP BY target_id, kind")
def reaction_breakdown(a):
    return a.reactions.groupBy("target_id", "kind").agg(F.count("*").alias("n"))


@query("SELECT target_id, string_agg(person_id, ',' ORDER BY created_at, id) AS actors FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY created_at, id) AS k FROM reactions) WHERE k <= 8 GROUP BY target_id")
def reaction_first_actors(a):
    n = reads.nested(a.reactions, "target_id", ["created_at", "id"], ["person_id"], "r")
    return n.select("target_id", F.array_join(F.slice(F.col("r.person_id"), 1, 8), ",").alias("actors"))


@query(
    """SELECT section, arg_max(status, struct_pack(r := r, s := seq)) AS status, sum(records)::BIGINT AS records, sum(warnings)::BIGINT AS warnings FROM (
  SELECT s_nationkey % 5 AS section, s_suppkey AS seq, ['detected', 'imported', 'partial', 'malformed'][s_suppkey % 4 + 1] AS status, s_suppkey % 4 + 1 AS r, s_suppkey AS records, s_suppkey % 3 AS warnings FROM supplier) GROUP BY section"""
)
def section_status_fold(a):
    status = F.element_at(F.array(*map(F.lit, ["detected", "imported", "partial", "malformed"])), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return merge.fold_sections(a.table("supplier").select((F.col("s_nationkey") % 5).alias("section"), F.col("s_suppkey").alias("seq"), status.alias("status"), F.col("s_suppkey").alias("records"), (F.col("s_suppkey") % 3).alias("warnings")))


@query(
    """SELECT list_sort(list(DISTINCT section) FILTER (true)) AS detected, list_sort(list(DISTINCT section) FILTER (status = 'imported')) AS imported, list_sort(list(DISTINCT section) FILTER (status = 'partial')) AS partial,
  list_sort(list(DISTINCT section) FILTER (status = 'malformed')) AS malformed, (SELECT list_sort(list('supplier:' || s_suppkey)) FROM supplier WHERE s_suppkey % 7 = 3) AS skipped_parts
FROM (SELECT 's' || s_nationkey AS section, ['detected', 'imported', 'partial', 'malformed'][s_nationkey % 4 + 1] AS status FROM supplier)"""
)
def coverage_sets(a):
    """Sections and parts of which each supplier's nation is one."""
    rows = a.table("supplier").select(F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("section"), F.element_at(F.array(*map(F.lit, ["detected", "imported", "partial", "malformed"])), (F.col("s_nationkey") % 4 + 1).cast("int")).alias("status"), "s_suppkey")
    states = rows.select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("part_id"), F.when(F.col("s_suppkey") % 7 == 3, "skipped").otherwise("complete").alias("status"))
    folded = merge.fold_sections(rows.select("section", "status", F.col("s_suppkey").alias("seq"), F.lit(1).alias("records"), F.lit(0).alias("warnings")))
    return diagnostics.coverage_sets(rows.select(F.array("section").alias("sections")), folded, states).select("detected", "imported", "partial", "malformed", "skipped_parts")


@query(
    """SELECT 'person:legacy:' || id || ':' || regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') AS id, name AS display_name, 'ambiguous' AS identity_confidence, false AS is_archive_owner
FROM (SELECT id, unnest(participant_names) AS name FROM chats)
UNION ALL SELECT person_id, display_name, 'exact', true FROM profiles"""
)
def legacy_people(a):
    """People of a store that has none: the owner, and who is named in conversations."""
    return backfill.legacy_people(a.profiles.withColumn("source_path", F.lit(None).cast("string")), a.conversations).select("id", "display_name", "identity_confidence", "is_archive_owner")


@query("SELECT id, 'person:legacy:' || conversation_id || ':' || regexp_replace(lower(sender_name), '[^a-z0-9]+', '-', 'g') AS sender_id FROM messages")
def legacy_senders(a):
    return backfill.legacy_senders(a.messages).select("id", "sender_id")


@query("SELECT category, sum(n)::BIGINT AS n, array_to_string(list_sort(list(DISTINCT path))[1:8], ',') AS paths FROM (SELECT l_returnflag AS category, 1 AS n, l_linestatus || (l_partkey % 40) AS path FROM lineitem) GROUP BY category")
def warning_groups(a):
    w = a.table("lineitem").select(F.col("l_returnflag").alias("category"), F.lit(1).alias("n"), F.concat("l_linestatus", (F.col("l_partkey") % 40).cast("string")).alias("path"))
    return merge.fold_warnings(w, 8).select("category", "n", F.array_join("paths", ",").alias("paths"))


@query("SELECT stage, count(*) AS calls, round(sum(v), 2) AS total, round(max(v), 2) AS worst FROM (SELECT event_type AS stage, value AS v FROM events) GROUP BY stage")
def stage_metrics(a):
    return a.table("events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("total"), F.round(F.max("value"), 2).alias("worst"))


@query("SELECT event_id, event_type, value FROM events ORDER BY value DESC, event_id LIMIT 10")
def topk_slowest(a):
    return a.table("events").orderBy(F.desc("value"), "event_id").limit(10).select("event_id", "event_type", "value")


@query("SELECT event_type, round(CASE WHEN sum(value) = 0 THEN 0 ELSE count(*) / sum(value) END, 6) AS rate FROM events GROUP BY event_type")
def throughput_ratios(a):
    return a.table("events").groupBy("event_type").agg(F.round(F.when(F.sum("value") == 0, 0.0).otherwise(F.count("*") / F.sum("value")), 6).alias("rate"))


@query("SELECT d.lang, count(*) AS n, count(l.quality) AS labelled, coalesce(sum(l.toxic), 0)::BIGINT AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang")
def label_coverage(a):
    return a.table("documents").join(a.table("labels"), "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


# -- windows, merges and set operations


@query("SELECT id, post_id, author_id, body, created_at FROM comments")
def first_wins_dedupe(a):
    order = ["created_at", "author_id", "body", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return merge.first_wins(a.raw_comments, ["id", "post_id"], order).select("id", "post_id", "author_id", "body", "created_at")


@query("SELECT id, created_at, author_id, body FROM raw_comments QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC, author_id DESC, body DESC) = 1")
def last_wins_upsert(a):
    return merge.last_wins(a.raw_comments.select("id", "created_at", "author_id", "body"), ["id"], ["created_at", "author_id", "body"])


@query(
    """SELECT id, arg_min(name, seq) FILTER (name IS NOT NULL) AS display_name, min(seen) AS first_seen, max(seen) AS last_seen, bool_or(own) AS is_archive_owner,
  CASE WHEN bool_or(conf = 'exact') THEN 'exact' ELSE 'inferred' END AS identity_confidence, string_agg(DISTINCT path, ',' ORDER BY path) AS paths
FROM (SELECT l_suppkey AS id, l_orderkey * 100000000 + l_partkey * 100 + l_quantity::INT AS seq, CASE WHEN l_linenumber > 2 THEN l_returnflag || l_partkey END AS name, strftime(l_shipdate, '%Y-%m-%d') AS seen,
  l_tax > 0.07 AS own, CASE WHEN l_linestatus = 'F' THEN 'exact' ELSE 'inferred' END AS conf, 'p' || l_linenumber AS path FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_orderkey, l_partkey, l_quantity ORDER BY l_shipdate, l_linenumber, l_extendedprice, l_tax, l_discount, l_returnflag) = 1) GROUP BY id"""
)
def merge_people(a):
    key = ["l_suppkey", "l_orderkey", "l_partkey", "l_quantity"]
    li = merge.first_wins(a.table("lineitem").drop("l_linestatus_"), key, ["l_shipdate", "l_linenumber", "l_extendedprice", "l_tax", "l_discount", "l_returnflag"])
    rows = li.select(
        F.col("l_suppkey").alias("id"), (F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 100 + F.col("l_quantity").cast("int")).alias("seq"),
        F.when(F.col("l_linenumber") > 2, F.concat("l_returnflag", F.col("l_partkey").cast("string"))).alias("display_name"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("first_seen"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("last_seen"), (F.col("l_tax") > 0.07).alias("is_archive_owner"),
        F.when(F.col("l_linestatus") == "F", "exact").otherwise("inferred").alias("identity_confidence"), F.array(F.concat(F.lit("p"), F.col("l_linenumber").cast("string"))).alias("source_paths"),
    )
    return merge.merge_people(rows, ["display_name"]).select("id", "display_name", "first_seen", "last_seen", "is_archive_owner", "identity_confidence", F.array_join(F.array_sort("source_paths"), ",").alias("paths"))


@query(
    """SELECT id, arg_min(title, seq) FILTER (title IS NOT NULL) AS title, array_to_string(list_sort(list(DISTINCT name)), ',') AS names, count(DISTINCT name) > 2 AS is_group
FROM (SELECT conv_id AS id, turn AS seq, CASE WHEN turn > 0 THEN role || turn END AS title, role AS name FROM conversations) GROUP BY id"""
)
def merge_conversations(a):
    chunks = a.table("conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("seq"), F.when(F.col("turn") > 0, F.concat("role", F.col("turn").cast("string"))).alias("title"), F.array("role").alias("participant_names"))
    return merge.merge_conversations(chunks).select("id", "title", F.array_join(F.array_sort("participant_names"), ",").alias("names"), "is_group")


@query("SELECT id, activity_type, actor_person_id, target_type, target_id, occurred_at, summary, calendar_year, calendar_month, calendar_day FROM ledger", _LEDGER_PARTS)
def ledger_union9(a):
    return derived.ledger(a).drop("source_path", "source_index", "archive_part_id")


@query("SELECT entity_type, entity_id, title, body, context, created_at, conversation_id FROM search_docs", _DOCS)
def search_docs_union10(a):
    return derived.search_documents(a).drop("source_path")


@query("SELECT id, author_id, title, body, created_at FROM posts")
def replay_idempotent(a):
    return merge.first_wins(a.posts.unionByName(a.posts), ["id"], ["created_at"])


@query("SELECT * FROM (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 3 = 0)")
def upsert_rows(a):
    base = a.table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    return merge.upsert(base, base.filter("k % 3 = 0").withColumn("v", F.lit("new")), ["k"])


# -- pages


@query(f"SELECT {_PICK} FROM feed ORDER BY coalesce(created_at, '') DESC, id DESC LIMIT 20", _FEED)
def feed_newest_page1(a):
    return reads.feed(a, page=lambda p: paging.window_of(p, F.col("created_at"), "id", 20)).select(*_FEED_COLUMNS)


@query(f"SELECT {_PICK} FROM feed WHERE coalesce(created_at, '') < '2000-01-01T00:00:00.000Z' OR coalesce(created_at, '') = '2000-01-01T00:00:00.000Z' AND id < 'post:5' ORDER BY coalesce(created_at, '') DESC, id DESC LIMIT 20", _FEED)
def feed_newest_page2(a):
    return reads.feed(a, page=lambda p: paging.window_of(p, F.col("created_at"), "id", 20, after=("2000-01-01T00:00:00.000Z", "post:5"))).select(*_FEED_COLUMNS)


@query(f"SELECT {_PICK} FROM feed WHERE coalesce(created_at, '') > '' OR coalesce(created_at, '') = '' AND id > 'post:2' ORDER BY coalesce(created_at, ''), id LIMIT 20", _FEED)
def feed_oldest_page2(a):
    return reads.feed(a, page=lambda p: paging.window_of(p, F.col("created_at"), "id", 20, descending=False, after=("", "post:2"))).select(*_FEED_COLUMNS)


@query(f"SELECT {_PICK} FROM feed WHERE id = 'post:17'", _FEED)
def post_by_id(a):
    return reads.feed(a, post="post:17").select(*_FEED_COLUMNS)


_PEOPLE = """
rollup AS (
  SELECT p.id, p.display_name, (SELECT count(*) FROM posts x WHERE x.author_id = p.id) AS post_count, (SELECT count(*) FROM comments x WHERE x.author_id = p.id) AS comment_count,
         (SELECT count(*) FROM reactions x WHERE x.person_id = p.id) AS reaction_count, (SELECT count(*) FROM connections x WHERE x.person_id = p.id) AS connection_count FROM people p)"""


@query("SELECT id, display_name, post_count, comment_count, reaction_count, connection_count FROM rollup WHERE lower(display_name) > 'customer#000000050' OR lower(display_name) = 'customer#000000050' AND id > 'person:c:50' ORDER BY lower(display_name), id LIMIT 30", _PEOPLE)
def people_page2(a):
    rows = reads.people_rollup(a, page=lambda p: paging.window_of(p, F.col("sort_name"), "id", 30, descending=False, after=("customer#000000050", "person:c:50")))
    return rows.select("id", "display_name", "post_count", "comment_count", "reaction_count", "connection_count")


@query("SELECT id, display_name, username, relationship_type FROM connections WHERE relationship_type = 'friend' ORDER BY lower(display_name), id LIMIT 50")
def connections_page(a):
    return paging.window_of(reads.connections(a, "friend"), F.col("sort_name"), "id", 50, descending=False).select("id", "display_name", "username", "relationship_type")


@query("SELECT id, display_name FROM connections WHERE lower(display_name) LIKE '%user.3%' OR lower(username) LIKE '%user.3%'")
def connections_filter(a):
    return reads.connections(a, text="User.3").select("id", "display_name")


_THREAD = "SELECT id, sender_name, body, sent_at FROM messages WHERE conversation_id = 'conversation:3' ORDER BY coalesce(sent_at, '') DESC, id DESC LIMIT 40"


@query(_THREAD)
def thread_page(a):
    return paging.window_of(reads.thread(a, "conversation:3"), F.col("sent_at"), "id", 40).select("id", "sender_name", "body", "sent_at")


@query("SELECT id, path, media_type, timestamp FROM media WHERE media_type = 'photo' ORDER BY coalesce(timestamp, '') DESC, id DESC LIMIT 30")
def media_page(a):
    return paging.window_of(a.media.filter("media_type = 'photo'"), F.col("timestamp"), "id", 30).select("id", "path", "media_type", "timestamp")


@query("SELECT l.id, activity_type, occurred_at, summary, p.display_name AS actor_name FROM ledger l LEFT JOIN people p ON p.id = l.actor_person_id WHERE activity_type = 'comment' AND calendar_year = 1996 ORDER BY occurred_at DESC, l.id DESC LIMIT 40", _LEDGER_PARTS)
def activity_page(a):
    rows = reads.activity(derived.ledger(a), a.people, "comment", 1996, page=lambda r: paging.window_of(r, F.col("occurred_at"), "id", 40))
    return rows.select("id", "activity_type", "occurred_at", "summary", "actor_name")


@query(
    """SELECT id, target_type, target_id, calendar_year, greatest(0, 2024 - calendar_year) AS years_ago FROM (
  SELECT * FROM ledger WHERE calendar_month = 3 AND calendar_day = 5 ORDER BY calendar_year DESC, occurred_at DESC, id DESC LIMIT 60)
QUALIFY row_number() OVER (PARTITION BY activity_type, coalesce(target_id, id) ORDER BY calendar_year DESC, occurred_at DESC, id DESC) = 1""",
    _LEDGER_PARTS,
)
def memories(a):
    return reads.memories(derived.ledger(a), 3, 5, 2024).select("id", "target_type", "target_id", "calendar_year", "years_ago")


@query("SELECT o_orderkey AS k, strftime(make_date(2000, month(o_orderdate), day(o_orderdate)) + ((o_orderkey % 5) - 2)::INT, '%m-%d') AS day FROM orders")
def memory_day_shift(a):
    day = F.date_add(F.make_date(F.lit(2000), F.month("o_orderdate"), F.dayofmonth("o_orderdate")), ((F.col("o_orderkey") % 5) - 2).cast("int"))
    return a.table("orders").select(F.col("o_orderkey").alias("k"), F.date_format(day, "MM-dd").alias("day"))


@query("SELECT p.id, p.display_name, p.username, x.facebook_id, x.relationship, (SELECT string_agg(category || ':' || value, ',' ORDER BY category, value) FROM profile_facts) AS facts FROM profiles p LEFT JOIN people x ON x.id = p.person_id")
def profile_card(a):
    p = reads.profile(a)
    return p.select("id", "display_name", "username", "facebook_id", "relationship", F.array_join(F.transform("facts", lambda f: F.concat(f["category"], F.lit(":"), f["value"])), ",").alias("facts"))


@query("SELECT id, unnest(string_split(paths, ',')) AS path FROM (SELECT p.id, string_agg(m.path, ',' ORDER BY m.id) AS paths FROM posts p JOIN media m ON m.owner_type = 'post' AND m.owner_id = p.id GROUP BY p.id)")
def page_media_explode(a):
    owned = reads.nested(a.media.filter("owner_type = 'post'"), "owner_id", ["id"], ["id", "path"], "media").withColumnRenamed("owner_id", "id")
    return a.posts.select("id").join(owned, "id").select("id", F.explode(F.col("media.path")).alias("path"))


# -- scalars


@query("SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') WHEN 1 THEN strftime(o_orderdate, '%Y') || '-01-01T00:00:00.000Z' END AS at FROM orders")
def iso_timestamp_parse(a):
    k = F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("string")).when(k == 1, F.date_format("o_orderdate", "yyyy")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    return a.table("orders").select(F.col("o_orderkey").alias("k"), S.parse_time(raw).alias("at"))


@query("SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%dT15:04:00.000Z') AS at FROM orders")
def human_date_parse(a):
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MMMM d, yyyy 'at' 3:04 'PM'")).otherwise(F.date_format("o_orderdate", "d MMMM yyyy 15:04"))
    return a.table("orders").select(F.col("o_orderkey").alias("k"), S.parse_human_date(raw).alias("at"))


@query("SELECT id, calendar_year, calendar_month, calendar_day FROM ledger WHERE activity_type = 'post'", _LEDGER_PARTS)
def calendar_parts(a):
    return derived.ledger(a).filter("activity_type = 'post'").select("id", "calendar_year", "calendar_month", "calendar_day")


@query()
def fnv1a_ids(a):
    return a.people.select("id", S.fnv1a32(F.col("id")).alias("hash"))


@query("SELECT p_partkey AS k, 'media/a b+' || p_partkey || '.jpg' AS path FROM part")
def path_clean(a):
    raw = F.concat(F.lit("./media//a%20b+"), F.col("p_partkey").cast("string"), F.lit(".jpg"))
    return a.table("part").select(F.col("p_partkey").alias("k"), S.clean_path(raw).alias("path"))


@query("SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'media/' || p_partkey || '.jpg' WHEN 1 THEN 'posts/b/' || p_partkey || '.png' END AS path FROM part")
def path_resolve(a):
    k = F.col("p_partkey").cast("string")
    ref = F.element_at(F.array(F.concat(F.lit("../media/"), k, F.lit(".jpg#x")), F.concat(F.lit("./b/./"), k, F.lit(".png?y=1")), F.concat(F.lit("../../"), k), F.concat(F.lit("https://x/"), k)), (F.col("p_partkey") % 4 + 1).cast("int"))
    return a.table("part").select(F.col("p_partkey").alias("k"), S.resolve_path(F.lit("posts/page.html"), ref).alias("path"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages")
def url_host(a):
    return a.table("pages").select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"))


@query("SELECT p_partkey AS k, '<file>.jpg' AS file FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, '<file>' FROM part WHERE p_partkey % 2 = 1")
def redact_paths(a):
    raw = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, ".JPG").otherwise(" x"))
    return a.table("part").select(F.col("p_partkey").alias("k"), S.redact_file(raw).alias("file"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_extract(a):
    return a.table("events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT l_orderkey AS id, array_to_string(list_sort(list(DISTINCT l_linenumber))[1:3], ',') AS firsts FROM lineitem GROUP BY l_orderkey")
def array_union_caps(a):
    return a.table("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.slice(F.array_sort(F.collect_set("l_linenumber")), 1, 3).cast("array<string>"), ",").alias("firsts"))


# -- search


def _docs(a):
    d = a.table("documents")
    return d.select(F.lit("document").alias("entity_type"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("entity_id"), F.col("source").alias("title"), F.col("text").alias("body"), F.col("lang").alias("context"), F.lit(None).cast("string").alias("created_at"))


_TEXTS = """
texts AS (SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS entity_id, source AS title, text AS body, lang AS context FROM documents),
folded AS (SELECT *, translate(coalesce(title, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, translate(coalesce(body, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS b, translate(coalesce(context, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS c FROM texts),
plain AS (SELECT entity_id, strip_accents(lower(coalesce(title, ''))) AS t, strip_accents(lower(coalesce(body, ''))) AS b, strip_accents(lower(coalesce(context, ''))) AS c FROM texts),
words AS (SELECT entity_id, regexp_extract_all(t, '[\\p{L}\\p{N}\\p{Co}]+') AS t, regexp_extract_all(b, '[\\p{L}\\p{N}\\p{Co}]+') AS b, regexp_extract_all(c, '[\\p{L}\\p{N}\\p{Co}]+') AS c FROM plain)"""


@query("SELECT entity_id FROM folded WHERE t LIKE '%idiot%' OR b LIKE '%idiot%' OR c LIKE '%idiot%'", _TEXTS)
def search_like(a):
    return search.like_hits(_docs(a), "Idiot").select("entity_id")


@query("SELECT entity_id FROM folded WHERE (t LIKE '%the%' OR b LIKE '%the%' OR c LIKE '%the%') AND entity_id > '000000100' ORDER BY entity_id LIMIT 30", _TEXTS)
def search_like_page2(a):
    return search.like_hits(_docs(a), "the").filter("entity_id > '000000100'").orderBy("entity_id").limit(30).select("entity_id")


@query("SELECT entity_id FROM words WHERE (list_contains(t, 'the') OR list_contains(b, 'the') OR list_contains(c, 'the')) AND (list_contains(t, 'en') OR list_contains(b, 'en') OR list_contains(c, 'en'))", _TEXTS)
def search_and_terms(a):
    return search.ranked(_docs(a), "The EN").select("entity_id")


@query("SELECT entity_id FROM words WHERE (' ' || array_to_string(t, ' ') || ' ') LIKE '% of the %' OR (' ' || array_to_string(b, ' ') || ' ') LIKE '% of the %'", _TEXTS)
def search_phrase(a):
    return search.ranked(_docs(a), "of-the").select("entity_id")


_BM25 = _TEXTS + """,
freq AS (SELECT entity_id, len(t) + len(b) + len(c) AS dl, 5.0::DOUBLE * len(list_filter(t, lambda x: x = 'idiot')) + 1.5::DOUBLE * len(list_filter(b, lambda x: x = 'idiot')) + 1.0::DOUBLE * len(list_filter(c, lambda x: x = 'idiot')) AS f FROM words),
corpus AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, sum(CASE WHEN f > 0 THEN 1 ELSE 0 END)::DOUBLE AS d FROM freq)"""


@query("SELECT entity_id, round(-(greatest(1e-6, ln((n - d + 0.5) / (d + 0.5))) * (f * 2.2) / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 4) AS rank FROM freq, corpus WHERE f > 0", _BM25)
def search_bm25(a):
    return search.ranked(_docs(a), "idiot").select("entity_id", F.round("rank", 4).alias("rank"))


_MANY = _TEXTS + """,
freq AS (SELECT entity_id, len(t) + len(b) + len(c) AS dl,
  5.0::DOUBLE * len(list_filter(t, lambda x: x = 'idiot')) + 1.5::DOUBLE * len(list_filter(b, lambda x: x = 'idiot')) + 1.0::DOUBLE * len(list_filter(c, lambda x: x = 'idiot')) AS f,
  5.0::DOUBLE * len(list_filter(t, lambda x: x = 'en')) + 1.5::DOUBLE * len(list_filter(b, lambda x: x = 'en')) + 1.0::DOUBLE * len(list_filter(c, lambda x: x = 'en')) AS g FROM words),
corpus AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, sum(CASE WHEN f > 0 THEN 1 ELSE 0 END)::DOUBLE AS d, sum(CASE WHEN g > 0 THEN 1 ELSE 0 END)::DOUBLE AS e FROM freq)"""


@query(
    """SELECT entity_id, round(-(greatest(1e-6, ln((n - d + 0.5) / (d + 0.5))) * (f * 2.2) / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))
  + greatest(1e-6, ln((n - e + 0.5) / (e + 0.5))) * (g * 2.2) / (g + 1.2 * (0.25 + 0.75 * dl / avgdl))), 4) AS rank FROM freq, corpus WHERE f > 0 AND g > 0""",
    _MANY,
)
def search_stored(a):
    """Two terms by stored postings, which are written and read again."""
    return stored_hits(*build_stored(a))


def build_stored(a) -> tuple[DataFrame, DataFrame]:
    """The postings and the numbers of the corpus, written and read again."""
    folder = ingest.shared_folder(a.spark, f"postings-{uuid.uuid4().hex}")
    search.stored_postings(_docs(a)).write.partitionBy("bucket").parquet(f"{folder}/postings")
    search.corpus(_docs(a)).write.parquet(f"{folder}/corpus")
    return a.spark.read.schema(search.POSTINGS).parquet(f"{folder}/postings"), a.spark.read.schema(search.CORPUS).parquet(f"{folder}/corpus")


def stored_hits(stored: DataFrame, numbers: DataFrame) -> DataFrame:
    return search.scored(stored, numbers, "Idiot ÉN").select("entity_id", F.round("rank", 4).alias("rank"))


@query("SELECT entity_id FROM words WHERE (' ' || array_to_string(t, ' ') || ' ') LIKE '% of the %' OR (' ' || array_to_string(b, ' ') || ' ') LIKE '% of the %'", _TEXTS)
def search_stored_phrase(a):
    return search.scored(search.stored_postings(_docs(a)), search.corpus(_docs(a)), "of-the").select("entity_id")


@query("SELECT c AS lang, count(*) AS n FROM folded WHERE b LIKE '%de%' GROUP BY c", _TEXTS)
def search_filters(a):
    hits = search.like_hits(_docs(a).withColumn("title", F.lit(None).cast("string")).withColumn("lang", F.col("context")).withColumn("context", F.lit(None).cast("string")), "DE")
    return hits.groupBy("lang").agg(F.count("*").alias("n"))


@query()
def search_snippet(a):
    return search.top_hits(_docs(a), "idiot", 20).select("entity_id", "rank", "snippet")


@query("SELECT entity_type, count(*) AS n FROM search_docs WHERE lower(coalesce(title, '')) LIKE '%1%' OR lower(coalesce(body, '')) LIKE '%1%' OR lower(coalesce(context, '')) LIKE '%1%' GROUP BY entity_type", _DOCS)
def global_facets(a):
    return reads.facets(search.like_hits(derived.search_documents(a), "1"))


@query("SELECT term, count(DISTINCT entity_id) AS docs, count(*) AS n FROM (SELECT entity_id, unnest(list_concat(list_concat(t, b), c)) AS term FROM words) GROUP BY term", _TEXTS)
def postings_statistics(a):
    return search.term_statistics(_docs(a))


# -- extensions over time


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def tumbling_days(a):
    rows = a.table("events").select(S.iso(F.col("ts")).alias("occurred_at"))
    return reads.timeline(rows, "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n")
