"""Read queries of an archive, each as a DataFrame that a page or a limit is put on."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlog.functions.scalars import ascii_lower, contains_ci, or_null
from hearthlog.operators.derived import owner


def counts_by(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(name))


def with_count(df: DataFrame, id_col: str, child: DataFrame, key: str, name: str, few: bool = False) -> DataFrame:
    """`df` with the number of its children, 0 for none; children are counted before the join.

    `few` says that df is a page: then its ids, at most a page of them, filter the children where they are read.
    """
    if few:
        child = child.join(F.broadcast(df.select(F.col(id_col).alias(key)).distinct()), key, "left_semi")
    n = counts_by(child, key, name).withColumnRenamed(key, "__key")
    return df.join(n, F.col(id_col) == F.col("__key"), "left").drop("__key").withColumn(name, F.coalesce(name, F.lit(0)))


def named(posts: DataFrame, a, few: bool = False) -> DataFrame:
    """`posts` with author_name and author_photo_path: of the person, else of the profile, else of the archive's owner.

    Without a profile posts keep their rows and have no name where the author isn't known.
    """
    names = a.people.select(F.col("id").alias("author_id"), F.col("display_name").alias("known_name"), or_null(a.people, "profile_photo_path").alias("known_photo"))
    if few:
        names = names.join(F.broadcast(posts.select("author_id").distinct()), "author_id", "left_semi")
    own = owner(a).select("owner_name")  # one row
    if "is_archive_owner" in a.people.columns:
        photo = a.people.filter("is_archive_owner").agg(F.min("profile_photo_path").alias("owner_photo"))  # one row
    else:
        photo = own.select(F.lit(None).cast("string").alias("owner_photo"))
    mine = a.profiles.select(F.col("person_id").alias("author_id"), "display_name").groupBy("author_id").agg(F.min("display_name").alias("profile_name"))
    out = posts.join(names, "author_id", "left").join(mine, "author_id", "left").crossJoin(F.broadcast(own)).crossJoin(F.broadcast(photo))
    out = out.withColumn("author_name", F.coalesce("known_name", "profile_name", "owner_name")).withColumn("author_photo_path", F.coalesce("known_photo", "owner_photo"))
    return out.drop("known_name", "known_photo", "profile_name", "owner_name", "owner_photo")


def feed(a, year: str | None = None, person: str | None = None, post: str | None = None, page: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Posts with author and numbers of media, comments and reactions; `page` cuts the posts before anything is joined."""
    posts = a.posts
    for wanted, test in ((year, F.substring("created_at", 1, 4) == year), (person, F.col("author_id") == person), (post, F.col("id") == post)):
        posts = posts.filter(test) if wanted else posts
    posts, few = (page(posts), True) if page else (posts, bool(post))
    posts = named(posts, a, few)
    posts = with_count(posts, "id", a.media.filter("owner_type = 'post'"), "owner_id", "media_count", few)
    posts = with_count(posts, "id", a.comments, "post_id", "comment_count", few)
    return with_count(posts, "id", a.reactions.filter("target_type = 'post'"), "target_id", "reaction_count", few)


def with_children(page: DataFrame, child: DataFrame, key: str, order: list[str], fields: list[str], name: str) -> DataFrame:
    """The rows of a page with the list of their children; the page's ids filter the children where they are read."""
    fields = [f for f in fields if f in child.columns]
    ids = F.broadcast(page.select(F.col("id").alias(key)).distinct())
    lists = nested(child.join(ids, key, "left_semi"), key, order, fields, name).withColumnRenamed(key, "__key")
    kind = dict(lists.dtypes)[name]
    return page.join(lists, F.col("id") == F.col("__key"), "left").drop("__key").withColumn(name, F.coalesce(name, F.array().cast(kind)))


MEDIA_FIELDS = ["id", "path", "media_type", "filename", "mime_type", "caption", "timestamp", "owner_type", "owner_id", "width", "height", "duration_ms"]


def full_posts(page: DataFrame, a) -> DataFrame:
    """A page of posts with lists of their media, comments and reactions."""
    page = with_children(page, a.media.filter("owner_type = 'post'"), "owner_id", ["id"], MEDIA_FIELDS, "media")
    page = with_children(page, a.comments, "post_id", ["created_at", "id"], ["id", "author_id", "author_name", "body", "created_at"], "comments")
    return with_children(page, a.reactions.filter("target_type = 'post'"), "target_id", ["created_at", "id"], ["id", "person_id", "person_name", "kind", "created_at"], "reactions")


def nested(df: DataFrame, key: str, order: list[str], fields: list[str], name: str) -> DataFrame:
    """key and a list of structs of its rows, in a defined order."""
    kept = F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order])))
    return df.groupBy(key).agg(F.transform(kept, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name))


def inbox(a, text: str | None = None) -> DataFrame:
    """Conversations with number of messages and the latest one; messages are aggregated once."""
    k = F.coalesce("sent_at", F.lit(""))
    stats = a.messages.groupBy(F.col("conversation_id").alias("id")).agg(F.count("*").alias("message_count"), F.max(F.struct(k.alias("k"), "id", "body")).alias("last"))
    chats = a.conversations.join(stats, "id", "left")
    if text and text.strip():
        chats = chats.filter(contains_ci(F.coalesce("title", F.lit("")), text) | contains_ci(F.array_join("participant_names", ","), text))
    return chats.select("id", "title", "is_group", F.coalesce("message_count", F.lit(0)).alias("message_count"), F.col("last.body").alias("latest_text"), F.coalesce("last.k", F.lit("")).alias("latest_sent_at"))


def thread(a, conversation: str) -> DataFrame:
    texts = a.messages.filter(F.col("conversation_id") == conversation)
    return with_count(texts, "id", a.media.filter("owner_type = 'message'"), "owner_id", "media_count")


def activity(ledger: DataFrame, people: DataFrame, kind: str | None = None, year: int | None = None, text: str | None = None, page: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Records of the ledger with the name of who acted; `page` cuts them before names are joined."""
    rows = ledger
    rows = rows.filter(F.col("activity_type") == kind) if kind else rows
    rows = rows.filter(F.col("calendar_year") == year) if year else rows
    if text and text.strip():
        rows = rows.filter(contains_ci(F.col("summary"), text) | F.coalesce(contains_ci(or_null(rows, "source_path"), text), F.lit(False)))
    names = people.select(F.col("id").alias("actor_person_id"), F.col("display_name").alias("actor_name"))
    if page:
        rows = page(rows)
        names = names.join(F.broadcast(rows.select("actor_person_id").distinct()), "actor_person_id", "left_semi")
    return rows.join(names, "actor_person_id", "left")


def memories(ledger: DataFrame, month: int, day: int, as_of_year: int, limit: int = 60) -> DataFrame:
    """The same day in any year, newest first; limited, then one row for each kind of activity and target."""
    today = ledger.filter((F.col("calendar_month") == month) & (F.col("calendar_day") == day))
    few = today.orderBy(F.desc("calendar_year"), F.desc("occurred_at"), F.desc("id")).limit(min(100, max(1, limit)))
    once = few.groupBy("activity_type", F.coalesce("target_id", "id").alias("__target")).agg(F.max(F.struct("calendar_year", "occurred_at", "id", "target_type", "target_id", "summary")).alias("m")).select("activity_type", "m.*")
    return once.withColumn("years_ago", F.greatest(F.lit(0), F.lit(as_of_year) - F.col("calendar_year")))


#: The numbers of a person's records.
PERSON_COUNTS = ["post_count", "comment_count", "reaction_count", "connection_count", "media_count", "message_count", "album_count", "shared_post_count", "shared_media_count", "participation_count"]


def people_rollup(a, page: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """People with the PERSON_COUNTS of their records, and first and last sight.

    Media count through the author of their post, the sender of their message and the owner of their album; shared are
    a person's posts, and the media of their albums. Participation is exact membership in a conversation's
    participant_ids, each conversation once. `page` cuts the people by sort_name first; then only their own records are counted.
    """
    people = a.people.withColumn("sort_name", ascii_lower(F.col("display_name")))
    people = page(people) if page else people

    def media_of(kind: str, owners: DataFrame, person: str) -> DataFrame:
        return a.media.filter(F.col("owner_type") == kind).join(owners.select(F.col("id").alias("owner_id"), F.col(person).alias("person")), "owner_id").select("person")

    inside = a.conversations.select(F.explode(F.array_distinct("participant_ids")).alias("person"))
    parts = [
        (a.posts, "author_id", "created_at", ["post_count", "shared_post_count"]), (a.comments, "author_id", "created_at", ["comment_count"]), (a.reactions, "person_id", "created_at", ["reaction_count"]),
        (a.messages, "sender_id", "sent_at", ["message_count"]), (a.connections, "person_id", None, ["connection_count"]), (a.albums, "owner_id", None, ["album_count"]), (inside, "person", None, ["participation_count"]),
        (media_of("post", a.posts, "author_id"), "person", None, ["media_count"]), (media_of("message", a.messages, "sender_id"), "person", None, ["media_count"]),
        (media_of("album", a.albums, "owner_id"), "person", None, ["media_count", "shared_media_count"]),
    ]
    # One union and one aggregate instead of a join for each number.
    seen = lambda at: (F.col(at) if at else F.lit(None).cast("string")).alias("at")
    rows = [df.select(F.col(key).alias("id"), *[F.lit(int(n in told)).alias(n) for n in PERSON_COUNTS], seen(at)) for df, key, at, told in parts]
    if page:
        wanted = F.broadcast(people.select("id"))
        rows = [df.join(wanted, "id", "left_semi") for df in rows]
    sums = reduce(DataFrame.unionByName, rows).groupBy("id").agg(*[F.sum(n).alias(n) for n in PERSON_COUNTS], F.min("at").alias("first_interaction"), F.max("at").alias("last_interaction"))
    return people.join(sums, "id", "left").select("id", "display_name", "sort_name", *[F.coalesce(n, F.lit(0)).alias(n) for n in PERSON_COUNTS], "first_interaction", "last_interaction")


def connections(a, kind: str | None = None, text: str | None = None) -> DataFrame:
    rows = a.connections
    rows = rows.filter(F.col("relationship_type") == kind) if kind else rows
    if text and text.strip():
        rows = rows.filter(contains_ci(F.col("display_name"), text) | F.coalesce(contains_ci(F.col("username"), text), F.lit(False)))
    return rows.withColumn("sort_name", ascii_lower(F.col("display_name")))


def albums(a) -> DataFrame:
    """Albums with media ids by position and their number."""
    inside = a.album_media.groupBy(F.col("album_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "media_id"))), lambda x: x["media_id"]).alias("media_ids"))
    rows = a.albums.join(inside, "id", "left").withColumn("media_ids", F.coalesce("media_ids", F.array().cast("array<string>")))
    return rows.withColumn("media_count", F.size("media_ids")).withColumn("sort_at", F.coalesce("updated_at", "created_at", F.lit("")))


def album_detail(a, album: str) -> DataFrame:
    return a.album_media.filter(F.col("album_id") == album).join(a.media, F.col("media_id") == F.col("id")).select("position", "id", "path", "media_type")


def stats(a, ledger: DataFrame) -> DataFrame:
    """name, value: numbers of each entity, and the ledger's range and years."""
    names = ["profiles", "people", "posts", "comments", "reactions", "connections", "albums", "conversations", "messages", "media", "profile_facts"]
    rows = [getattr(a, n).agg(F.lit(n).alias("name"), F.count("*").cast("string").alias("value")) for n in names]
    span = ledger.agg(F.min("occurred_at").alias("lo"), F.max("occurred_at").alias("hi"), F.count_distinct("calendar_year").cast("string").alias("years"), F.count("*").cast("string").alias("n"))
    more = span.select(F.explode(F.create_map(F.lit("activity_first"), F.col("lo"), F.lit("activity_last"), F.col("hi"), F.lit("activity_years"), F.col("years"), F.lit("activities"), F.col("n"))).alias("name", "value"))
    return reduce(DataFrame.unionByName, [*rows, more])


def profile(a) -> DataFrame:
    """The owner's profile with the person behind it and the facts in order."""
    facts = a.profile_facts.groupBy(F.col("profile_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("category", "value"))).alias("facts"))
    person = a.people.select(F.col("id").alias("person_id"), "facebook_id", "relationship")
    return a.profiles.join(person, "person_id", "left").join(facts, "id", "left").limit(1)


def participation(chats: DataFrame) -> DataFrame:
    """name, n: conversations of each participant, by exact membership."""
    return chats.select(F.explode("participant_names").alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def facets(hits: DataFrame) -> DataFrame:
    return hits.groupBy("entity_type").agg(F.count("*").alias("n"))


def timeline(events: DataFrame, every: str, slide: str | None = None) -> DataFrame:
    """Extension: numbers of records in windows of time."""
    at: Column = F.to_timestamp("occurred_at")
    return events.groupBy(F.window(at, every, slide) if slide else F.window(at, every)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")
