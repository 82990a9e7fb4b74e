"""JSON files of an archive as entity rows, by variant paths; fields are tried under their usual names."""

from __future__ import annotations

import json
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlog.functions import scalars as S


def parsed(files: DataFrame) -> DataFrame:
    """`files` (part_path, path, text) with `v`, the parsed document; null where it isn't JSON."""
    return files.withColumn("v", F.try_parse_json("text")).drop("text")


def _at(v: Column, path: str) -> Column:
    """The value at a path, if there is one."""
    return F.try_variant_get(v, path, "variant")


def _is(x: Column, *kinds: str) -> Column:
    return F.schema_of_variant(x).rlike("^(" + "|".join(kinds) + ")")


def _text(v: Column, path: str) -> Column:
    """The text at a path; null where there is none, where it is blank, or where something else is there."""
    return F.when(F.schema_of_variant(_at(v, path)) == "STRING", F.nullif(F.regexp_replace(F.try_variant_get(v, path, "string"), r"^\s+$", ""), F.lit("")))


def pick(v: Column, *paths: str) -> Column:
    """The first text that isn't blank."""
    return F.coalesce(*[_text(v, p) for p in paths])


def number(v: Column, *paths: str) -> Column:
    """The first number or text that isn't blank, if it is of digits alone."""
    found = F.coalesce(*[F.nullif(F.trim(F.try_variant_get(v, p, "string")), F.lit("")) for p in paths])
    return F.nullif(F.regexp_extract(found, r"^(\d+)$", 1), F.lit(""))


def raw_moment(v: Column, *paths: str) -> Column:
    """The first value that is there."""
    return F.trim(F.coalesce(*[F.try_variant_get(v, p, "string") for p in paths]))


def moment(v: Column, *paths: str) -> Column:
    """The first value that is there, as a time."""
    return S.parse_time(raw_moment(v, *paths))


def _list(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def listed(v: Column, *keys: str) -> Column:
    """A list as it is, that under the first key that has one, an object without nested values as one element, or its nested values."""
    inside = F.map_values(F.try_variant_get(v, "$", "map<string,variant>"))
    nested = F.filter(inside, lambda x: _is(x, "OBJECT", "ARRAY"))
    return F.coalesce(_list(v, "$"), *[_list(v, f"$.{k}") for k in keys], F.when((F.size(inside) > 0) & (F.size(nested) == 0), F.array(v)).otherwise(nested))


def rows_of(files: DataFrame, lists: Column) -> DataFrame:
    """One row for each element, with `place` from before any filter."""
    keep = [c for c in ("part_path", "path") if c in files.columns]
    return files.select(*keep, F.posexplode(lists).alias("place", "item"))


def _id(prefix: str, *more: str) -> Column:
    return F.concat_ws(":", F.lit(prefix), S.slug(F.col("path")), "place", *more)


def _source() -> list[Column]:
    return [F.col("part_path").alias("archive_part_id"), F.col("path").alias("source_path"), F.col("place").cast("int").alias("source_index")]


def _url(v: Column) -> Column:
    found = pick(v, "$.profile_url", "$.profileUrl", "$.url")
    return F.when(found.rlike(r"(?i)^https?://"), found)


_ACTORS = ["actor", "author", "from", "user", "profile", "reacter"]


def with_actor(rows: DataFrame, *records: str) -> DataFrame:
    """`rows` with actor_id, actor_name, actor_number, actor_username and actor_url of who acted in the first record that says it.

    Who acted is the nested actor, or the record itself. An id is exact by number, else a name within its file.
    """
    for k, c in enumerate(records):
        rows = rows.withColumn(f"__who{k}", F.coalesce(*[F.when(_is(_at(F.col(c), f"$.{a}"), "OBJECT"), _at(F.col(c), f"$.{a}")) for a in _ACTORS], F.col(c)))
    every = [(F.col(c), F.col(f"__who{k}")) for k, c in enumerate(records)]
    name = F.coalesce(*[x for i, w in every for x in (pick(w, "$.name", "$.display_name", "$.displayName", "$.full_name", "$.username"), pick(i, "$.actor_name", "$.author_name"))])
    digits = F.coalesce(*[x for i, w in every for x in (number(w, "$.id", "$.user_id", "$.facebook_id"), number(i, "$.actor_id", "$.author_id"))])
    rows = rows.withColumn("actor_name", name).withColumn("actor_number", digits)
    rows = rows.withColumn("actor_username", F.coalesce(*[pick(w, "$.username", "$.user_name") for _, w in every])).withColumn("actor_url", F.coalesce(*[_url(w) for _, w in every]))
    social = F.concat(F.lit("person:social:"), S.slug(F.col("path")), F.lit(":"), S.slug(F.col("actor_name")))
    return rows.withColumn("actor_id", F.coalesce(F.concat(F.lit("person:facebook:"), "actor_number"), social)).drop(*[f"__who{k}" for k in range(len(records))])


#: Where posts are listed.
POST_LISTS = ["posts", "posts_v2", "your_posts", "entries", "items", "data"]
INNER_LISTS = ["posts", "entries", "items", "data"]
_TIMES = ["$.timestamp", "$.timestamp_ms", "$.creation_timestamp", "$.created_at"]


def posts(files: DataFrame) -> DataFrame:
    """Posts with a body, a title or local media; `item` is the record they came from."""
    v = F.col("v")
    named = [x for k in POST_LISTS for x in (_list(v, f"$.{k}"), *[_list(v, f"$.{k}.{n}") for n in INNER_LISTS])]
    alone = F.filter(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), lambda x: pick(x, "$.post", "$.text", "$.message", "$.title").isNotNull() | _list(x, "$.data").isNotNull())
    rows = rows_of(files, F.coalesce(_list(v, "$"), *named, alone))
    i = F.col("item")
    data = F.coalesce(_list(i, "$.data"), F.array().cast("array<variant>"))
    inner = F.filter(F.transform(data, lambda d: pick(d, "$.post", "$.text", "$.content", "$.message")), lambda t: t.isNotNull())
    body = F.coalesce(pick(i, "$.post", "$.text", "$.content", "$.message", "$.story"), F.try_element_at(inner, F.lit(1)))
    title, author = pick(i, "$.title", "$.name"), number(i, "$.author_id", "$.actor_id", "$.author.id")
    rows = rows.withColumn("at", raw_moment(i, "$.timestamp", "$.timestamp_ms", "$.creation_timestamp", "$.created_timestamp", "$.created_time"))
    return rows.filter(body.isNotNull() | title.isNotNull() | F.to_json(i).rlike(r'"(uri|path|filename|file_name|fileName|local_path|localPath)"')).select(
        _id("post").alias("id"), F.coalesce(F.concat(F.lit("person:facebook:"), author), F.lit("owner")).alias("author_id"), pick(i, "$.author.name", "$.author.display_name", "$.author_name").alias("author_name"),
        title.alias("title"), body.alias("body"), S.parse_time(F.col("at")).alias("created_at"), *_source(), "item",
    )


def _told(i: Column, *names: str) -> Column:
    """A record itself, or the first of its data, that has one of these texts."""
    has = lambda x: pick(x, *names).isNotNull()
    return F.when(has(i), i).otherwise(F.try_element_at(F.filter(F.coalesce(_list(i, "$.data"), F.array().cast("array<variant>")), has), F.lit(1)))


_COMMENT = ["$.comment", "$.text", "$.content", "$.body", "$.message", "$.comment.text", "$.comment.comment"]
_REACTION = ["$.reaction", "$.type", "$.kind", "$.name", "$.label", "$.reaction_type"]


_WHO = {"facebook_id": "actor_number", "username": "actor_username", "profile_url": "actor_url"}


def _comments(rows: DataFrame) -> DataFrame:
    """Comments from rows with path, post_id, place, k and item; those without text go."""
    i, s = F.col("item"), F.col("s")
    rows = with_actor(rows.withColumn("s", _told(i, *_COMMENT)).filter("s IS NOT NULL"), "s", "item")
    rows = rows.withColumn("at", F.coalesce(raw_moment(s, *_TIMES), raw_moment(i, "$.timestamp", "$.timestamp_ms")))
    return rows.select(
        F.concat_ws(":", F.lit("comment"), S.slug(F.col("path")), "place", "k").alias("id"), "post_id", F.col("actor_id").alias("author_id"), F.col("actor_name").alias("author_name"),
        pick(s, *_COMMENT).alias("body"), S.parse_time(F.col("at")).alias("created_at"), *_source(), *[F.col(c).alias(n) for n, c in _WHO.items()],
    )


def _reactions(rows: DataFrame) -> DataFrame:
    """Reactions from rows with path, target_id, place, k and item; a text alone is a kind."""
    i, s = F.col("item"), F.col("s")
    rows = with_actor(rows.withColumn("s", F.coalesce(_told(i, *_REACTION), i)), "s", "item")
    kind = F.coalesce(pick(s, *_REACTION), pick(i, "$"), F.lit("Like"))
    rows = rows.withColumn("at", F.coalesce(raw_moment(s, *_TIMES), raw_moment(i, "$.timestamp", "$.timestamp_ms")))
    return rows.select(
        F.concat_ws(":", F.lit("reaction:post"), S.slug(F.col("target_id")), "k").alias("id"), F.lit("post").alias("target_type"), "target_id", F.col("actor_id").alias("person_id"), F.col("actor_name").alias("person_name"),
        kind.alias("kind"), S.parse_time(F.col("at")).alias("created_at"), *_source(), *[F.col(c).alias(n) for n, c in _WHO.items()],
    )


def _inside(post_rows: DataFrame, keys: list[str], inner: list[str], name: str) -> DataFrame:
    """part_path, path, place, the post's id under `name`, k and item of each element of a post's list."""
    found = F.coalesce(*[_at(F.col("item"), f"$.{k}") for k in keys])
    rows = post_rows.select(F.col("archive_part_id").alias("part_path"), F.col("source_path").alias("path"), F.col("source_index").alias("place"), F.col("id").alias(name), found.alias("list")).filter("list IS NOT NULL")
    return rows.select("part_path", "path", "place", name, F.posexplode(listed(F.col("list"), *inner)).alias("k", "item"))


def post_comments(post_rows: DataFrame) -> DataFrame:
    return _comments(_inside(post_rows, ["comments", "comments_v2", "comment_data", "comment"], ["comments", "comments_v2", "comment_data", "comment", "data"], "post_id"))


def post_reactions(post_rows: DataFrame) -> DataFrame:
    return _reactions(_inside(post_rows, ["reactions", "reactions_v2", "likes"], ["reactions", "reactions_v2", "likes", "data"], "target_id"))


def _target(i: Column) -> Column:
    return F.coalesce(pick(i, "$.post_id", "$.postId", "$.target_id", "$.targetId", "$.post.id"), _id("post"))


def comments(files: DataFrame) -> DataFrame:
    """Comments of a file of their own; the target is named, or the post at the same place."""
    rows = rows_of(files, listed(F.col("v"), "comments", "comments_v2", "comment_data", "data"))
    return _comments(rows.select("part_path", "path", "place", F.lit(0).alias("k"), _target(F.col("item")).alias("post_id"), "item"))


def reactions(files: DataFrame) -> DataFrame:
    rows = rows_of(files, listed(F.col("v"), "reactions", "reactions_v2", "likes", "data"))
    return _reactions(rows.select("part_path", "path", "place", F.lit(0).alias("k"), _target(F.col("item")).alias("target_id"), "item"))


#: Fields that name a file, and how deep they are looked for.
FILE_KEYS = ["uri", "path", "filename", "file_name", "fileName", "local_path", "localPath"]
HINT_KEYS = ["mime_type", "mimeType", "type", "media_type", "mediaType"]
MOST_DEPTH = 6


def _walk(node, depth: int = 0):
    """The objects of a document, outer ones first."""
    if depth > MOST_DEPTH:
        return
    if isinstance(node, dict):
        yield node
    for child in node.values() if isinstance(node, dict) else node if isinstance(node, list) else ():
        yield from _walk(child, depth + 1)


def _first_text(node: dict, keys: list[str]) -> str | None:
    return next((node[k] for k in keys if isinstance(node.get(k), str) and node[k].strip()), None)


def _whole(x) -> int | None:
    return int(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None


#: What is told of a reference to a file.
REFERENCE = ["k", "ref", "hint", "caption", "raw_time", "width", "height", "duration_ms"]


def references_told(document):
    """The fields of REFERENCE for each object that names a file, at any depth."""
    for k, n in enumerate(x for x in _walk(document) if _first_text(x, FILE_KEYS)):
        size = next((n[x] for x in ("media_metadata", "metadata", "dimensions") if isinstance(n.get(x), dict)), {})
        at = next((n[x] for x in ("creation_timestamp", "timestamp", "creation_time") if n.get(x) is not None), None)
        lasts = _whole(size.get("duration_ms")) or (_whole(size.get("duration")) or 0) * 1000 or None
        yield k, _first_text(n, FILE_KEYS), _first_text(n, HINT_KEYS), _first_text(n, ["description", "caption", "title", "name"]), None if at is None else str(at), _whole(size.get("width")), _whole(size.get("height")), lasts


def references(owners: DataFrame) -> DataFrame:
    """Every file that the records of owners (owner_type, owner_id, archive_part_id, source_path, source_index, item) name, at any depth.

    k numbers them within their owner; objects come in the order of their keys. ref is as it was written.
    """
    keep = ["owner_type", "owner_id", "archive_part_id", "source_path", "source_index"]
    kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())

    def run(batches):
        for batch in batches:
            which, out = [], []
            for row, text in enumerate(batch.column("json").to_pylist()):
                found = list(references_told(json.loads(text))) if text else []
                out += found
                which += [row] * len(found)
            of = batch.select(keep).take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays([*of.columns, *[pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]], names=[*keep, *REFERENCE])

    schema = "owner_type string, owner_id string, archive_part_id string, source_path string, source_index int, k int, ref string, hint string, caption string, raw_time string, width int, height int, duration_ms int"
    return owners.select(*keep[:4], F.col("source_index").cast("int").alias("source_index"), F.to_json("item").alias("json")).mapInArrow(run, schema)


def media(refs: DataFrame) -> DataFrame:
    """Local, safe files of references, once for each path and hint of an owner."""
    path = S.clean_path(F.col("ref"))
    local = ~F.col("ref").rlike(r"(?i)^(https?://|data:)") & ~S.suspicious_path(F.col("ref")) & ~S.suspicious_path(path)
    rows = refs.withColumn("path", path).filter(local & (path.rlike(r"[-_./]") | F.col("hint").isNotNull()))
    first = rows.groupBy("owner_type", "owner_id", "path", F.coalesce("hint", F.lit("")).alias("h")).agg(F.min_by(F.struct(*rows.columns), "k").alias("r")).select("r.*")
    return first.select(
        F.concat_ws(":", F.lit("media"), "owner_type", S.slug(F.col("owner_id")), "k").alias("id"), "path", S.media_type(F.col("path"), F.col("hint")).alias("media_type"), F.substring_index("path", "/", -1).alias("filename"),
        F.when(F.col("hint").contains("/"), F.lower("hint")).alias("mime_type"), "caption", S.parse_time(F.col("raw_time")).alias("timestamp"), "owner_type", "owner_id", "width", "height", "duration_ms", "archive_part_id", "source_path", "source_index", "k",
    )


def unsafe_references(refs: DataFrame) -> DataFrame:
    """path and message for each file name that leaves the archive."""
    bad = refs.filter(S.suspicious_path(F.col("ref")) | S.suspicious_path(S.clean_path(F.col("ref"))))
    return bad.filter(~F.col("ref").rlike(r"(?i)^(https?://|data:)")).select("archive_part_id", F.col("source_path").alias("path"), F.concat(F.lit("suspicious media path skipped ("), "ref", F.lit(")")).alias("message")).distinct()


#: Where messages are listed, below the document or a thread in it.
MESSAGE_LISTS = ["messages", "message", "messages_data", "message_data", "entries", "items", "data"]
INNER_MESSAGES = ["messages", "messages_data", "entries", "items", "data"]
THREADS = ["", ".thread", ".conversation", ".thread_data"]


def _conversation_id() -> Column:
    folder = F.regexp_extract("path", r"^(?:.*/)?([^/]+)/[^/]*$", 1)
    v = F.col("v")
    named = F.coalesce(*[F.try_variant_get(v, p, "string") for p in ("$.thread_path", "$.thread_id")])
    return F.concat(F.lit("conversation:"), S.slug(F.coalesce(named, F.nullif(folder, F.lit("")), F.col("path"))))


def _participant(conversation: Column, name: Column, digits: Column) -> Column:
    return F.concat(F.lit("person:messenger:"), S.slug(conversation), F.lit(":"), S.slug(F.coalesce(digits, name, F.lit("unknown"))))


def messages(files: DataFrame) -> DataFrame:
    """Messages with a text or local media; `item` is the record they came from."""
    v = F.col("v")
    lists = [x for t in THREADS for k in MESSAGE_LISTS for x in (_list(v, f"${t}.{k}"), *[_list(v, f"${t}.{k}.{n}") for n in INNER_MESSAGES])]
    rows = files.select("part_path", "path", _conversation_id().alias("conversation_id"), F.posexplode(F.coalesce(_list(v, "$"), *lists)).alias("place", "item"))
    i = F.col("item")
    name = pick(i, "$.sender_name", "$.sender", "$.from", "$.sender_info.name", "$.sender_info.display_name", "$.sender_info.full_name", "$.sender.name", "$.sender.display_name", "$.from.name")
    digits, body = number(i, "$.sender_id", "$.user_id", "$.sender_info.id"), pick(i, "$.content", "$.text", "$.body", "$.message")
    rows = rows.withColumn("at", raw_moment(i, "$.timestamp_ms", "$.timestamp", "$.creation_timestamp", "$.created_at"))
    kept = rows.filter(body.isNotNull() | F.to_json(i).rlike(r'"(uri|path|filename|file_name|fileName|local_path|localPath)"'))
    return kept.select(
        _id("message").alias("id"), "conversation_id", _participant(F.col("conversation_id"), name, digits).alias("sender_id"), name.alias("sender_name"), digits.alias("facebook_id"), body.alias("body"),
        S.parse_time(F.col("at")).alias("sent_at"), *_source(), "item",
    )


def participants(files: DataFrame) -> DataFrame:
    """conversation_id, place, name, id, facebook_id, profile_url of who a thread says takes part."""
    v = F.col("v")
    people = F.coalesce(*[x for p in ("$.participants", "$.thread.participants", "$.conversation.participants") for x in (_list(v, p), F.map_values(F.try_variant_get(v, p, "map<string,variant>")))])
    rows = files.select("part_path", "path", _conversation_id().alias("conversation_id"), F.posexplode(people).alias("place", "item"))
    i = F.col("item")
    name, digits = pick(i, "$.name", "$.display_name", "$.full_name"), number(i, "$.id", "$.user_id")
    return rows.select("part_path", "path", "conversation_id", "place", name.alias("name"), _participant(F.col("conversation_id"), name, digits).alias("id"), digits.alias("facebook_id"), _url(i).alias("profile_url"))


def conversations(files: DataFrame, message_rows: DataFrame) -> DataFrame:
    """Titles and participants over all chunks of a thread; who is named comes first, then who only wrote."""
    v = F.col("v")
    chunk = S.natural_key(F.col("path"))
    told = files.select(_conversation_id().alias("id"), pick(v, "$.title", "$.thread_name", "$.name").alias("title"), "part_path", "path", chunk.alias("o"))
    heads = told.groupBy("id").agg(F.min_by("title", F.when(F.col("title").isNotNull(), F.col("o"))).alias("title"), F.min_by("path", "o").alias("source_path"), F.min_by("part_path", "o").alias("archive_part_id"))
    people = participants(files).select(F.col("conversation_id").alias("id"), F.struct(F.lit(0).alias("r"), S.natural_key(F.col("path")).alias("o"), "place").alias("k"), "name", F.col("id").alias("person"))
    wrote = message_rows.select(F.col("conversation_id").alias("id"), F.struct(F.lit(1).alias("r"), S.natural_key(F.col("source_path")).alias("o"), F.col("source_index").alias("place")).alias("k"), F.col("sender_name").alias("name"), F.col("sender_id").alias("person"))
    first = people.unionByName(wrote).groupBy("id", "person").agg(F.min("k").alias("k"), F.min_by("name", "k").alias("name"))
    lists = first.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "name", "person"))).alias("all"))
    names = F.array_distinct(F.filter(F.transform("all", lambda x: x["name"]), lambda n: n.isNotNull()))
    out = heads.join(lists, "id", "left").select("id", "title", F.coalesce(names, F.array().cast("array<string>")).alias("participant_names"), F.coalesce(F.transform("all", lambda x: x["person"]), F.array().cast("array<string>")).alias("participant_ids"), "archive_part_id", "source_path")
    return out.withColumn("title", F.coalesce("title", F.nullif(F.array_join("participant_names", ", "), F.lit("")), F.lit("Conversation"))).withColumn("is_group", F.size("participant_names") > 2)


def connections(files: DataFrame) -> DataFrame:
    """Connections from a list, or from an object of lists whose keys say what kind they are."""
    keyed = files.select("part_path", "path", F.posexplode(F.map_entries(F.try_variant_get("v", "$", "map<string,variant>"))).alias("n", "e"))
    keyed = keyed.select("part_path", "path", F.col("e.key").alias("hint"), "n", F.posexplode(_list(F.col("e.value"), "$")).alias("k", "item"))
    before = keyed.groupBy("part_path", "path", "n").agg(F.count("*").alias("c"))
    # Places go on from list to list within a file.
    sums = before.groupBy("part_path", "path").agg(F.array_sort(F.collect_list(F.struct("n", "c"))).alias("all"))
    start = F.aggregate(F.filter("all", lambda x: x["n"] < F.col("n")), F.lit(0).cast("long"), lambda a, x: a + x["c"])
    keyed = keyed.join(sums, ["part_path", "path"]).select("part_path", "path", "hint", (start + F.col("k")).cast("int").alias("place"), "item")
    rows = rows_of(files, _list(F.col("v"), "$")).withColumn("hint", F.lit("")).select(keyed.columns).unionByName(keyed)
    rows = with_actor(rows, "item")
    i = F.col("item")
    name, digits = F.coalesce("actor_name", pick(i, "$.name", "$.display_name", "$.full_name", "$.username")), F.coalesce("actor_number", number(i, "$.id", "$.user_id", "$.facebook_id"))
    rows = rows.withColumn("name", name).withColumn("digits", digits).withColumn("told", F.concat_ws(" ", "path", F.coalesce(pick(i, "$.type", "$.relationship", "$.status", "$.direction"), F.col("hint"))))
    rows = rows.withColumn("began", raw_moment(i, "$.timestamp", "$.timestamp_ms", "$.created_at", "$.friendship_date", "$.added_timestamp")).withColumn("ended", raw_moment(i, "$.removed_timestamp", "$.removed_at", "$.unfriended_at"))
    name, digits = F.col("name"), F.col("digits")
    return rows.filter("name IS NOT NULL").select(
        _id("connection").alias("id"), F.coalesce("actor_id", F.concat(F.lit("person:facebook:"), digits), F.concat_ws(":", F.lit("person:connection"), S.slug(F.col("path")), "place")).alias("person_id"), name.alias("display_name"), digits.alias("facebook_id"),
        pick(i, "$.username", "$.user_name").alias("username"), _url(i).alias("profile_url"), S.connection_type(F.col("told")).alias("relationship_type"), S.parse_time(F.col("began")).alias("started_at"), S.parse_time(F.col("ended")).alias("ended_at"), *_source(),
    )


def albums(files: DataFrame) -> DataFrame:
    """Albums with a title; `item` is what they hold."""
    i = F.col("item")
    rows = rows_of(files, listed(F.col("v"), "albums", "data")).withColumn("title", pick(i, "$.title", "$.name", "$.album_name")).filter("title IS NOT NULL")
    inside, owner = F.coalesce(*[_at(i, f"$.{k}") for k in ("media", "photos", "videos", "items", "contents")]), number(i, "$.owner_id", "$.user_id")
    return rows.select(
        _id("album").alias("id"), "title", pick(i, "$.description", "$.caption").alias("description"), F.coalesce(F.concat(F.lit("person:facebook:"), owner), F.lit("owner")).alias("owner_id"),
        moment(i, "$.creation_timestamp", "$.created_at", "$.timestamp").alias("created_at"), moment(i, "$.update_timestamp", "$.updated_at").alias("updated_at"), *_source(), inside.alias("item"),
    )


#: Where a profile is looked for, and the fields that show that it is one.
PROFILE_ROOTS = ["profile_information", "profile_v2", "personal_information", "profile", "account", "account_information", "user_profile", "accounts"]
PROFILE_INNER = ["profile_information", "profile_v2", "personal_information", "basic_information", "account_information", "profile", "account", "data", "user"]
PROFILE_FIELDS = ["name", "full_name", "display_name", "username", "user_name", "id", "user_id"]
PROFILE_DEPTH = 5


def _object(x) -> dict:
    return x if isinstance(x, dict) else {}


def _profile_root(raw) -> dict:
    """The first object, level by level, that has a field of a profile."""
    top = _object(raw)
    level = [*[top.get(k) for k in PROFILE_ROOTS], raw if isinstance(raw, list) else None, top]
    for _ in range(PROFILE_DEPTH):
        below = []
        for x in level:
            if isinstance(x, list):
                below += [y for y in x if _object(y)][:1]
            elif _object(x):
                if _first_text(x, PROFILE_FIELDS):
                    return x
                below += [x[k] for k in PROFILE_INNER if x.get(k)]
        level = below
    return {}


def _digits(*values) -> str | None:
    found = next((str(x).strip() for x in values if isinstance(x, (int, str)) and not isinstance(x, bool) and str(x).strip()), "")
    return found if found.isascii() and found.isdigit() else None


def _present(node: dict, *keys: str) -> str | None:
    found = next((node[k] for k in keys if node.get(k) is not None), None)
    return None if found is None or isinstance(found, (dict, list)) else str(found)


PROFILE = ["display_name", "facebook_id", "username", "profile_url", "bio", "joined", "relationship", "photo", "cover"]


def profile_told(top):
    """The fields of PROFILE, or nothing where no name is found."""
    p = _profile_root(top)
    inner = next((_object(p[k]) for k in ("profile", "basic_information", "account_information") if p.get(k) is not None), {})
    name = _first_text(p, ["name", "full_name", "display_name"]) or _first_text(_object(top), ["name"]) or _first_text(inner, ["name"])
    if name:
        field = lambda keys, deep=(): _first_text(p, keys) or _first_text(inner, list(deep))
        yield (
            name, _digits(p.get("id"), p.get("user_id"), p.get("facebook_id"), _object(top).get("id")), field(["username", "user_name", "handle"], ["username"]), field(["profile_url", "profileUrl", "url"], ["profile_url"]),
            field(["bio", "about_me", "intro_bio", "about"], ["bio"]), _present(p, "registration_timestamp", "account_creation_time", "joined_at", "joinedAt"), field(["relationship_status", "relationship"], ["relationship"]),
            field(["profile_picture", "profile_photo", "profile_photo_uri", "profile_picture_uri"], ["profile_picture"]), field(["cover_photo", "cover_photo_uri", "cover_picture"], ["cover_photo"]),
        )


#: Categories of profile facts by key.
FACT_KEYS = {
    "work": "Work", "jobs": "Work", "education": "Education", "schools": "Education", "places_lived": "Places lived", "placesLived": "Places lived", "hometown": "Hometown",
    "current_city": "Places lived", "currentCity": "Places lived", "relationship_status": "Relationship", "relationship": "Relationship", "username_history": "Username history",
    "usernameHistory": "Username history", "languages": "Languages", "family": "Family", "websites": "Websites", "other_names": "Other names",
}
#: The fields of a fact that tell it, and how deep facts are looked for.
FACT_FIELDS = ["value", "name", "title", "text", "description", "school", "company", "position", "city", "location", "username"]
FACT_DEPTH = 4


def _facts_in(x, label: str | None = None, depth: int = 0):
    """label, value, start and end of each fact; an object gives its first telling field, or what lies deeper."""
    if depth > FACT_DEPTH or x is None or isinstance(x, bool):
        return
    if isinstance(x, (str, int, float)):
        if str(x).strip():
            yield label, str(x).strip(), None, None
    elif isinstance(x, list):
        for y in x:
            yield from _facts_in(y, label, depth + 1)
    elif told := _first_text(x, FACT_FIELDS):
        yield _first_text(x, ["label", "type", "category"]) or label, told, _present(x, "start_timestamp", "start_date", "from"), _present(x, "end_timestamp", "end_date", "to")
    else:
        for key, y in x.items():
            if key != "timestamp":
                yield from _facts_in(y, label or key, depth + 1)


FACT = ["key", "category", "n", "label", "value", "start", "end"]


def facts_told(top):
    """The fields of FACT for each text or number under a known key."""
    p = _profile_root(top)
    for key, category in FACT_KEYS.items():
        found = p.get(key) if p.get(key) is not None else _object(top).get(key)
        for n, fact in enumerate(_facts_in(found)):
            yield key, category, str(n), *fact


def _told_by(files: DataFrame, tell, names: list[str]) -> DataFrame:
    """part_path, path and the text fields that a helper tells of each document."""

    def run(batches):
        for batch in batches:
            which, out = [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                for fields in tell(json.loads(text) if text else {}):
                    which.append(row)
                    out.append(fields)
            of = batch.select([0, 1]).take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays([*of.columns, *[pa.array([r[i] for r in out], pa.string()) for i in range(len(names))]], names=["part_path", "path", *names])

    schema = ", ".join(f"`{c}` string" for c in ["part_path", "path", *names])
    return files.filter("v IS NOT NULL").select("part_path", "path", F.to_json("v").alias("json")).mapInArrow(run, schema)


def profiles(files: DataFrame) -> DataFrame:
    """The owner's profile from each file that has one; those without a name are left out."""
    return profile_table(_told_by(files, profile_told, PROFILE))


def profile_table(told: DataFrame) -> DataFrame:
    """Profiles from part_path, path and the fields of PROFILE."""
    local = lambda c: F.when(~S.suspicious_path(F.col(c)) & ~F.col(c).rlike(r"(?i)^https?://"), S.clean_path(F.col(c)))
    return told.select(
        F.lit("owner").alias("id"), F.lit("owner").alias("person_id"), "display_name", "facebook_id", "username", F.when(F.col("profile_url").rlike(r"(?i)^https?://"), F.col("profile_url")).alias("profile_url"), "bio",
        S.parse_time(F.trim("joined")).alias("joined_at"), "relationship", local("photo").alias("profile_photo_path"), local("cover").alias("cover_photo_path"),
        F.col("part_path").alias("archive_part_id"), F.col("path").alias("source_path"), F.lit(None).cast("int").alias("source_index"),
    )


def profile_facts(files: DataFrame) -> DataFrame:
    """A fact for each text or number under a known key of a profile."""
    return fact_table(_told_by(files, facts_told, FACT))


def fact_table(told: DataFrame) -> DataFrame:
    """Profile facts from part_path, path and the fields of FACT."""
    return told.select(
        F.concat_ws(":", F.lit("fact"), S.slug(F.col("path")), "key", "n", S.slug(F.col("value"))).alias("id"), F.lit("owner").alias("profile_id"), "category", "label", "value",
        S.parse_time(F.trim("start")).alias("start_date"), S.parse_time(F.trim("end")).alias("end_date"), F.col("part_path").alias("archive_part_id"), F.col("path").alias("source_path"), F.col("n").cast("int").alias("source_index"),
    )


def shape(v: Column) -> Column:
    """The type of a document, for diagnostics: structure without values."""
    return F.schema_of_variant(v)
