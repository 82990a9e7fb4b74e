"""Entity tables of an archive, as Spark schemas. Version 1; columns are only ever added."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

VERSION = 1
_SOURCE = "archive_part_id string, source_path string, source_index int"
_DDL = {
    "profiles": f"id string, person_id string, display_name string, username string, bio string, joined_at string, {_SOURCE}",
    "people": f"id string, facebook_id string, display_name string, username string, profile_url string, profile_photo_path string, cover_photo_path string, first_seen string, last_seen string, relationship string, identity_confidence string, identity_source string, source_paths array<string>, is_archive_owner boolean, {_SOURCE}",
    "posts": f"id string, author_id string, title string, body string, created_at string, links array<string>, {_SOURCE}",
    "comments": f"id string, post_id string, author_id string, author_name string, body string, created_at string, {_SOURCE}",
    "reactions": f"id string, target_type string, target_id string, person_id string, person_name string, kind string, created_at string, {_SOURCE}",
    "connections": f"id string, person_id string, display_name string, facebook_id string, username string, profile_url string, relationship_type string, started_at string, ended_at string, {_SOURCE}",
    "albums": f"id string, title string, description string, owner_id string, created_at string, updated_at string, {_SOURCE}",
    "album_media": "album_id string, media_id string, position int",
    "profile_facts": f"id string, profile_id string, category string, label string, value string, start_date string, end_date string, {_SOURCE}",
    "conversations": f"id string, title string, participant_names array<string>, participant_ids array<string>, is_group boolean, {_SOURCE}",
    "messages": f"id string, conversation_id string, sender_id string, sender_name string, body string, sent_at string, {_SOURCE}",
    "media": f"id string, path string, media_type string, filename string, mime_type string, caption string, timestamp string, owner_type string, owner_id string, width int, height int, duration_ms int, {_SOURCE}",
}
_TYPES = {"string": StringType(), "int": IntegerType(), "boolean": BooleanType(), "array<string>": ArrayType(StringType())}
SCHEMAS = {name: StructType([StructField(c, _TYPES[t]) for c, t in (x.split() for x in ddl.split(", "))]) for name, ddl in _DDL.items()}
