"""What records that were stored by earlier versions lack: the part that they came from, and people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlog.operators import merge
from hearthlog.schemas import SCHEMAS


def with_part(rows: DataFrame, part_id: str) -> DataFrame:
    """Rows without a part get this one."""
    return rows.withColumn("archive_part_id", F.coalesce("archive_part_id", F.lit(part_id)))


def legacy_person(conversation: Column, name: Column) -> Column:
    """The id of somebody who is known by name in one conversation only."""
    return F.concat(F.lit("person:legacy:"), conversation, F.lit(":"), F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"))


def legacy_people(profiles: DataFrame, conversations: DataFrame) -> DataFrame:
    """People of an archive that has none: its owner, and everybody whom a conversation names.

    Names of one conversation that give one id are one person, by the name that stands first; the owner comes before all.
    """
    first = profiles.agg(F.min(F.struct("id", "person_id", "display_name", "username", "source_path")).alias("p")).select("p.*").filter("person_id IS NOT NULL")
    own = first.select(F.col("person_id").alias("id"), "display_name", "username", F.lit("exact").alias("identity_confidence"), F.col("source_path").alias("identity_source"), F.array_compact(F.array("source_path")).alias("source_paths"), F.lit(True).alias("is_archive_owner"), F.lit(-1).alias("at"))
    named = conversations.select(F.col("id").alias("conversation"), F.posexplode("participant_names").alias("at", "display_name")).filter("display_name IS NOT NULL")
    others = named.select(legacy_person(F.col("conversation"), F.col("display_name")).alias("id"), "display_name", F.lit("ambiguous").alias("identity_confidence"), F.lit("legacy conversation").alias("identity_source"), F.array().cast("array<string>").alias("source_paths"), F.lit(False).alias("is_archive_owner"), "at")
    people = merge.first_wins(own.unionByName(others, allowMissingColumns=True), ["id"], ["at"]).drop("at")
    columns = SCHEMAS["people"]
    return people.select(*[F.col(f.name) if f.name in people.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in columns])


def legacy_participants(conversations: DataFrame) -> DataFrame:
    """Conversations whose participant_ids are those of legacy_people."""
    return conversations.withColumn("participant_ids", F.transform("participant_names", lambda n: legacy_person(F.col("id"), n)))


def legacy_senders(messages: DataFrame) -> DataFrame:
    """Messages whose sender_id is one of legacy_people, where a name is known."""
    return messages.withColumn("sender_id", F.when(F.col("sender_name").isNotNull(), legacy_person(F.col("conversation_id"), F.col("sender_name"))).otherwise(F.col("sender_id")))
