"""The driver's tables as entity tables, in Spark and, for the oracles, as common table expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hearthlog.functions.scalars import ascii_lower, iso, media_type

_ISO = "%Y-%m-%dT%H:%M:%S.%gZ"
RELATIONS = ["friend", "follower", "following", "outgoing_request", "incoming_request", "blocked", "removed_friend", "unknown"]


def _id(prefix: str, *cols: str):
    return F.concat(F.lit(prefix), F.concat_ws(":", *[F.col(c).cast("string") for c in cols]))


def _days(start: str, days):
    return iso(F.timestamp_add("DAY", days.cast("int"), F.to_timestamp_ntz(F.lit(start))))


@dataclass
class Archive:
    """Entity tables bound to a folder of the driver's tables."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def people(self) -> DataFrame:
        c = self.table("customer").select(_id("person:c:", "c_custkey").alias("id"), F.col("c_name").alias("display_name"), F.col("c_mktsegment").alias("relationship"), F.col("c_custkey").cast("string").alias("facebook_id"))
        s = self.table("supplier").select(_id("person:s:", "s_suppkey").alias("id"), F.col("s_name").alias("display_name"), F.lit("SUPPLIER").alias("relationship"), F.lit(None).cast("string").alias("facebook_id"))
        return c.unionByName(s)

    @cached_property
    def posts(self) -> DataFrame:
        return self.table("orders").select(
            _id("post:", "o_orderkey").alias("id"), _id("person:c:", "o_custkey").alias("author_id"), F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("title"),
            F.col("o_orderstatus").alias("body"), F.when(F.col("o_orderkey") % 50 != 0, iso(F.col("o_orderdate"))).alias("created_at"),
        )

    @cached_property
    def raw_comments(self) -> DataFrame:
        """With repeated ids, as parts of an archive would deliver them."""
        return self.table("lineitem").select(
            _id("comment:", "l_orderkey", "l_linenumber").alias("id"), _id("post:", "l_orderkey").alias("post_id"), _id("person:s:", "l_suppkey").alias("author_id"),
            F.concat_ws("/", "l_returnflag", "l_linestatus").alias("body"), iso(F.col("l_shipdate")).alias("created_at"), "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        )

    @cached_property
    def comments(self) -> DataFrame:
        order = ["created_at", "author_id", "body", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
        first = self.raw_comments.groupBy("id", "post_id").agg(F.min(F.struct(*order)).alias("r"))
        named = F.when(F.substring_index("r.author_id", ":", -1).cast("int") % 2 == 0, F.concat(F.lit("Author "), F.substring_index("r.author_id", ":", -1)))
        return first.select("id", "post_id", "r.author_id", named.alias("author_name"), "r.body", "r.created_at")

    @cached_property
    def reactions(self) -> DataFrame:
        e = self.table("events").filter(F.col("event_type").isin("click", "view", "purchase"))
        return e.select(_id("reaction:", "event_id").alias("id"), F.lit("post").alias("target_type"), F.concat(F.lit("post:"), F.expr("event_id div 4").cast("string")).alias("target_id"), _id("person:c:", "user_id").alias("person_id"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("User "), F.col("user_id").cast("string"))).alias("person_name"), F.col("event_type").alias("kind"), iso(F.col("ts")).alias("created_at"))

    @cached_property
    def messages(self) -> DataFrame:
        at = F.timestamp_add("MINUTE", F.col("turn").cast("int"), F.timestamp_add("DAY", F.col("conv_id").cast("int"), F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))))
        return self.table("conversations").select(
            _id("message:", "conv_id", "turn").alias("id"), _id("conversation:", "conv_id").alias("conversation_id"), F.concat(F.lit("person:m:"), F.col("role")).alias("sender_id"), F.col("role").alias("sender_name"), F.col("text").alias("body"),
            F.when(F.col("role") != "system", iso(at)).alias("sent_at"),
        )

    @cached_property
    def conversations(self) -> DataFrame:
        g = self.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("participant_names"))
        # Who takes part: the roles, as senders, and one customer.
        ids = F.concat(F.transform("participant_names", lambda x: F.concat(F.lit("person:m:"), x)), F.array(F.concat(F.lit("person:c:"), (F.col("conv_id") % 100 + 1).cast("string"))))
        return g.select(_id("conversation:", "conv_id").alias("id"), F.when(F.col("conv_id") % 5 != 0, F.concat(F.lit("Chat "), F.col("conv_id").cast("string"))).alias("title"), "participant_names", ids.alias("participant_ids"), (F.size("participant_names") > 2).alias("is_group"))

    @cached_property
    def media(self) -> DataFrame:
        p, even = self.table("part"), F.col("p_partkey") % 2 == 0
        endings = F.element_at(F.array(*map(F.lit, [".jpg", ".MP4", ".mp3", ".pdf", ""])), (F.col("p_size") % 5 + 1).cast("int"))
        path = F.concat(F.lit("media/"), F.col("p_partkey").cast("string"), endings)
        return p.select(
            _id("media:", "p_partkey").alias("id"), path.alias("path"), media_type(path).alias("media_type"), F.substring_index(path, "/", -1).alias("filename"), F.col("p_name").alias("caption"),
            F.when(F.col("p_size") % 10 != 0, _days("2000-01-01 00:00:00", F.col("p_size") * 7)).alias("timestamp"),
            F.when(even, "post").otherwise("album").alias("owner_type"), F.when(even, _id("post:", "p_partkey")).otherwise(_id("album:", "p_brand")).alias("owner_id"),
        )

    @cached_property
    def albums(self) -> DataFrame:
        g = self.table("part").groupBy("p_brand").agg(F.min("p_partkey").alias("k"), F.max("p_size").alias("z"))
        return g.select(_id("album:", "p_brand").alias("id"), F.col("p_brand").alias("title"), F.lit(None).cast("string").alias("description"), _id("person:c:", "k").alias("owner_id"), _days("2001-01-01 00:00:00", F.col("z")).alias("created_at"), F.when(F.col("k") % 2 == 0, _days("2002-01-01 00:00:00", F.col("z"))).alias("updated_at"))

    @cached_property
    def album_media(self) -> DataFrame:
        place = F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")) - 1
        return self.table("part").filter("p_partkey % 2 = 1").select(_id("album:", "p_brand").alias("album_id"), _id("media:", "p_partkey").alias("media_id"), place.alias("position"))

    @cached_property
    def connections(self) -> DataFrame:
        kind = F.element_at(F.array(*map(F.lit, RELATIONS)), (F.col("c_custkey") % 8 + 1).cast("int"))
        return self.table("customer").select(
            _id("connection:", "c_custkey").alias("id"), _id("person:c:", "c_custkey").alias("person_id"), F.col("c_name").alias("display_name"),
            F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("user."), F.col("c_custkey").cast("string"))).alias("username"), kind.alias("relationship_type"),
            F.when(F.col("c_custkey") % 11 != 0, _days("2010-01-01 00:00:00", F.col("c_custkey"))).alias("started_at"), F.lit(None).cast("string").alias("ended_at"),
        )

    @cached_property
    def profiles(self) -> DataFrame:
        return self.people.filter("id = 'person:c:1'").select(F.lit("profile:owner").alias("id"), F.col("id").alias("person_id"), "display_name", F.lit("owner.one").alias("username"), F.lit("2009-05-06T00:00:00.000Z").alias("joined_at"))

    @cached_property
    def profile_facts(self) -> DataFrame:
        n = self.table("nation").join(F.broadcast(self.table("region")), F.col("n_regionkey") == F.col("r_regionkey"))
        return n.select(_id("fact:", "n_nationkey").alias("id"), F.lit("profile:owner").alias("profile_id"), ascii_lower(F.col("r_name")).alias("category"), F.lit("Lived in").alias("label"), F.col("n_name").alias("value"), F.when(F.col("n_nationkey") % 4 != 0, _days("2011-01-01 00:00:00", F.col("n_nationkey"))).alias("start_date"), F.lit(None).cast("string").alias("end_date"))


def _sql() -> str:
    f, kinds = f"'{_ISO}'", ", ".join(f"'{r}'" for r in RELATIONS)
    return f"""
people AS (
  SELECT 'person:c:' || c_custkey AS id, c_name AS display_name, c_mktsegment AS relationship, CAST(c_custkey AS VARCHAR) AS facebook_id FROM customer
  UNION ALL SELECT 'person:s:' || s_suppkey, s_name, 'SUPPLIER', NULL FROM supplier),
posts AS (
  SELECT 'post:' || o_orderkey AS id, 'person:c:' || o_custkey AS author_id, nullif(o_orderpriority, '5-LOW') AS title, o_orderstatus AS body,
         CASE WHEN o_orderkey % 50 <> 0 THEN strftime(o_orderdate, {f}) END AS created_at FROM orders),
raw_comments AS (
  SELECT 'comment:' || l_orderkey || ':' || l_linenumber AS id, 'post:' || l_orderkey AS post_id, 'person:s:' || l_suppkey AS author_id,
         l_returnflag || '/' || l_linestatus AS body, strftime(l_shipdate, {f}) AS created_at, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem),
comments AS (
  SELECT id, post_id, author_id, CASE WHEN CAST(split_part(author_id, ':', 3) AS INT) % 2 = 0 THEN 'Author ' || split_part(author_id, ':', 3) END AS author_name, body, created_at FROM raw_comments
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at, author_id, body, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) = 1),
reactions AS (
  SELECT 'reaction:' || event_id AS id, 'post' AS target_type, 'post:' || (event_id // 4) AS target_id, 'person:c:' || user_id AS person_id,
         CASE WHEN user_id % 2 = 0 THEN 'User ' || user_id END AS person_name, event_type AS kind, strftime(ts, {f}) AS created_at FROM events WHERE event_type IN ('click', 'view', 'purchase')),
messages AS (
  SELECT 'message:' || conv_id || ':' || turn AS id, 'conversation:' || conv_id AS conversation_id, 'person:m:' || role AS sender_id, role AS sender_name, text AS body,
         CASE WHEN role <> 'system' THEN strftime(TIMESTAMP '2024-01-01' + to_days(conv_id::INT) + to_minutes(turn), {f}) END AS sent_at FROM conversations),
chats AS (
  SELECT 'conversation:' || conv_id AS id, CASE WHEN conv_id % 5 <> 0 THEN 'Chat ' || conv_id END AS title,
         list_sort(list(DISTINCT role)) AS participant_names, list_concat(list_sort(list(DISTINCT 'person:m:' || role)), ['person:c:' || (conv_id % 100 + 1)]) AS participant_ids,
         count(DISTINCT role) > 2 AS is_group FROM conversations GROUP BY conv_id),
media_paths AS (SELECT *, 'media/' || p_partkey || ['.jpg', '.MP4', '.mp3', '.pdf', ''][p_size % 5 + 1] AS path FROM part),
media AS (
  SELECT 'media:' || p_partkey AS id, path, ['photo', 'video', 'audio', 'file', 'unknown'][p_size % 5 + 1] AS media_type, split_part(path, '/', 2) AS filename, p_name AS caption,
         CASE WHEN p_size % 10 <> 0 THEN strftime(TIMESTAMP '2000-01-01' + to_days(p_size * 7), {f}) END AS timestamp,
         CASE WHEN p_partkey % 2 = 0 THEN 'post' ELSE 'album' END AS owner_type,
         CASE WHEN p_partkey % 2 = 0 THEN 'post:' || p_partkey ELSE 'album:' || p_brand END AS owner_id FROM media_paths),
albums AS (
  SELECT 'album:' || p_brand AS id, p_brand AS title, NULL::VARCHAR AS description, 'person:c:' || min(p_partkey) AS owner_id,
         strftime(TIMESTAMP '2001-01-01' + to_days(max(p_size)), {f}) AS created_at,
         CASE WHEN min(p_partkey) % 2 = 0 THEN strftime(TIMESTAMP '2002-01-01' + to_days(max(p_size)), {f}) END AS updated_at FROM part GROUP BY p_brand),
album_media AS (
  SELECT 'album:' || p_brand AS album_id, 'media:' || p_partkey AS media_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS position
  FROM part WHERE p_partkey % 2 = 1),
connections AS (
  SELECT 'connection:' || c_custkey AS id, 'person:c:' || c_custkey AS person_id, c_name AS display_name,
         CASE WHEN c_custkey % 3 = 0 THEN 'user.' || c_custkey END AS username, [{kinds}][c_custkey % 8 + 1] AS relationship_type,
         CASE WHEN c_custkey % 11 <> 0 THEN strftime(TIMESTAMP '2010-01-01' + to_days(c_custkey::INT), {f}) END AS started_at, NULL::VARCHAR AS ended_at FROM customer),
profiles AS (
  SELECT 'profile:owner' AS id, id AS person_id, display_name, 'owner.one' AS username, '2009-05-06T00:00:00.000Z' AS joined_at FROM people WHERE id = 'person:c:1'),
profile_facts AS (
  SELECT 'fact:' || n_nationkey AS id, 'profile:owner' AS profile_id, lower(r_name) AS category, 'Lived in' AS label, n_name AS value,
         CASE WHEN n_nationkey % 4 <> 0 THEN strftime(TIMESTAMP '2011-01-01' + to_days(n_nationkey), {f}) END AS start_date, NULL::VARCHAR AS end_date
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


#: The same entities for DuckDB; conversations are called chats there, as the name is taken.
CTES = _sql()
