"""Registered queries over parts of an archive: ZIP files written from the driver's tables by Spark, and what is read from them."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hearthlog.operators import metrics, paging, reads
from hearthlog.plans.bindings import CTES, Archive
from hearthlog.sources import adapters, archives, html_records, zip_source
from hearthlog.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _zipped(spark: SparkSession, files: DataFrame, rows: str) -> DataFrame:
    """`rows` of parts that hold `files` (path, text). The limits of a folder are for what users bring; here every part counts."""
    folder = f"{ingest.shared_folder(spark, f'parts-{uuid.uuid4().hex}')}/zips"
    zip_source.write_parts(files, folder)
    return zip_source.read_zips(spark, folder, rows, most_files=sys.maxsize, most_visited=sys.maxsize)


@query("SELECT 'your_facebook_activity/posts/page_' || page_id || '.html' AS path, octet_length(encode(html)) AS size, 'posts' AS section, 'html' AS format FROM pages WHERE html IS NOT NULL")
def zip_entries(spark, sf_dir):
    """Directories of parts, without inflating anything."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").filter("html IS NOT NULL").select(F.concat(F.lit("your_facebook_activity/posts/page_"), "page_id", F.lit(".html")).alias("path"), F.col("html").alias("text"))
    return _zipped(spark, pages, "entries").select("path", "size", "section", "format")


@query("SELECT doc_id, lang, sha256(coalesce(text, '')) AS text_sha256 FROM documents")
def zip_texts(spark, sf_dir):
    """JSON files of parts, whole."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = docs.select(F.concat(F.lit("archive/posts/"), "lang", F.lit("/"), "doc_id", F.lit(".json")).alias("path"), F.to_json(F.struct("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))).alias("text"))
    read = _zipped(spark, files, "texts").filter("section = 'posts' AND format = 'json'")
    parsed = read.select(F.from_json("text", "doc_id long, lang string, text string").alias("d")).select("d.*")
    return parsed.select("doc_id", "lang", F.sha2("text", 256).alias("text_sha256"))


@query(
    """WITH t AS (SELECT doc_id, lang, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS body FROM documents)
SELECT 'Page ' || doc_id AS h1, lang AS heading, sha256(CASE WHEN length(body) > 100000 THEN substr(body, 1, 100000) || '…' ELSE body END) AS body_sha256 FROM t WHERE body <> ''"""
)
def zip_pages_streamed(spark, sf_dir):
    """Cards of HTML pages in parts, as the streaming tokeniser hands them out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    safe = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(F.lit("<html><body><h1>Page "), "doc_id", F.lit("</h1><section class='_a6-g'><h2>"), "lang", F.lit("</h2><div class='_a6-p'>"), safe, F.lit("</div></section></body></html>"))
    files = docs.select(F.concat(F.lit("archive/posts/"), "doc_id", F.lit(".html")).alias("path"), html.alias("text"))
    _, cards = html_records.split(_zipped(spark, files, "pages").filter("section = 'posts' AND format = 'html'"))
    return cards.filter("body IS NOT NULL").select(F.col("page_title").alias("h1"), "heading", F.sha2("body", 256).alias("body_sha256"))


#: Paths of files in invented parts, by p_partkey.
_PATHS = ["profile_information/profile_information.json", "your_facebook_activity/posts/your_posts_1.html", "messages/archived_threads/a/message_1.json", "documents/tax.pdf", "connections/friends.json", "ads_information/ads.html", "photos_and_videos/album/1.json", "saved_items/search_history.json"]
_FILES_SQL = f"SELECT p_brand AS part_path, {_PATHS!r}[p_partkey % {len(_PATHS)} + 1] AS path FROM part WHERE p_partkey % 5 < 2 AND p_size < 12"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("p_partkey") % len(_PATHS) + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey % 5 < 2 AND p_size < 12").select(F.col("p_brand").alias("part_path"), path.alias("path"))


_HINTS = ", ".join(f"({k}, '{n}', '{s}', {ok})" for k, (n, s, ok) in enumerate(archives.SECTION_HINTS))


@query(
    f"""WITH files AS ({_FILES_SQL}), hints(k, needle, section, ok) AS (VALUES {_HINTS}),
found AS (SELECT part_path, section, min(k) AS k FROM files JOIN hints ON contains(lower(path), needle) GROUP BY ALL),
kinds AS (SELECT part_path, count(*) FILTER (path LIKE '%.json') AS j, count(*) FILTER (path LIKE '%.html') AS h, bool_or(path LIKE '%/profile_information.json') AS who,
                 bool_or(path LIKE 'your_facebook_activity/%' OR path LIKE 'messages/%') AS rooted, bool_or(path LIKE 'your_facebook_activity/%' OR path LIKE 'messages/%' OR path LIKE 'connections/%' OR path LIKE 'profile_information/%') AS page_rooted FROM files GROUP BY 1),
told AS (SELECT *, coalesce((SELECT string_agg(section, ',' ORDER BY k) FROM found f WHERE f.part_path = kinds.part_path), '') AS sections, (SELECT count(*) FROM found f WHERE f.part_path = kinds.part_path) AS n FROM kinds),
said AS (SELECT *, (j > 0 OR h > 0 AND n > 0 AND page_rooted) AND (who OR rooted OR n > 0) AS supported FROM told)
SELECT part_path, CASE WHEN j > 0 AND h > 0 THEN 'mixed' WHEN j > 0 THEN 'json' WHEN h > 0 THEN 'html' ELSE 'unknown' END AS format, sections, supported,
       round(CASE WHEN supported THEN least(0.98, 0.55 + 0.06 * n) WHEN h > 0 AND j = 0 AND n > 0 THEN 0.2 ELSE 0.05 END, 2)::DOUBLE AS confidence FROM said"""
)
def detected_parts(spark, sf_dir):
    """What parts show by the paths of their files."""
    found = archives.detect_parts(_files(spark, sf_dir))
    return found.select("part_path", "format", F.array_join("sections", ",").alias("sections"), "supported", F.col("confidence").cast("double").alias("confidence"))


@query(
    """WITH files AS (SELECT 'part:' || p_size % 7 AS part_id, 'm' || p_partkey % 3 || '/x/' || p_partkey % 40 || '/' || p_size % 9 || '.jpg' AS path FROM part),
wanted AS (SELECT DISTINCT 'x/' || p_partkey % 40 || '/' || p_size % 9 || '.jpg' AS path FROM part UNION SELECT DISTINCT path FROM files WHERE part_id = 'part:3'),
ends AS (SELECT part_id, unnest(list_distinct([path, path.split('/')[-1], array_to_string(path.split('/')[-2:], '/'), array_to_string(path.split('/')[-3:], '/')])) AS suffix FROM files),
own AS (SELECT suffix, min(part_id) AS part_id FROM ends GROUP BY suffix HAVING count(DISTINCT part_id) = 1),
tried AS (SELECT path, unnest([9, 3, 2, 1]) AS n, unnest([path, array_to_string(path.split('/')[-3:], '/'), array_to_string(path.split('/')[-2:], '/'), path.split('/')[-1]]) AS suffix FROM wanted)
SELECT path, part_id FROM tried JOIN own USING (suffix) QUALIFY row_number() OVER (PARTITION BY path ORDER BY n DESC) = 1"""
)
def media_owner_parts(spark, sf_dir):
    """The one part that has a file, by the stored endings of paths."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    ending = F.concat(F.lit("x/"), F.col("p_partkey") % 40, F.lit("/"), F.col("p_size") % 9, F.lit(".jpg"))
    files = part.select(F.concat(F.lit("part:"), F.col("p_size") % 7).alias("part_id"), F.concat(F.lit("m"), F.col("p_partkey") % 3, F.lit("/"), ending).alias("path"))
    wanted = part.select(ending.alias("path")).union(files.filter("part_id = 'part:3'").select("path")).distinct()
    return archives.owners_by_suffix(wanted, archives.suffixes(files, "part_id"))


@query("SELECT event_type AS stage, count(*) AS calls, round(sum(value), 4) AS ms, sum(user_id)::BIGINT AS rows, sum(length(props))::BIGINT AS bytes, max(value) AS worst FROM events GROUP BY 1")
def metrics_of_batches(spark, sf_dir):
    """Stage metrics of 32 batches, each folded by itself, then put together in two more steps."""
    one = metrics.stage_map(F.col("event_type"), F.col("value"), F.col("user_id"), F.length("props"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.pmod(F.xxhash64("event_id"), F.lit(32)).alias("batch"), one.alias("m"))
    by_batch = metrics.folded(rows, "m", "batch")
    whole = metrics.folded(metrics.folded(by_batch.withColumn("half", F.col("batch") % 3), "m", "half"), "m")
    return whole.select(F.explode("m").alias("stage", "s")).select("stage", "s.calls", F.round("s.ms", 4).alias("ms"), "s.rows", "s.bytes", "s.worst")


@query("SELECT event_type AS entity_type, count(*)::BIGINT AS n FROM events GROUP BY 1")
def facets_of_pages(spark, sf_dir):
    """Numbers of hits by type, added over pages."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    facets = events.groupBy((F.col("event_id") % 2).alias("page"), "event_type").agg(F.count("*").alias("n")).groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    sides = facets.agg(F.first(F.when(F.col("page") == 0, F.col("m")), True).alias("a"), F.first(F.when(F.col("page") == 1, F.col("m")), True).alias("b"))
    return sides.select(F.explode(metrics.merged_sums(F.col("a"), F.col("b"))).alias("entity_type", "n"))


def _entities(sql: str) -> str:
    return f"WITH {CTES}\n{sql}"


@query(_entities("SELECT id, sent_at, body FROM (SELECT * FROM messages WHERE conversation_id = 'conversation:3' ORDER BY coalesce(sent_at, '') DESC, id DESC LIMIT 40)"))
def thread_newest(spark, sf_dir):
    """The newest messages of a thread, which its page shows oldest first."""
    a = Archive(spark, sf_dir)
    return paging.window_of(reads.thread(a, "conversation:3"), F.col("sent_at"), "id", 40).select("id", "sent_at", "body").orderBy(F.coalesce("sent_at", F.lit("")), "id")


@query(_entities("""SELECT p.id, (SELECT count(*) FROM posts x WHERE x.author_id = p.id) AS posts, (SELECT string_agg(id, ',' ORDER BY coalesce(created_at, '') DESC, id DESC) FROM (SELECT * FROM posts x WHERE x.author_id = p.id ORDER BY coalesce(created_at, '') DESC, id DESC LIMIT 5)) AS newest
FROM people p WHERE p.id IN ('person:c:1', 'person:c:2', 'person:c:4')"""))
def person_posts(spark, sf_dir):
    """People with their number of posts and the five newest, each group cut while it is gathered."""
    a = Archive(spark, sf_dir)
    few = a.people.filter(F.col("id").isin("person:c:1", "person:c:2", "person:c:4")).select("id")
    mine = a.posts.select(F.col("author_id").alias("id"), F.col("id").alias("post"), F.coalesce("created_at", F.lit("")).alias("at")).join(F.broadcast(few), "id", "left_semi")
    top = mine.withColumn("k", F.row_number().over(W.partitionBy("id").orderBy(F.desc("at"), F.desc("post")))).filter("k <= 5").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "post"))), lambda x: x["post"]), ",").alias("newest"))
    counts = mine.groupBy("id").agg(F.count("*").alias("posts"))
    return few.join(counts, "id", "left").join(top, "id", "left").select("id", F.coalesce("posts", F.lit(0)).alias("posts"), "newest")


@query(_entities("""SELECT id, (SELECT count(*) FROM posts x WHERE x.author_id = p.id) AS post_count, (SELECT count(*) FROM comments x WHERE x.author_id = p.id) AS comment_count,
  (SELECT count(*) FROM reactions x WHERE x.person_id = p.id) AS reaction_count, (SELECT count(*) FROM connections x WHERE x.person_id = p.id) AS connection_count,
  (SELECT count(*) FROM messages x WHERE x.sender_id = p.id) AS message_count, (SELECT count(*) FROM albums x WHERE x.owner_id = p.id) AS album_count,
  (SELECT count(*) FROM media m JOIN posts x ON m.owner_type = 'post' AND m.owner_id = x.id WHERE x.author_id = p.id) + (SELECT count(*) FROM media m JOIN messages x ON m.owner_type = 'message' AND m.owner_id = x.id WHERE x.sender_id = p.id)
  + (SELECT count(*) FROM media m JOIN albums x ON m.owner_type = 'album' AND m.owner_id = x.id WHERE x.owner_id = p.id) AS media_count,
  (SELECT count(*) FROM posts x WHERE x.author_id = p.id) AS shared_post_count, (SELECT count(*) FROM media m JOIN albums x ON m.owner_type = 'album' AND m.owner_id = x.id WHERE x.owner_id = p.id) AS shared_media_count,
  (SELECT count(*) FROM (SELECT DISTINCT id, unnest(participant_ids) AS who FROM chats) x WHERE x.who = p.id) AS participation_count FROM people p"""))
def person_counts(spark, sf_dir):
    """All ten numbers of everybody, from one union and one aggregate."""
    return reads.people_rollup(Archive(spark, sf_dir)).select("id", *reads.PERSON_COUNTS)


def _json_files(rows: DataFrame, folder: str, key: str, *fields) -> DataFrame:
    return rows.select(F.concat(F.lit(folder), key, F.lit(".json")).alias("path"), F.to_json(F.struct(*fields)).alias("text"))


@query("SELECT 'archive/profile_information/' || c_custkey || '.json' AS path, c_name AS display_name, CAST(c_custkey AS VARCHAR) AS facebook_id, c_mktsegment AS bio, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS relationship FROM customer WHERE c_custkey % 2 = 0")
def lateral_profiles(spark, sf_dir):
    """Profiles from JSON files by a lateral table function; every second file is called as no adapter reads it."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    inner = F.struct(F.col("c_name").alias("full_name"), F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("about_me"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("relationship_status"))
    files = _json_files(c, "archive/profile_information/", "c_custkey", F.struct(inner.alias("profile_v2")).alias("profile_information"))
    named = files.withColumn("path", F.when(F.substring_index(F.substring_index("path", "/", -1), ".", 1).cast("long") % 2 == 0, F.col("path")).otherwise(F.replace("path", F.lit(".json"), F.lit(".txt"))))
    adapters.register(spark)
    named.createOrReplaceTempView("profile_files")
    return spark.sql("SELECT f.path, p.display_name, p.facebook_id, p.bio, p.relationship FROM profile_files f, LATERAL archive_records(f.path, f.text, 'profile') p")


@query(
    """SELECT 'archive/posts/' || p_partkey || '.json' AS path, k::INT AS k, 'media/' || p_partkey || '_' || k || '.jpg' AS ref, CASE WHEN k = 0 THEN p_name END AS caption, CASE WHEN k = 0 THEN p_size END AS width
FROM (SELECT *, unnest([0, 1]) AS k FROM part)"""
)
def lateral_references(spark, sf_dir):
    """Files that posts name at two depths, by a lateral table function."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    uri = lambda k: F.concat(F.lit("media/"), F.col("p_partkey").cast("string"), F.lit(f"_{k}.jpg"))
    outer = F.struct(F.struct(uri(0).alias("uri"), F.col("p_name").alias("description"), F.struct(F.col("p_size").alias("width")).alias("dimensions")).alias("media"))
    deep = F.struct(F.array(F.struct(F.struct(uri(1).alias("uri")).alias("photo"))).alias("data"))
    files = _json_files(p, "archive/posts/", "p_partkey", F.array(outer).alias("attachments"), F.array(deep).alias("more"))
    return adapters.told(files, "references").select("path", "k", "ref", "caption", "width")


@query("SELECT 'pages/' || doc_id || '.html' AS path, 0 AS place, lang AS heading, sha256(CASE WHEN length(body) > 100000 THEN substr(body, 1, 100000) || '…' ELSE body END) AS body_sha256 FROM (SELECT doc_id, lang, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS body FROM documents) WHERE body <> ''")
def lateral_cards(spark, sf_dir):
    """Cards of HTML pages by a lateral table function."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    safe = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(F.lit("<html><body><section class='_a6-g'><h2>"), "lang", F.lit("</h2><div class='_a6-p'>"), safe, F.lit("</div></section></body></html>"))
    files = docs.select(F.concat(F.lit("pages/"), "doc_id", F.lit(".html")).alias("path"), html.alias("text"))
    return adapters.told(files, "cards").filter("body IS NOT NULL").select("path", "place", "heading", F.sha2("body", 256).alias("body_sha256"))
