"""From ZIP parts to entity tables: what is listed, read, normalised and collected for an ArchiveStore."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hearthlog.functions import scalars as S
from hearthlog.operators import diagnostics
from hearthlog.sources import adapters, archives, html_records, json_records, zip_source
from hearthlog.store import BOOKS, ArchiveStore
from hearthlog.streaming import ingest


def _union(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def _seen(df: DataFrame, id_: str, name: str, at: Column, exact: Column, owner: Column | None = None) -> DataFrame:
    """People as their records show them."""
    return df.filter(F.col(id_).isNotNull() & F.col(name).isNotNull()).select(
        F.col(id_).alias("id"), F.col(name).alias("display_name"), S.or_null(df, "facebook_id").alias("facebook_id"), S.or_null(df, "username").alias("username"), S.or_null(df, "profile_url").alias("profile_url"),
        at.alias("first_seen"), at.alias("last_seen"), F.when(exact, "exact").otherwise("inferred").alias("identity_confidence"), F.col("source_path").alias("identity_source"), F.array("source_path").alias("source_paths"),
        (F.lit(False) if owner is None else owner).alias("is_archive_owner"), "archive_part_id", "source_path",
    )


def people_of(t: dict[str, DataFrame]) -> DataFrame:
    """Everyone whom participants, senders, authors, actors, connections and the profile name. Repeated ids merge in the store."""
    numbered = lambda c: F.col(c).startswith("person:facebook:") & ~F.col(c).startswith("person:facebook:html:")
    own_name = t["profiles"].agg(F.min("display_name").alias("own_name"))  # one row, also without a profile
    posts = t["posts"].crossJoin(F.broadcast(own_name)).withColumn("shown", F.when(F.col("author_id") == "owner", F.coalesce("own_name", F.lit("Archive owner"))).otherwise(F.coalesce(S.or_null(t["posts"], "author_name"), "own_name", F.lit("Archive owner"))))
    chats = t["conversations"].select("archive_part_id", "source_path", F.explode(F.arrays_zip("participant_ids", "participant_names")).alias("p")).select("archive_part_id", "source_path", F.col("p.participant_ids").alias("id"), F.col("p.participant_names").alias("name"))
    owner = t["profiles"].select(
        F.col("person_id").alias("id"), "display_name", S.or_null(t["profiles"], "facebook_id").alias("facebook_id"), "username", S.or_null(t["profiles"], "profile_url").alias("profile_url"), S.or_null(t["profiles"], "profile_photo_path").alias("profile_photo_path"),
        S.or_null(t["profiles"], "cover_photo_path").alias("cover_photo_path"), S.or_null(t["profiles"], "relationship").alias("relationship"), F.lit("exact").alias("identity_confidence"), F.col("source_path").alias("identity_source"), F.array("source_path").alias("source_paths"), F.lit(True).alias("is_archive_owner"), "archive_part_id", "source_path",
    )
    none = F.lit(None).cast("string")
    return _union(
        owner, _seen(chats, "id", "name", none, F.lit(False)), _seen(t["messages"], "sender_id", "sender_name", F.col("sent_at"), S.or_null(t["messages"], "facebook_id").isNotNull()),
        _seen(posts, "author_id", "shown", F.col("created_at"), F.col("author_id") == "owner", F.col("author_id") == "owner"), _seen(t["comments"], "author_id", "author_name", F.col("created_at"), numbered("author_id")),
        _seen(t["reactions"], "person_id", "person_name", F.col("created_at"), numbered("person_id")), _seen(t["connections"], "person_id", "display_name", F.coalesce("started_at", "ended_at"), F.col("facebook_id").isNotNull()),
    )


def bundle(files: DataFrame, page_rows: DataFrame, folder: str) -> dict[str, DataFrame]:
    """Entity tables of JSON files (part_path, path, section, text) and of streamed pages, and the warnings that came up.

    What several tables come from is parsed once and kept below `folder`. Media get positions in albums; a
    reference that leaves the archive is left out and told as a warning.
    """

    def keep(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    json = lambda section: json_records.parsed(files.filter(F.col("section") == section).select("part_path", "path", "text"))
    pages, card_rows = html_records.split(page_rows)
    card_rows = keep("cards", card_rows)
    cards = html_records.records(card_rows)
    profile, posts = keep("profiles", json_records.profiles(json("profile"))), keep("posts", json_records.posts(json("posts")))
    chats, albums = keep("messages", json_records.messages(json("messages"))), keep("albums", json_records.albums(json("albums")))
    owned = lambda df, kind: df.select(F.lit(kind).alias("owner_type"), F.col("id").alias("owner_id"), "archive_part_id", "source_path", "source_index", "item")
    refs = keep("references", json_records.references(_union(owned(posts, "post"), owned(chats, "message"), owned(albums, "album"))))
    page_albums, page_media = html_records.albums(pages, card_rows)
    media = keep("media", _union(json_records.media(refs), cards["media"], page_media))
    inside = media.filter("owner_type = 'album'").select(F.col("owner_id").alias("album_id"), F.col("id").alias("media_id"), F.coalesce("k", "source_index").alias("at"))
    ranked = inside.groupBy("album_id").agg(F.array_sort(F.collect_list(F.struct("at", "media_id"))).alias("all")).select("album_id", F.posexplode("all").alias("position", "m")).select("album_id", "m.media_id", "position")
    # A post or message whose record only seemed to name a file has neither text nor media.
    with_media = media.select(F.col("owner_id").alias("id")).distinct()
    bare = lambda df, *texts: df.filter(F.coalesce(*texts).isNotNull()).unionByName(df.filter(F.coalesce(*texts).isNull()).join(with_media, "id", "left_semi"))
    out = {
        "profiles": _union(profile, html_records.profiles(pages)), "profile_facts": _union(json_records.profile_facts(json("profile")), html_records.profile_facts(pages)),
        "posts": _union(bare(posts, "body", "title").drop("item"), cards["posts"]), "comments": keep("comments", _union(json_records.post_comments(posts), json_records.comments(json("comments")), cards["comments"])),
        "reactions": keep("reactions", _union(json_records.post_reactions(posts), json_records.reactions(json("reactions")), cards["reactions"])), "connections": keep("connections", _union(json_records.connections(json("connections")), cards["connections"])),
        "albums": _union(albums.drop("item"), page_albums), "album_media": ranked, "media": media.drop("k"), "messages": _union(bare(chats, "body").drop("item"), cards["messages"]),
    }
    out["conversations"] = keep("conversations", _union(json_records.conversations(json("messages"), chats), cards["conversations"]))
    out["people"] = _union(people_of(out), cards["people"])
    broken = json_records.parsed(files.select("part_path", "path", "text")).filter("v IS NULL").select(F.col("part_path").alias("archive_part_id"), "path", F.lit("malformed JSON").alias("message"))
    untold = cards["warnings"].select(F.lit(None).cast("string").alias("archive_part_id"), "path", F.concat(F.lit("unsupported: no target in "), "section").alias("message"))
    out["warnings"] = _union(broken, json_records.unsafe_references(refs), untold)
    return out


#: Tables whose rows say from which file they come.
_RECORDS = ("profiles", "posts", "comments", "reactions", "connections", "albums", "messages", "conversations")


def take_stock(store: ArchiveStore, folder: str, work: str, **limits) -> tuple[DataFrame, DataFrame]:
    """The directories of all parts below `folder`, written once, and a row for each ZIP file that was found.

    The latter has part_id, part_path, fingerprint, entries, bytes, known, detection and outcome: new, known (final
    before), duplicate (a copy of another file) or unreadable.
    """
    spark = store.spark
    zip_source.read_zips(spark, folder, "entries", **limits).write.parquet(f"{work}/listing")
    listing = spark.read.schema(zip_source.ENTRY).parquet(f"{work}/listing")
    told = archives.manifests(listing).withColumn("part_id", F.concat(F.lit("part:"), "fingerprint")).join(archives.detect_parts(listing), "part_path", "left")
    first = told.groupBy("part_id").agg(F.min("part_path").alias("first_path"))
    told = told.join(first, "part_id").withColumn("outcome", F.when(F.col("part_path") != F.col("first_path"), "duplicate").otherwise("new")).drop("first_path")
    broken = listing.filter("path IS NULL AND error IS NOT NULL").select("part_path", "error").withColumn("outcome", F.lit("unreadable"))
    return listing, told.unionByName(broken, allowMissingColumns=True)


def import_archive(store: ArchiveStore, folder: str, batch_files: int = 5_000, stop: Callable[[], bool] = lambda: False, **limits) -> DataFrame:
    """Imports every ZIP part below `folder` that isn't in the store yet; a row for each file: part_id, part_path, taken, warnings.

    A part is known by the fingerprint of its directory, whatever its file is called. Files are read in batches of
    `batch_files`, each of which commits its rows together with the names of the files that gave records without a
    warning; a later run leaves these out, so an import that was stopped or lost goes on behind its last batch. `stop`
    is asked before each batch. Copies of a part are imported once, files that aren't ZIPs are told as warnings, and
    where media are is stored with the parts. Derived tables are built by store.run_derived().
    """
    spark: SparkSession = store.spark
    work = f"{store.root}/staged/{uuid.uuid4().hex}"
    listing, found = take_stock(store, folder, work, **limits)
    rows = sorted(found.collect(), key=lambda r: (r["part_path"] or "", r["error"] or ""))  # a row for each ZIP file
    new = [r for r in rows if r["outcome"] == "new" and not store.is_final(r["part_id"])]
    pages = any(r["supported"] and r["format"] in ("html", "mixed") for r in rows)
    lost = [r for r in new if not (r["supported"] or r["media_only"] and pages)]  # media alone come with pages only
    good = [r for r in new if r not in lost]
    notes = [(None, r["part_path"], f"{_file(r)}: ZIP could not be inspected ({r['error']})") for r in rows if r["outcome"] == "unreadable"]
    notes += [(r["part_id"], r["part_path"], f"{_file(r)}: duplicate ZIP part selected; it will be imported once.") for r in rows if r["outcome"] == "duplicate"]
    notes += [(r["part_id"], r["part_path"], f"{_file(r)}: unsupported, no known archive content; skipped.") for r in lost]
    warn = lambda some: spark.createDataFrame(some, "part_id string, path string, message string")
    for r in lost:
        store.mark_part(r["part_id"], "failed")
    taken: set[str] = set()
    if good:
        taken = _import_parts(store, listing, good, folder, work, batch_files, stop, warn(notes))
    elif notes:
        store.note(warn(notes))
    groups = diagnostics.warning_groups(store.table("warnings"), by="part_id").collect()
    by_part: dict[str, list[str]] = {}
    for g in groups:
        by_part.setdefault(g["part_id"], []).append(f"{g['category']}: {g['n']}")
    own = lambda r: {"unreadable": ["unreadable-part: 1"], "duplicate": ["duplicate-part: 1"]}.get(r["outcome"], sorted(x for x in by_part.get(r["part_id"], []) if not x.startswith("duplicate-part")))
    told = [(r["part_id"], r["part_path"], r["outcome"] == "new" and r["part_id"] in taken, own(r)) for r in rows]
    return spark.createDataFrame(told, "part_id string, part_path string, taken boolean, warnings array<string>")


def _file(row) -> str:
    return (row["part_path"] or "").rsplit("/", 1)[-1]


def _import_parts(store: ArchiveStore, listing: DataFrame, good: list, folder: str, work: str, batch_files: int, stop: Callable[[], bool], notes: DataFrame) -> set[str]:
    """Reads what the parts still lack, batch by batch; the ids of parts that are complete now."""
    spark = store.spark
    order = [r["part_id"] for r in good]
    named = spark.createDataFrame([(r["part_path"], r["part_id"], k) for k, r in enumerate(good)], "part_path string, part_id string, part_at int")
    here = listing.join(F.broadcast(named), "part_path")  # a row for each ZIP file, of which a folder has a bounded number
    wanted = archives.candidates(archives.checked(here.filter("error IS NULL")).filter("problem IS NULL")).join(F.broadcast(named), "part_path")
    done = store.table("files").filter(F.col("parser_version") == adapters.version_of(F.col("path")))
    left = ingest.pending(wanted, done, ["part_id", "path"])
    counts = {r["part_at"]: r["n"] for r in left.groupBy("part_at").agg(F.count("*").alias("n")).collect()}
    before, at = {}, 0
    for k in range(len(good)):
        before[k], at = at, at + counts.get(k, 0)
    starts = spark.createDataFrame(list(before.items()), "part_at int, before long")
    rank = F.row_number().over(W.partitionBy("part_at").orderBy("section", "place"))  # a part has at most 100,000 entries
    dealt = left.join(F.broadcast(starts), "part_at").withColumn("batch", ((F.col("before") + rank - 1) / batch_files).cast("int"))
    dealt.select("part_path", "part_id", "path", "section", "batch").write.parquet(f"{work}/wanted")
    plan = spark.read.parquet(f"{work}/wanted")
    for adapter in adapters.ADAPTERS:
        name = adapter.rows
        read = zip_source.read_zips(spark, folder, name).filter(F.col("part_path").isin([r["part_path"] for r in good]) & F.col("section").isNotNull() & (F.col("format") == adapter.format))
        read.drop("section", "format", "size", "packed", "crc").join(plan, ["part_path", "path"]).drop("part_path").withColumnRenamed("part_id", "part_path").write.partitionBy("batch").parquet(f"{work}/{name}")
    schema = lambda more: f"path string, error string, {more}, part_path string, section string, batch int"
    texts, pages = (spark.read.schema(schema(more)).parquet(f"{work}/{name}") for name, more in (("texts", "text string"), ("pages", html_records.STREAMED)))

    batches = -(-at // batch_files)
    complete: set[str] = set()
    for b in range(max(batches, 1)):
        if stop():
            for p in set(order) - complete:
                store.mark_part(p, "interrupted")
            break
        lo, hi = b * batch_files, (b + 1) * batch_files
        parts = [r["part_id"] for k, r in enumerate(good) if before[k] < hi and before[k] + counts.get(k, 0) > lo or b == 0 and not counts.get(k)]
        finals = tuple(r["part_id"] for k, r in enumerate(good) if r["part_id"] in parts and (before[k] + counts.get(k, 0) <= hi or not counts.get(k)))
        some_texts, some_pages = (df.filter(F.col("batch") == b) for df in (texts, pages))
        tables = bundle(some_texts.filter("error IS NULL"), some_pages.filter("error IS NULL"), f"{work}/batch-{b}")
        told = tables.pop("warnings").select(F.col("archive_part_id").alias("part_id"), "path", "message")
        unread = some_texts.unionByName(some_pages, allowMissingColumns=True).filter("error IS NOT NULL").select(F.col("part_path").alias("part_id"), "path", F.col("error").alias("message"))
        told = told.unionByName(unread)
        told.write.parquet(f"{work}/batch-{b}/warnings")
        told = spark.read.schema("part_id string, path string, message string").parquet(f"{work}/batch-{b}/warnings")
        books = _books(store, tables, told, plan.filter(F.col("batch") == b))
        if b == 0:
            books |= _first_books(here, good, notes)
            books["warnings"] = told.unionByName(notes)
        if store.import_batch(tables, parts, finals, books):
            complete |= set(finals)
    return complete


def _books(store: ArchiveStore, tables: dict[str, DataFrame], told: DataFrame, wanted: DataFrame) -> dict[str, DataFrame]:
    """Files that are done, warnings, and how sections fared, of one batch."""
    made = _union(*[tables[t].select(F.col("archive_part_id").alias("part_id"), F.col("source_path").alias("path")) for t in _RECORDS if "archive_part_id" in tables[t].columns])
    per_file = made.groupBy("part_id", "path").agg(F.count("*").alias("records"))
    warned = told.groupBy("part_id", "path").agg(F.count("*").alias("warnings"))
    files = wanted.select("part_id", "path", "section").join(per_file, ["part_id", "path"], "left").join(warned, ["part_id", "path"], "left").fillna(0, ["records", "warnings"])
    status = F.when(F.sum("records") == 0, F.when(F.sum("warnings") > 0, "malformed").otherwise("unsupported")).when(F.sum("warnings") > 0, "partial").otherwise("imported")
    sections = files.groupBy("part_id", "section").agg(status.alias("status"), F.sum("records").alias("records"), F.sum("warnings").alias("warnings")).withColumn("seq", F.lit(len(store.commits())).cast("long"))
    return {"files": files.filter("records > 0 AND warnings = 0").select("part_id", "path", adapters.version_of(F.col("path")).alias("parser_version"), "records"), "warnings": told, "sections": sections}


def _first_books(here: DataFrame, good: list, notes: DataFrame) -> dict[str, DataFrame]:
    """What the parts are, where they are, and the endings of the paths of their files."""
    spark = here.sparkSession
    parts = [(r["part_id"], r["part_path"], _file(r), r["entries"], r["bytes"], r["format"], r["sections"], r["known"]) for r in good]
    return {
        "parts": spark.createDataFrame(parts, BOOKS["parts"]), "sources": spark.createDataFrame([(r["part_id"], r["part_path"], True, None) for r in good], BOOKS["sources"]),
        "suffixes": archives.suffixes(here.filter("path IS NOT NULL AND error IS NULL"), "part_id").select("suffix", "n", "part_id"),
    }


def reconnect(store: ArchiveStore, folder: str) -> Row:
    """Connects the parts that are below `folder` now, whatever their names; see ArchiveStore.reconnect."""
    listing = zip_source.read_zips(store.spark, folder, "entries")
    return store.reconnect(archives.manifests(listing))
