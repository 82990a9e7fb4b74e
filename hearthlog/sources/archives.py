"""Archives as sets of parts: what is detected in them, fingerprints and ownership of media. Parts are read by zip_source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hearthlog.functions import scalars as S
from hearthlog.sources.zip_source import MOST_ENTRY_BYTES

#: The MIME types of media that may be shown.
SHOWN_MIMES = "image/jpeg image/png image/gif image/webp image/heic video/mp4 video/quicktime video/webm audio/mpeg audio/mp4 audio/wav".split()


def checked(listing: DataFrame) -> DataFrame:
    """`listing` with `problem`: suspicious, too large, or null."""
    return listing.withColumn("problem", F.when(S.suspicious_path(F.col("path")), "suspicious").when(F.col("size") > MOST_ENTRY_BYTES, "too large"))


def candidates(listing: DataFrame) -> DataFrame:
    """part_path, path, section, format of what will be parsed: JSON before HTML within a part and section, in natural order."""
    found = listing.withColumn("section", S.section(F.col("path"))).filter(F.col("section").isNotNull() & ~S.suspicious_path(F.col("path")))
    found = found.withColumn("format", F.when(S.ascii_lower(F.col("path")).endswith(".json"), "json").otherwise("html"))
    json = found.filter("format = 'json'").select("part_path", "section").distinct()
    html = found.filter("format = 'html'").join(json, ["part_path", "section"], "left_anti")
    both = found.filter("format = 'json'").unionByName(html.select(found.columns))
    order = W.partitionBy("part_path", "section").orderBy(S.natural_key(F.col("path")))
    return both.select("part_path", "path", "section", "format").withColumn("place", F.row_number().over(order) - 1)


def manifests(listing: DataFrame) -> DataFrame:
    """part_path, fingerprint, entries, bytes, known: the identity of each part, whatever its name."""
    line = F.concat_ws(":", "path", F.col("size").cast("string"), F.col("packed").cast("string"))
    out = listing.filter("path IS NOT NULL").groupBy("part_path").agg(F.sort_array(F.collect_list(line)).alias("lines"), F.count("*").alias("entries"), F.sum("size").alias("bytes"), F.slice(F.sort_array(F.collect_list("path")), 1, 80).alias("known"))
    return out.select("part_path", S.fnv1a32(F.array_join("lines", "|")).alias("fingerprint"), "entries", "bytes", "known")


def set_fingerprint(parts_found: DataFrame) -> DataFrame:
    """One row: the identity of a set of parts, whatever their order."""
    return parts_found.agg(S.fnv1a32(F.array_join(F.sort_array(F.collect_set("fingerprint")), "|")).alias("fingerprint"), F.count_distinct("fingerprint").alias("parts"))


def duplicates(listing: DataFrame, most: int = 20) -> DataFrame:
    """The first paths that several parts have."""
    return listing.groupBy("path").agg(F.array_sort(F.collect_set("part_path")).alias("owners")).filter(F.size("owners") > 1).orderBy("path").limit(most)


#: Parts of a path that tell of a section, and whether its files can be imported.
SECTION_HINTS = [
    ("profile_information", "Profile", True),
    ("profile_v2", "Profile", True),
    ("personal_information", "Profile", True),
    ("/profile/", "Profile", True),
    ("/profile.json", "Profile", True),
    ("your_posts", "Posts", True),
    ("/posts/", "Posts", True),
    ("messages/", "Messages", True),
    ("/messages/", "Messages", True),
    ("archived_threads", "Messages", True),
    ("filtered_messages", "Messages", True),
    ("message_requests", "Messages", True),
    ("marketplace_messages", "Messages", True),
    ("comments", "Comments", True),
    ("reactions", "Reactions", True),
    ("likes_and_reactions", "Reactions", True),
    ("friends", "Friends", True),
    ("followers", "Friends", True),
    ("following", "Friends", True),
    ("friend_requests", "Friends", True),
    ("connections", "Friends", True),
    ("albums", "Albums", True),
    ("/album/", "Albums", True),
    ("your_photos", "Photos", True),
    ("your_videos", "Photos", True),
    ("photos_and_videos", "Photos", False),
    ("your_activity_across_facebook", "Activity", False),
    ("saved_items", "Saved items", False),
    ("saved", "Saved items", False),
    ("search_history", "Search history", False),
    ("searches", "Search history", False),
    ("groups", "Groups", False),
    ("events", "Events", False),
    ("location_history", "Location history", False),
    ("ads", "Ads", False),
    ("security", "Security", False),
    ("payments", "Payments", False),
]
#: Files that say whose archive it is, by their end and, at the root, by their name.
IDENTITY_FILES = r"/(profile_information|profile_v2|personal_information|profile)\.json$|^(profile_information|profile_v2|profile)\.json$"
#: Roots of an archive's folders; of pages; of media without pages; and the media's endings.
ROOTS = "^(your_facebook_activity|personal_information|messages|facebook)/"
PAGE_ROOTS = "^(your_facebook_activity|personal_information|profile_information|profile_v2|messages|connections|facebook)/"
MEDIA_ROOTS = "^(your_facebook_activity|personal_information|messages|connections|facebook)/"
MEDIA_FILES = r"\.(jpe?g|png|gif|webp|heic|mp4|mov|m4v|avi|mkv|mp3|m4a|wav|ogg|pdf)$"


def hints(path: Column) -> Column:
    """A bit for each entry of SECTION_HINTS that the path contains; sets of bits merge by OR in any order."""
    low = S.ascii_lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return reduce(lambda bits, k: bits.bitwiseOR(F.when(low.contains(SECTION_HINTS[k][0]), F.lit(1 << k)).otherwise(F.lit(0)).cast("long")), range(len(SECTION_HINTS)), F.lit(0).cast("long"))


def path_sections(path: Column) -> Column:
    """All sections that a path's hints name, in the order of the hints."""
    low = S.ascii_lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return F.array_distinct(F.array_compact(F.array(*[F.when(low.contains(needle), F.lit(name)) for needle, name, _ in SECTION_HINTS])))


def _named(bits: Column, of: list[tuple[str, str, bool]]) -> Column:
    known = F.array(*[F.struct(F.lit(1 << SECTION_HINTS.index(h)).cast("long").alias("bit"), F.lit(h[1]).alias("name")) for h in of])
    return F.array_distinct(F.transform(F.filter(known, lambda h: bits.bitwiseAND(h["bit"]) != 0), lambda h: h["name"]))


def evidence(listing: DataFrame, *keys: str) -> DataFrame:
    """What paths show of an archive, for each value of the keys; all of it merges by sums, OR and AND."""
    low = S.ascii_lower(F.replace("path", F.lit("\\"), F.lit("/")))
    return listing.filter("path IS NOT NULL").groupBy(*keys).agg(
        F.bit_or(hints(F.col("path"))).alias("hints"), F.count("*").alias("files"),
        F.count_if(low.endswith(".json")).alias("json"), F.count_if(low.rlike(r"\.html?$")).alias("html"),
        F.bool_or(low.rlike(IDENTITY_FILES)).alias("identity"), F.bool_or(low.rlike(ROOTS)).alias("rooted"), F.bool_or(low.rlike(PAGE_ROOTS)).alias("page_rooted"),
        F.bool_and(low.rlike(MEDIA_ROOTS) & low.rlike(MEDIA_FILES)).alias("only_media"),
    )


def _verdict(found: DataFrame, base: float, each: float, most: float, least: float) -> DataFrame:
    """Format, sections, whether it can be imported and how sure that is, from evidence."""
    col, n = F.col, F.size("sections")
    kind = F.when((col("json") > 0) & (col("html") > 0), "mixed").when(col("json") > 0, "json").when(col("html") > 0, "html").otherwise("unknown")
    named = found.withColumn("format", kind).withColumn("sections", _named(col("hints"), SECTION_HINTS))
    named = named.withColumn("supported_sections", _named(col("hints"), [h for h in SECTION_HINTS if h[2]])).withColumn("unsupported_sections", _named(col("hints"), [h for h in SECTION_HINTS if not h[2]]))
    shaped = (col("json") > 0) | (col("html") > 0) & (n > 0) & col("page_rooted")
    supported = col("supported") if "supported" in found.columns else shaped & (col("identity") | col("rooted") | (n > 0))
    named = named.withColumn("supported", supported).withColumn("media_only", col("only_media") & (col("format") == "unknown"))
    sure = F.when(col("supported"), F.least(F.lit(most), base + each * n)).when((col("format") == "html") & (n > 0), 0.2).otherwise(least)
    told = F.array_compact(F.array(
        F.when(col("supported") & (F.size("supported_sections") < 2), "Only a limited set of recognizable sections was found."),
        F.when((col("format") == "html") & (n > 0) & ~col("supported"), "HTML export markers were found, but no supported structural HTML file was detected."),
        F.when((col("format") == "html") & col("supported"), "HTML export detected. Unsupported pages are skipped with warnings."),
        F.when(col("format") == "mixed", "This archive contains both JSON and HTML files. JSON is preferred where a section has JSON."),
        F.when(F.size("unsupported_sections") > 0, F.concat(F.lit("Detected unsupported sections: "), F.array_join("unsupported_sections", ", "), F.lit("."))),
    ))
    return named.withColumn("confidence", F.round(sure, 2)).withColumn("detection_warnings", told)


_TOLD = ("format", "sections", "supported_sections", "unsupported_sections", "supported", "media_only", "confidence", "detection_warnings")


def detect_parts(listing: DataFrame) -> DataFrame:
    """part_path and what each part by itself shows."""
    return _verdict(evidence(listing, "part_path"), 0.55, 0.06, 0.98, 0.05).select("part_path", *_TOLD)


def detect(listing: DataFrame) -> DataFrame:
    """One row: what all parts show together. It can be imported if one part by itself can."""
    one = _verdict(evidence(listing, "part_path"), 0.55, 0.06, 0.98, 0.05)
    both = one.agg(F.bit_or("hints").alias("hints"), *[F.sum(c).alias(c) for c in ("files", "json", "html")], *[F.bool_or(c).alias(c) for c in ("identity", "rooted", "page_rooted", "supported")], F.bool_and("only_media").alias("only_media"))
    return _verdict(both, 0.58, 0.05, 0.99, 0.03).select(*_TOLD)


def suffixes(listing: DataFrame, keep: str = "part_path") -> DataFrame:
    """suffix, n and the `keep` column for every path in full (n = 9) and by its last one, two and three segments."""
    seg = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(seg), F.lit(3))), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(seg, -n, n), "/").alias("suffix")))
    full = F.array(F.struct(F.lit(9).alias("n"), F.col("path").alias("suffix")))
    return listing.select(keep, F.explode(F.array_distinct(F.concat(full, ends))).alias("s")).select("s.suffix", "s.n", keep)


def owners_by_suffix(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """path, part_id: the one part that has such a file, by the longest ending that only one part has."""
    owned = index.groupBy("suffix").agg(F.min("part_id").alias("lo"), F.max("part_id").alias("hi")).filter("lo = hi").select("suffix", F.col("lo").alias("part_id"))
    tried = suffixes(wanted.select("path").distinct(), "path")
    return tried.join(owned, "suffix").groupBy("path").agg(F.max(F.struct("n", "part_id"))["part_id"].alias("part_id"))


def media_owners(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """`wanted` (column path) with the one part that has such a file by its last three, two or one segments or in full.

    A suffix that several parts have decides nothing.
    """
    found = owners_by_suffix(wanted, suffixes(listing).withColumnRenamed("part_path", "part_id"))
    return wanted.join(found.withColumnRenamed("part_id", "part_path"), "path", "left")
