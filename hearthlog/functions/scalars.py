"""Scalar expressions over columns; none of them is a UDF."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only, so other letters keep their order and identity."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def contains_ci(c: Column, text: str) -> Column:
    """LIKE '%text%' without case for A-Z; % and _ in the text are wildcards and there is no escape character."""
    pattern = text.strip().translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)).replace("\\", "\\\\")
    return ascii_lower(c).like(f"%{pattern}%")


def iso(ts: Column) -> Column:
    """The canonical text of a timestamp, UTC with milliseconds."""
    return F.date_format(ts, ISO)


def valid_iso(c: Column) -> Column:
    """True for a text that begins with a real date; bare years and clock times aren't dates."""
    date = F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd"))
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}") & date.isNotNull(), F.lit(False))


def parse_time(c: Column) -> Column:
    """Canonical text from seconds or milliseconds, a year, or an ISO-like text; null for anything else."""
    number = F.when(c.rlike(r"^\d+(\.\d+)?$") & ~c.rlike(r"^\d{4}$"), c.try_cast("double"))
    millis = F.when(number < 1e12, number * 1000).otherwise(number).cast("long")
    day = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))
    full = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), F.try_to_timestamp(F.regexp_replace(c, " ", "T")))
    year = F.when(c.rlike(r"^\d{4}$"), F.try_to_timestamp(F.concat(c, F.lit("-01-01")), F.lit("yyyy-MM-dd")))
    return iso(F.coalesce(F.when(millis < 253402300800000, F.timestamp_millis(millis)), year, day, full))


def parse_human_date(c: Column) -> Column:
    """Canonical text from `Month D, YYYY` or `D Month YYYY` with an optional time, read as UTC; months by prefix."""
    months = "jan feb mar apr may jun jul aug sep oct nov dec".split()
    low = F.trim(ascii_lower(c))
    first, second = r"^([a-z]{3})[a-z]*\.? (\d{1,2}),? (\d{4})", r"^(\d{1,2}) ([a-z]{3})[a-z]*\.? (\d{4})"
    us, eu = low.rlike(first), low.rlike(second)
    name = F.when(us, F.regexp_extract(low, first, 1)).when(eu, F.regexp_extract(low, second, 2))
    day = F.when(us, F.regexp_extract(low, first, 2)).when(eu, F.regexp_extract(low, second, 1))
    year = F.when(us, F.regexp_extract(low, first, 3)).when(eu, F.regexp_extract(low, second, 3))
    month = reduce(lambda e, m: e.when(name == m[1], f"{m[0]:02d}"), enumerate(months, 1), F.when(F.lit(False), ""))
    clock = r"(\d{1,2}):(\d{2})(?::(\d{2}))? ?(am|pm)?"
    hour, half = F.regexp_extract(low, clock, 1).try_cast("int"), F.regexp_extract(low, clock, 4)
    hour24 = F.when(half == "pm", hour % 12 + 12).when(half == "am", hour % 12).otherwise(hour)
    time = F.format_string("%02d:%s:%s", F.coalesce(hour24, F.lit(0)), F.coalesce(F.nullif(F.regexp_extract(low, clock, 2), F.lit("")), F.lit("00")), F.coalesce(F.nullif(F.regexp_extract(low, clock, 3), F.lit("")), F.lit("00")))
    text = F.concat(year, F.lit("-"), month, F.lit("-"), F.lpad(day, 2, "0"), F.lit("T"), time)
    return F.coalesce(parse_time(F.trim(c)), iso(F.try_to_timestamp(text)))


def fnv1a32(c: Column) -> Column:
    """FNV-1a of the UTF-16 code units as eight hexadecimal digits. An id for people to see, not a key to join on."""
    units = F.hex(F.encode(c, "UTF-16BE"))
    # Cut into units once: an expression over the whole text inside a lambda would run for every unit.
    each = F.transform(F.regexp_extract_all(units, F.lit("...."), 0), lambda u: F.conv(u, 16, 10).cast("long"))
    h = F.aggregate(each, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
    return F.lpad(ascii_lower(F.hex(h)), 8, "0")


def clean_path(c: Column) -> Column:
    """Percent-decoded, forward slashes, without leading ./ and doubled slashes; + stays a plus."""
    decoded = F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(decoded, r"\\\\", "/"), r"^(?:\./)+", ""), "/{2,}", "/")


def suspicious_path(c: Column) -> Column:
    """Absolute paths, drives, schemes, parent folders and NUL."""
    return c.rlike(r"^/") | c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | c.rlike(r"(^|[/\\])\.\.([/\\]|$)") | c.contains("\0")


def resolve_path(source: Column, ref: Column) -> Column:
    """A reference inside an archive, relative to its source file; null for schemes, // and what leaves the root."""
    bare = F.regexp_replace(ref, r"[?#].*$", "")
    decoded = F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)
    folder = F.regexp_extract(source, r"^(.*/)?[^/]*$", 1)
    parts = F.filter(F.split(F.concat(folder, decoded), "/"), lambda p: ~p.isin("", "."))
    start = F.struct(F.array().cast("array<string>").alias("path"), F.lit(False).alias("out"))

    def fold(state: Column, part: Column) -> Column:
        up, path = part == "..", state["path"]
        return F.struct(
            F.when(~up, F.concat(path, F.array(part))).when(F.size(path) > 0, F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))).otherwise(path).alias("path"),
            (state["out"] | (up & (F.size(path) == 0))).alias("out"),
        )

    done = F.aggregate(parts, start, fold)
    bad = ref.rlike(r"^\s*[A-Za-z][A-Za-z0-9+.-]*:") | ref.rlike("^(//|/)") | done["out"] | (F.size(done["path"]) == 0)
    return F.when(~bad, F.array_join(done["path"], "/"))


#: Kinds of media in the order in which they are tried, with a word that settles them and file endings.
MEDIA_KINDS = [
    ("video", "video", "mp4 mov webm m4v"),
    ("audio", "audio", "mp3 m4a wav ogg oga"),
    ("photo", "image", "jpg jpeg png gif webp heic avif"),
    ("file", "file", "pdf doc docx xls xlsx txt zip"),
]
#: The same for media that an HTML page shows, where the tag settles the kind.
SHOWN_KINDS = [
    ("video", "mp4 mov m4v webm avi mkv"),
    ("audio", "mp3 m4a wav ogg aac"),
    ("photo", "jpg jpeg png gif webp heic avif bmp"),
]


def _ends(low: Column, endings: str, more: str = "$") -> Column:
    return low.rlike(rf"\.({endings.replace(' ', '|')}){more}")


def media_type(path: Column, hint: Column | None = None) -> Column:
    """video, audio, photo, file or unknown: a word in the hint or the path decides before the file's ending."""
    low = ascii_lower(path if hint is None else F.concat_ws(" ", hint, path))
    return reduce(lambda e, k: e.when(low.contains(k[1]) | _ends(low, k[2]), k[0]), MEDIA_KINDS, F.when(F.lit(False), "")).otherwise("unknown")


def shown_media_type(path: Column, tag: Column) -> Column:
    """video, audio, photo or unknown for media that a page shows."""
    low = ascii_lower(path)
    return reduce(lambda e, k: e.when((tag == k[0]) | _ends(low, k[1], "($|[?#])"), k[0]), SHOWN_KINDS, F.when(F.lit(False), "")).otherwise("unknown")


def _first_mark(low: Column, marks: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    return reduce(lambda e, m: e.when(low.rlike(m[1]), m[0]), marks, F.when(F.lit(False), "")).otherwise(F.lit(otherwise))


#: What a connection's path and type say about it, tried in this order.
CONNECTION_MARKS = [
    ("removed_friend", "removed|unfriend"),
    ("follower", "follower"),
    ("following", "following"),
    ("blocked", "blocked"),
    ("incoming_request", "incoming|received"),
    ("outgoing_request", "outgoing|sent"),
    ("friend", "friend"),
]
#: The same for HTML pages, by their path alone.
PAGE_CONNECTION_MARKS = [
    ("removed_friend", "removed_friends"),
    ("follower", "followers"),
    ("following", "following|who_you"),
    ("incoming_request", "received.*request|request.*received"),
    ("outgoing_request", "(sent|outgoing).*request|request.*(sent|outgoing)"),
    ("blocked", "blocked"),
    ("friend", "friend"),
]


def connection_type(hint: Column) -> Column:
    return _first_mark(ascii_lower(hint), CONNECTION_MARKS, "unknown")


def page_connection_type(path: Column) -> Column:
    return _first_mark(ascii_lower(path), PAGE_CONNECTION_MARKS, "unknown")


#: The part of a path that says which section a file belongs to, tried in this order.
SECTION_MARKS = [
    ("profile", r"profile_information|profile_v2|personal_information|/profile/|(^|/)profile\.json$"),
    ("posts", r"/posts/|(^|/)posts\.json$|(^|/)your_posts(__|[_-])?[^/]*\.(json|html?)$"),
    ("messages", r"messages/(.*/)?message([_-]\d+)?\.(json|html?)$"),
    ("comments", "comment"),
    ("reactions", "reaction|like"),
    ("connections", "friends|followers|following|friend_requests|connections"),
    ("albums", "album|your_photos|your_videos"),
]


def section(path: Column) -> Column:
    """The section of a JSON or HTML file, or null."""
    low = ascii_lower(path)
    return F.when(low.rlike(r"\.(json|html?)$"), _first_mark(low, SECTION_MARKS))


#: The hosts that profile links may point to.
SAFE_HOSTS = ["facebook.com", "www.facebook.com", "m.facebook.com", "web.facebook.com", "fb.com", "www.fb.com"]


def safe_profile_url(url: Column, hosts: list[str] = SAFE_HOSTS) -> Column:
    """The URL if it is https, names an allowed host exactly and carries no credentials; else null."""
    host = F.try_parse_url(url, F.lit("HOST"))
    user = F.try_parse_url(url, F.lit("USERINFO"))
    return F.when(url.startswith("https://") & ascii_lower(host).isin(hosts) & user.isNull(), url)


def profile_target(url: Column, number: Column, username: Column, name: Column) -> Column:
    """Where a profile link leads: the exact URL, else by number, user name or a search for the name."""
    home = "https://www.facebook.com/"
    return F.coalesce(
        safe_profile_url(url),
        F.when(number.rlike(r"^\d+$"), F.concat(F.lit(home + "profile.php?id="), number)),
        F.when(username.rlike(r"^[A-Za-z0-9.]+$"), F.concat(F.lit(home), username)),
        F.when(F.trim(name) != "", F.concat(F.lit(home + "search/people/?q="), F.url_encode(F.trim(name)))),
    )


def summary(c: Column, most: int = 160) -> Column:
    """One line of at most `most` characters."""
    return F.substring(F.regexp_replace(c, r"[\n\r]", " "), 1, most)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(ascii_lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def bounded(c: Column, most: int) -> Column:
    """White space squeezed, cut with an ellipsis."""
    one = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(one) > most, F.concat(F.substring(one, 1, most), F.lit("…"))).otherwise(one)


def redact_file(c: Column) -> Column:
    """A file's name without what it says: <file> and its ending."""
    return F.concat(F.lit("<file>"), F.regexp_extract(ascii_lower(c), r"(\.[a-z0-9]{1,8})$", 1))


#: What a warning's text says about its category, tried in this order.
WARNING_MARKS = [
    ("unsupported-shape", "unsupported|unrecognized"),
    ("malformed-json", "malformed|json|parse"),
    ("unsafe-path", "suspicious|unsafe"),
    ("missing-media", "media reference not found"),
    ("duplicate-part", "duplicate"),
]


def warning_category(c: Column) -> Column:
    """A known category, or the message itself without its file, what is in brackets and numbers, at most 120 characters."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^.*?·\s*", ""), r"\([^)]*\)", "(path)"), r"\d+", "#")
    other = F.coalesce(F.nullif(F.substring(F.trim(bare), 1, 120), F.lit("")), F.lit("import-warning"))
    return F.coalesce(_first_mark(ascii_lower(bare), WARNING_MARKS), other)


def or_null(df: DataFrame, name: str, kind: str = "string") -> Column:
    """A column of `df`, or null where it has none of this name."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def natural_key(path: Column) -> Column:
    """Orders message chunks by number, then by path."""
    number = F.regexp_extract(path, r"(?:message|chunk)[_-]?(\d+)", 1)
    return F.struct(F.coalesce(number.try_cast("int"), F.lit(2**31 - 1)).alias("chunk"), path.alias("path"))


def keyset_after(key: Column, id_: Column, last_key, last_id, descending: bool = True) -> Column:
    """Rows behind a cursor. The plain bound on the key lets the scan skip row groups."""
    if descending:
        return (key <= F.lit(last_key)) & ((key < F.lit(last_key)) | (id_ < F.lit(last_id)))
    return (key >= F.lit(last_key)) & ((key > F.lit(last_key)) | (id_ > F.lit(last_id)))
