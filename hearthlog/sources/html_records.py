"""HTML pages of an archive as cards, and cards as records; a small tokenizer helper runs per page."""

from __future__ import annotations

import codecs
from collections import Counter
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlog.functions import scalars as S

#: Limits of a card.
MOST_TEXT, MOST_LINKS, MOST_DEPTH, MOST_ALBUM = 100_000, 100, 2048, 20_000
#: Classes that mark a card, its heading, its body and its date.
CARD, HEADING, BODY, DATE, SENDER = "_a6-g", "_a6-h", "_a6-p", "_a72d", "_a6-i"
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SILENT = frozenset(("script", "style", "template", "noscript"))
_CARD_TYPE = "struct<heading:string,heading_class:string,body:string,date:string,datetime:string,text:string,links:array<string>,media:array<string>,tags:array<string>,attributes:map<string,string>,media_before:int>"
_PAGE_FIELDS = "title:string,h1:string,links:array<string>,media:array<string>,loose:array<struct<ref:string,tag:string>>,rows:array<array<string>>"
_CARD_ARROW = pa.struct([*[(k, pa.string()) for k in ("heading", "heading_class", "body", "date", "datetime", "text")], *[(k, pa.list_(pa.string())) for k in ("links", "media", "tags")], ("attributes", pa.map_(pa.string(), pa.string())), ("media_before", pa.int32())])
_PAGE_ARROW = [("title", pa.string()), ("h1", pa.string()), ("links", pa.list_(pa.string())), ("media", pa.list_(pa.string())), ("loose", pa.list_(pa.struct([("ref", pa.string()), ("tag", pa.string())]))), ("rows", pa.list_(pa.list_(pa.string())))]
#: A page as rows: its cards one by one, then what it has besides.
STREAMED = f"place int, card {_CARD_TYPE}, page struct<{_PAGE_FIELDS}>"
STREAMED_ARROW = [("place", pa.int32()), ("card", _CARD_ARROW), ("page", pa.struct(_PAGE_ARROW))]


class _Text:
    """Text with its white space squeezed as it comes; what goes beyond the limit isn't kept."""

    def __init__(self):
        self.parts, self.length, self.gap = [], 0, False

    def add(self, data: str) -> None:
        if self.length > MOST_TEXT:
            return
        words = " ".join(data.split())
        if not words:
            self.gap = self.gap or bool(data)
            return
        lead = " " if self.length and (self.gap or data[0].isspace()) else ""
        self.parts.append((lead + words)[: MOST_TEXT + 1 - self.length])
        self.length += len(self.parts[-1])
        self.gap = data[-1].isspace()

    def get(self) -> str | None:
        text = "".join(self.parts)
        return (text[:MOST_TEXT] + "…" if len(text) > MOST_TEXT else text) or None


class PageStream(HTMLParser):
    """Collects the page's title and heading, the rows of tables and the cards; unclosed and stray tags are put up with.

    Bytes come in pieces of any size, also with a character split between two; they are dealt to the parser in blocks
    of fixed length, so that the result doesn't depend on the pieces. A card is handed out when it ends, and all that
    is kept of a page has a bound, so memory doesn't grow with it.
    """

    BLOCK = 1 << 16  # characters
    HELD = 1 << 20  # characters of a tag or comment that may be waiting for its end

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.decoder, self.waiting = codecs.getincrementaldecoder("utf-8")("replace"), ""
        self.open: list[tuple[str, str | None]] = []
        self.count, self.into = Counter(), []
        self.done, self.rows, self.links, self.media, self.loose = [], [], [], [], []
        self.text = {"title": _Text(), "h1": _Text()}
        self.card, self.row, self.silent, self.cards_seen, self.media_seen = None, None, 0, 0, 0

    # -- pieces

    def take(self, data: bytes | str, last: bool = False) -> list[dict]:
        """The cards that end within the next piece; `last` closes the page."""
        self.waiting += self.decoder.decode(data, last) if isinstance(data, bytes) else data
        at = 0
        while len(self.waiting) - at >= self.BLOCK or last and at < len(self.waiting):
            self.feed(self.waiting[at : at + self.BLOCK])
            at += self.BLOCK
            while len(self.rawdata) > self.HELD and self.cdata_elem is None:  # never ended: its first character is text
                held, self.rawdata = self.rawdata, ""
                self.handle_data(held[0])
                self.feed(held[1:])
        self.waiting = self.waiting[at:]
        if self.cdata_elem is not None and len(self.rawdata) > self.HELD:  # a long script; its end tag may be split
            self.rawdata = self.rawdata[-64:]
        if last:
            self.close()
            if self.card is not None:  # never closed
                self._finish_card()
        out, self.done = self.done, []
        return out

    def page(self) -> dict:
        return {"title": self.text["title"].get(), "h1": self.text["h1"].get(), "links": self.links, "media": self.media, "loose": [{"ref": r, "tag": t} for r, t in self.loose], "rows": [[c.get() or "" for c in r] for r in self.rows if r]}

    # -- the parser's events

    def _finish_card(self) -> None:
        c = self.card
        self.done.append({**c, **{k: c[k].get() for k in ("heading", "body", "date", "text")}, "attributes": list(c["attributes"].items()), "media_before": self.media_seen})
        self.cards_seen, self.media_seen, self.card = self.cards_seen + 1, self.media_seen + len(c["media"]), None

    def _part(self) -> None:
        if self.card is not None:
            self.card["body"].gap = True

    def handle_starttag(self, tag, attrs):
        self._part()
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        into = None
        if CARD in classes and self.card is None:
            self.card = {"heading": _Text(), "heading_class": None, "body": _Text(), "date": _Text(), "datetime": None, "text": _Text(), "links": [], "media": [], "tags": [], "attributes": {}}
            into = "card"
        elif self.card is not None:
            into = "heading" if tag == "h2" or HEADING in classes else "body" if BODY in classes else "date" if tag == "time" or DATE in classes else None
            if into == "heading" and self.card["heading_class"] is None:
                self.card["heading_class"] = " ".join(classes)
            if tag == "time" and a.get("datetime"):
                self.card["datetime"] = a["datetime"]
        if self.card is not None:
            for k, v in attrs:
                if k.startswith("data-") and (k in self.card["attributes"] or len(self.card["attributes"]) < MOST_LINKS):
                    self.card["attributes"][k] = (v or "")[:MOST_TEXT]
        if tag == "tr":
            self.row = []
        elif tag in ("th", "td") and self.row is not None and len(self.row) < MOST_LINKS:
            self.row.append(_Text())
            into = into or "cell"
        for name, keep in (("href", "links"), ("src", "media")):
            if a.get(name) and (tag == "a" if name == "href" else tag in ("img", "video", "audio", "source")):
                if len(getattr(self, keep)) < MOST_ALBUM:
                    getattr(self, keep).append(a[name])
                if self.card is not None and len(self.card[keep]) < MOST_LINKS:
                    self.card[keep].append(a[name])
                    if keep == "media":
                        self.card["tags"].append(tag)
                elif self.card is None and keep == "media" and len(self.loose) < MOST_ALBUM:
                    self.loose.append((a[name], tag))
        if tag not in _VOID and (len(self.open) < MOST_DEPTH or tag in _SILENT):
            self.open.append((tag, into))
            self.count[tag] += 1
            self.silent += tag in _SILENT
            if into and into != "card":
                self.into.append(into)

    def handle_endtag(self, tag):
        self._part()
        if not self.count[tag]:
            return  # an end without a start
        while self.open:
            t, into = self.open.pop()
            self.count[t] -= 1
            self.silent -= t in _SILENT
            if into == "card":
                self._finish_card()
            elif into:
                self.into.pop()
            if t == "tr" and self.row is not None:
                if len(self.rows) < MOST_ALBUM:
                    self.rows.append(self.row)
                self.row = None
            if t == tag:
                return

    def handle_comment(self, data):
        self._part()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_data(self, data):
        if self.silent:
            return
        if self.card is not None:
            self.card["text"].add(data)
        for name, text in self.text.items():
            if self.count[name]:
                text.add(data)
        into = self.into[-1] if self.into else None
        if into == "cell" and self.row:
            self.row[-1].add(data)
        elif into and into != "cell" and self.card is not None:
            self.card[into].add(data)
        elif self.card is not None and self.open and self.open[-1][0] != "title":
            self.card["body"].add(data)


def _page(html: str | None) -> dict:
    p = PageStream()
    return {"cards": p.take(html or "", last=True), **p.page()}


def streamed(chunks: Iterable[bytes]) -> Iterator[tuple[tuple, int]]:
    """Rows (place, card, page) of one page from its bytes, and about the bytes that each holds: its cards, then the page itself."""
    p, place = PageStream(), 0
    for data in chunks:
        for card in p.take(data):
            yield (place, card, None), sum(len(card[k] or "") for k in ("heading", "body", "text"))
            place += 1
    for card in p.take(b"", last=True):
        yield (place, card, None), len(card["text"] or "")
        place += 1
    yield (None, None, p.page()), 1000


def pages(files: DataFrame, html_col: str = "text") -> DataFrame:
    """`files` with title, h1, links, media, media outside of cards, rows and cards of each page, without the HTML. Null pages have none."""
    keep = [c for c in files.columns if c != html_col]
    arrow = pa.struct([*_PAGE_ARROW, ("cards", pa.list_(_CARD_ARROW))])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                page = pa.array([_page(t) for t in part.column(len(keep)).to_pylist()], arrow)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], page], names=[*keep, "page"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*keep).schema)
    out = files.select(*keep, html_col).mapInArrow(run, f"{kinds}, page struct<{_PAGE_FIELDS},cards:array<{_CARD_TYPE}>>")
    return out.select(*keep, "page.*")


#: What a page's path says about its cards, tried in this order.
PAGE_MARKS = [
    ("messages", "(^|/)messages/"),
    ("connections", "connections/"),
    ("comments", "comment"),
    ("reactions", "reaction|likes_and_reactions"),
    ("albums", "/album|albums|your_photos|your_videos"),
    ("posts", "/posts/|your_posts"),
]
#: The folders that hold threads.
THREAD_FOLDERS = "inbox|archived_threads|filtered_threads|message_requests|marketplace_messages|marketplace|thread_requests|e2ee_cutover"


def page_kind(path: Column) -> Column:
    low = S.ascii_lower(path)
    kind = F.when(F.lit(False), "")
    for name, pattern in PAGE_MARKS:
        kind = kind.when(low.rlike(pattern), name)
    return kind


def cards(parsed: DataFrame, path_col: str = "path") -> DataFrame:
    """One row for each card, with its place on the page, kind, date and the page's heading."""
    keep = [c for c in parsed.columns if c not in ("title", "h1", "links", "media", "loose", "rows", "cards")]
    rows = parsed.select(*keep, F.col("h1").alias("page_title"), F.posexplode("cards").alias("place", "card")).select(*keep, "page_title", "place", "card.*")
    return _dated(rows, path_col)


def _dated(rows: DataFrame, path_col: str) -> DataFrame:
    at = F.coalesce(S.parse_human_date(F.col("datetime")), S.parse_human_date(F.col("date")))
    return rows.withColumn("created_at", at).withColumn("section", page_kind(F.col(path_col)))


def split(rows: DataFrame, keys: tuple[str, ...] = ("part_path", "path")) -> tuple[DataFrame, DataFrame]:
    """Pages (without cards) and cards, as pages() and cards() have them, from the rows of a page stream."""
    pages_ = rows.filter("page IS NOT NULL").select(*keys, "page.*")
    titles = pages_.select(*keys, F.col("h1").alias("page_title"))
    cards_ = rows.filter("card IS NOT NULL").select(*keys, F.col("place"), "card.*").join(titles, list(keys), "left")
    return pages_, _dated(cards_, "path")


def _hashed(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:facebook:html:"), S.fnv1a32(F.concat_ws(":", *parts)))


def folder(path: Column) -> Column:
    """The folder of a thread."""
    named = F.nullif(F.regexp_extract(path, rf"(?i)/messages/(?:{THREAD_FOLDERS})/([^/]+)/", 1), F.lit(""))
    return F.coalesce(named, F.nullif(F.regexp_extract(path, r"([^/]+)/[^/]*$", 1), F.lit("")), F.lit("messages"))


def identity(name: Column, href: Column, scope: Column) -> dict[str, Column]:
    """id, number, username and profile_url of a person: by number in the link, else by user name, else by name within a scope."""
    url = S.safe_profile_url(href)
    digits = F.try_parse_url(url, F.lit("QUERY"), F.lit("id"))
    digits = F.when(digits.rlike(r"^\d+$"), digits)
    path = F.try_parse_url(url, F.lit("PATH"))
    single, people = F.regexp_extract(path, r"^/+([^/]+)/*$", 1), F.regexp_extract(path, r"(?i)^/+people/+([^/]+)", 1)
    single = F.when(~S.ascii_lower(single).isin("profile.php", "people"), single)
    username = F.when(digits.isNull(), F.coalesce(F.nullif(people, F.lit("")), F.nullif(single, F.lit(""))))
    seed = F.coalesce(F.concat(F.lit("id:"), digits), F.concat(F.lit("username:"), F.lower(username)), F.concat(F.lit("name:"), F.lower(F.coalesce(name, F.lit(""))), F.lit("|scope:"), scope))
    return {"id": F.concat(F.lit("person:facebook:html:"), S.fnv1a32(seed)), "facebook_id": digits, "username": username, "profile_url": url}


def _count(text: Column, label: str) -> Column:
    """The number beside a label, in front of it or behind it; 0 without one."""
    behind = F.regexp_extract(text, rf"(?i)(?:{label}s?|reactions?)\s*[:·-]?\s*(\d+)", 1)
    before = F.regexp_extract(text, rf"(?i)(\d+)\s+{label}s?", 1)
    return F.coalesce(F.nullif(behind, F.lit("")), F.nullif(before, F.lit("")), F.lit("0")).cast("int")


def _media(rows: DataFrame, kind: str) -> DataFrame:
    """Local media of rows with path, id, place, refs (ref, tag) and caption, once for each path, as tables have them."""
    return _each_media(rows.select("part_path", "path", "id", "caption", F.posexplode("refs").alias("k", "r")), kind)


def _each_media(refs: DataFrame, kind: str) -> DataFrame:
    each = refs.withColumn("file", S.resolve_path(F.col("path"), F.col("r.ref"))).filter("file IS NOT NULL")
    first = each.groupBy("part_path", "path", "id", "file").agg(F.min(F.struct("k", "r.tag", "caption")).alias("m")).select("part_path", "path", "id", "file", "m.k", "m.tag", "m.caption")
    return first.select(
        _hashed("media", F.col("path"), F.col("id"), F.col("k").cast("string"), F.col("file")).alias("id"), F.col("file").alias("path"), S.shown_media_type(F.col("file"), F.col("tag")).alias("media_type"), F.substring_index("file", "/", -1).alias("filename"),
        "caption", F.lit(kind).alias("owner_type"), F.col("id").alias("owner_id"), F.col("part_path").alias("archive_part_id"), F.col("path").alias("source_path"), F.col("k").cast("int").alias("source_index"),
    )


def records(card_rows: DataFrame) -> dict[str, DataFrame]:
    """Cards as posts, messages, conversations, connections, comments, reactions, media and people.

    Comments and reactions of pages of their own need an explicit target; those without count as warnings.
    """
    if "part_path" not in card_rows.columns:
        card_rows = card_rows.withColumn("part_path", F.lit(None).cast("string"))
    kind, col = F.col("section"), F.col
    attr = lambda *names: F.coalesce(*[F.nullif(F.try_element_at("attributes", F.lit(f"data-{n}")), F.lit("")) for n in names])
    path, place = col("path"), col("place").cast("string")
    source = [col("part_path").alias("archive_part_id"), path.alias("source_path"), col("place").cast("int").alias("source_index")]
    href = F.try_element_at(F.filter("links", lambda x: S.safe_profile_url(x).isNotNull()), F.lit(1))
    text = F.coalesce("body", F.nullif(F.trim(F.replace(F.replace(F.coalesce("text", F.lit("")), F.coalesce("heading", F.lit("")), F.lit("")), F.coalesce("date", F.lit("")), F.lit(""))), F.lit("")))
    rows = card_rows.withColumn("href", href).withColumn("said", text).withColumn("refs", F.arrays_zip(col("media").alias("ref"), col("tags").alias("tag"))).withColumn("caption", F.lit(None).cast("string"))
    here = lambda name, scope=path, link=col("href"): identity(name, link, scope)
    chat_scope = F.concat(F.lit("messages:"), F.lower(folder(path)))

    def people(df: DataFrame, name: Column, who: dict[str, Column], at: Column) -> DataFrame:
        named = F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("Unknown person"))
        return df.select(
            who["id"].alias("id"), named.alias("display_name"), who["facebook_id"].alias("facebook_id"), who["username"].alias("username"), who["profile_url"].alias("profile_url"), at.alias("first_seen"), at.alias("last_seen"),
            F.when(who["facebook_id"].isNotNull() | who["username"].isNotNull(), "exact").otherwise("inferred").alias("identity_confidence"), path.alias("identity_source"), F.array(path).alias("source_paths"), F.lit(False).alias("is_archive_owner"), *source[:2],
        )

    chats = rows.filter(kind == "messages")
    sent = chats.filter(col("heading").isNotNull() & F.coalesce(col("heading_class"), F.lit("")).rlike(rf"(^|\s){SENDER}(\s|$)"))
    conversation = _hashed("conversation", F.concat(F.lit("folder:"), F.lower(folder(path)))).alias("conversation_id")
    sender = here(col("heading"), chat_scope)
    messages = sent.withColumn("id", _hashed("message", path, place)).withColumn("sender_id", sender["id"])
    titled = chats.select(conversation, F.struct("path", "place").alias("o"), F.when(col("heading_class").rlike(SENDER), col("page_title")).otherwise(col("heading")).alias("title"), "part_path", "path")
    titles = titled.groupBy("conversation_id").agg(F.min_by("title", F.when(col("title").isNotNull(), col("o"))).alias("title"), F.min_by("path", "o").alias("source_path"), F.min_by("part_path", "o").alias("archive_part_id"))
    members = messages.select(conversation, F.struct("path", "place").alias("o"), "sender_id", "heading").groupBy("conversation_id", "sender_id").agg(F.min("o").alias("o"), F.min_by("heading", "o").alias("name"))
    lists = members.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("o", "name", "sender_id"))).alias("all"))
    threads = titles.join(lists, "conversation_id", "left").select(
        col("conversation_id").alias("id"), "title", F.coalesce(F.array_distinct(F.transform("all", lambda x: x["name"])), F.array().cast("array<string>")).alias("participant_names"),
        F.coalesce(F.transform("all", lambda x: x["sender_id"]), F.array().cast("array<string>")).alias("participant_ids"), "archive_part_id", "source_path",
    ).withColumn("is_group", F.size("participant_names") > 2)

    own = F.lower(path).rlike("your_posts|your_facebook_activity/posts")
    told = rows.filter((kind == "posts") & (col("said").isNotNull() | col("heading").isNotNull() | (F.size("refs") > 0))).withColumn("id", _hashed("post", path, place))
    author = here(col("heading"))
    posts = told.withColumn("author_id", F.when(own, "owner").when(col("heading").isNotNull(), author["id"]))
    reacted = told.filter(attr("reaction-type", "reaction").isNotNull() & attr("actor", "actor-name").isNotNull())
    replied = told.filter(attr("comment", "comment-text").isNotNull())

    friends = rows.filter((kind == "connections") & col("heading").isNotNull())
    friend = here(col("heading"))
    post_id = F.coalesce(attr("post-id"), F.when(attr("target-type") == "post", attr("target-id")))
    targeted = rows.filter((kind == "comments") & post_id.isNotNull() & col("said").isNotNull())
    writer = F.coalesce(attr("comment-author", "actor"), col("heading"), F.lit("Unknown person"))
    target_id = F.coalesce(attr("target-id"), F.when(attr("target-type") == "post", attr("post-id")))
    given = attr("reaction-type", "reaction", "kind")
    liked = rows.filter((kind == "reactions") & target_id.isNotNull() & given.isNotNull())
    liker = F.coalesce(attr("actor", "actor-name"), col("heading"))
    lost = rows.filter(((kind == "comments") & (post_id.isNull() | col("said").isNull())) | ((kind == "reactions") & (target_id.isNull() | given.isNull())))

    named = lambda df, name: df.filter(name.isNotNull())
    inline = attr("comment-author")
    everyone = [
        people(messages, col("heading"), sender, col("created_at")), people(friends, col("heading"), friend, col("created_at")), people(targeted, writer, here(writer), col("created_at")),
        people(named(liked, liker), liker, here(liker), col("created_at")), people(named(posts, col("heading")).filter(~own), col("heading"), author, col("created_at")),
        people(reacted, attr("actor", "actor-name"), here(attr("actor", "actor-name")), col("created_at")), people(replied, inline, here(inline, link=F.lit(None).cast("string")), col("created_at")),
    ]
    all_people = everyone[0]
    for more in everyone[1:]:
        all_people = all_people.unionByName(more)
    links = F.array_distinct(F.filter(F.transform("links", lambda x: F.when(x.rlike("^https://"), x).otherwise(S.resolve_path(path, x))), lambda x: x.isNotNull()))
    return {
        "posts": posts.select("id", "author_id", col("heading").alias("title"), col("said").alias("body"), "created_at", links.alias("links"), F.size("refs").alias("media_count"), _count(col("text"), "comment").alias("comment_count"), _count(col("text"), "reaction").alias("reaction_count"), *source),
        "messages": messages.select("id", conversation, "sender_id", col("heading").alias("sender_name"), col("said").alias("body"), col("created_at").alias("sent_at"), *source),
        "conversations": threads,
        "connections": friends.select(_hashed("connection", path, place).alias("id"), friend["id"].alias("person_id"), col("heading").alias("display_name"), friend["facebook_id"].alias("facebook_id"), friend["username"].alias("username"), friend["profile_url"].alias("profile_url"), S.page_connection_type(path).alias("relationship_type"), col("created_at").alias("started_at"), *source),
        "comments": targeted.select(_hashed("comment", path, place, post_id, col("said")).alias("id"), post_id.alias("post_id"), here(writer)["id"].alias("author_id"), writer.alias("author_name"), col("said").alias("body"), "created_at", *source).unionByName(
            replied.select(_hashed("comment", path, place, attr("comment", "comment-text")).alias("id"), col("id").alias("post_id"), here(inline, link=F.lit(None).cast("string"))["id"].alias("author_id"), F.coalesce(inline, F.lit("Unknown person")).alias("author_name"), attr("comment", "comment-text").alias("body"), "created_at", *source)),
        "reactions": liked.select(_hashed("reaction", path, place, target_id, given, F.coalesce(liker, F.lit(""))).alias("id"), F.when(attr("target-type").isin("post", "comment"), attr("target-type")).otherwise("post").alias("target_type"), target_id.alias("target_id"), F.when(liker.isNotNull(), here(liker)["id"]).alias("person_id"), liker.alias("person_name"), given.alias("kind"), "created_at", *source).unionByName(
            reacted.select(_hashed("reaction", path, place, attr("reaction-type", "reaction"), attr("actor", "actor-name")).alias("id"), F.lit("post").alias("target_type"), col("id").alias("target_id"), here(attr("actor", "actor-name"))["id"].alias("person_id"), attr("actor", "actor-name").alias("person_name"), attr("reaction-type", "reaction").alias("kind"), "created_at", *source)),
        "media": _media(posts, "post").unionByName(_media(messages, "message")),
        "people": all_people,
        "warnings": lost.groupBy("path", "section").agg(F.count("*").alias("n")),
    }


def albums(parsed: DataFrame, card_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An album for each page of albums, photos or videos, and its media: those outside of cards, then those of its cards."""
    if "part_path" not in parsed.columns:
        parsed, card_rows = (df.withColumn("part_path", F.lit(None).cast("string")) for df in (parsed, card_rows))
    shown = F.lower("path").rlike("/album|albums|your_photos|your_videos")
    told = F.try_element_at(F.transform(F.filter("rows", lambda r: (F.size(r) == 2) & r[0].rlike("(?i)^(album|title|name)$")), lambda r: r[1]), F.lit(1))
    name = F.coalesce("h1", told, F.nullif(F.regexp_replace(F.substring_index("path", "/", -1), r"(?i)\.(html?|json)$", ""), F.lit("")), F.lit("Facebook album"))
    rows = parsed.filter(shown).withColumn("id", _hashed("album", F.col("path"))).withColumn("name", name)
    loose = rows.select("part_path", "path", "id", F.posexplode("loose").alias("k", "r"), F.lit(None).cast("string").alias("caption"))
    before = rows.select(F.col("part_path").alias("__part"), F.col("path").alias("__path"), F.size("loose").alias("__loose"))
    inside = card_rows.filter(shown).select("part_path", "path", "media_before", F.col("body").alias("caption"), F.posexplode(F.arrays_zip(F.col("media").alias("ref"), F.col("tags").alias("tag"))).alias("j", "r"))
    inside = inside.join(before, F.col("part_path").eqNullSafe(F.col("__part")) & (F.col("path") == F.col("__path")))
    inside = inside.select("part_path", "path", _hashed("album", F.col("path")).alias("id"), (F.col("__loose") + F.col("media_before") + F.col("j")).alias("k"), "r", "caption")
    made = rows.select("id", F.col("name").alias("title"), F.lit("owner").alias("owner_id"), F.col("part_path").alias("archive_part_id"), F.col("path").alias("source_path"), F.lit(0).alias("source_index"))
    return made, _each_media(loose.unionByName(inside).withColumn("caption", F.lit(None).cast("string")), "album")


#: Categories of profile facts by label, tried in this order.
FACT_MARKS = [("work", "work|employ"), ("education", "school|education|university"), ("places_lived", "live|place|hometown"), ("relationship", "relationship|married"), ("languages", "language"), ("bio", "bio|about"), ("profile", "username|profile")]
_NAME = "(?i)^(name|full name|profile name)$"


def profile_facts(parsed: DataFrame) -> DataFrame:
    """Rows of two cells on profile pages as facts; the name isn't one."""
    part = F.col("part_path") if "part_path" in parsed.columns else F.lit(None).cast("string")
    pages_ = parsed.filter(F.lower("path").rlike("profile_information|profile_v2|personal_information"))
    named = F.filter("rows", lambda r: (F.size(r) == 2) & (r[1] != "") & ~r[0].rlike(_NAME))
    rows = pages_.select(part.alias("archive_part_id"), "path", F.posexplode(named).alias("place", "row"))
    label = F.col("row")[0]
    low = S.ascii_lower(label)
    kind = F.when(F.lit(False), "")
    for name, pattern in FACT_MARKS:
        kind = kind.when(low.rlike(pattern), name)
    return rows.select(_hashed("fact", F.col("path"), F.col("place").cast("string"), label).alias("id"), F.lit("owner").alias("profile_id"), kind.otherwise("other").alias("category"), label.alias("label"), F.col("row")[1].alias("value"), "archive_part_id", F.col("path").alias("source_path"), F.col("place").cast("int").alias("source_index"))


def profiles(parsed: DataFrame) -> DataFrame:
    """The owner's profile from each profile page that says a name, with the fields that its facts tell."""
    part = F.col("part_path") if "part_path" in parsed.columns else F.lit(None).cast("string")
    pages_ = parsed.filter(F.lower("path").rlike("profile_information|profile_v2|personal_information"))
    value = lambda pattern: F.try_element_at(F.transform(F.filter("rows", lambda r: (F.size(r) == 2) & r[0].rlike(pattern)), lambda r: r[1]), F.lit(1))
    href = F.try_element_at(F.filter("links", lambda x: S.safe_profile_url(x).isNotNull()), F.lit(1))
    name = F.coalesce(F.nullif(value(_NAME), F.lit("")), F.col("h1"))
    who = identity(name, href, F.col("path"))
    return pages_.filter(name.isNotNull()).select(
        _hashed("profile", F.col("path")).alias("id"), F.lit("owner").alias("person_id"), name.alias("display_name"), who["facebook_id"].alias("facebook_id"), who["username"].alias("username"), who["profile_url"].alias("profile_url"),
        value("(?i)bio|about").alias("bio"), S.parse_human_date(value("(?i)registration|joined|created")).alias("joined_at"), value("(?i)relationship|married").alias("relationship"), part.alias("archive_part_id"), F.col("path").alias("source_path"), F.lit(0).alias("source_index"),
    )
