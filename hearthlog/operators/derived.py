"""The two derived tables: the activity ledger and the search documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlog.functions.scalars import or_null, summary, valid_iso
from hearthlog.operators import search

_NULL = lambda: F.lit(None).cast("string")
LEDGER = "id string, activity_type string, actor_person_id string, target_type string, target_id string, occurred_at string, summary string, source_path string, source_index int, archive_part_id string, calendar_year int, calendar_month int, calendar_day int"
DOCUMENTS = "entity_type string, entity_id string, title string, body string, context string, created_at string, conversation_id string, source_path string"

#: Tables in the order in which the ledger and the documents are made from them.
LEDGER_SOURCES = ("profiles", "posts", "comments", "reactions", "messages", "connections", "albums", "media", "profile_facts")
DOCUMENT_SOURCES = ("people", "profile_facts", "posts", "comments", "reactions", "connections", "albums", "media", "conversations", "messages")


def owner(a) -> DataFrame:
    """owner_person, owner_profile, owner_name: one row, of nulls where no profile is known."""
    first = a.profiles.agg(F.min(F.struct("id", "person_id", "display_name")).alias("p"))
    return first.select(F.col("p.person_id").alias("owner_person"), F.col("p.id").alias("owner_profile"), F.col("p.display_name").alias("owner_name"))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("“"), c, F.lit("”"))


def _if_any(c: Column, *text) -> Column:
    """The texts together if c isn't empty, else nothing."""
    return F.when(F.coalesce(c, F.lit("")) != "", F.concat(*text)).otherwise("")


def ledger(a) -> DataFrame:
    """Every dated record of the archive `a` as one row; records without a real date stay out.

    Where no profile is known, the owner's own records have no actor.
    """
    return reduce(DataFrame.unionByName, ledger_branches(a).values())


def ledger_branches(a) -> dict[str, DataFrame]:
    """The ledger by the table that its rows come from."""
    own = F.broadcast(owner(a))  # one row
    lit, col = F.lit, F.col

    def branch(df: DataFrame, kind: str, actor: Column, target_type: Column, target_id: Column, at: Column, text: Column, name: str | None = None) -> DataFrame:
        return df.select(
            F.concat(lit(f"activity:{name or kind}:"), col("id")).alias("id"), lit(kind).alias("activity_type"), actor.alias("actor_person_id"),
            target_type.alias("target_type"), target_id.alias("target_id"), at.alias("occurred_at"), text.alias("summary"),
            or_null(df, "source_path").alias("source_path"), or_null(df, "source_index", "int").alias("source_index"), or_null(df, "archive_part_id").alias("archive_part_id"),
        )

    body, words = _quoted(summary(col("body"))), lambda c: F.coalesce(col(c), lit(""))
    author, reactor, sender = or_null(a.comments, "author_name"), or_null(a.reactions, "person_name"), col("sender_name")
    branches = [
        branch(a.profiles, "profile", col("person_id"), lit("profile"), col("id"), col("joined_at"), F.concat(lit("Profile: "), col("display_name"))),
        branch(
            a.posts.crossJoin(own), "post", F.when(col("author_id") == "owner", col("owner_person")).otherwise(col("author_id")), lit("post"), col("id"), col("created_at"),
            F.when(words("title") != "", F.concat(lit("Posted "), _quoted(col("title")))).when(words("body") != "", F.concat(lit("Posted "), body)).otherwise("Posted"),
        ),
        branch(a.comments, "comment", col("author_id"), lit("post"), col("post_id"), col("created_at"), F.concat(lit("Commented"), _if_any(author, lit(" as "), author), lit(": "), body)),
        branch(a.reactions, "reaction", col("person_id"), col("target_type"), col("target_id"), col("created_at"), F.concat(lit("Reacted "), col("kind"), _if_any(reactor, lit(" as "), reactor))),
        branch(a.messages, "message", col("sender_id"), lit("conversation"), col("conversation_id"), col("sent_at"), F.concat(lit("Message"), _if_any(sender, lit(" from "), sender), _if_any(col("body"), lit(": "), body))),
        branch(a.connections, "connection", col("person_id"), lit("person"), col("person_id"), F.coalesce("started_at", "ended_at"), F.concat(F.replace(col("relationship_type"), lit("_"), lit(" ")), lit(": "), col("display_name"))),
        branch(a.albums, "album", col("owner_id"), lit("album"), col("id"), F.coalesce("created_at", "updated_at"), F.concat(lit("Album: "), col("title"))),
        branch(a.media, "media", _NULL(), col("owner_type"), col("owner_id"), col("timestamp"), F.concat(lit("Media: "), F.coalesce(or_null(a.media, "filename"), col("path")))),
        branch(a.profile_facts.crossJoin(own), "profile", col("owner_person"), lit("profile"), col("owner_profile"), F.coalesce("start_date", "end_date"), F.concat(col("category"), _if_any(col("label"), lit(" · "), col("label")), lit(": "), col("value")), "profile-fact"),
    ]
    part = lambda a, n: F.substring("occurred_at", a, n).cast("int")
    dated = lambda rows: rows.filter(valid_iso(col("occurred_at"))).select("*", part(1, 4).alias("calendar_year"), part(6, 2).alias("calendar_month"), part(9, 2).alias("calendar_day"))
    return {name: dated(rows) for name, rows in zip(LEDGER_SOURCES, branches, strict=True)}


def search_documents(a) -> DataFrame:
    """Every searchable record as (entity_type, entity_id, title, body, context, created_at, conversation_id, source_path)."""
    return reduce(DataFrame.unionByName, document_branches(a).values())


def document_branches(a) -> dict[str, DataFrame]:
    """The search documents by the table that they come from."""
    lit, col = F.lit, F.col
    join = lambda *cs: F.trim(F.concat_ws(" ", *cs))

    def doc(df: DataFrame, kind: str, title: Column, body: Column, context: Column, at: Column, conversation: Column | None = None, key: Column | None = None) -> DataFrame:
        path = F.coalesce(or_null(df, "source_path"), or_null(df, "identity_source"))
        return df.select(
            lit(kind).alias("entity_type"), (col("id") if key is None else key).alias("entity_id"), title.alias("title"), body.alias("body"), context.alias("context"),
            at.alias("created_at"), (_NULL() if conversation is None else conversation).alias("conversation_id"), path.alias("source_path"),
        )

    chats = a.conversations.select(col("id").alias("conversation_id"), col("title").alias("chat_title"))
    texts = a.messages.join(chats, "conversation_id", "left")
    links = F.array_join("links", " ") if "links" in a.posts.columns else _NULL()
    branches = [
        doc(a.people, "person", col("display_name"), join(or_null(a.people, "username"), "relationship"), col("facebook_id"), _NULL()),
        doc(a.profile_facts, "profile-fact", col("category"), join("label", "value"), join("start_date", "end_date"), F.coalesce("start_date", "end_date"), key=F.concat(lit("fact:"), col("id"))),
        doc(a.posts, "post", col("title"), col("body"), join("created_at", links), col("created_at")),
        doc(a.comments, "comment", or_null(a.comments, "author_name"), col("body"), col("post_id"), col("created_at")),
        doc(a.reactions, "reaction", col("kind"), or_null(a.reactions, "person_name"), col("target_id"), col("created_at")),
        doc(a.connections, "connection", col("display_name"), join("relationship_type", "username"), F.coalesce("started_at", "ended_at"), F.coalesce("started_at", "ended_at")),
        doc(a.albums, "album", col("title"), col("description"), col("created_at"), F.coalesce("updated_at", "created_at")),
        doc(a.media, "media", F.coalesce(or_null(a.media, "filename"), col("path")), col("caption"), col("path"), col("timestamp")),
        doc(a.conversations, "conversation", F.coalesce("title", lit("Conversation")), F.array_join("participant_names", " "), F.array_join("participant_names", " "), _NULL()),
        doc(texts, "message", F.coalesce("chat_title", lit("Conversation")), col("body"), join("sender_name", "sent_at"), col("sent_at"), col("conversation_id")),
    ]
    return dict(zip(DOCUMENT_SOURCES, branches, strict=True))


class _Windowed:
    """An archive of which one table is only a window."""

    def __init__(self, archive, name: str, rows: DataFrame):
        self._archive, self._name, self._rows = archive, name, rows

    def __getattr__(self, name: str) -> DataFrame:
        return self._rows if name == self._name else getattr(self._archive, name)


@dataclass
class Phase:
    """A part of a build: the table that it goes through by key, and the rows that a window of it gives, by table.

    `source` gets a reader of what earlier phases of the same build have made; `level` says how many phases it stands
    behind: one that reads what others made waits until those are committed.
    """

    key: str
    source: Callable[[Callable[[str], DataFrame]], DataFrame]
    rows: Callable[[DataFrame], dict[str, DataFrame]]
    level: int = 0


def phases(a, kind: str) -> dict[str, Phase]:
    """The phases of a build in their order: the ledger table by table, or the documents, their postings and the corpus."""

    def of(table: str, target: str, branches) -> Phase:
        return Phase("id", lambda made: getattr(a, table), lambda rows: {target: branches(_Windowed(a, table, rows))[table]})

    if kind == "activity":
        return {t: of(t, "ledger", ledger_branches) for t in LEDGER_SOURCES}
    out = {t: of(t, "search_documents", document_branches) for t in DOCUMENT_SOURCES}
    out["postings"] = Phase("entity_id", lambda made: made("search_documents"), lambda rows: {"postings": search.stored_postings(rows)}, 1)
    out["corpus"] = Phase("documents", lambda made: search.corpus(made("search_documents")), lambda rows: {"corpus": rows}, 1)
    out["terms"] = Phase("term", lambda made: search.stored_terms(made("postings")), lambda rows: {"terms": rows}, 2)
    return out


def within(rows: DataFrame, key: str, low, high) -> DataFrame:
    """The rows behind `low` up to `high`; None is no bound, and rows without a key come first."""
    rows = rows if low is None else rows.filter(F.col(key) > F.lit(low))
    return rows if high is None else rows.filter(F.col(key).isNull() | (F.col(key) <= F.lit(high)))


def steps(todo: list[tuple[str, Phase, DataFrame]], key_cursor, window_rows: int, per_window: int = 40) -> Iterator[list[tuple[str, DataFrame, object, bool]]]:
    """Commits to make of phases (name, phase, source), each a list of (phase name, rows, key that they reach, whether that ends the phase).

    Neighbouring phases that fit one window go together; a large one is cut into windows of about so many rows. The
    first phase goes on behind `key_cursor`. Bounds come from a sample of at most some `per_window` keys a window, so
    only a few keys reach the driver. They needn't be the same in a build that goes on: what a cursor leaves is dealt
    out anew.
    """
    left = [(name, p, within(df, p.key, key_cursor if k == 0 else None, None)) for k, (name, p, df) in enumerate(todo)]
    counts = {r["k"]: r["n"] for r in reduce(DataFrame.union, [df.agg(F.lit(k).alias("k"), F.count("*").alias("n")) for k, (_, _, df) in enumerate(left)]).collect()}
    group, held = [], 0
    for k, (name, phase, df) in enumerate(left):
        n = counts[k]
        if group and held + n > window_rows:
            yield group
            group, held = [], 0
        if n <= window_rows:
            group.append((name, df, None, True))
            held += n
            continue
        windows = -(-n // window_rows)
        few = sorted(r[0] for r in df.filter(F.col(phase.key).isNotNull()).select(phase.key).sample(fraction=min(1.0, windows * per_window / n), seed=7).collect())
        bounds = sorted({few[i * len(few) // windows] for i in range(1, windows)} if few else ())
        for low, high in zip([None, *bounds], [*bounds, None]):
            yield [(name, within(df, phase.key, low, high), high, high is None)]
    if group:
        yield group
