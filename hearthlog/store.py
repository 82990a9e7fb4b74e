"""A stored archive: imports, derived tables and all read queries behind one object.

A change writes what is new to a folder of its own and commits it last, under the next number of a log; readers take
what is committed, so a change that fails leaves what was there. Two writers can't take one number: the one that comes
second looks at what the first did and goes on behind it, or gives up what the first has done already. What an import
brings is added to what was there; readers resolve repeated records, and `compact` writes the resolved tables as one
generation. Derived tables are built in windows of keys, each committed with the place that it reaches; they count only
when all phases are done, and until the records change.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hearthlog.commits import CommitLog
from hearthlog.functions import scalars as S
from hearthlog.operators import backfill, derived, diagnostics, merge, paging, reads, search
from hearthlog.schemas import SCHEMAS
from hearthlog.sources import archives
from hearthlog.streaming import ingest

KEYS = {name: ["album_id", "media_id"] if name == "album_media" else ["id"] for name in SCHEMAS}
#: What is known of imports besides the records: states of parts, files that are done, and so on.
BOOKS = {
    "states": "part_id string, status string, seq long",
    "files": "part_id string, path string, parser_version int, records long",
    "parts": "part_id string, part_path string, filename string, entries long, bytes long, format string, sections array<string>, known array<string>",
    "suffixes": "suffix string, n int, part_id string",
    "sources": "part_id string, part_path string, connected boolean, seq long",
    "warnings": "part_id string, path string, message string",
    "sections": "part_id string, section string, status string, records long, warnings long, seq long",
}
#: One row for each of these; of several the last.
BOOK_KEYS = {"files": ["part_id", "path"], "parts": ["part_id"], "sources": ["part_id"]}
DERIVED = {"ledger": derived.LEDGER, "search_documents": derived.DOCUMENTS, "postings": search.POSTINGS, "corpus": search.CORPUS, "terms": search.TERMS}
#: The builds and the tables that each makes.
JOBS = {"activity": ("ledger",), "search": ("search_documents", "postings", "corpus", "terms")}
PARTITIONS = {"ledger": "calendar_year", "postings": "bucket"}
#: Tables that are written in ranges of a key, with Bloom filters on it, as they are read by few values of it.
CLUSTERED = {"search_documents": "entity_id"}
#: The part and place from which a record came; records arrive in this order.
ARRIVAL = ("__seq", "source_path", "source_index")
#: Generations that are read side by side before they are written as one.
MOST_PARTS = 32
#: What a commit says of its records: before 2 they may lack the part that they came from, and people.
FORMAT = 2


class Interrupted(Exception):
    """A build was asked to stop; it goes on from its last commit."""


@dataclass
class ArchiveStore:
    spark: SparkSession
    root: str
    _views: dict[str, DataFrame] = field(default_factory=dict)
    _pin: int | None = None

    def __post_init__(self):
        self.log = CommitLog(self.spark, f"{self.root}/commits")

    # -- generations

    def commits(self) -> list[dict]:
        """What is committed, up to the generation that this object is pinned to."""
        return [c for c in self.log.all() if self._pin is None or c["generation"] <= self._pin]

    def pinned(self) -> ArchiveStore:
        """This archive as it is now: later commits don't show, so several reads see one state."""
        return ArchiveStore(self.spark, self.root, _pin=max((c["generation"] for c in self.commits()), default=0))

    def _generations(self, name: str) -> list[dict]:
        """The commits that make a table up: the latest whole one and what was added since."""
        found: list[dict] = []
        for c in self.commits():
            if name in c["tables"] and not c.get("job"):
                found = [c] if c["tables"][name] else [*found, c]
        return found

    def _schema(self, name: str) -> StructType:
        return SCHEMAS.get(name) or StructType.fromDDL(DERIVED.get(name) or BOOKS[name])

    def _write(self, tables: dict[str, DataFrame], added: frozenset[str] = frozenset(), finals: tuple[str, ...] = (), job: dict | None = None, same: bool = False, since: int | None = None, careful: bool = False) -> bool:
        """Commits tables together; those in `added` go beside what is there, the others replace it.

        False, and nothing is changed, if since generation `since` another writer has finished one of the parts
        `finals`, or changed a table that this change replaces as it was then (`same`, or `careful`), or moved the job.
        """
        if self._pin is not None:
            raise ValueError("a pinned archive is read only")
        seen = since if since is not None else max((c["generation"] for c in self.log.all()), default=0)
        folder = f"v-{uuid.uuid4().hex}"
        for name, df in tables.items():
            if key := CLUSTERED.get(name):
                df = df.repartitionByRange(key).sortWithinPartitions(key)
            writer = df.write.mode("overwrite")
            if key:
                writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
            (writer.partitionBy(PARTITIONS[name]) if name in PARTITIONS else writer).parquet(f"{self.root}/{folder}/{name}")
        commit = {"folder": folder, "tables": {n: n not in added for n in tables}, "finals": list(finals), "job": job, "same": same, "format": FORMAT}
        while True:
            now = self.log.all()
            for c in now:
                if c["generation"] > seen:
                    replaced = {n for n, whole in commit["tables"].items() if whole and not job}
                    if set(finals) & set(c["finals"]) or replaced & set(c["tables"]) and (same or careful) or job and c["job"] and c["job"]["kind"] == job["kind"]:
                        return False
            if self.log.take(max((c["generation"] for c in now), default=0) + 1, commit):
                self._views.clear()
                return True

    def _changed(self) -> int:
        """The generation of the last change of records."""
        return max((c["generation"] for c in self.commits() if not c["job"] and not c["same"] and set(c["tables"]) & set(SCHEMAS)), default=0)

    def job(self, kind: str) -> dict | None:
        """Where the latest build of this kind stands, if it is of the records as they are."""
        last = next((c["job"] for c in reversed(self.commits()) if c["job"] and c["job"]["kind"] == kind), None)
        return last if last and last["base"] >= self._changed() else None

    def fresh(self, name: str) -> bool:
        """Whether a derived table was built, to its end, after the last change of the records."""
        now = self.job(next(k for k, made in JOBS.items() if name in made))
        return now is not None and now["status"] == "complete"

    def table(self, name: str) -> DataFrame:
        """A table as it is; an empty one where nothing was written, or where a derived one is out of date."""
        if name not in self._views:
            self._views[name] = self._derived(name) if name in DERIVED else self._stored(name)
        return self._views[name]

    def _stored(self, name: str) -> DataFrame:
        generations, schema = self._generations(name), self._schema(name)
        parts = [self.spark.read.schema(schema).parquet(f"{self.root}/{c['folder']}/{name}") for c in generations]
        if not parts:
            return self.spark.createDataFrame([], schema)
        if name in BOOKS:
            rows = parts[0].withColumn("__seq", F.lit(0))
            for i, part in enumerate(parts[1:], 1):
                rows = rows.unionByName(part.withColumn("__seq", F.lit(i)))
            if name == "states":
                return ingest.transition(rows.limit(0).drop("__seq"), rows.select("part_id", "status", F.col("__seq").cast("long").alias("seq")))
            return merge.last_wins(rows, BOOK_KEYS[name], ["__seq"]).drop("__seq") if name in BOOK_KEYS else rows.drop("__seq").distinct()
        return parts[0] if len(parts) == 1 else self._resolved(name, parts)

    def _derived(self, name: str, job: dict | None = None) -> DataFrame:
        """The windows of the build that is complete, or of the given one."""
        kind = next(k for k, made in JOBS.items() if name in made)
        wanted = job or (self.job(kind) if self.fresh(name) else None)
        folders = [f"{self.root}/{c['folder']}/{name}" for c in self.commits() if wanted and c["job"] and c["job"]["id"] == wanted["id"] and name in c["tables"]]
        if not folders:
            return self.spark.createDataFrame([], self._schema(name))
        parts = [self.spark.read.schema(self._schema(name)).parquet(f).select(*self._schema(name).names) for f in folders]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _resolved(self, name: str, parts: list[DataFrame]) -> DataFrame:
        """Repeated records of several parts as one: people and conversations merge, profiles fill what earlier ones lack, of all others the first record counts."""
        rows = parts[0] if "__seq" in parts[0].columns else parts[0].withColumn("__seq", F.lit(0))
        for i, part in enumerate(parts[1:], 1):
            rows = rows.unionByName(part.withColumn("__seq", F.lit(i)))
        columns = SCHEMAS[name].names
        if name == "people":
            return merge.merge_people(rows, [c for c in columns if c not in merge.PERSON_RULES], "__seq").select(*columns)
        if name == "conversations":
            return merge.merge_conversations(rows, "__seq").select(*columns)
        order = [c for c in ARRIVAL if c in rows.columns]
        if name == "profiles":
            return merge.fill_first(rows, KEYS[name], order, ["archive_part_id", "source_path", "source_index"]).drop("__seq")
        return merge.first_wins(rows, KEYS[name], order).drop("__seq")

    def compact(self) -> None:
        """Writes the records of all generations as one. If another import comes in between, it tries again."""
        while True:
            seen = max((c["generation"] for c in self.log.all()), default=0)
            self._views.clear()
            several = [n for n in (*SCHEMAS, *BOOKS) if len(self._generations(n)) > 1]
            if not several or self._write({n: self.table(n) for n in several}, same=True, since=seen):
                return

    def backfill(self) -> list[str]:
        """Brings records of commits before FORMAT up to it, in one commit; the tables that were written.

        Records without a part get the first that was ever imported. Where nobody is known, people are made of the
        profile and of the names in conversations, and messages get them as senders. A second call finds nothing to
        do. If another import comes in between, it tries again.
        """
        while True:
            seen = max((c["generation"] for c in self.log.all()), default=0)
            self._views.clear()
            old = [n for n in SCHEMAS if any(c.get("format", 1) < FORMAT for c in self._generations(n))]
            if not old:
                return []
            part = next((c["finals"][0] for c in self.commits() if c["finals"]), "part:legacy")
            new = {n: self.table(n) for n in old}
            if self.people.isEmpty():
                new["people"] = backfill.legacy_people(self.profiles, self.conversations)
                new["conversations"] = backfill.legacy_participants(self.conversations)
                new["messages"] = backfill.legacy_senders(self.messages)
            tables = {n: backfill.with_part(df, part) if "archive_part_id" in df.columns and n != "people" else df for n, df in new.items()}
            if self._write(tables, since=seen, careful=True):
                return sorted(tables)

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMAS:
            return self.table(name)
        raise AttributeError(name)

    # -- imports

    def replace(self, bundle: dict[str, DataFrame]) -> None:
        """The whole archive anew."""
        self._write({n: self._shaped(n, bundle.get(n)) for n in SCHEMAS} | {n: self.spark.createDataFrame([], BOOKS[n]) for n in BOOKS})

    def _shaped(self, name: str, df: DataFrame | None, order: list[str] | None = None) -> DataFrame:
        """`df` in a table's columns, one row for each key by the rules that hold between parts; parts arrive in `order`."""
        empty = self.spark.createDataFrame([], SCHEMAS[name])
        if df is None:
            return empty
        rows = empty.unionByName(df.select(*[c for c in df.columns if c in SCHEMAS[name].names]), allowMissingColumns=True)
        if order and "archive_part_id" in rows.columns:
            rows = rows.withColumn("__seq", F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("archive_part_id")).cast("int"), F.lit(0)))
        return self._resolved(name, [rows])

    def is_final(self, part_id: str) -> bool:
        final = False
        for c in self.commits():
            final = final and not c["tables"].get("states") or c["same"] and final or part_id in c["finals"]
        return final

    def import_part(self, part_id: str, bundle: dict[str, DataFrame]) -> bool:
        """Adds a part's records. Posts and the like that are there stay as they are, people and conversations merge.

        A part that is complete or skipped isn't taken again, nor one that another writer completes meanwhile.
        """
        return self.import_batch(bundle, [part_id], (part_id,))

    def import_batch(self, bundle: dict[str, DataFrame], parts: list[str], finals: tuple[str, ...] = (), books: dict[str, DataFrame] | None = None) -> bool:
        """Adds records of some parts, in the order of `parts`, and what the books say of them, in one commit.

        `finals` are the parts that are complete with it. False if one of them was final before.
        """
        seen = max((c["generation"] for c in self.log.all()), default=0)
        if any(self.is_final(p) for p in finals):
            return False
        tables = {}
        for name, df in bundle.items():
            new = self._shaped(name, df, parts)
            if "archive_part_id" in new.columns and len(parts) == 1:
                new = new.withColumn("archive_part_id", F.coalesce("archive_part_id", F.lit(parts[0])))
            tables[name] = new
        states = [(p, "complete" if p in finals else "importing", None) for p in parts]
        tables |= (books or {}) | {"states": self.spark.createDataFrame(states, BOOKS["states"])}
        if not self._write(tables, added=frozenset(tables), finals=finals, since=seen):
            return False
        if max(len(self._generations(n)) for n in (*SCHEMAS, *BOOKS)) > MOST_PARTS:
            self.compact()
        return True

    def mark_part(self, part_id: str, status: str) -> None:
        """Skips, fails, cancels, interrupts or retries (pending) a part."""
        if status not in ingest.STATES:
            raise ValueError(status)
        rows = self.spark.createDataFrame([(part_id, status, None)], BOOKS["states"])
        self._write({"states": rows}, added=frozenset(["states"]), finals=(part_id,) if status in ingest.FINAL else ())

    def note(self, warnings: DataFrame) -> None:
        """Adds warnings (part_id, path, message)."""
        self._write({"warnings": warnings}, added=frozenset(["warnings"]))

    def session(self) -> Row:
        return ingest.session_state(self.table("states"), self.table("posts").count() + self.table("messages").count()).first()

    # -- sources of media

    def connect(self, parts: dict[str, str | None]) -> None:
        """Where parts are now: id and path, or None for a part that isn't there any more."""
        rows = self.spark.createDataFrame([(p, at, at is not None, None) for p, at in parts.items()], BOOKS["sources"])
        self._write({"sources": rows}, added=frozenset(["sources"]), same=False)

    def reconnect(self, found: DataFrame) -> Row:
        """Connects the known parts among `found` (part_path, fingerprint); one row of matched, missing, duplicates and unexpected."""
        known = self.table("parts").select(F.col("part_id").alias("expected_id"), F.regexp_replace("part_id", "^part:", "").alias("fingerprint"))
        told = merge.match_parts(known, found.select(F.col("part_path").alias("found_id"), "fingerprint")).cache()
        self.connect({r["expected_id"]: r["found_id"] for r in told.filter("outcome = 'matched'").collect()})
        n = lambda x: F.count_if(F.col("outcome") == x)
        still = self.table("parts").join(self.table("sources").filter("connected"), "part_id", "left_anti").count()
        return told.agg(n("matched").alias("matched"), n("duplicate").alias("duplicates"), n("unexpected").alias("unexpected")).withColumn("missing", F.lit(still)).first()

    def media_sources(self) -> DataFrame:
        """Media with owner_part, the one part that has the file by the stored index of path endings, and whether it is connected."""
        owned = archives.owners_by_suffix(self.media.select("path"), self.table("suffixes"))
        there = self.table("sources").select(F.col("part_id").alias("owner_part"), F.col("part_path").alias("owner_path"), "connected")
        rows = self.media.join(owned.withColumnRenamed("part_id", "owner_part"), "path", "left").join(there, "owner_part", "left")
        return rows.withColumn("connected", F.coalesce("connected", F.lit(False)))

    def identity(self) -> Row | None:
        """filename, bytes, entries, fingerprint and known entries of the first part; None before an import."""
        first = self.table("parts").select("filename", "bytes", "entries", F.regexp_replace("part_id", "^part:", "").alias("fingerprint"), F.col("known").alias("known_entries"), "part_path")
        return first.orderBy("part_path", "fingerprint").drop("part_path").first()

    def archive_set(self) -> Row | None:
        """One row of all parts together: their number, size, identity whatever their order, format and status."""
        parts = self.table("parts").select(F.regexp_replace("part_id", "^part:", "").alias("fingerprint"), "bytes", "format", "part_id")
        rows = parts.join(self.table("states").select("part_id", "status"), "part_id", "left")
        kind = F.when(F.count_distinct("format") > 1, "mixed").otherwise(F.max("format"))
        status = F.when(F.bool_or(F.col("status") == "failed"), "failed").when(F.bool_and(F.coalesce("status", F.lit("pending")).isin("complete", "skipped")), "complete").otherwise("incomplete")
        whole = rows.agg(F.sum("bytes").alias("bytes"), kind.alias("format"), status.alias("status"))
        found = archives.set_fingerprint(parts).crossJoin(whole).first()  # one row each
        return found if found["parts"] else None

    def coverage_sets(self) -> Row:
        """One row of lists: the sections that parts have, those imported, partial, unsupported and malformed, and the parts that were skipped."""
        return diagnostics.coverage_sets(self.table("parts"), merge.fold_sections(self.table("sections")), self.table("states")).first()

    def term_statistics(self) -> DataFrame:
        """term, docs, n of the search as it was built; empty while it is out of date."""
        return self.table("terms")

    def coverage(self) -> DataFrame:
        return diagnostics.coverage(merge.fold_sections(self.table("sections")))

    def archive_status(self) -> DataFrame:
        """part_id, filename, status, connected, entries, bytes and format of every part that was seen."""
        states, sources = self.table("states").select("part_id", "status"), self.table("sources").select("part_id", "connected")
        rows = self.table("parts").join(states, "part_id", "full_outer").join(sources, "part_id", "left")
        return rows.select("part_id", "filename", F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("connected", F.lit(False)).alias("connected"), "entries", "bytes", "format", "sections")

    # -- derived tables

    def build(self, kind: str, window_rows: int = 20_000_000, force: bool = False, stop: Callable[[], bool] = lambda: False) -> dict:
        """Builds the tables of a kind, phase by phase in windows of keys, from where an earlier build stands.

        Each window's rows are committed together with its phase and the last key that it covers. `stop` is asked
        before each window; then the build is left as interrupted, and the next one goes on from the last commit.
        `force`, or records that changed, start anew.
        """
        phases = derived.phases(self, kind)
        last = self.job(kind)
        job = None if force else last
        if job is None:
            job = {"id": uuid.uuid4().hex, "kind": kind, "phase": next(iter(phases)), "cursor": None, "phase_done": False, "base": self._changed(), "status": "running"}
        if job["status"] == "complete":
            return job
        names = list(phases)
        todo = names[names.index(job["phase"]) + bool(job["phase_done"]) :]
        while todo:
            # Phases that read what this build has made wait until that is committed.
            now = [n for n in todo if phases[n].level == phases[todo[0]].level]
            sources = [(n, phases[n], phases[n].source(lambda table, j=job: self._derived(table, j))) for n in now]
            for step in derived.steps(sources, job["cursor"], window_rows):
                if stop():
                    self._commit_job(last, job | {"status": "interrupted"}, {})
                    raise Interrupted(f"{kind}: behind {job['phase']}, {job['cursor']}")
                rows: dict[str, DataFrame] = {}
                for name, df, _, _ in step:
                    for table, made in phases[name].rows(df).items():
                        rows[table] = rows[table].unionByName(made) if table in rows else made
                name, _, reached, ended = step[-1]
                done = job | {"phase": name, "cursor": reached, "phase_done": ended, "status": "complete" if ended and name == names[-1] else "running"}
                job = last = self._commit_job(last, done, rows)
            todo = todo[len(now) :]
        return job

    def _commit_job(self, last: dict | None, job: dict, rows: dict[str, DataFrame]) -> dict:
        """Commits a step behind `last`, which is where this build saw the job."""
        seen = max((c["generation"] for c in self.log.all()), default=0)
        if self.job(job["kind"]) != last or not self._write(rows, added=frozenset(rows), job=job, since=seen):
            raise Interrupted(f"{job['kind']}: another build has moved it")
        return job

    def rebuild_activity(self) -> int:
        self.build("activity", force=True)
        return self.table("ledger").count()

    def rebuild_search(self) -> int:
        """Search documents, their postings by term, and the numbers that ranks need."""
        self.build("search", force=True)
        return self.table("search_documents").count()

    def run_derived(self, **options) -> dict[str, int]:
        """Builds what is out of date, and nothing else; rows of each. A build that was broken off goes on where it stood."""
        built = {}
        for kind, name in (("activity", "ledger"), ("search", "search_documents")):
            if not self.fresh(name):
                self.build(kind, **options)
                built[name] = self.table(name).count()
        return built

    def derived_status(self) -> dict[str, str]:
        """pending, running, interrupted or complete, for the ledger and the search."""
        return {kind: (self.job(kind) or {"status": "pending"})["status"] for kind in JOBS}

    # -- read queries

    def stats(self) -> dict[str, str]:
        return {r["name"]: r["value"] for r in reads.stats(self, self.table("ledger")).collect()}

    def profile(self) -> Row | None:
        return reads.profile(self).first()

    def posts_page(self, limit: int | None = None, cursor: str | None = None, newest: bool = True, year: str | None = None, person: str | None = None) -> paging.Page:
        n, c = paging.clamp(limit), paging.decode_cursor(cursor, "key", "id")
        cut = lambda p: paging.window_of(p, F.col("created_at"), "id", n + 1, newest, (c["key"], c["id"]) if c else None)
        order = (F.desc, F.asc)[not newest]
        rows = reads.full_posts(reads.feed(self, year, person, page=cut), self).orderBy(order("sort_key"), order("id")).collect()
        return self._page(rows, n)

    def post(self, post_id: str) -> Row | None:
        return reads.full_posts(reads.feed(self, post=post_id), self).first()

    def people_page(self, limit: int | None = None, cursor: str | None = None, text: str | None = None) -> paging.Page:
        n, c = paging.clamp(limit), paging.decode_cursor(cursor, "name", "id")

        def cut(people: DataFrame) -> DataFrame:
            people = people.filter(S.contains_ci(F.col("display_name"), text)) if text and text.strip() else people
            return paging.window_of(people, F.col("sort_name"), "id", n + 1, descending=False, after=(c["name"], c["id"]) if c else None)

        rows = reads.people_rollup(self, page=cut).orderBy("sort_name", "id").collect()
        more, items = len(rows) > n, rows[:n]
        return paging.Page(items, paging.encode_cursor(name=items[-1]["sort_name"], id=items[-1]["id"]) if more else None, more)

    def person(self, person_id: str) -> Row | None:
        return reads.people_rollup(self, page=lambda p: p.filter(F.col("id") == person_id)).first()

    def conversations_page(self, limit: int | None = None, cursor: str | None = None, text: str | None = None) -> paging.Page:
        return paging.page(reads.inbox(self, text), F.col("latest_sent_at"), limit=limit, cursor=cursor)

    def messages_page(self, conversation: str, limit: int | None = 40, cursor: str | None = None) -> paging.Page:
        return paging.page(reads.thread(self, conversation), F.col("sent_at"), limit=limit, cursor=cursor, then=lambda p: reads.with_children(p, self.media.filter("owner_type = 'message'"), "owner_id", ["id"], reads.MEDIA_FIELDS, "media"))

    def media_page(self, kind: str | None = None, limit: int | None = None, cursor: str | None = None) -> paging.Page:
        rows = self.media.filter(F.col("media_type") == kind) if kind else self.media
        return paging.page(rows, F.col("timestamp"), limit=limit, cursor=cursor)

    def connections_page(self, kind: str | None = None, text: str | None = None, limit: int | None = None, cursor: str | None = None) -> paging.Page:
        return paging.page(reads.connections(self, kind, text), F.col("sort_name"), limit=limit, cursor=cursor, descending=False, name="name")

    def albums_page(self, limit: int | None = None, cursor: str | None = None) -> paging.Page:
        return paging.page(reads.albums(self), F.col("sort_at"), limit=limit, cursor=cursor)

    def album(self, album_id: str) -> DataFrame:
        return reads.album_detail(self, album_id).orderBy("position")

    def activity_page(self, kind: str | None = None, year: int | None = None, text: str | None = None, limit: int | None = None, cursor: str | None = None) -> paging.Page:
        rows = reads.activity(self.table("ledger"), self.people, kind, year, text)
        return paging.page(rows, F.col("occurred_at"), limit=limit, cursor=cursor)

    def memories(self, month: int, day: int, as_of_year: int, limit: int = 60) -> DataFrame:
        return reads.memories(self.table("ledger"), month, day, as_of_year, limit).orderBy(F.desc("calendar_year"), F.desc("occurred_at"), F.desc("id"))

    def search_page(self, text: str, kind: str | None = None, year: str | None = None, start: str | None = None, end: str | None = None, backend: str = "ranked", limit: int | None = None, cursor: str | None = None) -> search.SearchPage:
        """A page of ranked hits, or of substring hits with backend `like`; blank texts have none.

        Dates without a time cover the day. While the search is out of date, `preparing` is true and there are no hits.
        """
        ready = self.fresh("postings" if backend == "ranked" else "search_documents")
        if not text.strip() or not ready:
            return search.SearchPage([], None, False, {}, backend, not ready and bool(text.strip()))
        tests = [
            F.col("entity_type") == kind if kind else None, F.substring("created_at", 1, 4) == year if year else None,
            F.col("created_at") >= (f"{start}T00:00:00.000Z" if len(start) == 10 else start) if start else None,
            F.col("created_at") <= (f"{end}T23:59:59.999Z" if len(end) == 10 else end) if end else None,
        ]
        where = F.lit(True)
        for t in tests:
            where = where & F.coalesce(t, F.lit(False)) if t is not None else where
        docs = self.table("search_documents")
        if backend == "like":
            return search.like_page(docs, text, where, paging.clamp(limit), cursor)
        return search.ranked_page(docs, self.table("postings"), self.table("corpus"), text, where, paging.clamp(limit), cursor)

    def search(self, text: str, **options) -> list[Row]:
        """The hits of search_page."""
        return self.search_page(text, **options).items

    # -- what pages show together, from one state of the archive

    def home_page(self, month: int, day: int, as_of_year: int) -> dict[str, object]:
        """The newest posts, the numbers of people and media, the years that the archive spans, and three memories of a day."""
        now = self.pinned()
        numbers = now.stats()
        span = [numbers[k][:4] for k in ("activity_first", "activity_last") if numbers.get(k)]
        return {"posts": now.posts_page(), "people": int(numbers["people"]), "media": int(numbers["media"]), "years": tuple(span) if len(span) == 2 else None, "memories": now.memories(month, day, as_of_year, 3).collect()}

    def profile_page(self) -> dict[str, object]:
        """The profile with its person, and the first friends, albums, photos and own posts."""
        now = self.pinned()
        profile = now.profile()
        person = now.person(profile["person_id"]) if profile else None
        posts = now.posts_page(5, person=profile["person_id"]).items if profile else []
        return {"profile": profile, "person": person, "friends": now.connections_page("friend", limit=6).items, "albums": now.albums_page(4).items, "photos": now.media_page("photo", 6).items, "posts": posts}

    def person_page(self, person_id: str) -> dict[str, object]:
        """A person with numbers, the newest posts, and where a link to the person leads."""
        now = self.pinned()
        link = S.profile_target(F.col("profile_url"), F.col("facebook_id"), F.col("username"), F.col("display_name"))
        target = now.people.filter(F.col("id") == person_id).select(link.alias("url")).first()
        return {"person": now.person(person_id), "posts": now.posts_page(5, person=person_id).items, "link": target and target["url"]}

    def thread_page(self, conversation: str, limit: int = 40, cursor: str | None = None) -> dict[str, object]:
        """A thread's newest messages in the order in which they were sent, and its title."""
        now = self.pinned()
        page = now.messages_page(conversation, limit, cursor)
        chat = now.conversations.filter(F.col("id") == conversation).select("title").first()
        return {"title": chat and chat["title"], "messages": page.items[::-1], "next_cursor": page.next_cursor, "has_more": page.has_more}

    def search_groups(self, text: str, **options) -> list[tuple[str, list[Row]]]:
        """The hits of a page by type, in the order of search.TYPE_ORDER; every type is listed."""
        hits = self.pinned().search(text, **options)
        return [(t, [h for h in hits if h["entity_type"] == t]) for t in search.TYPE_ORDER if any(h["entity_type"] == t for h in hits)]

    def report(self, filenames: DataFrame, warnings: DataFrame) -> str:
        return diagnostics.report(filenames, warnings).first()["report"]

    @staticmethod
    def _page(rows: list[Row], n: int) -> paging.Page:
        items, more = rows[:n], len(rows) > n
        return paging.Page(items, paging.encode_cursor(key=items[-1]["sort_key"], id=items[-1]["id"]) if more else None, more)
