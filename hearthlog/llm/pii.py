"""Personal data: base patterns, and terms that give protected entities away by their co-occurrence in the corpus."""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.llm.common import bitmap, cut, lean, maybe_in

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A run of digits either starts a match or has none, so the look-behind and the possessive runs lose nothing.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


@dataclass(frozen=True)
class Disclosure:
    """When a term counts as giving an entity away. Documents are counted by distinct texts, so copies change nothing.

    For one entity: window is the number of characters on either side in which its terms are looked for;
    least_contexts how many different contexts of the entity must hold the term (copies of a context count once);
    least_given the least share of the documents with the term that hold it beside the entity; least_bits the least
    pointwise mutual information of term and entity.

    For a kind of entity: the mutual information of term and kind, by documents, must be least_share of the kind's
    own information or more, and least_documents must hold both. Both must be so in each of two halves of the
    documents, so no term is chosen on the documents alone that it was found in.
    """

    window: int = 60
    least_contexts: int = 3
    least_given: float = 0.5
    least_bits: float = 3.0
    least_share: float = 0.5
    least_documents: int = 5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str):
    at, free = text.find("@"), 0
    while at >= 0:
        end = _DOMAIN.match(text, at + 1)
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if end and start < at:
            yield start, end.end()
            free = end.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of each base match by start, then kind; kinds are places in KINDS."""
    if not text:
        return []
    found = [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def entity(text: str, span: tuple[int, int, int]) -> str:
    """A matched text without the writing it varies in: lower case, and digits alone for cards and phones."""
    start, kind, end = span
    found = text[start:end].lower()
    return f"{KINDS[kind]}:{re.sub(r'[^0-9]', '', found) if kind in (2, 3) else found}"


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


class Taken:
    """Tells in logarithmic time whether a stretch meets one of the spans."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts, self.stops = [], []
        for a, _, b in spans:
            if self.stops and a <= self.stops[-1]:
                self.stops[-1] = max(self.stops[-1], b)
            else:
                self.starts.append(a)
                self.stops.append(b)

    def __call__(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k > 0 and self.stops[k - 1] > a


def free_terms(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """start, end and lower-cased term for each whole word outside the spans."""
    taken = Taken(spans)
    return [(m.start(), m.end(), m[0].lower()) for m in _TERM.finditer(text) if not taken(m.start(), m.end())]


def term_spans(text: str, terms: set[str], taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Whole-word occurrences of terms outside the spans already taken."""
    return [(a, 4, b) for a, b, term in free_terms(text, taken) if term in terms]


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def text_counts(rows: DataFrame) -> DataFrame:
    """doc, copies: a hash of each distinct text, and how many rows have it."""
    return cut(rows.groupBy(F.xxhash64("text").alias("doc")).agg(F.count("*").alias("copies")))


def over_distinct(rows: DataFrame, repeated: np.ndarray, run: Callable, schema: str) -> DataFrame:
    """run(batches of one column text) over each distinct text of `rows` once.

    Texts met once are worked on where they are, and only repeated ones are shuffled. `repeated` is the bitmap of
    their hashes; what it lets through besides is shuffled in vain.
    """

    def part(again: bool):
        def some(batches):
            seen: set[int] = set()
            for batch in batches:
                docs = batch.column(0).to_numpy()
                keep = maybe_in(docs, repeated)
                if again and keep.any():
                    for i in np.flatnonzero(keep):
                        keep[i] = int(docs[i]) not in seen
                        seen.add(int(docs[i]))
                    if len(seen) > 200_000:
                        seen.clear()
                yield batch.filter(pa.array(keep if again else ~keep)).select(["doc", "text"] if again else ["text"])

        return some

    def first(batches):
        seen: set[int] = set()
        for batch in batches:
            new = []
            for doc in batch.column(0).to_pylist():
                new.append(doc not in seen)
                seen.add(doc)
            yield batch.filter(pa.array(new, pa.bool_())).select(["text"])

    keyed = rows.select(F.xxhash64("text").alias("doc"), "text")
    once = part(False)
    again = keyed.mapInArrow(lean(part(True)), "doc long, text string").repartition("doc")
    return keyed.mapInArrow(lean(lambda b: run(once(b))), schema).unionByName(again.mapInArrow(lean(lambda b: run(first(b))), schema))


def half_of(text: str) -> int:
    return zlib.crc32(text.encode()) & 1


def _terms(text: str, spans: list) -> set[str]:
    """The words of a text outside its entities."""
    return {w[2] for w in free_terms(text, spans)} if spans else {t.lower() for t in set(_TERM.findall(text))}


def _met_in(window: int, most: int = 200_000):
    """Rows entity, term, context, docs: in how many texts a term is met beside an entity in a context, or with a kind in a half."""

    def flush(out: Counter):
        columns = (*zip(*out), tuple(out.values()))
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["entity", "term", "context", "docs"])

    def run(batches):
        out: Counter[tuple[str, str, int]] = Counter()
        for batch in batches:
            for row in batch.column("text"):
                text = row.as_py()
                spans, met = base_spans(text), set()
                words = free_terms(text, spans) if spans else []
                starts, low = [w[0] for w in words], 0
                for a, k, b in spans:
                    near = text[max(0, a - window) : a] + "\0" + text[b : b + window]
                    mark = int.from_bytes(hashlib.blake2b(near.encode(), digest_size=8).digest(), "big", signed=True)
                    name = entity(text, (a, k, b))
                    while low < len(words) and words[low][0] < a - window:
                        low += 1
                    terms = {w[2] for w in words[low : bisect_left(starts, b + window)] if w[1] <= b + window}
                    for term in ("", *terms):
                        out[name, term, mark if term else 0] += (name, term) not in met
                        met.add((name, term))
                if spans:
                    half, terms = half_of(text), {"", *(w[2] for w in words)}
                    for kind in {KINDS[k] for _, k, _ in spans}:
                        out.update([(kind, t, half) for t in terms])
                if len(out) > most:
                    yield flush(out)
                    out.clear()
        if out:
            yield flush(out)

    return run


def met_terms(suspects: DataFrame, repeated: np.ndarray, window: int) -> DataFrame:
    """entity, term, contexts, docs, docs0, docs1: of pairs of entity, or kind, and term; the empty term counts the entity's own texts.

    A text counts at the first context in which it holds a pair. docs0 and docs1 are the halves, of kinds only.
    """
    met = over_distinct(suspects, repeated, _met_in(window), "entity string, term string, context long, docs long").groupBy("entity", "term", "context").agg(F.sum("docs").alias("docs"))
    half = lambda h: F.coalesce(F.sum(F.when(F.col("context") == h, F.col("docs"))), F.lit(0)).alias(f"docs{h}")
    return met.groupBy("entity", "term").agg(F.count("*").alias("contexts"), F.sum("docs").alias("docs"), half(0), half(1))


def term_statistics(rows: DataFrame, repeated: np.ndarray, most: int = 300_000) -> DataFrame:
    """term, n0, n1: how many distinct texts of each half hold a term outside entities; the empty term counts all texts."""

    def run(batches):
        counts: list[Counter[str]] = [Counter(), Counter()]

        def flush():
            halves = np.repeat(np.arange(2, dtype=np.int32), [len(c) for c in counts])
            got = [pa.array([t for c in counts for t in c], pa.string()), pa.array(halves), pa.array([n for c in counts for n in c.values()], pa.int64())]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(got, names=["term", "half", "n"])

        for batch in batches:
            for row in batch.column("text"):
                text = row.as_py()
                terms = _terms(text, base_spans(text))
                count = counts[half_of(text)]
                count.update(terms)
                count[""] += 1
                if sum(map(len, counts)) > most:
                    yield flush()
        yield flush()

    met = over_distinct(rows, repeated, run, "term string, half int, n long")
    n = lambda h: F.coalesce(F.sum(F.when(F.col("half") == h, F.col("n"))), F.lit(0)).alias(f"n{h}")
    return met.groupBy("term").agg(n(0), n(1))


def disclosing_terms(docs: DataFrame, rule: Disclosure = Disclosure(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """entity, term: the terms that exceed the disclosure thresholds, from counts over all of `docs`.

    entity is one entity, as kind:value, or a kind alone, which the term gives away wherever both stand in a document.
    """
    rows = _prepared(docs, id_col, text_col)
    return _disclosing(rows, rows.filter(F.col("text").rlike("[0-9@]")), rule)


def _disclosing(rows: DataFrame, suspects: DataFrame, rule: Disclosure) -> DataFrame:
    counts = text_counts(rows)
    repeated = bitmap(counts.filter("copies > 1").select("doc"))
    met = cut(met_terms(suspects, repeated, rule.window))
    is_kind = F.col("entity").isin(*KINDS[:4])
    enough = F.when(is_kind, F.least("docs0", "docs1") >= rule.least_documents).otherwise(F.col("contexts") >= rule.least_contexts)
    likely = cut(met.filter(enough & (F.col("term") != "")))
    statistics = term_statistics(rows, repeated)
    total = statistics.filter("term = ''").select(F.col("n0").alias("all0"), F.col("n1").alias("all1"))  # one row
    own = met.filter("term = ''").select("entity", F.col("docs").alias("own"), F.col("docs0").alias("own0"), F.col("docs1").alias("own1"))
    measured = likely.join(statistics, "term").join(own, "entity").crossJoin(F.broadcast(total))
    given = F.least(F.col("docs") / (F.col("n0") + F.col("n1")), F.lit(1.0))
    bits = F.log2(given * (F.col("all0") + F.col("all1")) / F.col("own"))

    def told(half: int):
        base = F.col(f"own{half}") / F.col(f"all{half}")
        return (F.log2(F.col(f"docs{half}") / F.col(f"n{half}") / base) >= -F.log2(base) * rule.least_share) & (base < 1)

    return measured.filter(F.when(is_kind, told(0) & told(1)).otherwise((given >= rule.least_given) & (bits >= rule.least_bits))).select("entity", "term")


#: Up to so many disclosing terms are sent to every task; beyond, documents are joined to them.
MOST_TOLD = 50_000


def _suspects(docs: DataFrame, rule: Disclosure, text_col: str) -> tuple[DataFrame, DataFrame, dict[str, set[str]] | None]:
    """Rows of `docs` that can hold no entity; the others with __told; and what each term gives away, for all of them.

    Both have __text. Where there are too many terms to send around, __told holds those of each row instead.
    """
    keyed = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    suspect, text = F.col("__text").rlike("[0-9@]"), F.col("__text").alias("text")
    clean, held = keyed.filter(~suspect), keyed.filter(suspect)
    terms = cut(_disclosing(keyed.select(text), held.select(text), rule))
    if terms.count() <= MOST_TOLD:
        known: dict[str, set[str]] = {}
        for row in terms.collect():
            known.setdefault(row["term"], set()).add(row["entity"])
        return clean, held.withColumn("__told", F.lit(None).cast("array<struct<entity:string,term:string>>")), known

    def entities(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                out = set()
                for uid, text in zip(batch.column(0).slice(at, 50).to_pylist(), batch.column(1).slice(at, 50).to_pylist()):
                    spans = base_spans(text)
                    terms = {w[2] for w in free_terms(text, spans)} if spans else ()
                    out.update((uid, name, term) for name in protected(text, spans) for term in terms)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string()))], names=["__uid", "entity", "term"])

    held = cut(held.withColumn("__uid", F.monotonically_increasing_id()))
    met = held.select("__uid", "__text").mapInArrow(lean(entities), "__uid long, entity string, term string")
    told = met.join(terms, ["entity", "term"]).groupBy("__uid").agg(F.collect_set(F.struct("entity", "term")).alias("__told"))
    return clean, held.join(told, "__uid", "left").drop("__uid"), None


def protected(text: str, spans: list[tuple[int, int, int]]) -> set[str]:
    """The entities of a text, each by itself and by its kind."""
    return {entity(text, s) for s in spans} | {KINDS[k] for _, k, _ in spans}


def judge(text: str, told: list[dict] | None, known: dict[str, set[str]] | None) -> tuple[list, list]:
    """The base spans of a text, and all spans, with those of terms that give one of its entities away."""
    base = base_spans(text)
    if not base:
        return base, base
    names = protected(text, base)
    terms = {x["term"] for x in told or ()} if known is None else {t for t, of in known.items() if not of.isdisjoint(names)}
    return base, sorted(base + term_spans(text, terms, base)) if terms else base


def find(docs: DataFrame, rule: Disclosure = Disclosure(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of `docs`: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, text.

    The method adds spans of kind `term` to the base ones, in documents that hold the entity, or an entity of the
    kind, which the term gives away; it never removes or moves a base span. text is the sanitised text: base spans
    are generalised to [KIND] and disclosing terms removed. Null texts count as empty; repeated rows are judged
    each by itself; a table without entities, or an empty one, gives rows without spans. Long texts with many
    entities are scanned in linear time.
    """
    rows = _prepared(docs, id_col, text_col)
    clean, held, known = _suspects(rows, rule, "text")

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text, told in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "__text", "__told"))):
                base, spans = judge(text, told, known)
                n = Counter(k for _, k, _ in base)
                out.append((doc_id, n[0], n[1], n[2], n[3], hashlib.sha256(written(base).encode()).hexdigest(), written(spans), redact(text, spans)))
            types = (pa.int64(), *[pa.int64()] * 4, *[pa.string()] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names=names)

    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "text"]
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, text string"
    marked = held.select("doc_id", "__text", "__told").mapInArrow(lean(run), schema)
    zero = [F.lit(0).cast("long").alias(c) for c in names[1:5]]
    return clean.select("doc_id", *zero, F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"), "text").unionByName(marked)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Base spans become [KIND]; disclosing terms are removed. Overlapping spans are generalised as one."""
    out, done = [], 0
    for a, k, b in spans:
        if a >= done:
            out += [text[done:a], "" if k == 4 else f"[{KINDS[k].upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame, rule: Disclosure = Disclosure(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with sanitised texts, all rows and columns kept. Null texts stay null. Spans are those of `find`."""
    clean, held, known = _suspects(docs, rule, text_col)

    def run(batches):
        for batch in batches:
            texts = [redact(text, judge(text, told, known)[1]) for text, told in zip(batch.column("__text").to_pylist(), batch.column("__told").to_pylist())]
            yield batch.set_column(place, text_col, pa.array(texts, batch.column(place).type)).select(columns)

    columns = docs.columns
    place = columns.index(text_col)
    marked = held.select(*columns, "__text", "__told").mapInArrow(lean(run), docs.schema)
    return clean.select(*columns).unionByName(marked)
