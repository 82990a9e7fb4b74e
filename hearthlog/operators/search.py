"""Ranked full-text search over three columns: stored postings, conjunctive queries, phrases, BM25, snippets and pages."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from hearthlog.functions.scalars import contains_ci
from hearthlog.operators import paging

COLUMNS = ("title", "body", "context")
#: Types of hits in the order in which they are grouped.
TYPE_ORDER = ("person", "post", "message", "conversation", "comment", "reaction", "connection", "album", "media", "profile-fact")
#: Weights of the columns, and the usual constants of BM25.
WEIGHTS = {"title": 5.0, "body": 1.5, "context": 1.0}
K1, B = 1.2, 0.75
#: Letters, numbers and private use; everything else separates tokens.
SEPARATOR = r"[^\p{L}\p{N}\p{Co}]+"
#: Buckets of terms in the stored postings; a query reads those of its terms only.
BUCKETS = 64
POSTINGS = "term string, entity_type string, entity_id string, title array<int>, body array<int>, context array<int>, length long, created_at string, bucket int"
CORPUS = "documents long, length double"
TERMS = "term string, docs long, n long"


@lru_cache(1)
def _marked() -> tuple[str, str]:
    """Lower-case letters with one or more marks, and their letters without, by Unicode's own decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0x80, 0x2000) if chr(c) == chr(c).lower()]
    found = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isalpha() and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(c for c, _ in found), "".join(d for _, d in found)


def folded(c: Column) -> Column:
    """Lower case, letters without marks: accents and case don't tell tokens apart."""
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), *_marked())


def folded_text(text: str) -> str:
    return text.lower().translate(str.maketrans(*_marked()))


def tokens(c: Column) -> Column:
    return F.filter(F.split(folded(c), SEPARATOR), lambda t: t != "")


def query_phrases(text: str) -> list[list[str]]:
    """White space separates phrases, all of which must occur; a phrase of several tokens needs them side by side.

    Tokens are what they are in documents: letters, numbers and private use.
    """
    inside = lambda ch: unicodedata.category(ch)[0] in "LN" or unicodedata.category(ch) == "Co"
    words = ("".join(ch if inside(ch) else " " for ch in w).split() for w in folded_text(text).split())
    return [w for w in words if w]


def postings(docs: DataFrame) -> DataFrame:
    """term, entity_type, entity_id, col, pos for every token of `docs`."""
    each = [docs.select("entity_type", "entity_id", F.lit(c).alias("col"), F.posexplode(tokens(F.col(c))).alias("pos", "term")) for c in COLUMNS]
    return reduce(DataFrame.unionByName, each)


def term_statistics(docs: DataFrame) -> DataFrame:
    """term, docs, n: in how many documents each term occurs, and how often. Each document counts its terms first."""
    every = F.concat(*[tokens(F.col(c)) for c in COLUMNS])
    # Sorted tokens: the first of each run of equal ones adds a document.
    met = docs.select(F.array_sort(every).alias("t")).select(F.posexplode("t").alias("i", "term"), "t")
    return met.groupBy("term").agg(F.count_if((F.col("i") == 0) | (F.col("t")[F.greatest(F.col("i") - 1, F.lit(0))] != F.col("term"))).alias("docs"), F.count("*").alias("n"))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def stored_postings(docs: DataFrame) -> DataFrame:
    """A row for each term of each document: where it stands in each column, and the document's length and date.

    A document's sorted tokens are cut where a term ends, so what is dealt out once are whole rows, with all places of a
    term in one short text. Rows are dealt by ranges of bucket, term and document and sorted so, so that a query reads few
    row groups and the list of a word that nearly every document has is written by several tasks.
    """
    placed = lambda k, c: F.transform(tokens(F.col(c)), lambda t, i: F.struct(t.alias("term"), F.shiftleft(i, 2).bitwiseOR(F.lit(k)).alias("place")))
    keys = ["entity_type", "entity_id", "created_at"]
    every = docs.select(*keys, F.sort_array(F.concat(*[placed(k, c) for k, c in enumerate(COLUMNS)])).alias("p"))
    term = lambda i: F.get("p", i)["term"]
    cuts = every.withColumn("cuts", F.filter(F.transform("p", lambda _, i: i), lambda i: (i == 0) | (term(i) != term(i - 1))))
    run = lambda i, j: F.sequence(i, F.coalesce(F.get("cuts", j + 1), F.size("p")) - 1)
    places = lambda i, j: F.array_join(F.transform(run(i, j), lambda at: F.get("p", at)["place"].cast("string")), ",")
    met = F.inline(F.transform("cuts", lambda i, j: F.struct(term(i).alias("term"), places(i, j).alias("places"))))
    rows = cuts.select(*keys, F.size("p").cast("long").alias("length"), met)
    bucket = _bucket(F.col("term"))
    dealt = rows.repartitionByRange(bucket, "term", "entity_id").withColumn("bucket", bucket).sortWithinPartitions("bucket", "term", "entity_id")
    dealt = dealt.withColumn("places", F.transform(F.split("places", ","), lambda x: x.cast("int")))
    at = lambda k, c: F.transform(F.filter("places", lambda x: x.bitwiseAND(F.lit(3)) == k), lambda x: F.shiftright(x, 2)).alias(c)
    return dealt.select("term", "entity_type", "entity_id", *[at(k, c) for k, c in enumerate(COLUMNS)], "length", "created_at", "bucket")


def stored_terms(stored: DataFrame) -> DataFrame:
    """term, docs, n from stored postings, of which a document has one a term; texts aren't read again."""
    return stored.groupBy("term").agg(F.count("*").alias("docs"), F.sum(sum((F.size(c) for c in COLUMNS), F.lit(0))).alias("n"))


def corpus(docs: DataFrame) -> DataFrame:
    """documents, length: how many there are, and how long they are on average. One row."""
    return docs.agg(F.count("*").alias("documents"), F.avg(sum((F.size(tokens(F.col(c))) for c in COLUMNS), F.lit(0))).alias("length"))


def _idf(documents: Column, with_phrase: Column) -> Column:
    return F.greatest(F.lit(1e-6), F.ln((documents - with_phrase + 0.5) / (with_phrase + 0.5)))


def _score(f: Column, d: Column, documents: Column, length: Column, mean: Column) -> Column:
    return _idf(documents, d) * (f * (K1 + 1)) / (f + K1 * (1 - B + B * length / mean))


def scored(stored: DataFrame, numbers: DataFrame, text: str, where: Column | None = None) -> DataFrame:
    """entity_type, entity_id, created_at, rank of the documents that hold all phrases, from the stored postings alone.

    Only the postings of the query's terms are read; their number of documents comes from them too. `where` filters
    hits, not the numbers.
    """
    phrases = query_phrases(text)
    terms = sorted({t for p in phrases for t in p})
    empty = stored.select("entity_type", "entity_id", "created_at", F.lit(0.0).alias("rank")).limit(0)
    if not terms:
        return empty
    buckets = [r[0] for r in stored.sparkSession.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t"))).distinct().collect()]
    read = stored.filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
    place = lambda i, c: F.flatten(F.collect_list(F.when(F.col("term") == terms[i], F.col(c)))).alias(f"{c}{i}")
    docs = read.groupBy("entity_type", "entity_id", "created_at", "length").agg(*[place(i, c) for i in range(len(terms)) for c in COLUMNS])

    def followed(starts: Column, places: Column, k: int) -> Column:
        return F.array_intersect(starts, F.transform(places, lambda p: p - k))  # by a hash set, not place by place

    def found(phrase: list[str], c: str) -> Column:
        at = [F.col(f"{c}{terms.index(t)}") for t in phrase]
        return F.size(reduce(lambda starts, k: followed(starts, at[k], k), range(1, len(phrase)), at[0]))

    for i, p in enumerate(phrases):
        docs = docs.withColumn(f"_f{i}", sum((found(p, c) * F.lit(w) for c, w in WEIGHTS.items()), F.lit(0.0)))
    n = range(len(phrases))
    docs = docs.select("entity_type", "entity_id", "created_at", "length", *[f"_f{i}" for i in n])
    counts = docs.agg(*[F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in n]).crossJoin(numbers.select("documents", F.col("length").alias("_mean")))  # one row
    hits = reduce(lambda df, i: df.filter(F.col(f"_f{i}") > 0), n, docs if where is None else docs.filter(where)).crossJoin(F.broadcast(counts))
    rank = sum((_score(F.col(f"_f{i}"), F.col(f"_d{i}"), F.col("documents"), F.col("length"), F.col("_mean")) for i in n), F.lit(0.0))
    return hits.select("entity_type", "entity_id", "created_at", (-rank).alias("rank"))


@dataclass(frozen=True)
class SearchPage:
    """items, where the next page begins, whether there is one, hits of this page by kind, the backend, and whether it's out of date."""

    items: list[Row]
    next_cursor: str | None
    has_more: bool
    counts: dict[str, int]
    backend: str
    preparing: bool = False


def _search_page(rows: list[Row], limit: int, backend: str) -> SearchPage:
    items, counts = rows[:limit], {}
    for r in items:
        counts[r["entity_type"]] = counts.get(r["entity_type"], 0) + 1
    more, last = len(rows) > limit, items[-1] if items else None
    at = {"rank": last["rank"] if backend == "ranked" else 0, "createdAt": last["created_at"] or "", "entityId": last["entity_id"], "entityType": last["entity_type"]} if more else None
    return SearchPage(items, paging.encode_cursor(**at) if at else None, more, counts, backend)


def _behind(cursor: str | None, rank: Column | None) -> Column:
    """Rows behind a cursor in the order of rank, newest, id and kind."""
    at = paging.decode_cursor(cursor, "rank", "createdAt", "entityId", "entityType")
    if not at:
        return F.lit(True)
    day, id_, kind = F.coalesce("created_at", F.lit("")), F.col("entity_id"), F.col("entity_type")
    later = (day < at["createdAt"]) | ((day == at["createdAt"]) & ((id_ > at["entityId"]) | ((id_ == at["entityId"]) & (kind > at["entityType"]))))
    return later if rank is None else (rank > at["rank"]) | ((rank == at["rank"]) & later)


_ORDER = lambda: (F.desc(F.coalesce("created_at", F.lit(""))), "entity_id", "entity_type")


def documents_of(docs: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """The documents with these (entity_type, entity_id), a page's worth.

    Each id is a test of its own, which the Parquet reader holds against statistics and Bloom filters of row groups;
    of a longer list of values it would take the least and the largest only.
    """
    ids = sorted({i for _, i in keys})
    wanted = reduce(lambda a, b: a | b, (F.col("entity_id") == i for i in ids), F.lit(False))
    return docs.filter(wanted & F.col("entity_type").isin(sorted({t for t, _ in keys})))


def ranked_page(docs: DataFrame, stored: DataFrame, numbers: DataFrame, text: str, where: Column | None, limit: int, cursor: str | None = None) -> SearchPage:
    """A page of hits; of the documents, row groups without any of the page's own aren't read."""
    hits = scored(stored, numbers, text, where).withColumn("rank", F.round("rank", 6)).filter(_behind(cursor, F.col("rank"))).orderBy("rank", *_ORDER()).limit(limit + 1)
    best = hits.collect()  # at most limit + 1 rows
    if not best:
        return _search_page([], limit, "ranked")
    ranks = docs.sparkSession.createDataFrame(best, hits.schema)
    found = documents_of(docs, [(r["entity_type"], r["entity_id"]) for r in best]).drop("created_at").join(F.broadcast(ranks), ["entity_type", "entity_id"])
    found = found.withColumn("snippet", snippet(F.col("body"), query_phrases(text)))
    return _search_page(found.orderBy("rank", *_ORDER()).collect(), limit, "ranked")


def like_page(docs: DataFrame, text: str, where: Column | None, limit: int, cursor: str | None = None) -> SearchPage:
    hits = like_hits(docs, text, where).filter(_behind(cursor, None))
    return _search_page(hits.orderBy(*_ORDER()).limit(limit + 1).collect(), limit, "like")


def _spaced(c: Column) -> Column:
    """The tokens of a text, each between two single spaces of its own."""
    return F.concat(F.lit("  "), F.regexp_replace(folded(c), SEPARATOR, "  "), F.lit("  "))


def _length(spaced: Column) -> Column:
    """Number of tokens."""
    bare = F.trim(spaced)
    return F.when(bare == "", 0).otherwise((F.length(bare) - F.length(F.replace(bare, F.lit("  "), F.lit("")))) / 2 + 1).cast("long")


def _count(phrase: list[str], spaced: Column) -> Column:
    """Occurrences of a phrase that don't overlap."""
    wanted = " " + "  ".join(phrase) + " "
    return (F.length(spaced) - F.length(F.replace(spaced, F.lit(wanted), F.lit("")))) / len(wanted)


def ranked(docs: DataFrame, text: str, where: Column | None = None) -> DataFrame:
    """The documents that hold all phrases of the query, with `rank`; lower is better.

    One pass counts; texts stay strings, so no arrays are built. Statistics (documents, length, documents with
    each phrase) come from all of `docs` in one aggregate of one row; `where` filters hits only.
    """
    phrases = query_phrases(text)
    if not phrases:
        return docs.withColumn("rank", F.lit(0.0)).limit(0)
    counted = docs
    for c in COLUMNS:
        counted = counted.withColumn(f"_{c}", _spaced(F.col(c)))
    for i, p in enumerate(phrases):
        counted = counted.withColumn(f"_f{i}", sum((_count(p, F.col(f"_{c}")) * F.lit(w) for c, w in WEIGHTS.items()), F.lit(0.0)))
    counted = counted.withColumn("_len", sum((_length(F.col(f"_{c}")) for c in COLUMNS), F.lit(0)))
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *[F.sum((F.col(f"_f{i}") > 0).cast("long")).alias(f"_d{i}") for i in range(len(phrases))])
    hits = reduce(lambda df, i: df.filter(F.col(f"_f{i}") > 0), range(len(phrases)), counted if where is None else counted.filter(where))
    met = hits.crossJoin(F.broadcast(stats))  # one row
    score = sum((_score(F.col(f"_f{i}"), F.col(f"_d{i}"), F.col("_n"), F.col("_len"), F.col("_avg")) for i in range(len(phrases))), F.lit(0.0))
    return met.withColumn("rank", -score).select(*docs.columns, "rank")


def top_hits(docs: DataFrame, text: str, limit: int = 20, where: Column | None = None) -> DataFrame:
    """The best hits; equal ranks by date, newest first, then id."""
    hits = ranked(docs, text, where).withColumn("rank", F.round("rank", 6)).withColumn("snippet", snippet(F.col("body"), query_phrases(text)))
    return hits.orderBy("rank", F.desc(F.coalesce("created_at", F.lit(""))), "entity_id").limit(limit)


def snippet(body: Column, phrases: list[list[str]], width: int = 18) -> Column:
    """Up to `width` tokens of the body around the first hit, hits marked."""
    words = tokens(body)
    terms = [t for p in phrases for t in p]
    hit = F.array_position(F.transform(words, lambda t: t.isin(terms) if terms else F.lit(False)), True)
    start = F.greatest(F.lit(1), hit.cast("int") - width // 3)
    part = F.slice(words, start, width)
    marked = F.transform(part, lambda t: F.when(t.isin(terms), F.concat(F.lit("[[H]]"), t, F.lit("[[/H]]"))).otherwise(t)) if terms else part
    return F.concat(F.when(start > 1, "…").otherwise(""), F.array_join(marked, " "), F.when(F.size(words) >= start + width, "…").otherwise(""))


def like_hits(docs: DataFrame, text: str, where: Column | None = None) -> DataFrame:
    """Substring hits in any column, without rank; blank texts have none."""
    if not text.strip():
        return docs.withColumn("snippet", F.lit("")).limit(0)
    found = reduce(lambda a, b: a | b, (F.coalesce(contains_ci(F.col(c), text), F.lit(False)) for c in COLUMNS))
    hits = docs.filter(found if where is None else found & where)
    return hits.withColumn("snippet", F.substring(F.coalesce("body", "title", "context"), 1, 240))
