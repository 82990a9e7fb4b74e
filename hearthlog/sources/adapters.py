"""Adapters of the formats that exports come in, and their readers as one table function for SQL.

    SELECT f.path, p.display_name FROM files f, LATERAL archive_records(f.path, f.text, 'profile') p

The third argument says what is wanted, and the columns follow from it; the file's adapter is looked up by its path.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, MapType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from hearthlog.functions import scalars as S
from hearthlog.sources import html_records, json_records, zip_source

NAME = "archive_records"


def _columns(names: list[str], **other: DataType) -> StructType:
    return StructType([StructField(n, other.get(n, StringType())) for n in names])


_NUMBER, _TEXTS = IntegerType(), ArrayType(StringType())
_CARD = ["place", "heading", "heading_class", "body", "date", "datetime", "text", "links", "media", "tags", "attributes", "media_before"]
#: What can be asked for, and the columns of the answer.
KINDS = {
    "profile": _columns(json_records.PROFILE),
    "facts": _columns(json_records.FACT),
    "references": _columns(json_records.REFERENCE, k=_NUMBER, width=_NUMBER, height=_NUMBER, duration_ms=_NUMBER),
    "cards": _columns(_CARD, place=_NUMBER, media_before=_NUMBER, links=_TEXTS, media=_TEXTS, tags=_TEXTS, attributes=MapType(StringType(), StringType())),
    "page": _columns(["title", "h1", "links", "media", "rows"], links=_TEXTS, media=_TEXTS, rows=ArrayType(_TEXTS)),
}


@dataclass(frozen=True)
class Adapter:
    """How files of one format are read: `rows` of the ZIP source it takes, and what it tells by kind."""

    platform: str
    format: str
    parser_version: int
    rows: str
    endings: str
    told: dict[str, Callable[[str], Iterator[tuple]]]

    def supports(self, path: Column) -> Column:
        return F.coalesce(S.ascii_lower(path).rlike(self.endings), F.lit(False))


def _object(pairs: list[tuple]) -> dict:
    """An object in the order of its keys, as variants have them; they refuse a key that is there twice."""
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("a key is there twice")
    return dict(sorted(pairs, key=lambda kv: kv[0].encode("utf-16-be", "surrogatepass")))


def _not_json(name: str):
    raise ValueError(name)


def _of_json(tell: Callable) -> Callable[[str], Iterator[tuple]]:
    """A reader of JSON text; what isn't JSON tells nothing."""

    def read(text: str) -> Iterator[tuple]:
        try:
            document = json.loads(text, object_pairs_hook=_object, parse_constant=_not_json)
        except (ValueError, RecursionError):
            return
        yield from tell(document)

    return read


def _cards(html: str) -> Iterator[tuple]:
    """Cards in chunks of the page, so that no more than one chunk's cards are held."""
    stream, place = html_records.PageStream(), 0
    for at in range(0, max(len(html), 1), stream.BLOCK):
        for card in stream.take(html[at : at + stream.BLOCK], last=at + stream.BLOCK >= len(html)):
            yield (place, *(dict(card[n]) if n == "attributes" else card[n] for n in _CARD[1:]))
            place += 1


def _pages(html: str) -> Iterator[tuple]:
    stream = html_records.PageStream()
    for at in range(0, max(len(html), 1), stream.BLOCK):
        stream.take(html[at : at + stream.BLOCK], last=at + stream.BLOCK >= len(html))
    page = stream.page()
    yield tuple(page[n] for n in KINDS["page"].names)


#: One for each format; a later version has its files read anew.
ADAPTERS = (
    Adapter("facebook", "json", 1, "texts", r"[.]json$", {"profile": _of_json(json_records.profile_told), "facts": _of_json(json_records.facts_told), "references": _of_json(json_records.references_told)}),
    Adapter("facebook", "html", 1, "pages", r"[.]html?$", {"cards": _cards, "page": _pages}),
)


def adapter_of(path: str | None) -> Adapter | None:
    return next((a for a in ADAPTERS if path and zip_source.format_of(path) == a.format), None)


def version_of(path: Column) -> Column:
    """The parser version of the adapter that reads a file; null where there is none."""
    chain = F.when(F.lit(False), F.lit(0))
    for a in ADAPTERS:
        chain = chain.when(a.supports(path), F.lit(a.parser_version))
    return chain


class ArchiveRecords:
    """archive_records(path, text, kind): what a file tells; nothing for null texts and files that no adapter reads so."""

    @staticmethod
    def analyze(path: AnalyzeArgument, text: AnalyzeArgument, kind: AnalyzeArgument) -> AnalyzeResult:
        if not kind.isConstantExpression or kind.value not in KINDS:
            raise ValueError(f"{NAME}: the third argument must be one of {', '.join(sorted(KINDS))}")
        return AnalyzeResult(KINDS[kind.value])

    def eval(self, path: str | None, text: str | None, kind: str) -> Iterator[tuple]:
        adapter = adapter_of(path)
        if adapter and text is not None and kind in adapter.told:
            yield from adapter.told[kind](text)


def register(spark: SparkSession) -> None:
    """Makes archive_records callable from SQL in this session."""
    spark.udtf.register(NAME, F.udtf(ArchiveRecords))


def told(files: DataFrame, kind: str, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """`files` without their text, joined laterally with what their adapters tell of `kind`."""
    spark = files.sparkSession
    register(spark)
    own = ", ".join(f"f.`{c}`" for c in files.columns if c != text_col)
    return spark.sql(f"SELECT {own}, t.* FROM {{files}} f, LATERAL {NAME}(f.`{path_col}`, f.`{text_col}`, '{kind}') t", files=files)
