"""Captured pages of search results as a data source: format("search_pages"), batch, streaming and writing.

A folder holds one JSON file a captured page, named <sequence>-<page number>-<keyword>.json (the keyword percent-encoded), so that which
pages there are, and in which order they came, is a listing. Each page is a partition of a read; the options keywords and maxPage
leave out pages before any is opened. As a stream the offset is the
sequence number: a batch has the pages captured since. A writer stages its files and names them in commit, so a failed or
repeated task leaves nothing behind.

Rows are results: (sequence, keyword, page_number, requested, has_next, failed, received, position, title, url, snippet); a page
without results is one row with a null position, for the rules by which paging stops (`search_results`).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from postloom.operators.relational import stop_paging

SCHEMA = (
    "sequence bigint, keyword string, page_number bigint, requested bigint, has_next boolean, failed boolean, received bigint, position bigint,"
    " title string, url string, snippet string"
)
#: What the writer takes: a page a row.
PAGE = "keyword string, page_number bigint, requested bigint, has_next boolean, failed boolean, results array<struct<title:string,url:string,snippet:string>>"
PAGE_SIZE, MOST_RESULTS = 10, 100


@dataclass(frozen=True)
class PagePartition(InputPartition):
    sequence: int
    page_number: int
    keyword: str
    file: str

    def __hash__(self):
        return hash(self.file)


def _listing(path: str) -> list[PagePartition]:
    """The pages of a folder in the order of capture; a missing folder has none."""
    system, root = fs.FileSystem.from_uri(path)
    out = []
    for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        name = info.base_name
        if name.endswith(".json") and not name.startswith("."):
            sequence, number, keyword = name.removesuffix(".json").split("-", 2)
            out.append(PagePartition(int(sequence), int(number), unquote(keyword), info.path))
    return sorted(out, key=lambda p: p.sequence)


def _rows(path: str, part: PagePartition) -> Iterator[tuple]:
    system, _ = fs.FileSystem.from_uri(path)
    with system.open_input_file(part.file) as f:
        page = json.loads(f.read())
    results = page.get("results") or []
    head = (part.sequence, part.keyword, part.page_number, page.get("requested"), page.get("has_next"), bool(page.get("failed")), len(results))
    for position, r in enumerate(results, 1):
        yield (*head, position, r.get("title"), r.get("url"), r.get("snippet"))
    if not results:
        yield (*head, None, None, None, None)


class _Reader(DataSourceReader):
    """Keywords and a last page are options, not pushed filters: Spark 4.1.2 keeps the reader that took one query's filters for
    other scans of the same frame, which would then miss rows."""

    def __init__(self, path: str, keywords: list[str] | None, max_page: int | None):
        self.path, self.keywords, self.max_page = path, keywords, max_page

    def _wanted(self, page: PagePartition) -> bool:
        return (self.keywords is None or page.keyword in self.keywords) and (self.max_page is None or page.page_number <= self.max_page)

    def partitions(self):
        return [p for p in _listing(self.path) if self._wanted(p)] or [None]

    def read(self, partition):
        return _rows(self.path, partition) if partition is not None else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"sequence": 0}

    def latestOffset(self) -> dict:
        return {"sequence": max((p.sequence for p in _listing(self.path)), default=0)}

    def partitions(self, start: dict, end: dict):
        return [p for p in _listing(self.path) if start["sequence"] < p.sequence <= end["sequence"]]

    def read(self, partition):
        return _rows(self.path, partition)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, int, str]]


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> _Written:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root)
        files = []
        for row in iterator:
            page = row.asDict(recursive=True)
            staged = f"{root}/.{uuid.uuid4().hex}"
            with system.open_output_stream(staged) as f:
                f.write(json.dumps(page, ensure_ascii=False).encode())
            files.append((page["keyword"], page["page_number"], staged))
        return _Written(files)

    def commit(self, messages) -> None:
        """Names in order of keyword and page, behind all that is there."""
        system, root = fs.FileSystem.from_uri(self.path)
        last = max((p.sequence for p in _listing(self.path)), default=0)
        files = sorted(f for m in messages if m is not None for f in m.files)
        for sequence, (keyword, number, staged) in enumerate(files, last + 1):
            system.move(staged, f"{root}/{sequence:012d}-{number}-{quote(keyword, safe='')}.json")

    def abort(self, messages) -> None:
        system, _ = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for _, _, staged in m.files if m is not None else ():
                system.delete_file(staged)


class SearchPages(DataSource):
    """Options: path, a folder or a URI of one; of a batch read also keywords (a JSON list) and maxPage, which leave out pages unopened."""

    @classmethod
    def name(cls) -> str:
        return "search_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        keywords, last = self.options.get("keywords"), self.options.get("maxPage")
        return _Reader(self.options["path"], json.loads(keywords) if keywords else None, int(last) if last else None)

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("captured pages are only appended")
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the source known to the session."""
    spark.dataSource.register(SearchPages)


def most_results(n: int) -> int:
    """How many results a keyword may have: a whole number from 1 to MOST_RESULTS."""
    if not isinstance(n, int) or isinstance(n, bool):
        raise TypeError("max_results must be an integer.")
    if n < 1:
        raise ValueError("max_results must be greater than 0.")
    if n > MOST_RESULTS:
        raise ValueError(f"max_results cannot exceed {MOST_RESULTS}.")
    return n


def taken_pages(rows: DataFrame, max_results: int = MOST_RESULTS) -> DataFrame:
    """rows of the source from pages within max_results, up to and with the first page that is short or has no next; a failed page and
    those behind it are left out. One row a page is judged, wherever its results are."""
    pages = rows.where(F.col("page_number") <= -(-most_results(max_results) // PAGE_SIZE)).groupBy("keyword", "page_number").agg(
        F.max("sequence").alias("sequence"), F.max_by("requested", "sequence").alias("requested"), F.max_by("received", "sequence").alias("received"),
        F.max_by("has_next", "sequence").alias("has_next"), F.max_by("failed", "sequence").alias("failed"))
    return stop_paging(pages)


def search_results(rows: DataFrame, max_results: int = MOST_RESULTS) -> DataFrame:
    """(keyword, rank, page_number, title, url, snippet): the results of the pages taken, in the order of pages, at most max_results a keyword. Of
    a page captured more than once the last capture counts."""
    taken = taken_pages(rows, max_results).select("keyword", "page_number", "sequence")
    held = rows.where("position is not null").join(taken, ["keyword", "page_number", "sequence"], "left_semi")
    # at most MOST_RESULTS rows a keyword get here
    rank = F.row_number().over(Window.partitionBy("keyword").orderBy("page_number", "position"))
    return held.withColumn("rank", rank).where(F.col("rank") <= max_results).select("keyword", "rank", "page_number", "title", "url", "snippet")


def payloads(rows: DataFrame, max_results: int = MOST_RESULTS) -> DataFrame:
    """(keyword, requested_count, result_count, page_logs, results): one envelope a keyword; both arrays are bounded by the pages that a keyword may have."""
    taken = taken_pages(rows, max_results)
    logs = taken.groupBy("keyword").agg(F.array_sort(F.collect_list(F.struct("page_number", "requested", "received"))).alias("page_logs"))
    found = search_results(rows, max_results).groupBy("keyword").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "url", "snippet"))).alias("results"))
    none = F.array().cast("array<struct<rank:int,title:string,url:string,snippet:string>>")
    d = logs.join(found, "keyword", "left").withColumn("results", F.coalesce("results", none))
    return d.select("keyword", F.lit(max_results).cast("bigint").alias("requested_count"), F.size("results").cast("bigint").alias("result_count"), "page_logs", "results")
