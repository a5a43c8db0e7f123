"""Cards of a captured page as rows: a table function for SQL.

    SELECT * FROM result_cards(TABLE(SELECT page_id, html FROM pages) PARTITION BY (page_id), 'li', 'a', 'p')

The table's columns but html come out in front of (card, title, url, snippet). A card is an element of a class ('.gsc-result') or tag ('li'); its link is the
first of the link's kind inside it that has an address, its snippet the first of the snippet's kind with a visible text.
Cards without a link are left out; cards inside a card belong to it and count for themselves too.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from postloom.operators.html import PageTree

# The classes of a result page's parts.
CARD, LINK, SNIPPET = ".gsc-webResult.gsc-result", "a.gs-title", ".gs-snippet"


def _matcher(selector: str):
    """A test of (tag, attrs) for 'tag', '.class', 'tag.class.class'."""
    tag, *classes = selector.split(".")
    wanted = set(filter(None, classes))
    return lambda t, attrs: (not tag or t == tag) and (not wanted or "class" in attrs and wanted <= set(attrs["class"].split()))


def cards(html: str, card: str = CARD, link: str = LINK, snippet: str = SNIPPET) -> Iterator[tuple[str, str, str | None]]:
    """(title, url, snippet) of a page's cards, in their order. Time is in proportion to the page and to what lies in cards."""
    page = PageTree(html)
    is_card, is_link, is_snippet = map(_matcher, (card, link, snippet))
    for i in (i for i in range(1, len(page.tags)) if is_card(page.tags[i], page.attrs[i])):
        inside = range(i + 1, page.last[i] + 1)
        title = next((j for j in inside if is_link(page.tags[j], page.attrs[j]) and page.attrs[j].get("href", "").strip()), None)
        if title is not None:
            texts = (" ".join(page.visible(j).split()) for j in inside if is_snippet(page.tags[j], page.attrs[j]))
            yield " ".join(page.visible(title).split()), page.attrs[title]["href"].strip(), next(filter(None, texts), None)


class ResultCards:
    """The handler: analyze gives the columns by those of the table, eval the cards of a row."""

    def __init__(self, analyzed: AnalyzeResult | None = None):
        self.names = [f.name for f in analyzed.schema.fields[:-4]] if analyzed is not None else []

    @staticmethod
    def analyze(table: AnalyzeArgument, card: AnalyzeArgument | None = None, link: AnalyzeArgument | None = None, snippet: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not table.isTable or "html" not in table.dataType.names:
            raise ValueError("result_cards takes a table with a column html")
        if any(a is not None and not isinstance(a.value, str) for a in (card, link, snippet)):
            raise ValueError("selectors are constant texts")
        schema = T.StructType([f for f in table.dataType.fields if f.name != "html"])
        for name, kind in (("card", T.IntegerType()), ("title", T.StringType()), ("url", T.StringType()), ("snippet", T.StringType())):
            schema = schema.add(name, kind)
        return AnalyzeResult(schema=schema)

    def eval(self, row, card: str = CARD, link: str = LINK, snippet: str = SNIPPET):
        for number, found in enumerate(cards(row["html"] or "", card, link, snippet), 1):
            yield (*(row[n] for n in self.names), number, *found)


def register(spark: SparkSession) -> None:
    """Make result_cards known to the session's SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("result_cards", udtf(ResultCards))
