"""Text built from columns: model prompts, rerank texts, page records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.strings import strip
from shelfspark.schema import LIST_FIELDS, TEXT_FIELDS


def fill(template: str, **columns: Column) -> Column:
    """`{name}` marks in the template become column values; null prints as ''."""
    parts, rest = [], template
    while rest:
        head, mark, tail = rest.partition("{")
        if head:
            parts.append(F.lit(head))
        if not mark:
            break
        name, _, rest = tail.partition("}")
        parts.append(F.coalesce(columns[name].cast("string"), F.lit("")))
    return F.concat(*parts)


EXTRACT_TEMPLATE = (
    "Return one JSON object with the text keys "
    + ", ".join(TEXT_FIELDS)
    + " and the list keys "
    + ", ".join(LIST_FIELDS)
    + ". Leave a key empty if the page does not say.\nPage:\n{content}"
)
#: What is known of a product, as one text.
CONTEXT_TEMPLATE = "{title}\n{description}"


def rerank_text(title: Column, description: Column, summary: Column) -> Column:
    return strip(
        fill(
            "Title: {title}\nDescription: {description}\nSummary: {summary}",
            title=title,
            description=description,
            summary=summary,
        )
    )


def page_record(url: Column, content: Column) -> Column:
    """One block of a site's text file."""
    return fill("\n\nURL: {url}\nContent:\n{content}\n" + "-" * 80, url=url, content=content)
