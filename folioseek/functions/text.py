"""Text, date, map and URL expressions of the document pipeline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
PDF_MIME = "application/pdf"
UNTITLED = "(untitled)"
NO_NOTE = "(no note)"
STATUSES = ("PENDING", "RUNNING", "DONE", "ERROR")
DEFAULT_BASE_URL = "http://localhost:8000"


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def or_untitled(title) -> Column:
    return F.coalesce(_col(title), F.lit(UNTITLED))


def or_empty(value) -> Column:
    return F.coalesce(_col(value), F.lit(""))


def iso_date(day) -> Column:
    return F.date_format(_col(day), "yyyy-MM-dd")


def document_url(doc_id, base_url: str = DEFAULT_BASE_URL) -> Column:
    """Link to a document; trailing slashes of the base are dropped, a blank base is refused."""
    base = base_url.rstrip("/")
    if not base.strip():
        raise ValueError("base_url must be provided")
    return F.concat(F.lit(base + "/documents/"), _col(doc_id).cast("string"))


def drop_nulls(values) -> Column:
    return F.array_compact(_col(values))


def comma_joined(values) -> Column:
    return F.array_join(_col(values), ",")


def trimmed(value) -> Column:
    """Strip white space of every kind from both ends (``trim`` strips blanks only)."""
    return F.regexp_replace(_col(value), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def to_int_or_null(value) -> Column:
    """Optional sign and ASCII digits within 32 bits, else null."""
    value = _col(value)
    return F.when(value.rlike(r"\A[+-]?[0-9]+\z"), value.try_cast("int"))


def clamped_top_k(top_k, default: int = 5, maximum: int = 20) -> Column:
    top_k = _col(top_k)
    return F.least(F.coalesce(F.when(top_k > 0, top_k), F.lit(default)), F.lit(maximum))


def count_mismatch(vectors, segments) -> Column:
    """Message for a document whose segments and vectors do not match in number."""
    return F.concat(_col(vectors).cast("string"), F.lit(" vectors for "), _col(segments).cast("string"), F.lit(" segments"))


def render_document(title, correspondent, day, content, note) -> Column:
    """Full text that is split and embedded; every line ends in a newline."""
    newline = F.lit("\n")
    correspondent = _col(correspondent)
    return F.concat(
        F.lit("Title: "), or_untitled(title), newline,
        F.when(correspondent.isNotNull(), F.concat(F.lit("Correspondent: "), correspondent, newline))
        .otherwise(F.lit("")),
        F.lit("Date: "), iso_date(day), newline,
        newline,
        _col(content), newline,
        newline,
        F.lit("Note: "), F.coalesce(_col(note), F.lit(NO_NOTE)), newline,
    )


def metadata_map(doc_id, title, correspondent, day, owner, tags) -> Column:
    """The six metadata entries of a chunk."""
    return F.create_map(
        F.lit("doc_id"), _col(doc_id).cast("string"),
        F.lit("title"), or_untitled(title),
        F.lit("correspondent_name"), or_empty(correspondent),
        F.lit("document_date"), iso_date(day),
        F.lit("owner_username"), or_empty(owner),
        F.lit("tags"), or_empty(comma_joined(tags)),
    )
