"""Column expressions over text that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def estimated_tokens(text: Column) -> Column:
    """A deterministic stand-in for a tokenizer: a token for every four characters, rounded up."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def truncated_to_tokens(text: Column, limit: int, marker: str = "\n[...truncated...]") -> Column:
    return F.when(estimated_tokens(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, 4 * limit), F.lit(marker)))


def empty_as_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def without_dot_leaders(text: Column) -> Column:
    """Runs of five dots or more, also with spaces between, become a colon."""
    return F.regexp_replace(F.regexp_replace(text, r"\.{5,}", ": "), r"(?:\. ){5,}\.?", ": ")


def physical_index(text: Column) -> Column:
    """The number in ``<physical_index_5>`` or ``physical_index_5``, or of a plain number; else null."""
    return F.regexp_extract(text, r"^\s*(?:<?physical_index_)?(\d+)>?\s*$", 1).try_cast("int")


def parent_code(code: Column) -> Column:
    """``1.2`` of ``1.2.3``; null for a code without a dot."""
    return F.when(F.contains(code, F.lit(".")), F.regexp_replace(code, r"\.[^.]*$", ""))


def without_type_suffix(name: Column) -> Column:
    """``Acme`` of ``Acme (ORGANIZATION)``."""
    return F.trim(F.regexp_replace(name, r"\s*\([^(]*\)$", ""))


def page_tag(number: Column, text: Column) -> Column:
    tag = F.concat(F.lit("<physical_index_"), number.cast("string"), F.lit(">"))
    return F.concat(tag, F.lit("\n"), text, F.lit("\n"), tag, F.lit("\n"))


def tagged_pages(text: Column) -> Column:
    """First and last page of a text with ``<start_index_N>`` tags; -1 without any."""
    found = F.regexp_extract_all(text, F.lit(r"<start_index_(\d+)>"), F.lit(1))
    first, last = F.try_element_at(found, F.lit(1)), F.try_element_at(found, F.lit(-1))
    return F.struct(F.coalesce(first.cast("int"), F.lit(-1)).alias("first"), F.coalesce(last.cast("int"), F.lit(-1)).alias("last"))


def repaired_json(answer: Column) -> Column:
    """The JSON in a model's answer: out of its fence, with null for None and without trailing commas; null if it is none."""
    fenced = F.regexp_extract(answer, r"(?s)```json\s*(.*)```", 1)
    body = F.regexp_replace(F.when(fenced != "", fenced).otherwise(answer), r"^\s+|\s+$", "")
    body = F.regexp_replace(F.regexp_replace(body, r"\bNone\b", "null"), r",\s*([\]}])", "$1")
    parsed = F.try_parse_json(body)
    return F.when(parsed.isNotNull(), body).otherwise(F.when(F.try_parse_json(F.regexp_replace(body, r"\s+", " ")).isNotNull(), F.regexp_replace(body, r"\s+", " ")))


def zero_padded(number: Column, width: int = 4) -> Column:
    """Like ``lpad``, but longer numbers stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 if either vector is zero."""
    d = lambda v: F.transform(v, lambda x: x.cast("double"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    a, b = d(a), d(b)
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    norm = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    return F.when(norm == 0, 0.0).otherwise(dot / norm)


def without_first_block(text: Column) -> Column:
    """A text without its first ``<physical_index_N>...<physical_index_N>`` block; later ones stay."""
    block = F.regexp_extract(text, r"(?s)(<physical_index_\d+>.*?<physical_index_\d+>)", 1)
    at = F.instr(text, block)
    return F.when(block == "", text).otherwise(F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(block), F.length(text))))
