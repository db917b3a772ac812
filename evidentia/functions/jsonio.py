"""JSON functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.text import col


def kind(text: Column | str) -> Column:
    """OBJECT, ARRAY or SCALAR of a JSON text; null if it is blank or no JSON."""
    schema = F.schema_of_variant(F.try_parse_json(F.when(F.trim(col(text)) != "", col(text))))
    return F.when(F.startswith(schema, F.lit("OBJECT")), "OBJECT").when(F.startswith(schema, F.lit("ARRAY")), "ARRAY").when(schema.isNotNull(), "SCALAR")


def is_object(text: Column | str) -> Column:
    return F.coalesce(kind(text) == "OBJECT", F.lit(False))


def is_valid(text: Column | str) -> Column:
    return kind(text).isNotNull()


def unfenced(text: Column | str) -> Column:
    """Without a Markdown code fence round it."""
    return F.trim(F.regexp_replace(F.trim(col(text)), r"(?s)^```[a-zA-Z]*\s*|\s*```$", ""))


def salvaged_array(text: Column | str) -> Column:
    """A JSON array that was cut off, closed after its last whole object; otherwise as it is."""
    t = unfenced(text)
    last = F.regexp_extract(t, r"(?s)^(\[.*\})", 1)
    return F.when(F.try_parse_json(t).isNotNull(), t).when(last != "", F.concat(last, F.lit("]"))).otherwise(t)


def outermost_object(text: Column | str) -> Column:
    """From the first opening to the last closing brace; null without both."""
    found = F.regexp_extract(col(text), r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def parsed_rows(text: Column | str, schema: str) -> Column:
    """A lenient array of rows: fences off, a cut-off tail dropped, rows that are no objects dropped."""
    return F.filter(F.from_json(salvaged_array(text), f"array<{schema}>"), lambda r: r.isNotNull())


def quoted(text: Column | str) -> Column:
    """A JSON string: quote and backslash escaped, short escapes where they exist, other control characters as \\uXXXX, all else as it is."""
    out = F.replace(F.replace(col(text), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    for code in range(32):
        out = F.replace(out, F.lit(chr(code)), F.lit(short.get(code, f"\\u{code:04x}")))
    return F.concat(F.lit('"'), out, F.lit('"'))


def canonical(fields: dict[str, Column], strings: tuple[str, ...], pretty: bool = False) -> Column:
    """An object with its fields in the given order; those named in ``strings`` are quoted, others are whole numbers. Nulls make the whole null.

    Compact without spaces, or pretty with two spaces of indentation and a line end after it.
    """
    colon, comma = (": ", ",\n") if pretty else (":", ",")
    body = [F.concat(F.lit(("  " if pretty else "") + f'"{n}"{colon}'), quoted(c) if n in strings else c.cast("long").cast("string")) for n, c in fields.items()]
    parts: list[Column] = []
    for k, b in enumerate(body):
        parts += [F.lit(comma), b] if k else [b]
    return F.concat(F.lit("{\n" if pretty else "{"), *parts, F.lit("\n}\n" if pretty else "}"))
