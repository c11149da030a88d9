"""Splitting of fields that hold several values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Brackets that may wrap the whole field.
_OPEN, _CLOSE = "\\[{(", "\\])}"
#: Delimiters that always separate.
_STRONG = ",;|\\t\\r\\n、，；"
#: Delimiters that separate only with white space on both sides.
_SPACED = "&+/·"
#: A span in double or single quotes that stands as a whole value.
QUOTED = (
    rf"(?<=^|[\s{_STRONG}{_SPACED}{_OPEN}])"
    r"(?:\"(?:[^\"\\]|\\.|\"\")*+\"|'(?:[^'\\]|\\.|'')*+')"
    rf"(?=$|[\s{_STRONG}{_SPACED}{_CLOSE}])"
)
#: A character outside quotes that a backslash protects.
ESCAPED = r"\\."
_DELIM = rf"\s*(?:[{_STRONG}]|(?<=^|\s)[{_SPACED}](?=\s|$))\s*"
#: Marks of a placeholder; the field's own occurrences are protected like quoted spans.
_L, _R = "\ue000", "\ue001"
_SPAN = rf"(?s){QUOTED}|{ESCAPED}|[{_L}{_R}]"


def _unquote(span: Column) -> Column:
    """The value of a protected span."""
    inner = F.substring(span, F.lit(2), F.length(span) - 2)
    first = F.substring(span, 1, 1)

    def plain(quote: str) -> Column:
        # Pairs of backslashes cut the text, so that none of their halves is read again.
        def part(x: Column) -> Column:
            x = F.regexp_replace(x, quote + quote, quote)
            x = F.replace(F.replace(F.replace(x, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
            return F.regexp_replace(x, r"\\(?!u[0-9a-fA-F]{4})(.)", "$1")

        return F.array_join(F.transform(F.split(inner, r"\\\\", -1), part), "\\")

    def json(x: Column) -> Column:
        return F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), x, F.lit("}")), "$.v"), plain('"'))

    uni = span.rlike(r"\\u[0-9a-fA-F]{4}")
    return (
        F.when((first == '"') & uni, json(span))
        .when(first == '"', plain('"'))
        .when(first == "'", plain("'"))
        .when(first == "\\", F.substring(span, 2, 1))
        .otherwise(span)
    )


def with_values(df: DataFrame, field: str, out: str) -> DataFrame:
    """``df`` with the values of a packed field as ``array<string>``, in the order written.

    Quoted spans and characters after a backslash are replaced by indexed
    placeholders (the placeholder's own marks count as such a span, so none can
    collide), the rest is split, and the spans are put back through an array
    lookup. Where no other delimiter occurs, runs of white space separate.

    A null gives null; an empty field, brackets around nothing and empty places
    give no value. Values written twice stay twice. A quoted empty or blank value
    is empty and gives none. An unclosed quote is an ordinary character.

    The steps are separate projections, so that each is computed once a row.
    """
    keep = df.columns
    n = f"_{out}_"
    s, spans, held, parts = (F.col(n + x) for x in ("s", "spans", "held", "parts"))
    guarded = s.rlike(rf"[\"'\\{_L}{_R}]")
    d = df.withColumn(n + "s", F.regexp_replace(field, r"^\s+|\s+$", ""))
    d = d.withColumn(n + "spans", F.when(guarded, F.regexp_extract_all(s, F.lit(f"({_SPAN})"), 1)))
    marked = F.array_join(
        F.transform(
            F.split(s, _SPAN, -1),
            lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit(_L), (i - 1).cast("string"), F.lit(_R), x)),
        ),
        "",
    )
    marked = F.when(guarded, marked).otherwise(s)
    d = d.withColumn(n + "held", F.regexp_replace(marked, rf"(?s)^[{_OPEN}]\s*(.*?)\s*[{_CLOSE}]$", "$1"))
    d = d.withColumn(n + "parts", F.when(held.rlike(_DELIM), F.split(held, _DELIM, -1)).otherwise(F.split(held, r"\s+", -1)))

    def restore(p: Column) -> Column:
        return F.array_join(
            F.transform(
                F.split(p, _L, -1),
                lambda b, i: F.when(i == 0, b).otherwise(
                    F.concat(_unquote(F.get(spans, F.substring_index(b, _R, 1).cast("int"))), F.substring_index(b, _R, -1))
                ),
            ),
            "",
        )

    put = F.transform(parts, lambda p: F.when(F.contains(p, F.lit(_L)), F.regexp_replace(restore(p), r"^[\s\u00a0]+|[\s\u00a0]+$", "")).otherwise(p))
    d = d.withColumn(out, F.filter(F.when(F.size(spans) > 0, put).otherwise(parts), lambda v: v != ""))
    return d.select(*[F.col(f"`{c}`") for c in keep if c != out], out)
