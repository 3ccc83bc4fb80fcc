"""Scalar Column helpers (all JVM-side built-ins, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from raterlab import constants as C


def pseudonym(x: Column, n: int = C.PSEUDONYM_HEX_CHARS) -> Column:
    """first ``n`` hex chars of md5 of the text form; a null hashes the text ``None``."""
    return F.substring(F.md5(F.coalesce(x.cast("string"), F.lit("None"))), 1, n)


def _escape_controls(x: Column, form: str) -> Column:
    """The remaining control characters written as ``form`` (e.g. ``\\u%04x``); most texts have none."""
    esc = x
    for code in range(32):
        if chr(code) not in "\n\r\t":
            esc = F.replace(esc, F.lit(chr(code)), F.lit(form % code))
    return F.when(x.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), esc).otherwise(x)


def json_string(x: Column) -> Column:
    """Quote ``x`` as a JSON string literal (escapes backslash, quote and all control characters)."""
    esc = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    esc = F.replace(esc, F.lit('"'), F.lit('\\"'))
    esc = F.replace(esc, F.lit("\n"), F.lit("\\n"))
    esc = F.replace(esc, F.lit("\r"), F.lit("\\r"))
    esc = _escape_controls(F.replace(esc, F.lit("\t"), F.lit("\\t")), "\\u%04x")
    return F.concat(F.lit('"'), esc, F.lit('"'))


def json_string_array(arr: Column) -> Column:
    """``array<string>`` → JSON array text, item order kept."""
    return F.concat(F.lit("["), F.array_join(F.transform(arr, json_string), ", "), F.lit("]"))


def python_literal_list(arr: Column) -> Column:
    """``array<string>`` → a Python list literal in single quotes (``['a', 'b']``)."""
    def q(x):
        esc = F.replace(x, F.lit("\\"), F.lit("\\\\"))
        esc = F.replace(esc, F.lit("'"), F.lit("\\'"))
        esc = F.replace(esc, F.lit("\n"), F.lit("\\n"))
        esc = F.replace(esc, F.lit("\r"), F.lit("\\r"))
        esc = _escape_controls(F.replace(esc, F.lit("\t"), F.lit("\\t")), "\\x%02x")
        return F.concat(F.lit("'"), esc, F.lit("'"))
    return F.concat(F.lit("["), F.array_join(F.transform(arr, q), ", "), F.lit("]"))


# \xNN escapes are not JSON: rewrite them to \u00NN, leaving escaped backslashes alone
_HEX_ESCAPE = r"(?<!\\)((?:\\\\)*)\\x([0-9a-fA-F]{2})"


def parse_python_list(x: Column) -> Column:
    """Python-literal list of strings (``"['a', \"b\"]"``) → ``array<string>``.

    Jackson accepts single-quoted strings and ``\\'``; unparsable text → NULL.
    """
    fixed = F.regexp_replace(x, _HEX_ESCAPE, r"$1\\u00$2")
    return F.from_json(fixed, "array<string>", {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})


def _literal_lists(values):
    """Lists and tuples of strings and None, as the Python literals that they are; null for any other text."""
    import ast

    import pandas as pd

    def parse(text):
        if text is None:
            return None
        try:
            value = ast.literal_eval(text.strip())
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return None
        whole = isinstance(value, (list, tuple)) and all(v is None or isinstance(v, str) for v in value)
        return list(value) if whole else None
    return pd.Series([parse(v) for v in values])


def parse_python_literal(x: Column) -> Column:
    """F3 for every legal literal: the native parser first; only text that it cannot read (tuples, 8-digit escapes, joined
    strings, None) reaches Python, in Arrow batches in which all other rows are null."""
    from pyspark.sql.functions import pandas_udf
    native = parse_python_list(x)
    rest = pandas_udf(_literal_lists, "array<string>")(F.when(native.isNull(), x))
    return F.coalesce(native, rest)


def parse_python_spans(x: Column) -> Column:
    """F3 for ``"[(1, 4), (7, 9)]"`` → ``array<struct<start,end>>``."""
    arr = F.from_json(F.translate(x, "()", "[]"), "array<array<int>>")
    return F.transform(arr, lambda p: F.struct(p[0].alias("start"), p[1].alias("end")))


def spans_to_text(spans: Column) -> Column:
    """``array<struct<start,end>>`` → Python tuple-list text ``[(s, e), ...]`` (sink format)."""
    return F.concat(F.lit("["), F.array_join(F.transform(
        spans, lambda s: F.format_string("(%d, %d)", s["start"], s["end"])), ", "), F.lit("]"))


def span_text(text: Column, span: Column) -> Column:
    """F8: substring covered by an inclusive span."""
    return F.substring(text, span["start"] + 1, span["end"] - span["start"] + 1)


def span_chars(spans: Column, inclusive: bool = True) -> Column:
    """total length of spans, ``e-s+1`` (inclusive) or ``e-s``; null array → 0."""
    extra = 1 if inclusive else 0
    return F.aggregate(F.coalesce(spans, F.array().cast("array<struct<start:int,end:int>>")),
                       F.lit(0).cast("bigint"),
                       lambda acc, s: acc + (s["end"] - s["start"] + extra))


def span_overlaps(a: Column, b: Column) -> Column:
    """Every (a, b) pair with a non-empty inclusive intersection → ``(max start, min end)``.

    Pairs are not de-duplicated (two predictions over one truth span both count).
    """
    def per_a(x):
        hits = F.filter(b, lambda y: F.greatest(x["start"], y["start"]) <= F.least(x["end"], y["end"]))
        return F.transform(hits, lambda y: F.struct(F.greatest(x["start"], y["start"]).alias("start"),
                                                    F.least(x["end"], y["end"]).alias("end")))
    return F.flatten(F.transform(F.coalesce(a, F.array().cast("array<struct<start:int,end:int>>")), per_a))


def mean_pm(mean: Column, three_sd: Column) -> Column:
    """``round(mean,3) ± round(3·sd,2)`` as text, half-even like numpy."""
    return F.concat(F.bround(mean, 3).cast("string"), F.lit("±"), F.bround(three_sd, 2).cast("string"))


def literal_replace(template: Column, token: str, value: Column) -> Column:
    """literal (non-regex) substitution of every occurrence of ``token``."""
    return F.replace(template, F.lit(token), value)
