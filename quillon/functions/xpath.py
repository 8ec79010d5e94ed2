"""XPath 1.0 core functions as Column expressions. What is not a number is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def string(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def number(x: Column) -> Column:
    """Decimal numbers only: no exponents, so the text is checked before the cast."""
    text = F.trim(x.cast("string"))
    plain = F.when(text.rlike(r"^-?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?$"), text)
    exponent = x.cast("string").rlike("[eE]")
    return F.when(~exponent, plain.try_cast("double")).otherwise(F.when(F.typeof(x) == "double", x.try_cast("double")))


def boolean(x: Column) -> Column:
    kind = F.typeof(x)
    truth = F.when(kind == "boolean", x.try_cast("boolean")).when(kind.isin("double", "int", "bigint"), x.try_cast("double") != 0).otherwise(F.length(x.cast("string")) > 0)
    return F.coalesce(truth, F.lit(False))


def substring(x: Column, start: Column, length: Column | None = None) -> Column:
    """Positions p with round(start) <= p < round(start) + round(length), as XPath counts."""
    first = rounded(start.cast("double"))
    text = string(x)
    end = first + rounded(length.cast("double")) if length is not None else F.char_length(text).cast("double") + 1
    begin = F.greatest(first, F.lit(1.0))
    size = F.greatest(F.least(end, F.char_length(text).cast("double") + 1) - begin, F.lit(0.0))
    return F.substring(text, begin.cast("int"), size.cast("int"))


def rounded(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("double")


def before(x: Column, mark: Column) -> Column:
    at = F.instr(string(x), string(mark))
    return F.when(at > 0, F.substring(string(x), F.lit(1), at - 1)).otherwise(F.lit(""))


def after(x: Column, mark: Column) -> Column:
    at = F.instr(string(x), string(mark))
    return F.when(at > 0, F.substring(string(x), at + F.char_length(string(mark)), F.char_length(string(x)))).otherwise(F.lit(""))


def split_uri(uri: Column) -> Column:
    """(namespace, local) at the last #, else /, else :; both null where the local part is no name."""
    cut = F.when(uri.contains("#"), F.char_length(uri) - F.char_length(F.substring_index(uri, "#", -1))).when(
        uri.contains("/"), F.char_length(uri) - F.char_length(F.substring_index(uri, "/", -1))
    ).otherwise(F.char_length(uri) - F.char_length(F.substring_index(uri, ":", -1)))
    local = F.substring(uri, cut + 1, F.char_length(uri))
    good = local.rlike(r"^[\p{L}_][\p{L}\p{N}._-]*$")
    return F.struct(F.when(good, F.substring(uri, F.lit(1), cut)).alias("namespace"), F.when(good, local).alias("local"))


FUNCTIONS = {
    "string": string,
    "number": number,
    "boolean": boolean,
    "concat": lambda *a: F.concat(*map(string, a)),
    "starts-with": lambda x, y: F.startswith(string(x), string(y)),
    "ends-with": lambda x, y: F.endswith(string(x), string(y)),
    "contains": lambda x, y: F.contains(string(x), string(y)),
    "substring": substring,
    "substring-before": before,
    "substring-after": after,
    "string-length": lambda x: F.char_length(string(x)).cast("double"),
    "normalize-space": lambda x: F.trim(F.regexp_replace(string(x), r"[ \t\r\n]+", " ")),
    "translate": lambda x, a, b: F.call_function("translate", string(x), a, b),
    "floor": lambda x: F.floor(number(x)).cast("double"),
    "ceiling": lambda x: F.ceil(number(x)).cast("double"),
    "round": lambda x: rounded(number(x)),
    "local-name-from-uri": lambda x: split_uri(x)["local"],
    "namespace-uri-from-uri": lambda x: split_uri(x)["namespace"],
    "+": lambda x, y: number(x) + number(y),
    "-": lambda x, y: number(x) - number(y),
    "div": lambda x, y: F.try_divide(number(x), number(y)),
    "mod": lambda x, y: F.try_mod(number(x), number(y)),
    "match": lambda x, y: F.regexp_like(string(x), y),
    "if": lambda c, a, b: F.when(boolean(c), a).otherwise(b),
}
NUMBERS = {"number", "count", "sum", "string-length", "floor", "ceiling", "round", "position", "last"}
