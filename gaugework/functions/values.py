"""Numbers, JSON and text forms as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from gaugework.functions.words import folded


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def close(a: Column, b: Column, relative: float = 1e-9, absolute: float = 1e-12) -> Column:
    """Equal within a tolerance; NULL is close to NULL alone."""
    near = F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise((a == b) | near)


def clamped(value: Column, low: float | None, high: float | None) -> Column:
    value = value if low is None else F.when(value.isNotNull(), F.greatest(value, F.lit(float(low))))
    return value if high is None else F.when(value.isNotNull(), F.least(value, F.lit(float(high))))


#: A JSON string, or a number whose fraction is zeros.
_WHOLE = r'("(?:[^"\\]++|\\.)*+")|(-?\d+)\.0+(?![0-9eE])'


def canonical(value: Column) -> Column:
    """JSON text of a VARIANT with sorted keys, in which equal values of JSON are equal texts; numbers of one value too
    (1, 1.0 and 1e0 at the top, 1 and 1.0 inside). SQL NULL for an absent member, 'null' for a JSON null."""

    def text(v: Column) -> Column:
        number = once(F.schema_of_variant(v), lambda k: k.isin("BIGINT", "DOUBLE", "FLOAT") | k.startswith("DECIMAL"))
        shown_ = lambda d: F.when(F.abs(d) < 2.0**53, F.when(d == F.floor(d), d.cast("bigint").cast("string")).otherwise(d.cast("string"))).otherwise(F.to_json(v))
        return F.when(v.isNull(), None).when(number, once(F.try_variant_get(v, "$", "double"), shown_)).otherwise(F.regexp_replace(F.to_json(v), _WHOLE, "$1$2"))

    return once(value, text)


def folded_json(value: Column) -> Column:
    """A string in folded form; any other JSON as the folded text of its canonical form."""
    return F.when(F.schema_of_variant(value) == "STRING", folded(F.try_variant_get(value, "$", "string"))).otherwise(folded(canonical(value)))


def member(*names: str) -> str:
    """The path of a member of a VARIANT, whatever characters its names hold, except both kinds of quotes in one."""
    for n in names:
        if "'" in n and '"' in n:
            raise ValueError(f"a member's name cannot hold both kinds of quotes: {n}")
    return "$" + "".join(f'["{n}"]' if "'" in n else f"['{n}']" for n in names)


def at_path(record: Column, dotted: str) -> Column:
    """The member that a dotted path names, as VARIANT: SQL NULL where it is absent, a JSON null where it is null."""
    return F.try_variant_get(record, member(*dotted.split(".")), "variant")


def merged(a: Column, b: Column) -> Column:
    """Distinct items of both lists, in the order of their first appearance; a NULL list is empty."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(a, none), F.coalesce(b, none)))


def unfenced(text: Column) -> Column:
    """The content of a text that is one fenced block, whatever language the fence names; other texts as they are."""
    return F.trim(F.regexp_replace(F.trim(text), r"(?s)\A```[A-Za-z0-9_-]*[ \t]*\n?(.*?)\n?```\z", "$1"))


def annotation_text(text: Column) -> Column:
    """Escaped for a workflow command's message; the per cent sign first."""
    return F.replace(F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def annotation_title(text: Column) -> Column:
    return F.replace(F.replace(annotation_text(text), F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C"))


def shown(value: Column, digits: int = 4) -> Column:
    """A double to so many significant digits, as Python's g format: without trailing zeros, with an exponent below 1e-4 and
    from 10**digits on; 'none' for NULL. A tie of its shortest decimal form is rounded up."""
    number = value.cast("double")
    parts = F.split(F.format_string(f"%.{digits - 1}e", number), "e")
    power = F.try_element_at(parts, F.lit(2)).cast("int")
    bare = lambda t: F.when(t.contains("."), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)
    fixed = F.concat_ws("e", parts).try_cast(f"decimal(38,{digits + 4})").cast("string")
    far = (power < -4) | (power >= digits)
    text = F.when(far, F.concat(bare(parts[0]), F.lit("e"), F.try_element_at(parts, F.lit(2)))).otherwise(F.when(number == 0, "0").otherwise(bare(fixed)))
    return F.when(value.isNull(), "none").when(F.isnan(number), "nan").when(F.abs(number) == float("inf"), F.when(number > 0, "inf").otherwise("-inf")).otherwise(text)
