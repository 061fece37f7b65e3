"""Text helpers as Column expressions."""

from pyspark.sql import Column, functions as F

#: Fixed value: the white space at which words are split (Unicode white space and the four separators), as a class and
#: as its characters.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x20), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def words(text: Column) -> Column:
    """Split at a plain blank after all white space has become one: no regular expression per row."""
    return F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), lambda x: x != "")


def tokens(text: Column) -> Column:
    return F.array_distinct(words(text))


def folded(text: Column) -> Column:
    """Lower case, white space collapsed: the form in which leaks are compared."""
    return F.array_join(words(F.lower(text)), " ")


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")
