"""Identifiers of graph nodes, and roman numerals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters of each decimal place, for the digits 0 to 9.
_PLACES = (
    (1000, ("", "M", "MM", "MMM")),
    (100, ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM")),
    (10, ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC")),
    (1, ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")),
)
_VALUES = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def to_roman(n: Column) -> Column:
    """The roman numeral of 1 to 3999; null for anything else."""
    n = n.cast("int")
    letters = [
        F.element_at(F.array(*[F.lit(x) for x in digits]), (F.floor(n / place) % 10 + 1).cast("int")) for place, digits in _PLACES
    ]
    return F.when(n.between(1, 3999), F.concat(*letters))


def from_roman(text: Column) -> Column:
    """The value of a well-formed roman numeral in either case; null for anything else."""
    letters = F.filter(F.split(F.upper(F.trim(text)), ""), lambda c: c != "")
    worth_of = lambda c: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in _VALUES.items()])
    # A letter counts against the sum where a larger one follows.
    total = F.aggregate(
        F.reverse(F.transform(letters, worth_of)),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda acc, v: F.struct((acc["sum"] + F.when(v < acc["last"], -v).otherwise(v)).alias("sum"), v.alias("last")),
        lambda acc: acc["sum"],
    )
    formed = F.upper(F.trim(text)).rlike("^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$") & (F.trim(text) != "")
    return F.when(formed, total)


def _id(corpus: Column | None, *parts: Column | str) -> Column:
    own = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return own if corpus is None else F.concat(corpus.cast("string"), F.lit("."), own)


def article_id(number: Column, corpus: Column | None = None) -> Column:
    return _id(corpus, "Art.", number)


def article_paragraph_id(number: Column, paragraph: Column, corpus: Column | None = None) -> Column:
    return _id(corpus, "Art.", number, ".", paragraph)


def annex_id(number: Column, corpus: Column | None = None) -> Column:
    return _id(corpus, "Annex.", to_roman(number))


def annex_section_id(number: Column, section: Column, corpus: Column | None = None) -> Column:
    """Always below its annex, so sections of different annexes never share an id."""
    return F.concat(annex_id(number, corpus), F.lit(".Sect."), section.cast("string"))


def annex_paragraph_id(number: Column, paragraph: Column, section: Column | None = None, corpus: Column | None = None) -> Column:
    parent = annex_id(number, corpus)
    if section is not None:
        parent = F.when(section.isNull(), parent).otherwise(annex_section_id(number, section, corpus))
    return F.concat(parent, F.lit("."), paragraph.cast("string"))


def recital_id(number: Column, corpus: Column | None = None) -> Column:
    return _id(corpus, "Rec.", number)


def recital_paragraph_id(number: Column, paragraph: Column, corpus: Column | None = None) -> Column:
    return _id(corpus, "Rec.", number, ".", paragraph)


def chapter_id(roman: Column, corpus: Column | None = None) -> Column:
    return _id(corpus, "Chapt", F.upper(roman))


def chapter_section_id(roman: Column, section: Column, corpus: Column | None = None) -> Column:
    return F.concat(chapter_id(roman, corpus), F.lit(".Sect-"), section.cast("string"))


def number_of(node_id: Column) -> Column:
    """The last dot-separated part of an id."""
    return F.substring_index(node_id, ".", -1)
