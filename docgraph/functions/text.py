"""Text rules of pages, paragraphs and cross-references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import from_roman


def none_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def extracted(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where nothing matches or the group is empty."""
    return none_if_empty(F.regexp_extract(text, pattern, group))


# --- pages -----------------------------------------------------------------------------------------


def content_type(title: Column) -> Column:
    """Article, Annex or Recital by the start of the title in any case; null for other titles."""
    low = F.lower(title)
    return (
        F.when(low.startswith("article"), "Article").when(low.startswith("annex"), "Annex").when(low.startswith("recital"), "Recital")
    )


def title_number(title: Column) -> Column:
    """The number in a title; annexes may be numbered in roman or arabic numerals."""
    plain = extracted(title, r"(?i)(?:Article|Recital)\s+(\d+)").cast("int")
    annex = extracted(title, r"(?i)Annex\s+([IVX]+|\d+)")
    return F.coalesce(plain, F.when(annex.rlike(r"^\d+$"), annex.cast("int")).otherwise(from_roman(annex)))


def chapter_meta(text: Column) -> Column:
    """[number, name] of a link such as "Chapter III: Title"; null otherwise."""
    pattern = r"Chapter\s+([IVXL]+):\s*(.+)"
    return F.when(text.rlike(pattern), F.array(F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)))


def section_meta(text: Column) -> Column:
    """[number, name] of a link such as "Section 2: Title"; null otherwise."""
    pattern = r"Section\s+(\d+):\s*(.+)"
    return F.when(text.rlike(pattern), F.array(F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)))


def indent_level(style: Column) -> Column:
    """The nesting level of a padded block, 40 units a level; null without padding."""
    return F.floor(extracted(style, r"padding-left:\s*(\d+)").cast("int") / 40).cast("int")


def is_noise(text: Column, recital: bool = False) -> Column:
    """Whether a block is empty or a foot-note mark."""
    mark = text.rlike(r"^\[\d+\]") if recital else text.startswith("[*]") | text.startswith("[58]")
    return text.isNull() | (text == "") | mark


def paragraph_marker(text: Column) -> Column:
    """The number or letter that a paragraph starts with: "N.", "(N)", "(a)" or "(ii)"; else null."""
    head = F.substring(text, 1, 5)
    return F.coalesce(*[extracted(head, p) for p in (r"^(\d+)\.", r"^\((\d+)\)", r"^\(([a-z])\)", r"^\(([ivxlcdm]+)\)")])


def clean_text(text: Column) -> Column:
    """The text without a closing list of related recitals, trimmed on the right.

    Such a list is "Related:", "Recital" or "Recitals", and one number or several, the last after "and".
    """
    tail = F.substring_index(text, "Related:", -1)
    words = F.array_remove(F.split(F.translate(tail, ",", " "), r"\s+"), "")
    n = F.size(words)
    number = lambda w: w.rlike(r"^\d+$")
    several = (n >= 4) & (F.get(words, n - 2) == "and") & F.forall(F.slice(words, F.lit(2), F.greatest(n - 3, F.lit(0))), number)
    listed = text.contains("Related:") & F.get(words, F.lit(0)).isin("Recital", "Recitals") & number(F.get(words, n - 1)) & ((n == 2) | several)
    body = F.substring(text, F.lit(1), F.char_length(text) - F.char_length(tail) - len("Related:"))
    return F.regexp_replace(F.when(listed, body).otherwise(text), r"\s+$", "")


# --- links and references ----------------------------------------------------------------------------

#: Link kinds, in the order in which they are tried.
LINK_KINDS = (("/article/", "article"), ("/chapter/", "chapter"), ("/section", "section"), ("/annex/", "annex"), ("/recital/", "recital"))


def link_kind(href: Column) -> Column:
    kinds = [F.when(href.contains(part), F.lit(kind)) for part, kind in LINK_KINDS]
    return F.coalesce(*kinds)


def url_number(href: Column, kind: str) -> Column:
    """The number after /kind/ in a link."""
    pattern = r"(?i)\barticle/(\d+)\b" if kind == "article" else rf"(?i)/{kind}/(\d+)/?"
    return F.regexp_extract(href, pattern, 1).try_cast("int")  # no match gives an empty text, so null


def _tokens(context: Column) -> Column:
    """The context in a plain spelling: bracketed numbers and letters as <5> and <a>, "to" or a dash as ~, commas as &, "and" and "or"
    (after a comma or not) as +, all without the space around them; what is left has single spaces."""
    text = F.regexp_replace(F.lower(F.coalesce(context, F.lit(""))), r"\(\s*(\d+|[a-z])\s*\)", "<$1>")
    for spelling, token in ((r"(?<=[\d>])(?:\s*\bto\b\s*|\s*[-–]\s*)(?=[\d<])", "~"), (r"\s*,?\s*\b(?:and|or)\b\s*", "+"), (r"\s*,\s*", "&"), (r"\s+", " ")):
        text = F.regexp_replace(text, spelling, token)
    return text


#: Over these tokens a clause is a paragraph or a range of paragraphs, with letters right after it or not, or "point(s)" with letters or
#: plain numbers. A list ends with its "+".
_LETTERS = r"<[a-z]>(?:&<[a-z]>)*(?:\+<[a-z]>)?"
_CLAUSES = rf"<\d+>(?:~<\d+>)?(?:(?:points? )?{_LETTERS})?|\bpoints? (?:{_LETTERS}|\d+(?:~\d+|(?:&\d+)*(?:\+\d+)?)\b)"


def citations(context: Column) -> Column:
    """The citations in the text after a link, left to right: array of (paragraph, points).

    "(2) to (4)" gives a paragraph each; letters right after a paragraph are its points; "points 2
    to 8" and "points (a) and (b)" have points only. Reversed ranges are turned round. No citation: empty.
    """
    clauses = F.regexp_extract_all(_tokens(context), F.lit(_CLAUSES), F.lit(0))
    # Each step of a clause is a transform of its own, so that the ones after it read its value and do not work it out again.
    found = lambda clause, pattern: F.regexp_extract_all(clause, F.lit(pattern), F.lit(1))
    parts = F.transform(clauses, lambda c: F.struct(c.alias("clause"), found(c, r"(\d+)").cast("array<int>").alias("numbers"), found(c, r"<([a-z])>").alias("letters")))
    spread = F.transform(parts, lambda x: F.struct(x["clause"].startswith("<").alias("of_paragraphs"), _spread(x["clause"], x["numbers"]).alias("numbers"), F.when(F.size(x["letters"]) > 0, x["letters"]).alias("points")))
    cited = F.flatten(F.transform(spread, _cited))
    return F.when(_may_cite(context), cited).otherwise(F.array().cast("array<struct<paragraph:int,points:array<string>>>"))


def _may_cite(context: Column) -> Column:
    """Whether a text has what every clause has: a bracket, or the word "point"."""
    return F.coalesce(context.rlike(r"(?i)[(<]|point"), F.lit(False))


def _spread(clause: Column, numbers: Column) -> Column:
    """The numbers of a clause, of a range all of them."""
    return F.when(clause.contains("~"), F.sequence(F.array_min(numbers), F.array_max(numbers))).otherwise(numbers)


def _cited(x: Column) -> Column:
    """The citations of one clause (of_paragraphs, numbers, points)."""
    cited = lambda p, q: F.struct(p.cast("int").alias("paragraph"), q.cast("array<string>").alias("points"))
    of_paragraphs = F.transform(x["numbers"], lambda p: cited(p, x["points"]))
    return F.when(x["of_paragraphs"], of_paragraphs).otherwise(F.array(cited(F.lit(None), F.coalesce(x["points"], x["numbers"].cast("array<string>")))))


def section_numbers(text: Column) -> Column:
    """The numbers of "Section 2" or "Sections 1, 2 and 3"; empty if there is none."""
    body = F.regexp_extract(text, r"(?i)Sections?\s+((?:\d+\s*(?:,|and)?\s*)+)", 1)
    return F.regexp_extract_all(body, F.lit(r"\d+"), F.lit(0))


# --- token counts -------------------------------------------------------------------------------------


def tokens(text: Column) -> Column:
    """The lower-cased words of a text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")


def rough_token_count(text: Column) -> Column:
    return F.greatest(F.lit(1), F.size(tokens(text)))


def token_jaccard(a: Column, b: Column) -> Column:
    """The Jaccard similarity of two token sets; 0 if one is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def keyword_relevance(query: Column, text: Column) -> Column:
    """The share of the query's distinct words that are in the text; 0 if one is empty."""
    q, t = F.array_distinct(tokens(query)), tokens(text)
    return F.when((F.size(q) > 0) & (F.size(t) > 0), F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(F.lit(0.0))


def final_answer(text: Column) -> Column:
    """What follows "FINAL:" in any case, trimmed; null where it is absent."""
    return F.when(text.rlike("(?i)FINAL:"), F.trim(F.regexp_extract(text, r"(?is)FINAL:\s*(.*)$", 1)))
