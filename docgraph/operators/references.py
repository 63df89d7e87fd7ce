"""Cross-references: from the links of blocks to one long table of what cites what.

A link is (src_id, ord, href, text, before, after): its block, its place there, its anchor text, and the
text before and after it; ``after`` starts with the anchor text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ids import from_roman
from .checkpoints import cut


def _place(pos: Column, i: Column) -> Column:
    """A number that orders links by block, then by place in it; a block may have 2^32 of them."""
    return F.shiftleft(pos.cast("long"), 32) + i


def harvest_links(blocks: DataFrame, src_id: str = "doc_id", also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, src_id, ord, href, text, before, after): every link of (doc_id, pos, links), with the columns ``also`` of its block."""
    return blocks.select("doc_id", F.col(src_id).alias("src_id"), "pos", *also, F.posexplode("links").alias("_i", "_l")).select(
        "doc_id", "src_id", _place(F.col("pos"), F.col("_i")).alias("ord"), "_l.href", "_l.text", "_l.before", "_l.after", *also
    )


def _trail(links: DataFrame) -> DataFrame:
    return links.withColumn("trail", F.substring(F.col("after"), F.char_length("text") + 1, F.lit(2**31 - 1)))


def _first(rows: DataFrame, *keys: str) -> DataFrame:
    """Of rows with equal keys (null equals null), the first by ord."""
    order = Window.partitionBy(*keys).orderBy("ord", F.coalesce(F.col("sub"), F.lit(0)) if "sub" in rows.columns else F.lit(0))
    return rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def parsed_links(links: DataFrame) -> DataFrame:
    """(src_id, kind, ord, sub, number, paragraph, points, section, text, after): what links to articles, annexes and chapters cite.

    One pass over the links. Of articles and annexes a row for each citation after the link, of chapters for each section that
    "Section(s) N, N and N" names after the link, else before it; a bare row where there is none. The number of an annex counts only if
    it is that of the anchor's last word in roman. Of like rows of a block the first stays.
    """
    number = {kind: T.url_number(F.col("href"), kind) for kind in ("article", "annex", "chapter")}
    number["annex"] = F.when(number["annex"] == from_roman(F.element_at(F.split("text", " "), -1)), number["annex"])
    rows = _trail(links).select("*", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), n.alias("number")) for k, n in number.items()]))).where("number is not null")
    after, before = T.section_numbers(F.col("trail")), T.section_numbers(F.col("before"))
    named = F.transform(F.when(F.size(after) > 0, after).otherwise(before), lambda x: _what(None, None, x))
    cited = F.transform(T.citations(F.col("trail")), lambda c: _what(c["paragraph"], c["points"], None))
    rows = rows.select("src_id", "kind", "ord", "number", "text", "after", F.posexplode_outer(F.when(F.col("kind") == "chapter", named).otherwise(cited)).alias("sub", "_w"))
    rows = rows.select("src_id", "kind", "ord", "sub", "number", "_w.*", "text", "after")
    return _first(rows, "src_id", "kind", "number", "paragraph", "points", "section")


def _what(paragraph, points, section) -> Column:
    own = lambda x, kind, name: (F.lit(None) if x is None else x).cast(kind).alias(name)
    return F.struct(own(paragraph, "int", "paragraph"), own(points, "array<string>", "points"), own(section, "string", "section"))


def article_refs(links: DataFrame) -> DataFrame:
    """(src_id, ord, sub, number, paragraph, points, text, after): what links to articles cite."""
    return parsed_links(links).where("kind = 'article'").select("src_id", "ord", "sub", "number", "paragraph", "points", "text", "after")


def annex_refs(links: DataFrame) -> DataFrame:
    """The same for annexes."""
    return parsed_links(links).where("kind = 'annex'").select("src_id", "ord", "sub", "number", "paragraph", "points", "text", "after")


def chapter_refs(links: DataFrame) -> DataFrame:
    """(src_id, ord, sub, number, section, is_section, text, after): chapters, and their sections where named."""
    rows = parsed_links(links).where("kind = 'chapter'")
    return rows.select("src_id", "ord", "sub", "number", "section", F.col("section").isNotNull().alias("is_section"), "text", "after")


def match_context_to_link(links: DataFrame, refs: DataFrame) -> DataFrame:
    """Pairs links with the ``parsed_links`` of the same block and kind whose context fits the anchor text.

    article: the context starts with the anchor, or the anchor ends with the context; annex: the context starts
    or ends with it; chapter: starts with it, or (chapter rows only) ends with it. Of each context the beginnings and ends of the lengths
    that anchors of its block and kind have are joined with the anchors by equality, so a block with many links is not squared.
    """
    l, key = links.withColumn("kind", T.link_kind(F.col("href"))), ["src_id", "kind"]
    # Beginnings, and but for articles ends, of contexts, as long as an anchor.
    lengths = l.groupBy(*key).agg(F.collect_set(F.char_length("text")).alias("_lengths"))
    inside = F.filter("_lengths", lambda n: n <= F.char_length("after"))
    cuts = F.transform(inside, lambda n: F.substring("after", F.lit(1), n))
    tails = F.when(F.col("kind") == "article", F.array().cast("array<string>")).otherwise(F.transform(inside, lambda n: F.right("after", n)))
    pieces = refs.join(lengths, key).select(*refs.columns, F.explode(F.array_distinct(F.concat(cuts, tails))).alias("_piece"))
    joined = _paired(l, "text", pieces, "_piece")
    # Ends of the anchors of articles that are longer than a context.
    articles, contexts = l.where("kind = 'article'"), refs.where("kind = 'article'")
    shorter = contexts.groupBy("src_id").agg(F.collect_set(F.char_length("after")).alias("_lengths"))
    ends = F.transform(F.filter("_lengths", lambda n: n < F.char_length("text")), lambda n: F.right("text", n))
    articles = articles.join(shorter, "src_id").select(*l.columns, F.explode(ends).alias("_piece"))
    joined = joined.unionByName(_paired(articles, "_piece", contexts, "after"))
    kind, starts = F.col("l.kind"), F.col("r.after").startswith(F.col("l.text"))
    as_section = (kind == "chapter") & starts & F.col("r.section").isNotNull()
    part = F.concat_ws(".", T.url_number(F.col("l.href"), "chapter").cast("string"), "r.section")
    return joined.select(
        F.col("l.src_id"), F.col("l.ord"), F.col("r.ord").alias("ref_ord"), F.col("r.sub"),
        F.when(as_section, F.concat(F.col("l.text"), F.lit(" Section "), "r.section")).otherwise(F.col("l.text")).alias("text"), F.col("l.href").alias("url"),
        F.when(as_section, "section").otherwise(kind).alias("kind"), F.when(as_section, part).otherwise(F.col("r.number").cast("string")).alias("number"),
        "r.paragraph", "r.points",
    )


def _paired(links: DataFrame, of_link: str, refs: DataFrame, of_ref: str) -> DataFrame:
    """(l, r): the links and references of one block and kind whose columns ``of_link`` and ``of_ref`` are equal."""
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("src_id", "kind")] + [F.col(f"l.{of_link}") == F.col(f"r.{of_ref}")]
    own = [F.struct(*[F.col(f"{side}.{c}").alias(c) for c in df.columns if c != "_piece"]).alias(side) for side, df in (("l", links), ("r", refs))]
    return links.alias("l").join(refs.alias("r"), on).select(*own)


def first_links(links: DataFrame) -> DataFrame:
    """Of the links of a block with one anchor text and kind (and chapter) the first: the others give the same references."""
    kind = T.link_kind(F.col("href"))
    rows = links.withColumns({"_kind": kind, "_chapter": F.when(kind == "chapter", T.url_number(F.col("href"), "chapter"))})
    return _first(rows, "src_id", "_kind", "text", "_chapter").drop("_kind", "_chapter")


def explode_points(refs: DataFrame) -> DataFrame:
    """References with more than one point become one row each; others stay."""
    several = F.size("points") > 1
    one = F.when(several, F.transform("points", lambda p: F.array(p))).otherwise(F.array("points"))
    return refs.select(*[c for c in refs.columns if c != "points"], F.posexplode(one).alias("point_no", "points"))


def section_refs(links: DataFrame) -> DataFrame:
    """Links to sections ("{number}.{last word of the anchor}") and to recitals (their number)."""
    kind = T.link_kind(F.col("href"))
    section, recital = T.url_number(F.col("href"), "section"), T.url_number(F.col("href"), "recital")
    number = F.when(kind == "section", F.concat_ws(".", F.nullif(section.cast("string"), F.lit("")), F.element_at(F.split("text", " "), -1)))
    rows = links.select(
        "src_id", "ord", "text", F.col("href").alias("url"), kind.alias("kind"), F.coalesce(number, recital.cast("string")).alias("number"),
        section.alias("_s"), recital.alias("_r"),
    )
    rows = rows.where("kind = 'section' and _s is not null or kind = 'recital' and _r is not null")
    return rows.select("src_id", "ord", "text", "url", "kind", "number")


def dedupe_refs(refs: DataFrame) -> DataFrame:
    """Per block and kind, the first reference of each number; of articles, of each number, paragraph and points."""
    article = F.col("kind") == "article"
    key = F.when(article, F.concat_ws("_", F.col("number"), F.coalesce(F.col("paragraph").cast("string"), F.lit("-")), F.coalesce(F.array_join("points", ","), F.lit("-"))))
    rows = refs.withColumn("_key", F.coalesce(key, F.col("number")))
    return _first(rows, "src_id", "kind", "_key").drop("_key")


def element_references(links: DataFrame) -> DataFrame:
    """All references of blocks: (src_id, kind, number, paragraph, points, text, url, ord), deduplicated; ord is their order in a block.

    Links of which a column ``alone`` says that their block has no other are not joined, see ``lone_references``.
    """
    if "alone" in links.columns:
        several = links.where("not alone").drop("alone")
        lone = lone_references(links.where("alone"))
        return lone if several.isEmpty() else lone.unionByName(element_references(several))
    # Both are read several times; links are parsed, and their contexts searched, only once.
    cited = explode_points(match_context_to_link(cut(first_links(links)), cut(parsed_links(links))))
    others = section_refs(links).select(
        "*", F.col("ord").alias("ref_ord"), F.lit(0).alias("sub"), F.lit(None).cast("int").alias("paragraph"),
        F.lit(None).cast("array<string>").alias("points"), F.lit(0).alias("point_no"),
    )
    every = cited.unionByName(others)
    order = Window.partitionBy("src_id").orderBy("ord", "ref_ord", F.coalesce("sub", F.lit(0)), "point_no")
    every = every.withColumn("ord", F.row_number().over(order)).drop("sub")
    return dedupe_refs(every).select("src_id", "kind", "number", "paragraph", "points", "text", "url", "ord")


def lone_references(links: DataFrame) -> DataFrame:
    """``element_references`` of links that are the only ones of their blocks.

    Such a link meets its own context and no other, so its references are told from its row alone, without a shuffle.
    """
    kind, text, after = F.col("kind"), F.col("text"), F.col("after")
    rows = links.select("src_id", "href", "text", "before", "after", T.link_kind(F.col("href")).alias("kind"))
    last_word = F.element_at(F.split(text, " "), -1)
    annex, section = T.url_number(F.col("href"), "annex"), T.url_number(F.col("href"), "section")
    number = (
        F.when(kind == "article", T.url_number(F.col("href"), "article").cast("string")).when(kind == "annex", F.when(annex == from_roman(last_word), annex).cast("string"))
        .when(kind == "section", F.when(section.isNotNull(), F.concat_ws(".", section.cast("string"), last_word)))
        .when(kind.isin("chapter", "recital"), F.coalesce(*[F.when(kind == k, T.url_number(F.col("href"), k)) for k in ("chapter", "recital")]).cast("string"))
    )
    starts = after.startswith(text)
    fits = (
        F.when(kind == "article", starts | (F.char_length(after) < F.char_length(text)) & text.endswith(after))
        .when(kind.isin("annex", "chapter"), starts | after.endswith(text)).otherwise(F.lit(True))
    )
    trail = F.substring("after", F.char_length("text") + 1, F.lit(2**31 - 1))
    rows = rows.select("*", F.when(fits, number).alias("number"), starts.alias("_starts"), trail.alias("_trail"))
    rows = rows.select("*", F.when(_numbered(kind, "article", "annex"), _cited_keys(F.col("_trail"))).alias("_cited"), F.when(_numbered(kind, "chapter"), _named(F.col("_trail"), F.col("before"))).alias("_named"))
    whole = F.array(F.lit(_WHOLE))
    # What is listed here is a block's references in order, alike ones once; of an annex, and of a chapter without its sections, there is one.
    listed = (
        F.when(F.col("number").isNull(), F.array().cast("array<string>")).when((kind == "article") & (F.size("_cited") > 0), F.array_distinct("_cited"))
        .when((kind == "annex") & (F.size("_cited") > 0), F.slice("_cited", 1, 1)).when((kind == "chapter") & F.col("_starts") & (F.size("_named") > 0), F.array_distinct("_named")).otherwise(whole)
    )
    rows = rows.select("src_id", "kind", "number", "text", "href", F.posexplode(listed).alias("_i", "_what"))
    own = lambda place: F.when(kind.isin("article", "annex"), F.nullif(F.substring_index("_what", _PARTS, place), F.lit("")))
    as_section = (kind == "chapter") & (F.col("_what") != _WHOLE)
    return rows.select(
        "src_id", F.when(as_section, "section").otherwise(kind).alias("kind"), F.when(as_section, F.concat_ws(".", "number", "_what")).otherwise(F.col("number")).alias("number"),
        own(1).cast("int").alias("paragraph"), F.when(own(-1).isNotNull(), F.array(own(-1))).alias("points"),
        F.when(as_section, F.concat(text, F.lit(" Section "), "_what")).otherwise(text).alias("text"), F.col("href").alias("url"), (F.col("_i") + 1).alias("ord"),
    )


#: Between a paragraph and a point of it; alone, it stands for the whole of a document.
_PARTS = "_"
_WHOLE = _PARTS


def _numbered(kind: Column, *kinds: str) -> Column:
    return F.col("number").isNotNull() & kind.isin(*kinds)


def _cited_keys(trail: Column) -> Column:
    """The citations after a link, a point each, as "paragraph_point"; what is not named is empty."""
    points = lambda c: F.when(F.size(c["points"]) > 0, c["points"]).otherwise(F.array(F.lit("")))
    return F.flatten(F.transform(T.citations(trail), lambda c: F.transform(points(c), lambda p: F.concat(F.coalesce(c["paragraph"].cast("string"), F.lit("")), F.lit(_PARTS), p))))


def _named(trail: Column, before: Column) -> Column:
    """The numbers of the sections of a chapter that a link names: after it, else before it."""
    after = T.section_numbers(trail)
    return F.when(F.size(after) > 0, after).otherwise(T.section_numbers(before))


def document_references(links: DataFrame, content_type: DataFrame, paragraph_refs: DataFrame) -> DataFrame:
    """(doc_id, kind, number, text, url, ord): a page's links that its top-level paragraphs do not cite.

    Articles, annexes (by arabic or roman number in the link) and recitals; not "Next" and "Previous" links of articles;
    pages of recitals keep articles only. content_type: (doc_id, content_type); paragraph_refs: (doc_id, kind, number).
    """
    rows = uncited_links(links.join(content_type, "doc_id"), paragraph_refs)
    return _first(rows, "doc_id", "kind", "number")


def uncited_links(links: DataFrame, paragraph_refs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """The same of links with their page's content_type, each as often as it occurs, with the columns ``also`` of ``links``."""
    named = T.extracted(F.col("href"), r"(?i)/annex/([ivx\d]+)/?$")
    annex = F.when(named.rlike(r"^\d+$"), named.cast("int")).otherwise(from_roman(named))
    kind = F.col("kind")
    number = (
        F.when(kind == "article", T.extracted(F.col("href"), r"(?i)/article/(\d+)/?").cast("int"))
        .when(kind == "annex", annex).when(kind == "recital", T.url_number(F.col("href"), "recital"))
    )
    step = (kind == "article") & F.col("text").rlike("Next|Previous")
    taken = kind.isin("article", "annex", "recital") & ((kind == "article") | (F.col("content_type") != "Recital"))
    rows = links.select("doc_id", T.link_kind(F.col("href")).alias("kind"), "text", "href", "ord", "content_type", *also)
    # A generated column is worked out once, and not again for the filter on it.
    rows = rows.select("*", F.inline(F.when(F.coalesce(taken, F.lit(False)), F.array(F.struct(number.alias("_n"))))))
    rows = rows.where("_n is not null").where(~F.coalesce(step, F.lit(False)))
    text = F.when(kind == "recital", F.concat(F.lit("Recital "), F.col("_n").cast("string"))).otherwise(F.col("text"))
    rows = rows.select("doc_id", "kind", F.col("_n").cast("string").alias("number"), text.alias("text"), F.col("href").alias("url"), "ord", *also)
    cited = paragraph_refs.where("kind in ('article', 'annex')").select("doc_id", "kind", "number").distinct()
    return rows.join(cited, ["doc_id", "kind", "number"], "left_anti")
