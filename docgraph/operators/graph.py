"""Node and edge tables of the document graph, as set operations over many documents.

Nodes: (id, labels, name, text, number, sub_level, embed, load_seq). Edges: (src, type, dst, ref_kind, ord).
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T
from .endpoints import EndpointJoins

NODE_COLUMNS = {
    "id": "string", "labels": "array<string>", "name": "string", "text": "string", "number": "string", "sub_level": "int",
    "embed": "array<float>", "load_seq": "long",
}
EDGE_COLUMNS = {"src": "string", "type": "string", "dst": "string", "ref_kind": "string", "ord": "int"}
#: Labels that may hold paragraphs.
PARAGRAPH_PARENTS = ("Article", "Annex", "Annex_Section", "Recital", "Paragraph")


def _shaped(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    have = set(df.columns)
    return df.select(*[(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()])


def build_nodes(rows: DataFrame, label: str) -> DataFrame:
    """Nodes of one label from (id, name or text, number, ...); missing columns are null."""
    labels = F.array(F.lit(label), F.lit("EmbeddingNode"))
    return _shaped(rows.withColumn("labels", labels), NODE_COLUMNS)


def build_edges(rows: DataFrame, kind: str) -> DataFrame:
    """Edges of one type from (src, dst, ...); rows without both ends are left out."""
    return _shaped(rows.withColumn("type", F.lit(kind)), EDGE_COLUMNS).where("src is not null and dst is not null")


def merge_nodes(rows: DataFrame) -> DataFrame:
    """One node per id and label: of name, text and number the last written value counts; embed and sub_level are those of
    the row that created the node. Order is load_seq; give an existing table load_seq -1. Null ids are no nodes."""
    at = F.col("load_seq")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    first = lambda c: F.min_by(F.struct(c), at)[c].alias(c)
    merged = rows.where("id is not null").groupBy("id", "labels").agg(
        last("name"), last("text"), last("number"), first("sub_level"), first("embed"), F.min("load_seq").alias("load_seq")
    )
    return merged.select(*NODE_COLUMNS)


def chapters(articles: DataFrame, corpus: Column | None = None) -> DataFrame:
    """Chapter nodes from article metadata (chapter: [roman, name])."""
    rows = articles.where("chapter is not null").select(
        ids.chapter_id(F.get("chapter", F.lit(0)), corpus).alias("id"), F.get("chapter", F.lit(1)).alias("name"),
        F.get("chapter", F.lit(0)).alias("number"), "load_seq",
    )
    return merge_nodes(build_nodes(rows, "Chapter"))


def chapter_sections(articles: DataFrame, corpus: Column | None = None) -> DataFrame:
    """Chapter_Section nodes from article metadata (chapter and section: [number, name])."""
    rows = articles.where("chapter is not null and section is not null").select(
        ids.chapter_section_id(F.get("chapter", F.lit(0)), F.get("section", F.lit(0)), corpus).alias("id"),
        F.get("section", F.lit(1)).alias("name"), F.get("section", F.lit(0)).alias("number"), "load_seq",
    )
    return merge_nodes(build_nodes(rows, "Chapter_Section"))


def titled_nodes(documents: DataFrame, label: str) -> DataFrame:
    """Article, Annex, Annex_Section or Recital nodes from (id, name, number, load_seq)."""
    return merge_nodes(build_nodes(documents.select("id", "name", F.col("number").cast("string").alias("number"), "load_seq"), label))


def paragraph_nodes(paragraphs: DataFrame) -> DataFrame:
    """Paragraph nodes from (id, text, level, load_seq): cleaned text, number from the id."""
    rows = paragraphs.select("id", T.clean_text(F.col("text")).alias("text"), ids.number_of(F.col("id")).alias("number"), F.col("level").alias("sub_level"), "load_seq")
    return merge_nodes(build_nodes(rows, "Paragraph"))


def flatten_paragraphs(documents: DataFrame) -> DataFrame:
    """(doc_id, id, parent_id, idx, level, text) from (doc_id, id, paragraphs) with nested totalSubParagraphs, as deep as the schema."""
    level = documents.select("doc_id", F.col("id").alias("parent_id"), F.posexplode("paragraphs").alias("idx", "p"))
    levels = []
    for k in count():
        levels.append(level.select("doc_id", F.col("p.id").alias("id"), "parent_id", "idx", F.lit(k).alias("level"), F.col("p.text").alias("text")))
        nested = {f.name for f in level.schema["p"].dataType.fields}
        if "totalSubParagraphs" not in nested:
            break
        level = level.select("doc_id", F.col("p.id").alias("parent_id"), F.posexplode("p.totalSubParagraphs").alias("idx", "p"))
    return reduce(DataFrame.unionByName, levels)


def annex_layout(annexes: DataFrame) -> DataFrame:
    """(doc_id, id, parent_id, idx, kind, text) from (doc_id, id, content): the type of the first element decides whether an
    annex holds paragraphs or sections with paragraphs."""
    rows = annexes.withColumn("_sections", F.get("content", F.lit(0))["type"] == "Section")
    items = rows.select("doc_id", F.col("id").alias("annex"), "_sections", F.posexplode("content").alias("idx", "c"))
    flat = items.where("not _sections").select("doc_id", F.col("c.id").alias("id"), F.col("annex").alias("parent_id"), "idx", F.lit("Paragraph").alias("kind"), F.col("c.text").alias("text"))
    heads = items.where("_sections").select("doc_id", F.col("c.id").alias("id"), F.col("annex").alias("parent_id"), "idx", F.lit("Annex_Section").alias("kind"), F.col("c.name").alias("text"))
    inner = items.where("_sections").select("doc_id", F.col("c.id").alias("parent_id"), F.posexplode("c.paragraphs").alias("idx", "p"))
    inner = inner.select("doc_id", F.col("p.id").alias("id"), "parent_id", "idx", F.lit("Paragraph").alias("kind"), F.col("p.text").alias("text"))
    return flat.unionByName(heads).unionByName(inner)


def existing(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges of which both ends are nodes, each once. Nodes of very many edges hold up no task."""
    known = nodes.select("id").distinct()
    once = EndpointJoins(edges.dropDuplicates(["src", "type", "dst", "ref_kind"]), "src", "dst")
    begun = once.join(once.rows, known.withColumnRenamed("id", "src"), "src", "left_semi")
    return once.join(begun, known.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*EDGE_COLUMNS)


def contains_edges(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """CONTAINS edges from (parent, child, ord) where both exist; paragraphs only below PARAGRAPH_PARENTS."""
    labels = nodes.select("id", F.get("labels", F.lit(0)).alias("label")).distinct()
    once = EndpointJoins(pairs.dropDuplicates(["parent", "child"]), "parent", "child")
    rows = once.join(once.rows, labels.select(F.col("id").alias("parent"), F.col("label").alias("_p")), "parent")
    rows = once.join(rows, labels.select(F.col("id").alias("child"), F.col("label").alias("_c")), "child")
    rows = rows.where((F.col("_c") != "Paragraph") | F.col("_p").isin(*PARAGRAPH_PARENTS))
    return build_edges(rows.select(F.col("parent").alias("src"), F.col("child").alias("dst"), "ord"), "CONTAINS")


def next_edges_by_number(numbered: DataFrame) -> DataFrame:
    """NEXT edges from (scope, number, id): n to n + 1 of a scope, where both exist; a gap gives none."""
    left = numbered.select("scope", F.col("number").cast("long").alias("n"), F.col("id").alias("src")).where("src is not null").distinct()
    right = left.select("scope", (F.col("n") - 1).alias("n"), F.col("src").alias("dst"))
    return build_edges(left.join(right, ["scope", "n"]), "NEXT")


def next_edges_by_position(children: DataFrame) -> DataFrame:
    """NEXT edges from (parent, idx, id): each child to the one after it."""
    order = Window.partitionBy("parent").orderBy("idx")
    return build_edges(children.select(F.col("id").alias("src"), F.lead("id").over(order).alias("dst")), "NEXT")


def reference_kind(kind: Column, paragraph: Column, points: Column, text: Column) -> Column:
    """The kind of a REFERENCES edge; null for a section reference that names no chapter, which has no target."""
    many = F.when(kind == "annex", F.lit("annexes")).otherwise(F.concat(kind, F.lit("s")))
    with_points = F.size(points) > 0
    return (
        F.when(paragraph.isNotNull() & with_points, F.concat(many, F.lit("_paragraph_point")))
        .when(paragraph.isNotNull(), F.concat(many, F.lit("_paragraph")))
        .when(with_points, F.concat(many, F.lit("_point")))
        .when(kind == "section", F.when(text.contains("Chapter"), F.lit("chapter_sections")))
        .otherwise(many)
    )


def resolve_paragraph_target(refs: DataFrame, paragraphs: DataFrame, strict: bool = True) -> DataFrame:
    """Adds dst to references (kind, number, paragraph, points) of paragraphs: the first top-level paragraph of the document
    (kind, number) whose text starts with the prefix, as {document id}.{its place from 1}; null where none does.

    The prefix is "(point)" where there are points, else the paragraph number. paragraphs: (kind, number, idx, text), idx
    from 0, top level. strict resolves articles only. Wanted (document, prefix) pairs are resolved once each, so a much
    cited paragraph costs one row here.
    """
    prefix = F.when(F.size("points") > 0, F.concat(F.lit("("), F.get("points", F.lit(0)), F.lit(")"))).otherwise(F.col("paragraph").cast("string"))
    rows = refs.withColumn("_prefix", prefix)
    wanted = rows.where("_prefix is not null").select("kind", "number", "_prefix").distinct()
    if strict:
        wanted = wanted.where("kind = 'article'")
    # Each paragraph's beginnings of the lengths that are wanted of its document meet them by equality.
    lengths = wanted.groupBy("kind", "number").agg(F.collect_set(F.char_length("_prefix")).alias("_lengths"))
    starts = F.transform(F.filter("_lengths", lambda n: n <= F.char_length("text")), lambda n: F.substring("text", F.lit(1), n))
    cut_up = paragraphs.join(lengths, ["kind", "number"]).select("kind", "number", "idx", F.explode(starts).alias("_prefix"))
    first = cut_up.groupBy("kind", "number", "_prefix").agg((F.min("idx") + 1).alias("_place"))
    found = first.select("kind", "number", "_prefix", F.concat_ws(".", document_id(F.col("kind"), F.col("number")), F.col("_place").cast("string")).alias("dst"))
    return rows.join(found, ["kind", "number", "_prefix"], "left").drop("_prefix")


def document_id(kind: Column, number: Column, corpus: Column | None = None) -> Column:
    """The id of a cited article, annex, recital, chapter (numbers in arabic) or chapter section ("chapter.section")."""
    chapter, section = F.substring_index(number, ".", 1), F.substring_index(number, ".", -1)
    as_number = lambda c: F.when(c.rlike(r"^\d{1,9}$"), c).cast("int")
    return (
        F.when(kind == "article", ids.article_id(number, corpus)).when(kind == "annex", ids.annex_id(as_number(number), corpus))
        .when(kind == "recital", ids.recital_id(number, corpus)).when(kind == "chapter", ids.chapter_id(ids.to_roman(as_number(number)), corpus))
        .when(kind == "section", ids.chapter_section_id(ids.to_roman(as_number(chapter)), section, corpus))
    )


def reference_edges(refs: DataFrame, paragraphs: DataFrame, nodes: DataFrame, strict: bool = True) -> DataFrame:
    """REFERENCES edges from (src_id, kind, number, paragraph, points, text): resolved, both ends existing, each once."""
    # Only the first point counts, and texts only for the kind: like references are one before they are joined.
    points = F.when(F.size("points") > 0, F.slice("points", F.lit(1), F.lit(1)))
    rows = refs.withColumn("ref_kind", reference_kind(F.col("kind"), F.col("paragraph"), F.col("points"), F.col("text"))).where("ref_kind is not null")
    rows = rows.select("src_id", "kind", "number", "paragraph", points.alias("points"), "ref_kind").distinct()
    inner = rows.where("paragraph is not null or size(points) > 0")
    whole = rows.where("paragraph is null and not coalesce(size(points) > 0, false)")
    # A generated column is worked out once, and not again for the filter on it.
    whole = whole.select("*", F.explode(F.array(document_id(F.col("kind"), F.col("number")))).alias("dst"))
    resolved = resolve_paragraph_target(inner, paragraphs, strict).select("src_id", "dst", "ref_kind").unionByName(whole.select("src_id", "dst", "ref_kind"))
    return existing(build_edges(resolved.withColumnRenamed("src_id", "src"), "REFERENCES"), nodes)


def inverse_edges(edges: DataFrame) -> DataFrame:
    """PART_OF for each CONTAINS edge and PREVIOUS for each NEXT edge."""
    kind = F.when(F.col("type") == "CONTAINS", "PART_OF").when(F.col("type") == "NEXT", "PREVIOUS")
    return edges.select(F.col("dst").alias("src"), kind.alias("type"), F.col("src").alias("dst"), "ref_kind", "ord").where("type is not null")


def embedding_text(paragraphs: DataFrame, with_parent: bool = True) -> DataFrame:
    """(id, embed_text) of (id, parent_id, text): the text, after that of its parent paragraph and a blank line."""
    own = paragraphs.alias("p")
    if not with_parent:
        return own.select("id", F.col("text").alias("embed_text"))
    above = paragraphs.select(F.col("id").alias("_pid"), F.col("text").alias("_ptext"))
    return own.join(above, F.col("p.parent_id") == F.col("_pid"), "left").select("p.id", F.concat_ws("\n\n", "_ptext", "p.text").alias("embed_text"))
