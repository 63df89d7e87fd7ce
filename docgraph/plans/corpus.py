"""From a corpus of pages to the nodes and edges of its graph, in one job."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T
from ..operators import embedding, graph, hierarchy, references
from ..operators.checkpoints import cut
from ..sources import pages as pages_io

_REF = ("kind", "number", "paragraph", "points", "text", "url")
#: Label and id of the node above a whole corpus.
ACT = "Act"


def document_headers(blocks: DataFrame) -> DataFrame:
    """(doc_id, root, name, kind, number, chapter, section) of the pages that have a title with a type and a number.

    root is the id of the document; chapter and section are [number, name] or null.
    """
    # Titles, and links to chapters and sections, stand in a part of the blocks; nothing of the others is grouped.
    above = F.exists("links", lambda x: x["href"].contains("/chapter/") | x["href"].contains("/section/"))
    heads = pages_io.page_headers(blocks.where((F.col("tag") == "h1") | above))
    rows = heads.select(
        "doc_id", "name", F.lower(T.content_type(F.col("name"))).alias("kind"), T.title_number(F.col("name")).alias("number"),
        T.chapter_meta(F.col("chapter.name")).alias("chapter"), T.section_meta(F.col("section.name")).alias("section"),
    ).where("kind is not null and number is not null")
    return rows.withColumn("root", graph.document_id(F.col("kind"), F.col("number").cast("string")))


def _annex_paragraphs(body: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the sections (doc_id, id, name, key, idx), the hierarchy of the paragraphs) of annexes; without headings these hang off the annex."""
    rows = hierarchy.split_sections(body)
    own = F.when(F.col("section_no").isNull(), F.col("root")).otherwise(ids.annex_section_id(F.col("number"), F.col("section_key")))
    rows = rows.withColumn("under", own).withColumn("page", F.col("doc_id"))
    sections = rows.where("section_no is not null").groupBy("doc_id", "under").agg(F.min("section_name").alias("name"), F.min("section_key").alias("key"), F.min("section_no").alias("idx"))
    # A section is a document of its own to the hierarchy, so that levels do not reach across sections.
    apart = rows.withColumn("doc_id", F.concat_ws(":", "page", "under"))
    tree = hierarchy.assemble_hierarchy(hierarchy.filter_noise(apart), F.col("under"))
    tree = tree.withColumn("doc_id", F.substring_index("doc_id", ":", 1).cast("long"))
    return sections.withColumnRenamed("under", "id"), tree


class Corpus:
    """The parts of the graph of (page_id, url, html), each worked out when it is first asked for: nodes take no references.

    Blocks with a class (metadata, summaries) are no paragraphs. Indented "Related:" lines give their recitals to the paragraph before
    them. References come from paragraphs, and from documents for links that their top-level paragraphs do not cite.
    """

    def __init__(self, pages: DataFrame, container: str = "article", strict: bool = True):
        self.pages, self.container, self.strict = pages, container, strict

    @cached_property
    def blocks(self) -> DataFrame:
        return cut(pages_io.extract_blocks(self.pages, self.container))

    @cached_property
    def docs(self) -> DataFrame:
        return cut(document_headers(self.blocks))

    @cached_property
    def body(self) -> DataFrame:
        own = self.docs.select("doc_id", "root", "kind", "number")
        return self.blocks.where("tag <> 'h1' and css is null").select("doc_id", "pos", "tag", "style", "text").join(own, "doc_id")

    @cached_property
    def articles(self) -> tuple[DataFrame, DataFrame]:
        return hierarchy.attach_related_recitals(hierarchy.filter_noise(self.body.where("kind = 'article' and tag = 'p'")))

    @cached_property
    def annexes(self) -> tuple[DataFrame, DataFrame]:
        return _annex_paragraphs(self.body.where("kind = 'annex'"))

    @cached_property
    def tree(self) -> DataFrame:
        return cut(hierarchy.assemble_hierarchy(self.articles[0], F.col("root")).unionByName(self.annexes[1]))

    @cached_property
    def recitals(self) -> DataFrame:
        rows = hierarchy.number_recital_paragraphs(self.body.where("kind = 'recital'"), F.col("number"))
        return rows.join(self.docs.select("doc_id", F.col("root").alias("parent_id")), "doc_id").withColumn("level", F.lit(0))

    @cached_property
    def paragraphs(self) -> DataFrame:
        columns = ["doc_id", "pos", "id", "parent_id", "level", "text"]
        return cut(hierarchy.merge_runs(self.tree).select(*columns).unionByName(self.recitals.select(*columns)))

    @cached_property
    def links(self) -> DataFrame:
        """The links of all blocks, with whether they are alone in their block, whether this is one of the body, and what their page is."""
        own = self.docs.select("doc_id", "root", F.initcap("kind").alias("content_type"))
        rows = self.blocks.where(F.size("links") > 0).join(own, "doc_id").withColumns({
            "place": F.concat_ws(":", "doc_id", "pos"), "alone": F.size("links") == 1, "inner": F.expr("tag <> 'h1' and css is null"),
        })
        return cut(references.harvest_links(rows, "place", ("alone", "inner", "root", "content_type")))

    @cached_property
    def refs(self) -> DataFrame:
        """(doc_id, src_id, level, kind, ..): the references of each paragraph's blocks, and of the "Related:" lines after them; level is that of the block."""
        at, related = F.split("src_id", ":"), cut(self.articles[1])
        cited = references.element_references(self.links.where("inner").drop("inner", "root", "content_type"))
        found = cited.select(at[0].cast("long").alias("doc_id"), at[1].cast("int").alias("pos"), *_REF[:5])
        # Of a "Related:" line the recitals go to the paragraph before it, and nothing else counts.
        found = found.join(related, ["doc_id", "pos"], "left").where("to_pos is null or kind = 'recital'")
        found = found.withColumn("pos", F.coalesce("to_pos", "pos")).drop("to_pos")
        spots = self.tree.select("doc_id", "pos", "id", "level").unionByName(self.recitals.select("doc_id", "pos", "id", "level"))
        return cut(found.join(spots, ["doc_id", "pos"]).select("doc_id", F.col("id").alias("src_id"), "level", *_REF[:5]))

    @cached_property
    def nodes(self) -> DataFrame:
        seq = F.col("doc_id").alias("load_seq")
        articles = self.docs.where("kind = 'article'").withColumn("load_seq", F.col("doc_id"))
        titled = [graph.titled_nodes(self.docs.where(f"kind = '{kind.lower()}'").select(F.col("root").alias("id"), "name", "number", seq), kind) for kind in ("Article", "Annex", "Recital")]
        sections = graph.titled_nodes(self.annexes[0].select("id", "name", F.col("key").alias("number"), seq), "Annex_Section")
        inner = graph.paragraph_nodes(self.paragraphs.select("id", "text", "level", F.col("pos").cast("long").alias("load_seq")))
        return cut(reduce(DataFrame.unionByName, [graph.chapters(articles), graph.chapter_sections(articles), *titled, sections, inner]))

    @cached_property
    def references(self) -> DataFrame:
        """REFERENCES edges."""
        top = self.refs.where("level = 0").select("doc_id", "kind", "number")
        # A deeper block counts as top-level too where a block of its page with the same id is.
        deeper = self.refs.where("level > 0 and kind in ('article', 'annex')").select("doc_id", "src_id", "kind", "number").distinct()
        if not deeper.isEmpty():
            tops = self.paragraphs.where("level = 0").select("doc_id", F.col("id").alias("src_id"))
            top = top.unionByName(deeper.join(tops, ["doc_id", "src_id"], "left_semi").drop("src_id"))
        of_documents = references.uncited_links(self.links, top, ("root",)).withColumnRenamed("root", "src_id")
        bare = [F.lit(None).cast("int").alias("paragraph"), F.lit(None).cast("array<string>").alias("points")]
        cited = self.refs.select("src_id", *_REF[:5]).unionByName(of_documents.select("src_id", "kind", "number", *bare, "text"))
        targets = self.paragraphs.where("level = 0").join(self.docs.select("doc_id", "kind", F.col("number").cast("string").alias("number"), "root"), "doc_id")
        place = F.row_number().over(Window.partitionBy("kind", "number").orderBy("doc_id", "pos")) - 1
        targets = targets.where("parent_id = root").select("kind", "number", place.alias("idx"), "text")
        return graph.reference_edges(cited, targets, self.nodes, self.strict)

    @cached_property
    def following(self) -> DataFrame:
        """(src, dst) candidates of NEXT edges between paragraphs of one parent."""
        return graph.next_edges_by_position(self.paragraphs.select(F.col("parent_id").alias("parent"), F.col("pos").alias("idx"), "id"))

    @cached_property
    def edges(self) -> DataFrame:
        contains = graph.contains_edges(self._pairs(), self.nodes)
        return contains.unionByName(self.references).unionByName(graph.existing(self.following, self.nodes))

    def _pairs(self) -> DataFrame:
        """(parent, child, ord): chapters, their sections, articles; annexes and their sections; paragraphs."""
        part = F.get("chapter", F.lit(0))
        chapter, section = ids.chapter_id(part), ids.chapter_section_id(part, F.get("section", F.lit(0)))
        articles = self.docs.where("kind = 'article' and chapter is not null")
        has_section = F.col("section").isNotNull()
        parts = [
            _pair(articles.where(has_section), chapter, section, F.get("section", F.lit(0))).distinct(),
            _pair(articles, F.when(has_section, section).otherwise(chapter), F.col("root"), F.col("number")),
            _pair(self.annexes[0].join(self.docs.select("doc_id", "root"), "doc_id"), F.col("root"), F.col("id"), F.col("idx")),
            _pair(self.paragraphs, F.col("parent_id"), F.col("id"), F.col("pos")),
        ]
        return reduce(DataFrame.unionByName, parts)

    def whole_edges(self, act: str = ACT) -> DataFrame:
        """All edges of the graph under one node ``act``: it contains chapters, annexes and recitals; NEXT by number joins chapters, articles, annexes, recitals and
        the sections of a chapter, NEXT by place annex sections and paragraphs."""
        above = self.nodes.select("id", F.get("labels", F.lit(0)).alias("label"), "number").where("label in ('Chapter', 'Chapter_Section', 'Article', 'Annex', 'Recital')")
        number = F.when(F.col("label") == "Chapter", ids.from_roman(F.col("number"))).when(F.col("number").rlike(r"^\d{1,9}$"), F.col("number").cast("int"))
        above = cut(above.select("id", "label", number.alias("number")))
        top = _pair(above.where("label in ('Chapter', 'Annex', 'Recital')"), F.lit(act), F.col("id"), F.col("number"))
        within = F.when(F.col("label") == "Chapter_Section", F.regexp_replace("id", r"\.Sect-[^.]*$", "")).otherwise(F.lit(""))
        by_number = graph.next_edges_by_number(above.where("number is not null").select(F.concat_ws(" ", "label", within).alias("scope"), "number", "id"))
        sections = self.annexes[0].join(self.docs.select("doc_id", "root"), "doc_id").select(F.col("root").alias("parent"), "idx", "id")
        by_place = self.following.unionByName(graph.next_edges_by_position(sections))
        contains = graph.contains_edges(self._pairs().unionByName(top), self.whole_nodes(act))
        return reduce(DataFrame.unionByName, [contains, self.references, by_number, graph.existing(by_place, self.nodes)])

    def whole_nodes(self, act: str = ACT, name: str | None = None, embedder: embedding.Embedder | None = None, parent_context: bool = False) -> DataFrame:
        """All nodes, the one above them too; with an embedder each has the vector of its name or text, of paragraphs of articles and annexes
        with ``parent_context`` behind the text of the paragraph above. Each distinct text is embedded once."""
        root = graph.build_nodes(self.nodes.sparkSession.range(1).select(F.lit(act).alias("id"), F.lit(name or act).alias("name"), F.lit(-1).cast("long").alias("load_seq")), "Act")
        nodes = self.nodes.unionByName(root)
        if embedder is None:
            return nodes
        said = nodes.select("id", "labels", F.coalesce("text", "name").alias("said"))
        if parent_context:
            own = self.nodes.where(F.array_contains("labels", "Paragraph")).select("id", "text")
            parents = self.tree.groupBy("id").agg(F.min("parent_id").alias("parent_id"))  # recitals have none
            context = graph.embedding_text(own.join(parents, "id", "left")).select("id", F.array("embed_text").alias("_told"))
            said = said.join(context, "id", "left").select("id", "labels", F.when(F.array_contains("labels", "Paragraph"), F.coalesce(F.get("_told", F.lit(0)), "said")).otherwise(F.col("said")).alias("said"))
        vectors = embedding.embed_distinct(said, embedder, "said").select("id", "labels", "embed")
        return nodes.drop("embed").join(vectors, ["id", "labels"], "left").select(*graph.NODE_COLUMNS)


def _pair(df: DataFrame, parent: Column, child: Column, order: Column) -> DataFrame:
    return df.select(parent.alias("parent"), child.alias("child"), order.cast("int").alias("ord"))


def corpus_graph(pages: DataFrame, container: str = "article", strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of (page_id, url, html): articles, annexes and recitals with their paragraphs, chapters and references; see ``Corpus``."""
    corpus = Corpus(pages, container, strict)
    return corpus.nodes, corpus.edges
