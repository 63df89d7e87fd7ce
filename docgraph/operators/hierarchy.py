"""From ordered blocks to a hierarchy of paragraphs.

A block is (doc_id, pos, tag, style, text, links); all steps work on many documents at once, each document's blocks in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .folds import fold_rows


#: Runs of several blocks that are sent to all tasks, at most.
MOST_RUNS = 1 << 18


def filter_noise(blocks: DataFrame, recital: bool = False) -> DataFrame:
    """The blocks without empty ones and foot-note marks."""
    return blocks.where(~T.is_noise(F.col("text"), recital))


def _doc() -> Window:
    return Window.partitionBy("doc_id").orderBy("pos")


def with_levels(blocks: DataFrame, max_level: int | None = None) -> DataFrame:
    """Adds level (from the indent; 0 without one) and indented. Where ``max_level`` is given, deeper levels count as that one."""
    indent = T.indent_level(F.col("style"))
    level = F.coalesce(indent, F.lit(0))
    return blocks.select("*", (level if max_level is None else F.least(level, F.lit(max_level))).alias("level"), indent.isNotNull().alias("indented"))


class _Open:
    """A block that later ones may hang off: its level, place and id, the last marker among its children, and the last child's marker with the first place of its run."""

    __slots__ = ("level", "pos", "id", "marker", "last", "run")

    def __init__(self, level: int, pos: int | None, id_: str):
        self.level, self.pos, self.id, self.marker = level, pos, id_, None
        self.last, self.run = None, None


def _hang(stack: list[_Open], pos: int, level: int, own: str | None, root: str) -> tuple[int | None, str, str, str, int]:
    """The parent's place and id, the marker, the id and the run of a block; the stack holds the blocks that it may hang off.

    What a block closes is no smaller than itself, so each is closed once, however deep levels go.
    """
    if not stack:
        stack.append(_Open(-1, None, root))
    while stack[-1].level >= level:
        stack.pop()
    parent = stack[-1]
    if own is not None:
        parent.marker = own
    marker = "0" if parent.marker is None else parent.marker
    if parent.last != marker:
        parent.last, parent.run = marker, pos
    stack.append(_Open(level, pos, f"{parent.id}.{marker}" if parent.id else marker))
    return parent.pos, parent.id, marker, stack[-1].id, parent.run


def with_parents(blocks: DataFrame, root: Column) -> DataFrame:
    """Adds parent_pos, parent_id, marker, id and run to blocks with levels.

    The parent is the nearest block before with a smaller level, none at the top; the marker is the block's own, else that of the sibling
    before, else "0"; the id is the parent's (at the top ``root``; null counts as empty), a dot and the marker. Adjacent siblings with one id are a run,
    named by the place of its first. A stack of open blocks goes over each document's blocks in
    order, so levels may be of any depth and documents of any length.
    """
    rows = blocks.withColumns({"_own": T.paragraph_marker(F.col("text")), "_root": F.coalesce(root.cast("string"), F.lit(""))})
    place = rows.schema["pos"].dataType.simpleString()
    gives = f"parent_pos {place}, parent_id string, marker string, id string, run {place}"
    hung = fold_rows(rows, "doc_id", ["pos"], ["pos", "level", "_own", "_root"], gives, list, _hang)
    return hung.drop("_own", "_root")


def assemble_hierarchy(blocks: DataFrame, root: Column, max_level: int | None = None) -> DataFrame:
    """(doc_id, pos, level, parent_pos, parent_id, id, run, text) of the blocks, see ``with_parents``; ``root`` is the id of the document."""
    rows = with_levels(blocks.select("*", root.alias("_document")), max_level).select("doc_id", "pos", "level", "text", "_document")
    return with_parents(rows, F.col("_document")).select("doc_id", "pos", "level", "parent_pos", "parent_id", "id", "run", "text")


def _islands(paragraphs: DataFrame) -> DataFrame:
    """Adds _island: adjacent siblings with one id share it."""
    siblings = Window.partitionBy("doc_id", "parent_pos").orderBy("pos")
    rows = paragraphs.withColumn("_new", F.coalesce((F.col("id") != F.lag("id").over(siblings)).cast("int"), F.lit(1)))
    return rows.withColumn("_island", F.sum("_new").over(siblings.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def merge_same_id(paragraphs: DataFrame) -> DataFrame:
    """Adjacent siblings with one id become one: texts joined by a space; (doc_id, id, parent_id, level, pos, text, n_merged).

    Their children are joined by that already, as those carry the id as parent_id.
    """
    return _joined(_islands(paragraphs), "doc_id", "parent_pos", "_island").drop("parent_pos", "_island")


def _joined(paragraphs: DataFrame, *keys: str) -> DataFrame:
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    return paragraphs.groupBy(*keys).agg(
        F.min("id").alias("id"), F.min("parent_id").alias("parent_id"), F.min("level").alias("level"),
        F.min("pos").alias("pos"), joined.alias("text"), F.count("*").alias("n_merged"),
    )


def merge_runs(paragraphs: DataFrame) -> DataFrame:
    """``merge_same_id`` of paragraphs that are cheap to read, such as those of a cut: their runs are known, and most are of one block, which is left as it is."""
    runs = paragraphs.where("run <> pos").select("doc_id", "run").distinct()
    if runs.limit(MOST_RUNS + 1).count() > MOST_RUNS:
        return _joined(paragraphs, "doc_id", "run").drop("run")
    one = paragraphs.join(F.broadcast(runs), ["doc_id", "run"], "left_anti").withColumn("n_merged", F.lit(1).cast("long"))
    more = _joined(paragraphs.join(F.broadcast(runs), ["doc_id", "run"], "left_semi"), "doc_id", "run")
    return one.select(*[c for c in more.columns if c != "run"]).unionByName(more.drop("run"))


def merge_references(paragraphs: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, id, kind, number, paragraph, points, text, url, ord): the references (doc_id, pos, kind, ..., ord) of blocks as those
    of the paragraphs that ``merge_same_id`` makes of them; of like references of one paragraph the first stays."""
    what = ["kind", "number", "paragraph", "points", "text", "url"]
    rows = _islands(paragraphs).select("doc_id", "pos", "parent_pos", "_island", "id").join(refs.select("doc_id", "pos", *what, "ord"), ["doc_id", "pos"])
    first = F.min(F.struct("pos", "ord")).alias("at")
    merged = rows.groupBy("doc_id", "parent_pos", "_island", "id", *what).agg(first)
    order = Window.partitionBy("doc_id", "parent_pos", "_island").orderBy("at")
    return merged.select("doc_id", "id", *what, F.row_number().over(order).alias("ord"))


def attach_related_recitals(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks without "Related:" lines, (doc_id, pos, to_pos) of the indented ones).

    An indented "Related:" line belongs to the latest block before it of its level; others belong to none.
    """
    rows = with_levels(blocks)
    related = F.col("text").startswith("Related:")
    before = Window.partitionBy("doc_id", "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    target = F.last(F.when(~related & F.col("indented"), F.col("pos")), ignorenulls=True).over(before)
    marked = rows.withColumn("to_pos", target)
    attached = marked.where(related & F.col("indented") & F.col("to_pos").isNotNull()).select("doc_id", "pos", "to_pos")
    return blocks.where(~F.coalesce(related, F.lit(False))), attached


def split_sections(blocks: DataFrame) -> DataFrame:
    """Adds section_no, section_key and section_name: a heading h1 to h4 starts a section.

    The key is the heading's second word. Text before the first heading belongs to the first section;
    without headings all three are null. Headings themselves are not returned.
    """
    heading = F.col("tag").isin("h1", "h2", "h3", "h4")
    running = _doc().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("doc_id")
    rows = blocks.select(
        "*", heading.alias("_heading"), F.greatest(F.sum(heading.cast("int")).over(running), F.lit(1)).alias("_no"),
        F.sum(heading.cast("int")).over(whole).alias("_headings"),
    )
    section = Window.partitionBy("doc_id", "_no")
    rows = rows.withColumn("_name", F.max(F.when(F.col("_heading"), F.col("text"))).over(section))
    any_heading = F.col("_headings") > 0
    return rows.where(~F.col("_heading")).select(
        *blocks.columns,
        F.when(any_heading, F.col("_no")).alias("section_no"),
        F.when(any_heading, F.get(F.split("_name", " "), F.lit(1))).alias("section_key"),
        F.when(any_heading, F.col("_name")).alias("section_name"),
    )


def number_recital_paragraphs(blocks: DataFrame, number: Column) -> DataFrame:
    """(doc_id, id, pos, text): the kept paragraphs of recitals in sequence, recital{n}_p{i} from 1."""
    rows = filter_noise(blocks, recital=True).where(F.col("tag") == "p").withColumn("_n", number)
    i = F.row_number().over(_doc())
    return rows.select("doc_id", F.concat(F.lit("recital"), F.col("_n").cast("string"), F.lit("_p"), i.cast("string")).alias("id"), "pos", "text")


def extraction_stats(paragraphs: DataFrame, refs: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """Per document: its paragraphs, top-level paragraphs, sections of (doc_id, section_no), and references by kind."""
    count = lambda test: F.coalesce(F.sum(F.when(test, 1)), F.lit(0)).cast("long")
    out = paragraphs.groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), count(F.col("level") == 0).alias("n_top"))
    if sections is None:
        out = out.withColumn("n_sections", F.lit(0).cast("long"))
    else:
        out = out.join(sections.groupBy("doc_id").agg(F.count_distinct("section_no").alias("n_sections")), "doc_id", "left")
    kinds = refs.groupBy("doc_id").agg(*[count(F.col("kind") == k).alias(f"n_{k}_refs") for k in ("article", "chapter", "annex", "recital")])
    names = ["n_sections", *kinds.columns[1:]]
    return out.join(kinds, "doc_id", "left").select("doc_id", "n_paragraphs", "n_top", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
