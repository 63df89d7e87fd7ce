"""From questions to contexts, in one job for many questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import embedding, retrieval, traversal
from ..operators.checkpoints import cut


def question_contexts(questions: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 12, embed: embedding.Embedder | None = None, most_neighbours: int = traversal.MOST_NEIGHBOURS) -> DataFrame:
    """(query_id, rank, id, hit, similarity, part, error, context, references, children): the k best nodes of each question, with what their readers need.

    questions: (query_id, embed), or (query_id, text), whose distinct texts ``embed`` turns into vectors; nodes: with embed. ``hit`` is the node's own text,
    ``context`` the text below its topmost paragraph. Hits that several questions share are expanded once. Nodes with large
    subtrees or many neighbours come in parts, see ``traverse``. A question without a vector has no hits.
    """
    if "embed" not in questions.columns:
        questions = embedding.embed_distinct(questions.select("query_id", "text"), embed)
    nodes = cut(nodes)
    hits = cut(retrieval.project_hits(retrieval.vector_topk(questions, nodes, k), nodes))
    contexts = traversal.traverse(hits.select("id"), nodes, edges, most_neighbours=most_neighbours)
    rows = hits.select("query_id", "rank", "id", F.col("text").alias("hit"), "similarity").join(contexts, "id")
    return rows.select("query_id", "rank", "id", "hit", "similarity", "part", "error", F.col("text").alias("context"), "references", "children")
