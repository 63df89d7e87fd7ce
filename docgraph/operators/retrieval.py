"""Retrieval: exact cosine top-k for many queries at once, and node lookup."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are sent to all tasks at once; more of them are dealt into chunks of about so many, and nodes into parts of about PART.
MOST_QUERIES, PART = 4096, 65_536
#: Queries and nodes whose products are held at once.
TILE_QUERIES, TILE_ROWS = 256, 2_048


def vector_topk(queries: DataFrame, nodes: DataFrame, k: int = 12) -> DataFrame:
    """(query_id, id, similarity, rank): the k nodes of largest cosine to each query, ties by id.

    queries: (query_id long, embed), a stated set; nodes: (id, embed). Up to ``MOST_QUERIES`` queries go to all tasks, and nodes stay where they are. More of them
    form a grid with the nodes: each chunk of queries meets each part of nodes in a group of bounded size, in one plan for any number. Each
    group or batch keeps its own best k a query (matrix product, in tiles of ``TILE_QUERIES`` by ``TILE_ROWS``, so memory does not grow with either), so only those are shuffled on. Null or empty vectors are no hits and no queries; the cosine
    with a zero vector is 0. Vectors of unlike length are compared over the common length.
    """
    queries = queries.select("query_id", "embed").where("embed is not null and size(embed) > 0")
    nodes = nodes.select("id", "embed").where("embed is not null and size(embed) > 0")
    schema = f"query_id long, id {nodes.schema['id'].dataType.simpleString()}, similarity double"
    held = queries.limit(MOST_QUERIES + 1).collect()
    found = _sent_topk(held, nodes, k, schema) if len(held) <= MOST_QUERIES else _grid_topk(queries, nodes, k, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """A row for each list of an Arrow array, filled up with zeros to ``width`` at least."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=1)))))
    column = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), column] = pc.list_flatten(vectors).to_numpy(zero_copy_only=False)
    return out


def _best(rows: pa.RecordBatch | pa.Table, ids: np.ndarray, matrix: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, id, similarity): the best ``k`` of ``rows`` (id, embed) for each query, ties by id; a batch for each tile of queries."""
    rows = rows.take(pc.sort_indices(rows.column("id")))
    vectors = rows.column("embed")
    own = _matrix(vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors, matrix.shape[1])
    lengths, own = np.linalg.norm(own, axis=1), own[:, : matrix.shape[1]]
    for at in range(0, len(ids), TILE_QUERIES):
        some = matrix[at : at + TILE_QUERIES]
        norms = np.linalg.norm(some, axis=1)
        places, values = np.zeros((len(some), 0), np.int64), np.zeros((len(some), 0))
        for begin in range(0, len(own), TILE_ROWS):
            tile = own[begin : begin + TILE_ROWS]
            product, scale = some @ tile.T, np.outer(norms, lengths[begin : begin + TILE_ROWS])
            cosine = np.divide(product, scale, out=np.zeros_like(product), where=scale > 0)
            # Those kept so far come first, as their ids are smaller; a stable sort leaves ties in order of id.
            values = np.hstack([values, cosine])
            places = np.hstack([places, np.broadcast_to(np.arange(begin, begin + len(tile)), cosine.shape)])
            best = np.argsort(-values, axis=1, kind="stable")[:, :k]
            values, places = np.take_along_axis(values, best, 1), np.take_along_axis(places, best, 1)
        hits = rows.column("id").take(pa.array(places.reshape(-1)))
        hits = hits.combine_chunks() if isinstance(hits, pa.ChunkedArray) else hits
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at : at + TILE_QUERIES], places.shape[1])), hits, pa.array(values.reshape(-1))], names=["query_id", "id", "similarity"])


def _sent_topk(held: list, nodes: DataFrame, k: int, schema: str) -> DataFrame:
    ids = np.array([r.query_id for r in held], np.int64)
    shared = nodes.sparkSession.sparkContext.broadcast((ids, _matrix(pa.array([r.embed for r in held], pa.list_(pa.float64())), 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(shared.value[0]):
                yield from _best(batch, *shared.value, k)

    return nodes.mapInArrow(run, schema)


def _grid_topk(queries: DataFrame, nodes: DataFrame, k: int, schema: str) -> DataFrame:
    chunks, parts = max(1, -(-queries.count() // MOST_QUERIES)), max(1, -(-nodes.count() // PART))
    deal = lambda by, n: F.pmod(F.xxhash64(by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("query_id", "embed", deal("query_id", chunks).alias("chunk"), every(parts).alias("part"))
    held = nodes.select("id", "embed", deal("id", parts).alias("part"), every(chunks).alias("chunk"))

    def run(rows: pa.Table, some: pa.Table) -> pa.Table:
        ids, matrix = some["query_id"].to_numpy(), _matrix(some["embed"].combine_chunks(), 1)
        found = list(_best(rows, ids, matrix, k)) if len(rows) and len(ids) else []
        empty = pa.schema([("query_id", pa.int64()), ("id", rows.schema.field("id").type), ("similarity", pa.float64())])
        return pa.Table.from_batches(found, found[0].schema if found else empty)

    return held.groupBy("part", "chunk").cogroup(asked.groupBy("part", "chunk")).applyInArrow(run, schema)


def project_hits(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, rank, id, text, number, sub_level, labels, similarity): text or name, similarity to 3 digits."""
    return hits.join(nodes, "id").select(
        "query_id", "rank", "id", F.coalesce("text", "name").alias("text"), "number", "sub_level", "labels",
        F.round("similarity", 3).alias("similarity"),
    )


def lookup_nodes(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each wanted id with its first label ("Node" if it has none) and properties; null where it is unknown."""
    rows = nodes.drop("embed").withColumn("label", F.coalesce(F.get("labels", F.lit(0)), F.lit("Node")))
    return wanted.select("id").join(rows, "id", "left")
