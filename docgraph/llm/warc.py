"""WARC fixity audit: Merkle trees over records and offset ranges; only unlike branches are descended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Page ids that one archive file covers, and children of a tree node.
SLOTS, FANOUT = 1024, 16


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A page as one WARC response record."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def index_records(pages: DataFrame) -> DataFrame:
    """The records of (page_id, url, html): (page_id, archive, slot, copy, offset, length, sha).

    Archive ``page_id div 1024`` holds its records by slot ``page_id mod 1024``, then digest; ``copy`` counts
    rows that repeat a page_id. A page without id gets a slot from its content. Null url and html
    count as empty.
    """
    own = record(F.col("page_id"), F.col("url"), F.col("html"))
    spare = -1 - F.pmod(F.xxhash64(own), F.lit(1 << 40))
    place = F.coalesce(F.col("page_id").cast("long"), spare)
    rows = pages.select(
        "page_id",
        F.floor(place / SLOTS).cast("long").alias("archive"),
        F.pmod(place, F.lit(SLOTS)).cast("long").alias("slot"),
        F.octet_length(own).cast("long").alias("length"),
        F.sha2(own, 256).alias("sha"),
    )
    in_archive = Window.partitionBy("archive").orderBy("slot", "sha")
    in_slot = Window.partitionBy("archive", "slot")
    rows = rows.withColumns(
        {
            "place": F.row_number().over(in_archive),
            "offset": F.sum("length").over(in_archive.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length"),
        }
    )
    copy = (F.col("place") - F.min("place").over(in_slot)).cast("long")
    return rows.select("page_id", "archive", "slot", copy.alias("copy"), "offset", "length", "sha")


def leaves(records: DataFrame) -> DataFrame:
    """(node, hash): a leaf for each slot, over the digests and offset ranges of its records.

    Each record is hashed with its copy number and range, so their exclusive or stands for them in order, and a slot of any number of
    records is summed up without gathering them.
    """
    own = F.sha2(F.concat_ws(":", "copy", "offset", "length", "sha"), 256)
    part = lambda k: F.bit_xor(F.conv(F.substring(own, 1 + 15 * k, 15), 16, 10).cast("long"))
    node = (F.col("archive") * SLOTS + F.col("slot")).alias("node")
    return records.groupBy(node).agg(F.sha2(F.concat_ws(":", F.count("*"), *[part(k) for k in range(4)]), 256).alias("hash"))


def parents(nodes: DataFrame) -> DataFrame:
    """The level above: each node's hash is over its up to 16 children, in order and with their places."""
    own = F.array_sort(F.collect_list(F.struct("node", "hash")))
    text = F.transform(own, lambda c: F.concat_ws(":", c["node"], c["hash"]))
    return nodes.groupBy(F.floor(F.col("node") / FANOUT).alias("node")).agg(F.sha2(F.array_join(text, ","), 256).alias("hash"))


def tree(records: DataFrame, height: int) -> list[DataFrame]:
    """The levels of a replica's tree, leaves first; ``height`` levels stand above them."""
    levels = [cut(leaves(records))]
    for _ in range(height):
        levels.append(cut(parents(levels[-1])) if len(levels) % 3 == 0 else parents(levels[-1]))
    return levels


def _height(*records: DataFrame) -> int:
    """Levels needed to gather all archives under the nodes 0 and -1."""
    top = 1
    for df in records:
        low, high = df.agg(F.min("archive"), F.max("archive")).first()
        top = max(top, high + 1 if high is not None else 1, -low if low is not None else 1)
    height = 1
    while FANOUT**height < top * SLOTS:
        height += 1
    return height


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Compares two sets of (page_id, url, html) record by record, through their Merkle trees.

    One row for each record that differs: page_id, archive, slot, copy, status, and offset and length in
    each replica. Status: missing (not in the replica), extra (only there), altered (other bytes),
    moved (same bytes at another offset, as after a record of another length). From the roots down,
    only the children of unlike nodes are compared, and only records of unlike leaves are listed. Like
    replicas, empty ones too, give an empty result. Other columns are ignored.
    """
    a = index_records(primary)
    b = index_records(replica)
    height = _height(primary.select(F.floor(F.col("page_id") / SLOTS).alias("archive")), replica.select(F.floor(F.col("page_id") / SLOTS).alias("archive")))
    if primary.where("page_id is null").limit(1).count() or replica.where("page_id is null").limit(1).count():
        height = max(height, 11)  # spare slots reach down to -2^40
    tree_a, tree_b = tree(a, height), tree(b, height)
    unlike = None
    for level in range(height, -1, -1):
        left, right = tree_a[level].alias("a"), tree_b[level].alias("b")
        if unlike is not None:
            below = F.floor(F.col("node") / FANOUT)
            left = tree_a[level].join(unlike, below == F.col("parent"), "left_semi").alias("a")
            right = tree_b[level].join(unlike, below == F.col("parent"), "left_semi").alias("b")
        both = left.join(right, F.col("a.node") == F.col("b.node"), "full_outer")
        both = both.where(~F.col("a.hash").eqNullSafe(F.col("b.hash")))
        unlike = cut(both.select(F.coalesce("a.node", "b.node").alias("parent")))
    here = lambda df: df.join(unlike, F.col("archive") * SLOTS + F.col("slot") == F.col("parent"), "left_semi")
    left, right = here(a).alias("a"), here(b).alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("archive", "slot", "copy")]
    status = (
        F.when(F.col("b.sha").isNull(), "missing").when(F.col("a.sha").isNull(), "extra")
        .when(F.col("a.sha") != F.col("b.sha"), "altered").when(F.col("a.offset") != F.col("b.offset"), "moved")
    )
    return left.join(right, same, "full_outer").select(
        *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("page_id", "archive", "slot", "copy")],
        status.alias("status"),
        F.col("a.offset").alias("offset"), F.col("b.offset").alias("replica_offset"),
        F.col("a.length").alias("length"), F.col("b.length").alias("replica_length"),
    ).where("status is not null")


def damaged_replica(pages: DataFrame) -> DataFrame:
    """A copy of the pages as a failing disk may leave it, to audit against: by the MD5 of the page_id, of 256 pages one each has its
    first character replaced, reads as zeros, is lost, is cut to half, or is there twice. What follows in an archive moves."""
    code = F.left(F.md5(F.col("page_id").cast("string")), F.lit(2))
    spoilt = F.concat(F.lit("\u0001"), F.substring("html", 2, 2**31 - 1))
    half = F.substring("html", F.lit(1), F.floor(F.char_length("html") / 2).cast("int"))
    html = F.when(code == "00", spoilt).when(code == "01", F.repeat(F.lit("0"), F.octet_length("html"))).when(code == "03", half).otherwise(F.col("html"))
    times = F.when(code == "02", 0).when(code == "04", 2).otherwise(1)
    return pages.select("page_id", "url", html.alias("html"), F.explode(F.array_repeat(F.lit(0), times)).alias("again")).drop("again")
