"""Merkle fixity audit of WARC archives.

Records stand in files in a fixed order, ``PER_FILE`` to a file, each at a byte offset. A leaf hashes one record
(its number, offset, length and SHA-256); a node hashes its ``FANOUT`` ordered children, so it vouches for a range
of offsets. Three levels make a file's tree, further levels join the files' roots to one root. An audit compares
the roots of two replicas and goes down only where hashes differ, to the records that were changed, lost or added.

``write_archive`` writes the files and gives their index, ``read_replica`` hashes what stands in the index's ranges of another copy.

Each level is a grouped hash of at most ``FANOUT`` rows per group, whatever the data; the tree has a row for each
leaf and a fifteenth more. Only digests are shuffled, never records. All of it is DataFrame functions.

Defined results: null addresses and payloads are empty ones; records are ordered by id, nulls first, ties by
their digest; equal records are separate ones; two empty archives agree.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliogrid.session import cut, small

FANOUT_BITS = 4
FANOUT = 1 << FANOUT_BITS
FILE_LEVELS = 3
PER_FILE = FANOUT**FILE_LEVELS


def record(record_id: Column, uri: Column, payload: Column) -> Column:
    """A WARC/1.1 resource record as text; its UTF-8 bytes are what stands in a file."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(uri, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def pack(records: DataFrame, record_id: str, content: str, *carried: str) -> DataFrame:
    """(id, carried columns, ordinal, file, number, offset, length, sha): where each record stands.

    Records are range-partitioned by (id, digest) and numbered inside their partition; the partitions' counts
    give the offsets of the numbers. No window is longer than a file.
    """
    light = cut(records.select(F.col(record_id).alias("id"), F.octet_length(content).cast("long").alias("length"), F.sha2(content, 256).alias("sha"), *carried))
    placed = light.repartitionByRange("id", "sha").sortWithinPartitions("id", "sha").withColumn("mono", F.monotonically_increasing_id())
    placed = cut(placed.withColumn("part", F.shiftright("mono", 33)).withColumn("own", F.col("mono").bitwiseAND(F.lit((1 << 33) - 1))))
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    first = counts.select(F.col("part").alias("p"), F.expr("sum(n) over (order by part) - n").alias("first"))
    numbered = placed.join(small(first), F.col("part") == F.col("p")).withColumn("ordinal", F.col("first") + F.col("own"))
    numbered = numbered.withColumn("file", F.shiftright("ordinal", FANOUT_BITS * FILE_LEVELS)).withColumn("number", F.col("ordinal").bitwiseAND(F.lit(PER_FILE - 1)))
    numbered = numbered.withColumn("offset", F.expr("sum(length) over (partition by file order by number) - length"))
    return numbered.select("id", "ordinal", "file", "number", "offset", "length", "sha", *carried)


def tree(leaves: DataFrame) -> list[DataFrame]:
    """Levels of (replica, node, hash) from leaves (replica, ordinal, offset, length, sha), up to one root for each replica."""
    level = leaves.select("replica", F.col("ordinal").alias("node"), F.sha2(F.concat_ws(":", F.col("ordinal"), F.col("offset"), F.col("length"), F.col("sha")), 256).alias("hash"))
    level = cut(level)
    levels = [level]
    top = level.agg(F.max("node")).first()[0] or 0
    while top > 0:
        children = F.array_sort(F.collect_list(F.struct("node", "hash")))
        level = level.groupBy("replica", F.shiftright("node", FANOUT_BITS).alias("parent")).agg(children.alias("children"))
        level = cut(level.select("replica", F.col("parent").alias("node"), F.sha2(F.concat_ws(",", F.transform("children", lambda c: F.concat_ws(":", c["node"], c["hash"]))), 256).alias("hash")))
        levels.append(level)
        top >>= FANOUT_BITS
    return levels


def write_archive(records: DataFrame, path: str, record_id: str, content: str) -> DataFrame:
    """Write the archive's files below ``path``, ``file=N/part-*``, and give their index (id, ordinal, file, number, offset, length, sha).

    A file is what one task writes: ``PER_FILE`` records, one after the other without anything between. Each has
    to end with a line break (CR LF), as those of ``record`` do.
    """
    packed = pack(records, record_id, content, content)
    # a record ends with an empty line: the writer's separator stands for its last line break
    body = F.col(content).substr(F.lit(1), F.length(content) - 2)
    packed.repartition("file").sortWithinPartitions("file", "number").select("file", body.alias("value")).write.partitionBy("file").option("lineSep", "\r\n").text(path)
    return packed.drop(content)


def read_replica(index: DataFrame, path: str) -> DataFrame:
    """(ordinal, offset, length, sha) of what stands in a copy's files at the index's ranges; ranges behind a file's end, or of no file, are left out."""

    def run(key, ranges: pd.DataFrame, files: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(files):
            data = b"".join(files.sort_values("path")["content"])
            for r in ranges.sort_values("offset").itertuples():
                held = data[r.offset : r.offset + r.length]
                if held:
                    rows.append((r.ordinal, r.offset, len(held), hashlib.sha256(held).hexdigest()))
        return pd.DataFrame(rows, columns=["ordinal", "offset", "length", "sha"])

    files = index.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    files = files.select(F.regexp_extract("path", r"file=(\d+)/", 1).cast("long").alias("file"), "path", "content")
    return index.select("file", "ordinal", "offset", "length").groupBy("file").cogroup(files.groupBy("file")).applyInPandas(run, "ordinal long, offset long, length long, sha string")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Records that differ between two replicas: ordinal, kind, and offset, length and sha of either side.

    Both have (ordinal, offset, length, sha). kind is ``altered``, ``moved`` (the same bytes at another offset), ``missing`` (not in the replica) or ``extra``.
    """
    columns = ["ordinal", "offset", "length", "sha"]
    leaves = primary.select(F.lit("a").alias("replica"), *columns).unionByName(replica.select(F.lit("b").alias("replica"), *columns))
    levels = tree(leaves)

    def differing(level: DataFrame) -> DataFrame:
        sides = level.groupBy("node").agg(F.min(F.when(F.col("replica") == "a", F.col("hash"))).alias("a"), F.min(F.when(F.col("replica") == "b", F.col("hash"))).alias("b"))
        return sides.where(~F.col("a").eqNullSafe(F.col("b"))).select("node")

    bad = differing(levels[-1])
    for level in levels[-2::-1]:
        parents = cut(bad.select(F.col("node").alias("parent")))
        below = level.withColumn("parent", F.shiftright("node", FANOUT_BITS)).join(small(parents), "parent", "left_semi")
        bad = differing(below)
    found = cut(bad.select(F.col("node").alias("ordinal")))
    a = primary.join(small(found), "ordinal", "left_semi").select(*columns)
    b = replica.join(small(found), "ordinal", "left_semi").select("ordinal", *[F.col(c).alias(f"replica_{c}") for c in columns[1:]])
    both = a.join(b, "ordinal", "full_outer")
    kind = F.when(F.col("sha").isNull(), "extra").when(F.col("replica_sha").isNull(), "missing").when((F.col("sha") == F.col("replica_sha")) & (F.col("length") == F.col("replica_length")), "moved").otherwise("altered")
    return both.select("ordinal", kind.alias("kind"), "offset", "length", "sha", "replica_offset", "replica_length", "replica_sha")


def damaged(record_id: Column, payload: Column) -> tuple[Column, Column]:
    """(payload, lost) of a replica with decay, for trying an audit: by the digest of its id, a record of 256 has
    one character changed, one its second half cut off, and one is lost."""
    fate = F.substring(F.md5(F.coalesce(record_id.cast("string"), F.lit(""))), 1, 2)
    body = F.coalesce(payload, F.lit(""))
    half = F.floor(F.length(body) / 2).cast("int")
    middle = F.when(body.substr(half + 1, F.lit(1)) == "~", "^").otherwise("~")
    changed = F.concat(body.substr(F.lit(1), half), middle, body.substr(half + 2, F.length(body)))
    return F.when(fate == "00", changed).when(fate == "01", body.substr(F.lit(1), half)).otherwise(body), fate == "02"
