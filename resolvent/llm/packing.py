"""Operator 5: conflict-constrained best-fit packing of documents into sequences.

A bin holds ``capacity`` words.  Bins are kept in order of their residual; a
document goes into the tightest bin that fits, found by a successor search from
its size upwards that continues while a bin conflicts.  Every bin carries
bitmaps: one of its duplicate clusters (two texts of one cluster never share a
bin) and ``per_source`` of its sources (a source has at most so many documents
in a bin).

Documents are dealt into shards by a hash of id and text, with the number of
shards in proportion to the number of documents, so that a shard has a bounded
expected size whatever source or cluster is hot; bins do not cross shards.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents that a shard has on average.
SHARD = 4096
CAPACITY = 2048


class Packer:
    """Bins ordered by residual, each with bitmaps of what it holds."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []  # (residual, bin)
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []  # bitmap j: sources with more than j documents
        self.count: list[int] = []

    def add(self, size: int, source: int, cluster: int) -> tuple[int, int, int]:
        """(bin, start, position): the tightest compatible bin, or a new one."""
        s, c = 1 << source, 1 << cluster
        at = bisect_left(self.order, (size, -1))
        while at < len(self.order):
            room, b = self.order[at]
            if not self.clusters[b] & c and not self.sources[b][-1] & s:
                del self.order[at]
                break
            at += 1
        else:
            b, room = len(self.clusters), self.capacity
            self.clusters.append(0)
            self.sources.append([0] * self.per_source)
            self.count.append(0)
        self.clusters[b] |= c
        maps = self.sources[b]
        for j in range(self.per_source):
            if not maps[j] & s:
                maps[j] |= s
                break
        if room > size:  # a full bin takes no more
            insort(self.order, (room - size, b))
        self.count[b] += 1
        return b, self.capacity - room, self.count[b] - 1


def _pack(capacity: int, per_source: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "none", "id", "h", "piece", "copy"], ascending=[False, False, True, True, True, True], kind="stable")
        sources, clusters = pd.factorize(pdf["source"], use_na_sentinel=False)[0], pd.factorize(pdf["cluster"])[0]
        packer = Packer(capacity, per_source)
        got = [packer.add(int(n), int(s), int(c)) for n, s, c in zip(pdf["size"], sources, clusters, strict=True)]
        return pd.DataFrame({"shard": key[0], "id": pdf["id"].array, "none": pdf["none"].array, "piece": pdf["piece"].array, "size": pdf["size"].array, "source": pdf["source"].array, "cluster": pdf["cluster"].array, "bin": [x[0] for x in got], "start": [x[1] for x in got], "position": [x[2] for x in got]})

    return run


def n_words(text: str):
    """The number of words ``[^\\x20\\x09-\\x0D]+`` of a column; 0 for null."""
    t = F.coalesce(F.col(text), F.lit(""))
    inner = F.regexp_count(t, F.lit("[^\\x20\\x09-\\x0D]+"))
    return inner.cast("long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, capacity: int = CAPACITY, per_source: int = 3, shard: int = SHARD) -> DataFrame:
    """(id_col, piece, n_words, source, cluster, bin_id, start, position): where every word of every document goes.

    Sizes are words.  A text of more than ``capacity`` words is cut into full
    pieces, each a bin of its own, and a rest; pieces of one text never share a
    bin.  The cluster is ``cluster_col`` or, without it (or where null), the
    text itself, so that exact copies never meet in a bin.  A null source is a
    source of its own.  A null, empty or blank text has one piece of 0 words.
    A null id stays null.  Documents are taken by size, the largest first; ties
    go by id (null first), text and piece.  Repeated rows are packed once each.
    Other columns are not read; an empty table gives an empty table.
    """
    own = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    cluster = own if cluster_col is None else F.coalesce(F.col(cluster_col).cast("string"), own)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), cluster.alias("cluster"), n_words(text_col).alias("n"))
    count = rows.count()
    shards = max(1, -(-count // shard))
    # Equal rows get a number of their own, only to tell copies apart in the order.
    rows = rows.withColumn("h", F.xxhash64("cluster")).withColumn("copy", F.monotonically_increasing_id())
    pieces = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.expr(f"(n - 1) div {capacity}")).cast("long"))
    rows = rows.withColumn("piece", F.explode(pieces)).withColumn("size", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity))
    # Copies of one text and pieces of one document spread over the shards.
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", "h", "piece"), F.lit(shards)))
    # A null id travels as a flag: pandas would make doubles of a column of ids with nulls.
    rows = rows.withColumn("none", F.col("id").isNull()).withColumn("id", F.coalesce("id", F.lit(0).cast("long")))
    out = "shard long, id long, none boolean, piece long, size long, source string, cluster string, bin long, start long, position long"
    packed = rows.select("shard", "id", "none", "h", "copy", "piece", "size", "source", "cluster").groupBy("shard").applyInPandas(_pack(capacity, per_source), out)
    bin_id = F.concat_ws("-", "shard", "bin")
    return packed.select(F.when(~F.col("none"), F.col("id")).alias(id_col), "piece", F.col("size").alias("n_words"), "source", "cluster", bin_id.alias("bin_id"), "start", "position")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
