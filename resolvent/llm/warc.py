"""Operator 8: WARC archives, written and read back with boundary-chain verification.

Writing: one record per page, as a row of Spark's text writer whose line break
is the record's last byte, so files appear by Spark's own commit protocol and
on any file system.  Of equal payloads the first is a response, others revisit
it with no block of their own.

Reading: files are split at the record magic by the text reader, so a file of
any size is read by many tasks.  Each piece is a candidate record with its own
offset and that of its successor (from its Content-Length).  The magic may also
stand inside a payload: pointer jumping from the start of each file keeps only
the records that the chain reaches.  Runs of candidates that follow each other
are contracted first, so the jumps go over runs and not over records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._scratch import Scratch
from ._skew import HOT, frequent, join_unique

MAGIC = "WARC/1.0\r\n"
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
#: Groups of equal payloads up to which their table is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 20_000
_DATE = "2026-01-01T00:00:00Z"


def _header_safe(c: Column) -> Column:
    """A header value without control characters (percent-encoded line ends)."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "%", "%25"), "\r", "%0D"), "\n", "%0A")


def _header_text(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "%0A", "\n"), "%0D", "\r"), "%25", "%")


def decide_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """(id, url, payload, bytes, digest, kind, refers): what each page is written as.

    A group of equal payloads is reduced to its smallest id before it is joined,
    and payloads with very many copies are answered by a broadcast.  A null
    payload is empty, a null id is written without a record id and is never the
    smallest; rows of one id are records of their own, and of equal ones all but
    those with the smallest id revisit it.  Other columns are not read; an empty
    table gives an empty table.
    """
    scratch = Scratch(pages.sparkSession)
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit(""))
    x = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    x = x.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    first = x.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    first = scratch.cut(first.select("digest", "first", "n"), "copies")
    if first.count() <= BROADCAST_ROWS:
        x = x.join(F.broadcast(first.drop("n")), "digest", "left")
    else:  # fewer than HOT payloads hold more than a HOTth part of the pages each
        x = join_unique(x, first.drop("n"), ["digest"], "left", first.where(F.col("n") > pages.count() // HOT).select("digest"))
    again = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    return x.select("id", "url", "payload", "bytes", "digest", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers"))


def write_archives(records: DataFrame, path: str) -> None:
    """Write the rows of ``decide_records`` as WARC files under ``path``."""
    revisit = F.col("kind") == "revisit"
    uri = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    line = lambda name, c: F.coalesce(F.concat(F.lit(f"{name}: "), c, F.lit("\r\n")), F.lit(""))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    head = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.col("kind")), line("WARC-Record-ID", uri(F.col("id"))), line("WARC-Target-URI", _header_safe(F.col("url"))),
        line("WARC-Date", F.lit(_DATE)), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Refers-To", uri(F.col("refers"))), line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"),
    )
    # The writer adds the last "\n" of the record's closing "\r\n\r\n".
    records.select(F.concat(head, body, F.lit("\r\n\r")).alias("value")).write.text(path, lineSep="\n")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, piece, size, text): what stands between two magics, in the order of the file."""
    x = spark.read.text(path, lineSep=MAGIC)
    x = x.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("piece"), F.col("value").alias("text"))
    return x.withColumn("size", F.octet_length("text").cast("long"))


def _placed(x: DataFrame) -> DataFrame:
    """Pieces with their offset ``at`` in the file: the bytes of all pieces before them.

    The order inside a split is summed in the split, splits are summed by file.
    The first piece of a file stands before its first magic and gets at < 0.
    """
    n = F.col("size") + len(MAGIC)
    inside = Window.partitionBy("file", "block").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("in_block", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    blocks = x.groupBy("file", "block").agg(F.sum(n).alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("ahead", F.coalesce(F.sum("bytes").over(before), F.lit(0))).drop("bytes")
    x = x.join(blocks, ["file", "block"])
    return x.withColumn("at", F.col("ahead") + F.col("in_block") - len(MAGIC)).drop("in_block", "ahead", "block", "piece")


_HEAD = "substring_index(text, '\\r\\n\\r\\n', 1)"


def _field(name: str) -> Column:
    """A header field; null where it is absent."""
    return F.expr(f"nullif(regexp_extract(concat('\\n', head, '\\r'), '\\n{name}: ([^\\r]*)\\r', 1), '')")


def _parsed(x: DataFrame) -> DataFrame:
    """Pieces read as records: header fields, declared length, and bytes and digest of the payload itself."""
    x = x.withColumn("head", F.expr(_HEAD)).withColumn("body", F.expr("substring(text, char_length(head) + 5)"))
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '<urn:page:(-?[0-9]+)>', 1), '') as bigint)")
    x = x.withColumn("length", F.when(F.expr("locate('\\r\\n\\r\\n', text) > 0"), F.expr("try_cast(regexp_extract(concat('\\n', head, '\\r'), '\\nContent-Length: ([0-9]{1,18})\\r', 1) as bigint)")))
    x = x.withColumn("span", F.octet_length("head").cast("long") + F.col("length") + (len(MAGIC) + 8))
    x = x.withColumns({"rid": F.coalesce(_field("WARC-Record-ID"), F.lit("")), "ref": F.coalesce(_field("WARC-Refers-To"), F.lit("")), "kind": _field("WARC-Type")})
    x = x.withColumns({"id": number("rid"), "refers": number("ref"), "url": _header_text(_field("WARC-Target-URI")), "said": F.regexp_replace(_field("WARC-Payload-Digest"), "^sha256:", "")})
    payload = F.expr("substring(body, 1, char_length(body) - 4)")  # the closing CR LF CR LF
    return x.withColumn("payload", payload).drop("head", "body", "rid", "ref")


def reachable(spark: SparkSession, chain: DataFrame, scratch: Scratch) -> DataFrame:
    """The (file, at) of ``chain`` (file, at, next) that are reached from offset 0 of their file.

    Candidates that follow each other form a run; runs are jumped over by
    doubling their pointers until no file can have a longer chain.
    """
    w = Window.partitionBy("file").orderBy("at")
    x = chain.withColumn("prev_next", F.lag("next").over(w))
    starts = F.when(F.col("prev_next") == F.col("at"), 0).otherwise(1)
    x = x.withColumn("run", F.sum(starts).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = scratch.cut(x.select("file", "at", "next", "run"), "runs")
    tails = x.groupBy("file", "run").agg(F.max(F.struct("at", "next"))["next"].alias("next"))
    entry = x.select("file", F.col("at").alias("next"), F.col("run").alias("to_run"))
    # A run leads to another run, at the offset where its last candidate points.
    jump = tails.join(entry, ["file", "next"]).select("file", "run", "to_run", F.col("next").alias("to_at"))
    jump = scratch.cut(jump.where("to_run <> run"), "jumps")
    reach = scratch.cut(x.where("at = 0").select("file", "run", F.col("at").alias("from_at")), "reach")
    known = reach.count()
    while not jump.isEmpty():
        step = reach.join(jump, ["file", "run"]).select("file", F.col("to_run").alias("run"), F.col("to_at").alias("from_at"))
        more = scratch.cut(reach.union(step).groupBy("file", "run").agg(F.min("from_at").alias("from_at")), "reach")
        n = more.count()
        scratch.forget(reach)
        reach = more
        if n == known:
            break
        known = n
        twice = jump.alias("j").join(jump.alias("k"), (F.col("j.file") == F.col("k.file")) & (F.col("j.to_run") == F.col("k.run")))
        after = scratch.cut(twice.select("j.file", "j.run", F.col("k.to_run").alias("to_run"), F.col("k.to_at").alias("to_at")), "jumps")
        scratch.forget(jump)
        jump = after
    return x.join(reach, ["file", "run"]).where("at >= from_at").select("file", "at")


def archive_index(spark: SparkSession, path: str, scratch: Scratch | None = None) -> DataFrame:
    """(file, at, id, url, kind, refers, said, bytes, digest) of every record that the boundary chain reaches.

    ``said`` is the digest in the header; ``bytes`` and ``digest`` are those of
    the payload as read.  No payload is shuffled but those that hold the magic.
    An archive without records gives no rows; a file whose chain breaks gives
    the records before the break.
    """
    scratch = scratch or Scratch(spark)
    whole = ["id", "url", "kind", "refers", "said"]
    x = _parsed(_pieces(spark, path)).withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    x = scratch.cut(x.select("file", "block", "piece", "size", "span", *whole, "bytes", "digest"), "pieces")
    placed = scratch.cut(_placed(x).where("at >= 0"), "candidates")
    chain = placed.select("file", "at", (F.col("at") + F.col("span")).alias("next"))
    real = scratch.cut(reachable(spark, chain, scratch).withColumn("real", F.lit(True)), "real")
    x = placed.join(real, ["file", "at"], "left")
    # A piece that is no record belongs to the payload of the last record before it.
    owner = F.last(F.when(F.col("real"), F.col("at")), True).over(Window.partitionBy("file").orderBy("at"))
    inner = scratch.cut(x.select("file", "at", owner.alias("owner")).where("owner <> at"), "inner")
    out = x.where("real").select("file", "at", *whole, "bytes", "digest")
    if inner.isEmpty():
        return out
    parts = inner.union(inner.select("file", F.col("owner").alias("at"), "owner").distinct())
    files = F.broadcast(inner.select("file").distinct()) if inner.select("file").distinct().count() <= 10_000 else inner.select("file").distinct()
    texts = _placed(_pieces(spark, path).join(files, "file", "left_semi")).join(parts, ["file", "at"])
    texts = texts.groupBy("file", F.col("owner").alias("at")).agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("o"), "text"))).alias("t"))
    joined = _parsed(texts.select("file", "at", F.array_join(F.transform("t", lambda t: t["text"]), MAGIC).alias("text")))
    joined = joined.select("file", "at", F.octet_length("payload").cast("long").alias("bytes2"), F.sha2("payload", 256).alias("digest2"))
    out = out.join(joined, ["file", "at"], "left")
    return out.select("file", "at", *whole, F.coalesce("bytes2", "bytes").alias("bytes"), F.coalesce("digest2", "digest").alias("digest"))


def read_archives(spark: SparkSession, path: str, scratch: Scratch | None = None) -> DataFrame:
    """(id, url, kind, refers, digest, payload) of the records of ``archive_index``, with their payloads; null for a revisit."""
    index = archive_index(spark, path, scratch)
    w = Window.partitionBy("file").orderBy("at")
    texts = _placed(_pieces(spark, path)).where("at >= 0").join(index.select("file", "at", F.col("at").alias("o")), ["file", "at"], "left")
    texts = texts.withColumn("owner", F.last("o", True).over(w)).where("owner is not null")
    texts = texts.groupBy("file", F.col("owner").alias("at")).agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("p"), "text"))).alias("t"))
    texts = _parsed(texts.select("file", "at", F.array_join(F.transform("t", lambda t: t["text"]), MAGIC).alias("text"))).select("file", "at", "payload")
    x = index.join(texts, ["file", "at"])
    return x.select("id", "url", "kind", "refers", F.col("said").alias("digest"), F.when(F.col("kind") == "response", F.col("payload")).alias("payload"))


def resolved(index: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, bytes, digest, kind, refers): revisits take bytes and digest from the response they refer to."""
    scratch = scratch or Scratch(index.sparkSession)
    index = scratch.cut(index.select("id", "kind", "refers", "said", "bytes", "digest"), "index")
    answers = index.where("kind = 'response'").groupBy(F.col("id").alias("rid"), F.col("digest").alias("rdigest")).agg(F.max("bytes").alias("rbytes"))
    answers = answers.select(F.col("rid").alias("refers"), F.col("rdigest").alias("said"), "rbytes")
    again = scratch.cut(index.where("kind = 'revisit'").select("id", "kind", "refers", "said"), "revisits")
    again = join_unique(again, answers, ["refers", "said"], hot=frequent(again, ["refers", "said"], scratch))
    again = again.select("id", F.col("rbytes").alias("bytes"), F.col("said").alias("digest"), "kind", "refers")
    return index.where("kind = 'response'").select("id", "bytes", "digest", "kind", "refers").union(again)


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    path = scratch.path("warc")
    write_archives(decide_records(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    out = resolved(archive_index(spark, path, scratch), scratch)
    return out.select(F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers").alias("refers_to"))


#: The result of op8 in DuckDB SQL.
ORACLE = """
with p as (
  select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), f as (
  select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest
)
select page_id, payload_bytes, p.payload_digest, case when first is null or page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from p left join f on p.payload_digest = f.payload_digest
"""
