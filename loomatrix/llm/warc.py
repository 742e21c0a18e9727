"""WARC archives: writing with payload deduplication, and reading by boundary chains.

Writing: Spark's text writer puts out one archive a partition; a record is a row, and the
two line breaks that end it are the writer's line separator.

Reading: Spark splits the archives at the magic line, wherever it stands. Each piece is a
candidate record: its offset is a running sum of lengths in its file, and its header's
Content-Length names its successor's offset. The magic line may stand inside a payload,
so a candidate is a record only if the chain of successors from the file's start reaches
it. Candidates each of which is followed by its own successor are a run: a chain that
enters a run goes on to its end. Pointer jumping over runs finds those that the chain
enters, and where, in as many rounds as the number of runs on it has binary digits; all
other candidates are parts of the payload around them.

Joins here are sort-merge joins: both sides grow with the pages, and tables of offsets pack
so well that their files look small enough to be sent to every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, null_safe, written

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: Payloads of fewer bytes are never replaced by a revisit.
LEAST_BYTES = 100


def _clean(column: Column) -> Column:
    """A header value without line breaks, which would end it."""
    return F.regexp_replace(F.coalesce(column.cast("string"), F.lit("")), r"[\r\n]+", "%0D%0A")


def write_warc(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes one record for each row of pages to gzipped archives in folder.

    Of rows with equal payloads of LEAST_BYTES bytes or more those with the smallest id
    are responses, others revisits that name it and hold no payload. A null payload is
    empty, a null url is an empty header; a null id is smaller than none, so that a
    revisit never refers to it unless all ids of its payload are null, in which case
    all are responses. Repeated rows each give a record. Other columns are ignored.
    """
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), F.coalesce(pages[payload_col], F.lit("")).alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    # digests alone are dealt by digest; payloads move once at most, and a partition is an archive
    light = rows.select("id", "bytes", "digest")
    first = light.where(F.col("bytes") >= LEAST_BYTES).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("first").isNotNull())
    # written, so that Spark can split the rows of a digest that very many pages share
    first = written(first).hint("merge")
    copies = light.where(F.col("bytes") >= LEAST_BYTES).join(first, "digest").where("id is null or id <> first").select("id", "digest", "first").distinct()
    marked = null_safe(rows, copies.hint("merge"), ["id", "digest"], "left")
    revisit = F.col("first").isNotNull()
    header = F.concat(
        F.lit(MAGIC),
        F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Target-URI: "), _clean(F.col("url")),
        F.lit("\r\nWARC-Record-ID: "), _clean(F.col("id")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.lit("\r\nWARC-Payload-Length: "), F.col("bytes").cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: identical-payload-digest\r\nWARC-Refers-To: "), _clean(F.col("first")))).otherwise(""),
        F.lit("\r\nContent-Length: "), F.when(revisit, "0").otherwise(F.col("bytes").cast("string")),
        F.lit(END),
    )
    records = marked.select(F.concat(header, F.when(revisit, "").otherwise(F.col("payload"))).alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").text(folder)


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("header", rf"(?:^|\r\n){name}: ?([^\r\n]*)", 1), F.lit(""))


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    """(file, block, k, value): what stands between magic lines, k in order within a block.

    file is a hash of the path: a long path in each row would pack well in a shuffle and
    so let Spark take tables for small that are large in memory.
    """
    text = spark.read.option("lineSep", MAGIC).text(folder)
    return text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"), F.col("value").cast("binary").alias("value"))


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each piece that follows a magic line: (file, block, run, k, start, succ, length,
    header, digest).

    start is the offset of the magic line, succ that of the record's successor by its
    Content-Length (null without one), digest that of the payload if the piece holds all
    of it. Such a piece's successor is the piece after it; the others end a run of their block.
    """
    parts = _pieces(spark, folder).withColumn("size", F.octet_length("value").cast("long")).withColumn("head", F.expr(f"instr(cast(decode(value, 'ISO-8859-1') as string), '{END}')").cast("long"))
    parts = parts.withColumn("header", F.expr("decode(substring(value, 1, cast(head as int) - 1), 'UTF-8')"))
    parts = parts.withColumn("length", F.expr("try_cast(regexp_extract(header, '(?i)(?:^|\\r\\n)Content-Length: *([0-9]{1,18})', 1) as bigint)"))
    whole = (F.col("head") > 0) & (F.col("size") == F.col("head") + 3 + F.col("length") + 4)
    parts = parts.withColumn("digest", F.when(whole, F.sha2(F.expr("substring(value, cast(head as int) + 4, cast(length as int))"), 256)))
    light = written(parts.select("file", "block", "k", "size", "head", "length", "header", "digest"))
    # offsets: a running sum within each block, after the sums of the file's blocks before it
    size = F.col("size") + len(MAGIC)
    blocks = light.groupBy("file", "block").agg(F.sum(size).alias("block_size"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("base", F.coalesce(F.sum("block_size").over(before), F.lit(0))).drop("block_size")
    within = Window.partitionBy("file", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.coalesce(F.count_if(F.col("digest").isNull()).over(within), F.lit(0))
    placed = light.withColumn("inner", F.coalesce(F.sum(size).over(within), F.lit(0))).withColumn("run", ends).join(blocks.hint("merge"), ["file", "block"])
    # the first piece is what stands before the first magic line; every other began with one
    start = F.col("base") + F.col("inner") - len(MAGIC)
    placed = placed.withColumn("start", start)
    succ = F.when(F.col("head") > 0, F.col("start") + len(MAGIC) + F.col("head") + 3 + F.col("length") + len(END))
    return placed.where("start >= 0").select("file", "block", "run", "k", "start", succ.alias("succ"), "length", "header", "digest")


def reachable(found: DataFrame) -> DataFrame:
    """The candidates on the chain from each file's start, by pointer jumping over runs.

    A pointer leads from a run to the candidate that succeeds its last one, in whatever
    run that stands; successors lie behind, so that a chain enters a run once at most.
    """
    run = ["file", "block", "run"]
    last = found.groupBy(*run).agg(F.max_by("succ", "start").alias("at")).where("at is not null")
    # a pointer to no candidate ends the chain
    there = found.select("file", F.col("start").alias("at"), F.struct("block", "run").alias("to"))
    jump = written(last.join(there.hint("merge"), ["file", "at"]).select(*run, "to", "at"))
    reached = written(found.where("start = 0").select(*run, F.col("start").alias("at")))
    while not jump.isEmpty():
        more = reached.drop("at").join(jump.hint("merge"), run).select("file", "to.block", "to.run", "at")
        reached = written(reached.union(more).distinct())
        twice = jump.select("file", F.struct("block", "run").alias("to"), F.col("to").alias("then"), F.col("at").alias("then_at"))
        jump = written(jump.join(twice.hint("merge"), ["file", "to"]).select(*run, F.col("then").alias("to"), F.col("then_at").alias("at")))
    return found.join(reached.hint("merge"), run).where(F.col("start") >= F.col("at")).drop("at")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record of the archives in folder: (record_id, uri, record_type,
    refers_to, length, payload_bytes, payload_digest, header_digest).

    payload_bytes and payload_digest (hex SHA-256) are computed from the stored payload,
    magic lines in it included; a revisit has those that its header names. What follows
    a broken record in a file is unreachable and isn't read as records. An empty folder
    of archives gives an empty result.
    """
    found = written(candidates(spark, folder))
    records = reachable(found)
    split = written(records.where("digest is null and succ is not null").select("file", F.col("start").alias("owner"), "succ", "length"))
    if not split.isEmpty():
        # payloads that hold magic lines: gather their pieces by the record around them
        line = Window.partitionBy("file").orderBy("start", "mark").rowsBetween(Window.unboundedPreceding, 0)
        marks = split.select("file", F.col("owner").alias("start"), F.lit(0).alias("mark"), F.struct("owner", "succ", "length").alias("open"))
        pieces = found.join(split.select("file").distinct().hint("merge"), "file", "left_semi").select("file", "start", F.lit(1).alias("mark"), F.lit(None).cast("struct<owner:bigint,succ:bigint,length:bigint>").alias("open"), "block", "k")
        owned = pieces.unionByName(marks, allowMissingColumns=True).withColumn("open", F.last("open", ignorenulls=True).over(line))
        owned = owned.where("mark = 1 and start < open.succ").select("file", "block", "k", "start", "open.*")
        texts = _pieces(spark, folder).join(owned.hint("merge"), ["file", "block", "k"])
        whole = texts.groupBy("file", "owner", "length").agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("some"))
        joined = F.expr(f"unhex(array_join(transform(some, x -> hex(x.value)), '{MAGIC.encode().hex()}'))")
        whole = whole.select("file", F.col("owner").alias("start"), "length", joined.alias("value"))
        at = F.expr(f"instr(decode(value, 'ISO-8859-1'), '{END}')")
        whole = whole.withColumn("head", at).select("file", "start", F.sha2(F.expr("substring(value, head + 4, cast(length as int))"), 256).alias("joined_digest"))
        records = records.join(whole.hint("merge"), ["file", "start"], "left")
    else:
        records = records.withColumn("joined_digest", F.lit(None).cast("string"))
    revisit = _field("WARC-Type") == "revisit"
    return records.where("succ is not null").select(
        _field("WARC-Record-ID").alias("record_id"),
        _field("WARC-Target-URI").alias("uri"),
        _field("WARC-Type").alias("record_type"),
        _field("WARC-Refers-To").alias("refers_to"),
        "length",
        F.when(revisit, _field("WARC-Payload-Length").cast("long")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace(_field("WARC-Payload-Digest"), "^sha256:", "")).otherwise(F.coalesce("digest", "joined_digest")).alias("payload_digest"),
    )


def archive_folder(spark: SparkSession) -> str:
    return new_path(spark, "archives")
