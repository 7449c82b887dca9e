"""WARC archives: writing, and reading by boundary-chain verification.

Writing: equal payloads are found by SHA-256; the row with the largest id becomes a response, the others revisit it. Records are
written by Spark's text writer, so that archives can be in any store.

Reading: tasks read any stretch of a file, cut at each occurrence of the version line. A payload may hold that line too, so an
occurrence is only a candidate: tasks emit its offset and the offset at which a record there would end. Pointer jumping from each
file's start, over stretches of a file at a time, keeps the candidates that the chain of records reaches and no others. Pieces
of a record whose payload holds the version line are then put together again.

Archives are read twice, for the boundaries and for the payloads, so that payloads needn't be stored in between. Both readings cut
files into the same stretches whatever the session's settings and executors are by then, and the second one fails if a stretch
doesn't have the pieces and bytes that the first one found in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, checked_broadcast, in_batches, join_counted

#: What a record begins with, and so what archives are cut at.
VERSION = "WARC/1.1\r\n"
#: What follows a record's block.
RECORD_END = 4
#: Written in each record; archives of the same rows are the same bytes.
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pieces that are handed to Python at once; payloads are large rows.
BATCH_ROWS = 500
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1: eight digits for each ten hexadecimal ones."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def record_types(payloads: DataFrame, least_bytes: int, scratch: Scratch) -> DataFrame:
    """(id, same, refers_to) of the rows of (id, n, same) whose payload a row with a larger id has as well."""
    groups = payloads.where((F.col("n") >= least_bytes) & F.col("id").isNotNull()).groupBy("same").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("size"))
    groups = scratch.keep(groups.where("size > 1"), "groups")
    return join_counted(payloads, groups, ["same"], "size").where("id <> refers_to").select("id", "same", "refers_to").distinct()


def header(name: str, value: Column) -> Column:
    """A header line; empty for a null value. Line breaks in a value are percent-encoded."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", *, least_bytes: int = 0) -> None:
    """Writes a record for each row into archives below `path`.

    The payload is the column's text in UTF-8; null counts as empty. Of rows with equal payloads of at least `least_bytes`, the one
    with the largest id is a response and the others revisit it without a block of their own; all others are responses. A row
    without an id is a response without an id. Rows that repeat an id are typed by their payloads: with one payload they share a
    type, with several each is a response or a revisit on its own, and a revisit's digest tells which response of that id it means.
    An empty table writes no records.
    """
    scratch = Scratch(df.sparkSession, "warc-types")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("same", F.unhex(F.sha2(F.col("payload").cast("binary"), 256)))
    payloads = scratch.keep(rows.select("id", F.octet_length("payload").alias("n"), "same"), "payloads")
    revisits = scratch.keep(record_types(payloads, least_bytes, scratch), "revisits")
    typed = rows.join(checked_broadcast(revisits), ["id", "same"], "left")
    is_revisit = F.col("refers_to").isNotNull()
    block = F.when(is_revisit, F.lit("")).otherwise(F.col("payload"))
    record_id = F.concat(F.lit("<urn:page:"), F.col("id").cast("string"), F.lit(">"))
    record = F.concat(
        F.lit(VERSION),
        header("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", record_id),
        header("WARC-Date", F.lit(DATE)),
        header("WARC-Target-URI", F.col("url")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("payload").cast("binary")))),
        header("WARC-Profile", F.when(is_revisit, F.lit(PROFILE))),
        header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        header("Content-Type", F.lit("text/html")),
        header("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
        block,
        F.lit("\r\n\r"),
    )
    typed.select(record.alias("value")).write.option("lineSep", "\n").text(path)  # the writer ends each record with its last byte
    scratch.close()


HEADER_LINE = re.compile(rb"([A-Za-z][A-Za-z0-9-]*):[ \t]*([^\r\n]*)\r\n")


def parse_head(piece: bytes) -> tuple[int, dict[str, str]] | None:
    """(bytes from the version line to the record's end, headers) if what follows a version line is a record's head."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    head, at, fields = piece[: end + 2], 0, {}
    while at < len(head):
        line = HEADER_LINE.match(head, at)
        if line is None:
            return None
        fields[line[1].decode().lower()] = line[2].decode("utf-8", "replace")
        at = line.end()
    length = fields.get("content-length", "")
    if not length.isdigit() or "warc-type" not in fields:
        return None
    return len(VERSION) + end + 4 + int(length) + RECORD_END, fields


def reading_session(spark: SparkSession) -> SparkSession:
    """A session of its own for one reading, so that its scans cut files by their sizes only, and all alike.

    Without spark.sql.files.minPartitionNum, the size of splits would follow the executors that are alive.
    """
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return own


def pieces(own: SparkSession, path: str) -> DataFrame:
    """(file, block, value): what lies between version lines, in stretches of files that tasks read."""
    raw = own.read.option("lineSep", VERSION).option("recursiveFileLookup", "true").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, bytes | None]]:
    """(file, block, number in the block, offset from the block's first piece, bytes); rows come in the order of the file.

    After a block's last piece comes a row with null bytes: how many pieces the block has, and where the next one would begin.
    """
    now, number, offset = None, 0, 0
    for batch in batches:
        for file, block, value in zip(batch.column(0), batch.column(1), batch.column(2)):
            where, data = (file.as_py(), block.as_py()), value.as_py()
            if where != now:
                if now:
                    yield *now, number, offset, None
                now, number, offset = where, 0, 0
            yield *where, number, offset, data
            number += 1
            offset += len(data) + len(VERSION)
    if now:
        yield *now, number, offset, None


def candidates(own: SparkSession, path: str) -> DataFrame:
    """(file, block, number, at, size, reach): of each piece its place, its bytes, and the bytes from its version line to its record's end."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("number", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("reach", pa.int64())])

    def found(batches):
        def rows():
            for file, block, number, at, data in numbered(batches):
                if data is not None:
                    head = parse_head(data)
                    yield file, block, number, at, len(data), head[0] if head else None

        yield from in_batches(rows(), schema, lambda row: 160)

    return pieces(own, path).mapInArrow(found, "file string, block long, number long, at long, size long, reach long")


def stretch_bases(found: DataFrame) -> DataFrame:
    """(file, block, base, limit, file_end): where each stretch's first piece begins, where the next one's would, the file's size."""
    sizes = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(VERSION)).alias("bytes"), F.count(F.lit(1)).alias("pieces"))
    whole, along = Window.partitionBy("file"), Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("base", F.coalesce(F.sum("bytes").over(along), F.lit(0))).withColumn("file_end", F.sum("bytes").over(whole) - len(VERSION))
    return bases.select("file", "block", "base", (F.col("base") + F.col("bytes") - len(VERSION)).alias("limit"), "file_end", "bytes", "pieces")


def record_entries(scratch: Scratch, stretches: DataFrame) -> DataFrame:
    """(file, offset) of candidates that the chain from their file's start reaches as the first ones of their stretch.

    Pointer jumping: after k rounds, `jumps` lead over 2 ** k stretches and `entries` are known for as many.
    """
    entries = scratch.keep(stretches.select("file").distinct().withColumn("offset", F.lit(0).cast("long")), "entries-0")
    jumps = scratch.keep(stretches.where("exit is not null").select("file", "offset", "exit"), "jumps-0")
    known, turn = entries.count(), 0
    while True:
        turn += 1
        further = entries.join(jumps, ["file", "offset"]).select("file", F.col("exit").alias("offset"))
        entries = scratch.keep(entries.unionByName(further).distinct(), f"entries-{turn}")
        now = entries.count()
        if now == known:
            return entries
        known = now
        onward = jumps.select("file", F.col("offset").alias("exit"), F.col("exit").alias("end"))
        jumps = scratch.keep(jumps.join(onward, ["file", "exit"]).select("file", "offset", F.col("end").alias("exit")), f"jumps-{turn}")
        scratch.drop(f"jumps-{turn - 1}")


def owned_pieces(scratch: Scratch, found: DataFrame, bases: DataFrame) -> DataFrame:
    """(file, block, number, head): of each piece, the offset of the record it belongs to; null if it belongs to none."""
    placed = found.join(bases, ["file", "block"]).withColumn("offset", F.col("base") + F.col("at") - len(VERSION))
    stretches = scratch.keep(placed.groupBy("file", "block").applyInArrow(followed, "file string, block long, number long, offset long, succ long, exit long"), "stretches")
    entries = record_entries(scratch, stretches).withColumn("entry", F.lit(True))
    entered = stretches.join(entries, ["file", "offset"], "left").select("file", "block", "number", "offset", "succ", F.coalesce("entry", F.lit(False)).alias("entry"))
    heads = scratch.keep(entered.groupBy("file", "block").applyInArrow(walked, "file string, block long, number long, offset long, succ long, is_head boolean"), "heads")
    # a piece belongs to the last head before it, if that record reaches so far; the last head may be in an earlier stretch
    last = heads.where("is_head").groupBy("file", "block").agg(F.max(F.struct("offset", "succ")).alias("last"))
    blocks = bases.select("file", "block").join(last, ["file", "block"], "left")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.last("last", ignorenulls=True).over(earlier).alias("inherited"))
    so_far = Window.partitionBy("file", "block").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    own = F.last(F.when(F.col("is_head"), F.struct("offset", "succ")), ignorenulls=True).over(so_far)
    joined = heads.withColumn("own", own).join(blocks, ["file", "block"]).withColumn("owner", F.coalesce("own", "inherited"))
    return joined.select("file", "block", "number", F.when(F.col("offset") < F.col("owner.succ"), F.col("owner.offset")).alias("head"))


def followed(table: pa.Table) -> pa.Table:
    """For a stretch's candidates: their records' ends, and where their chains leave the stretch (null: they break off in it)."""
    table = table.sort_by("offset")
    offsets, reach = table["offset"].to_pylist(), table["reach"].to_pylist()
    limit, file_end = table["limit"][0].as_py(), table["file_end"][0].as_py()
    succ = [None if r is None or o < 0 or o + r > file_end else o + r for o, r in zip(offsets, reach)]
    exits: dict[int, int | None] = {}
    for offset, end in zip(reversed(offsets), reversed(succ)):
        exits[offset] = None if end is None else end if end >= limit else exits.get(end)
    columns = [*(table[c] for c in ("file", "block", "number", "offset")), pa.array(succ, pa.int64()), pa.array([exits[o] for o in offsets], pa.int64())]
    return pa.table(columns, names=["file", "block", "number", "offset", "succ", "exit"])


def walked(table: pa.Table) -> pa.Table:
    """Marks the candidates on the chain from the stretch's entries."""
    table = table.sort_by("offset")
    succ = dict(zip(table["offset"].to_pylist(), table["succ"].to_pylist()))
    heads: set[int] = set()
    for offset, entry in zip(table["offset"].to_pylist(), table["entry"].to_pylist()):
        while entry and offset in succ and offset not in heads and succ[offset] is not None:
            heads.add(offset)
            offset = succ[offset]
    flags = [o in heads for o in table["offset"].to_pylist()]
    return pa.table([table["file"], table["block"], table["number"], table["offset"], table["succ"], pa.array(flags)], names=["file", "block", "number", "offset", "succ", "is_head"])


RECORD = "file string, offset long, warc_type string, record_id string, target_uri string, payload_digest string, refers_to string, payload binary"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below `path`: file, offset, warc_type, record_id, target_uri, payload_digest, refers_to, payload.

    Only what the chain of records from a file's start reaches counts. A file that breaks off yields the records before the break.
    Missing headers are null; a folder without records gives an empty result.
    """
    scratch, own = Scratch(spark, "warc-read"), reading_session(spark)
    found = scratch.keep(candidates(own, path), "candidates")
    bases = scratch.keep(stretch_bases(found), "bases")
    owned = scratch.keep(owned_pieces(scratch, found, bases), "owned")
    several = owned.where("head is not null").groupBy("file", "head").agg(F.count(F.lit(1)).alias("pieces")).where("pieces > 1")
    parts = owned.join(several, ["file", "head"]).select("file", "block", "number", "head")
    none = owned.where("head is null").select("file", "block", "number", "head")
    odd = scratch.keep(parts.unionByName(none).withColumn("odd", F.lit(True)), "odd")  # all other pieces are a record each
    for label in ("candidates", "owned", "stretches", "heads"):
        scratch.drop(label)
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("number", pa.int64()), ("at", pa.int64()), ("value", pa.binary())])

    def read(batches):
        yield from in_batches(numbered(batches), schema, lambda row: len(row[4] or b"") + 64)

    every = pieces(own, path).mapInArrow(read, "file string, block long, number long, at long, value binary")
    every = every.join(checked_broadcast(bases.select("file", "block", "base", "bytes", "pieces")), ["file", "block"], "left")
    changed = F.col("base").isNull() | (F.col("value").isNull() & ((F.col("at") != F.col("bytes")) | (F.col("number") != F.col("pieces"))))
    fail = F.raise_error(F.concat(F.lit("the archive was cut or changed between two readings: "), F.col("file")))
    every = every.where(F.when(changed, fail.cast("boolean")).otherwise(F.col("value").isNotNull()))
    marked = every.join(checked_broadcast(odd), ["file", "block", "number"], "left")
    whole = marked.where("odd is null").select("file", (F.col("base") + F.col("at") - len(VERSION)).alias("offset"), F.col("value").alias("piece"))
    split = marked.where("head is not null").select("file", "head", "block", "number", "value")
    stitched = split.groupBy("file", "head").applyInArrow(joined_pieces, "file string, offset long, piece binary")
    return whole.unionByName(stitched).mapInArrow(parsed_records, RECORD)


def joined_pieces(table: pa.Table) -> pa.Table:
    """The pieces of one record, with the version lines between them."""
    ordered = table.sort_by([("block", "ascending"), ("number", "ascending")])
    piece = VERSION.encode().join(ordered["value"].to_pylist())
    return pa.table([ordered["file"][:1], ordered["head"][:1], pa.array([piece], pa.binary())], names=["file", "offset", "piece"])


def parsed_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("warc-type", "warc-record-id", "warc-target-uri", "warc-payload-digest", "warc-refers-to")
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64())] + [(n.removeprefix("warc-").replace("-", "_").replace("type", "warc_type"), pa.string()) for n in names] + [("payload", pa.binary())])

    def rows():
        for batch in batches:
            for file, offset, piece in zip(*batch.columns):
                data = piece.as_py()
                reach, head = parse_head(data)
                start = data.index(b"\r\n\r\n") + 4
                yield file.as_py(), offset.as_py(), *map(head.get, names), data[start : reach - len(VERSION) - RECORD_END]

    yield from in_batches(rows(), schema, lambda row: len(row[-1]) + 400)


def warc_round_trip(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", *, least_bytes: int = 0) -> DataFrame:
    """Writes df's archives to `path`, reads them back and returns per row: id, payload_bytes, payload_digest, record_type, refers_to.

    Both payload columns are of the full payload as read: a revisit's are those of the response that it names by id and digest.
    Null payloads count as empty, repeated ids and rows stay, an empty table gives an empty result; other columns aren't read.
    """
    spark = df.sparkSession
    write_warc(df, path, id_col, url_col, payload_col, least_bytes=least_bytes)
    records = read_warc(spark, path)
    page = lambda c: F.regexp_extract(c, r"<urn:page:(-?[0-9]+)>", 1).try_cast("long")
    scratch = Scratch(spark, "warc-records")
    read = records.select(page("record_id").alias("id"), F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to"), F.octet_length("payload").cast("long").alias("n"), base32_sha1(F.col("payload")).alias("digest"), F.regexp_replace("payload_digest", "^sha1:", "").alias("named_digest"))
    read = scratch.keep(read, "read")
    responses = read.where("record_type = 'response'")
    revisits = read.where("record_type = 'revisit'").select("id", "record_type", "refers_to", "named_digest")
    means = ["refers_to", "named_digest"]
    named = scratch.keep(revisits.groupBy(*means).agg(F.count(F.lit(1)).alias("times")), "named")
    meant = responses.select(F.col("id").alias("refers_to"), F.col("digest").alias("named_digest"), "n", "digest").dropDuplicates(means)
    resolved = join_counted(revisits, scratch.keep(named.join(meant, means, "left"), "meant"), means, "times")
    columns = [F.col("id").alias(id_col), F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"]
    return responses.select(*columns).unionByName(resolved.select(*columns))
