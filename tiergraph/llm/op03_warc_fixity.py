"""Merkle fixity audit of WARC files.

Pages are written as WARC 1.1 resource records, in page_id order, ``per_file`` ids to a file, each
record one gzip member, so that damage to stored bytes spoils the records it touches and no others;
offsets are those of the records in a file, uncompressed. Where ids repeat (or lack)
until a file would have more than 2 x per_file rows, its records are dealt over as many files as they
need, by hash; a record with more than per_file copies is counted, then written per_file copies to a
file. So no file grows with one id. A file's tree has its records' SHA-256 digests as leaves and,
above them, digests over up to ``FAN`` nodes in offset order, each with the range of bytes that it covers;
above the files' roots are digests over ``DIRECTORY`` file numbers, and one over those. Two replicas are
compared by that one first, then by their files' roots, and only the children of nodes that differ are
looked at further, down to the records; other leaves are never joined.

Within the branches that differ, records are matched by digest, then by id, then by place. So a record is
ok (same digest and number in its file), moved (same digest, another number, as a record before it is gone), corrupt
(another digest), missing (not in the other replica) or extra (not in mine).

Defined results: a null url or html is an empty one; rows without a page_id, while few, are dealt by
hash over files -1 to -NULL_FILES; rows that repeat a page_id are records each, ordered by digest;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tiergraph.llm.common import cut_lineage, sized

PER_FILE = 1024
FAN = 16
DIRECTORY = 1024
NULL_FILES = 256
#: Files of a task, at most or nearly so.
TASK_FILES = 16
DATE = "2024-01-01T00:00:00Z"
#: A member's first bytes, with their own CRC, so that no bit of it can change unseen; of the rest, only the under 8 bits that fill up the last byte of packed data can.
HEAD = b"\x1f\x8b\x08\x02\0\0\0\0\0\xff"
HEAD += (zlib.crc32(HEAD) & 0xFFFF).to_bytes(2, "little")


def record(url: Column, html: Column, page_id: Column) -> Column:
    """A whole WARC record as text."""
    return F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.regexp_replace(url, r"[\r\n]", ""),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(html).cast("string"),
        F.lit("\r\n\r\n"),
        html,
        F.lit("\r\n\r\n"),
    )


def _sized(rows: DataFrame) -> DataFrame | None:
    """rows, stored, and marked for broadcast only if small; None if there are none."""
    kept = sized(rows, width=80)
    return None if kept.isEmpty() else kept


def by_file(rows: DataFrame, pages: DataFrame, per_file: int) -> DataFrame:
    """rows dealt by file over tasks whose number grows with the pages."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-pages.count() // (per_file * TASK_FILES))), "file")


def records(pages: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """page_id, file, record, digest, copies (times that the record is there) of the pages.

    Files follow from ids, contents and their counts alone, so both replicas' sides agree on them.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    usual = F.coalesce(F.expr(f"page_id div {per_file}"), -1 - F.pmod(F.xxhash64("url", "html"), F.lit(NULL_FILES))).cast("long")
    range_ = F.expr(f"page_id div {per_file}")
    many = _sized(base.groupBy(range_.alias("range")).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 2 * per_file))

    def own(*names: Column) -> Column:
        """A file of a crowded range; should two meet in a number, or meet usual ones, they are one file."""
        return -1 - F.shiftrightunsigned(F.xxhash64(range_, *names), 1)

    content = record(F.col("url"), F.col("html"), F.col("page_id"))
    once = F.lit(1).cast("long").alias("copies")
    if many is None:
        return base.select("page_id", usual.alias("file"), content.alias("record"), once).withColumn("digest", F.sha2("record", 256))
    rows = base.join(many, range_.eqNullSafe(F.col("range")), "left").select("page_id", "rows", usual.alias("usual"), content.alias("record"))
    rows = rows.withColumn("digest", F.sha2("record", 256))
    part = F.pmod(F.xxhash64("digest"), F.ceil(F.col("rows") / per_file))
    placed = rows.select("page_id", F.when(F.col("rows").isNull(), F.col("usual")).otherwise(own(part)).alias("file"), "record", once, "digest")
    repeated = rows.where("rows is not null")
    heavy = _sized(repeated.groupBy(F.col("digest").alias("heavy")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > per_file).select("heavy"))
    if heavy is None:
        return placed
    rest = placed.join(heavy, F.col("digest") == F.col("heavy"), "left_anti")
    # the id is part of a record, so equal digests have equal ids; copies meet as one row and a count
    counted = repeated.join(heavy, F.col("digest") == F.col("heavy"), "left_semi").groupBy("page_id", "digest", "record").agg(F.count(F.lit(1)).alias("n"))
    files = counted.select("page_id", "digest", "record", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {per_file})")).alias("k"))
    copies = F.least(F.lit(per_file).cast("long"), F.col("n") - F.col("k") * per_file)
    return rest.unionByName(files.select("page_id", own(F.col("digest"), F.col("k")).alias("file"), "record", copies.alias("copies"), "digest"))


def _expanded(rows: DataFrame) -> DataFrame:
    """Every copy a row; at most per_file of one record, made where its file is."""
    return rows.withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).drop("copy", "copies")


def leaves(pages: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """page_id, file, ordinal, offset, length, digest as the pages say they should be."""
    rows = records(pages, per_file).select("page_id", "file", F.octet_length("record").cast("long").alias("length"), "digest", "copies")
    rows = _expanded(by_file(rows, pages, per_file))
    # some multiple of per_file rows share a file at most
    w = W.partitionBy("file").orderBy("page_id", "digest")
    return rows.select(
        "page_id",
        "file",
        (F.row_number().over(w) - 1).cast("long").alias("ordinal"),
        (F.sum("length").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("length")).alias("offset"),
        "length",
        "digest",
    )


def member(record: bytes) -> bytes:
    """record as a gzip member, or two: the last byte is zero always."""
    deflate = zlib.compressobj(wbits=-15)
    out = HEAD + deflate.compress(record) + deflate.flush() + zlib.crc32(record).to_bytes(4, "little") + (len(record) & 0xFFFFFFFF).to_bytes(4, "little")
    return out if out[-1] == 0 else out + member(b"")


def write_warc(pages: DataFrame, path: str, per_file: int = PER_FILE) -> None:
    """One folder a file number, each with one WARC file; Spark's writer commits them whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # the line separator is the last byte of a member
            packed = pa.array([member(r.as_py())[:-1] for r in batch.column("record")], pa.binary())
            yield batch.set_column(batch.schema.get_field_index("record"), "record", packed)

    rows = records(pages, per_file).select("page_id", "file", F.col("record").cast("binary").alias("record"), "digest", "copies")
    packed = rows.mapInArrow(run, "page_id long, file long, record binary, digest string, copies long")
    ordered = _expanded(by_file(packed, pages, per_file)).sortWithinPartitions("file", "page_id", "digest")
    # a string's bytes are written as they are
    ordered.select("file", F.col("record").cast("string").alias("value")).write.option("lineSep", "\0").partitionBy("file").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, file, ordinal, offset, length, digest of the records of the files at path, as their bytes say."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    number = F.regexp_extract("path", r"/file=(-?\d+)/", 1).cast("long").alias("file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, f, k, a, n, d) for f, data in zip(batch.column("file").to_pylist(), batch.column("content")) for k, (p, a, n, d) in enumerate(parse(data.as_py()))]
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 5 + [pa.string()])], names=["page_id", "file", "ordinal", "offset", "length", "digest"])

    schema = "page_id long, file long, ordinal long, offset long, length long, digest string"
    return files.select(number, "content").mapInArrow(run, schema)


def parse(data: bytes) -> Iterator[tuple[int | None, int, int, str]]:
    """(page_id, offset, length, digest) of each record; a record whose head can't be read runs to the next head.

    A member that can't be unpacked is one record without an id, with the length and digest of its
    stored bytes, and reading goes on at the next member's head. A cut stream of several records gives
    those before the cut.
    """
    import hashlib

    if data[:2] != b"\x1f\x8b" and HEAD not in data:
        yield from parse_plain(data)
        return
    at = offset = 0
    while at < len(data):
        plain, end, whole = unpack(data, at)
        found = list(parse_plain(plain))
        if not whole:
            # the last record unpacked is where the damage is
            found = found[:-1]
            start = found[-1][1] + found[-1][2] if found else 0
            found.append((None, start, end - at, hashlib.sha256(data[at:end]).hexdigest()))
        for name, start, length, digest in found:
            yield name, offset + start, length, digest
        offset += found[-1][1] + found[-1][2] if found else 0
        at = end


def unpack(data: bytes, at: int) -> tuple[bytes, int, bool]:
    """Contents of the gzip member at ``at``, where it ends, and whether it is sound; a spoiled one ends at the next head."""
    following = data.find(HEAD, at + 1)
    stop = first = following if following >= 0 else len(data)
    stream = zlib.decompressobj(31)
    plain = []
    try:
        plain.append(stream.decompress(data[at:stop]))
        while not stream.eof and stop < len(data):  # a head's bytes can be part of a member
            following = data.find(HEAD, stop + 1)
            start, stop = stop, following if following >= 0 else len(data)
            plain.append(stream.decompress(data[start:stop]))
    except zlib.error:
        return b"", first, False
    if stream.eof:
        return b"".join(plain), stop - len(stream.unused_data), True
    # own members hold one record each, others may hold several
    return b"" if data.startswith(HEAD, at) else b"".join(plain), first, False


def parse_plain(data: bytes) -> Iterator[tuple[int | None, int, int, str]]:
    """parse(), of records that are not packed."""
    import hashlib

    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        fields = dict(x.split(b": ", 1) for x in data[at : head if head >= 0 else at].split(b"\r\n")[1:] if b": " in x)
        size = fields.get(b"Content-Length", b"")
        end = head + 8 + int(size) if head >= 0 and data.startswith(b"WARC/", at) and size.isdigit() else -1
        if end < 0 or end > len(data) or data[end - 4 : end] != b"\r\n\r\n":
            nxt = data.find(b"WARC/1.1\r\n", at + 1)
            end = nxt if nxt >= 0 else len(data)
        name = fields.get(b"WARC-Record-ID", b"").removeprefix(b"<urn:page:").removesuffix(b">")
        yield int(name) if name.lstrip(b"-").isdigit() else None, at, end - at, hashlib.sha256(data[at:end]).hexdigest()
        at = end


def _digest_of(kids: Column) -> Column:
    """SHA-256 over sorted structs, their fields by colons and themselves by newlines."""
    return F.sha2(F.array_join(F.transform(F.array_sort(kids), lambda k: F.concat_ws(":", k["key"].cast("string"), k["lo"].cast("string"), k["hi"].cast("string"), k["digest"])), "\n"), 256)


def level_up(nodes: DataFrame) -> DataFrame:
    """The nodes over FAN nodes (file, node, digest, lo, hi): a digest over the children's numbers, ranges and digests."""
    kids = F.collect_list(F.struct(F.col("node").alias("key"), "lo", "hi", "digest"))
    up = nodes.groupBy("file", F.expr(f"node div {FAN}").alias("parent")).agg(_digest_of(kids).alias("digest"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return up.select("file", F.col("parent").alias("node"), "digest", "lo", "hi")


def levels(rows: DataFrame, per_file: int = PER_FILE) -> list[DataFrame]:
    """Trees of all files, leaves first; the last level has one node a file. lo and hi: the bytes a node covers."""
    out = [rows.select("file", F.col("ordinal").alias("node"), "digest", F.col("offset").alias("lo"), (F.col("offset") + F.col("length")).alias("hi"))]
    span = 1
    while span < per_file * FAN:  # room for repeated ids
        out.append(cut_lineage(level_up(out[-1])))  # a FANth of the rows below
        span *= FAN
    return out


def replica_root(roots: DataFrame) -> DataFrame:
    """replica: one digest, over digests over the roots (file, lo, hi, digest) of DIRECTORY file numbers each.

    The last step reads a row for each PER_FILE x DIRECTORY records.
    """
    part = lambda key: F.collect_list(F.struct(F.col(key).alias("key"), "lo", "hi", "digest"))
    folders = roots.groupBy(F.floor(F.col("file") / DIRECTORY).alias("folder")).agg(_digest_of(part("file")).alias("digest"), F.sum("lo").alias("lo"), F.sum("hi").alias("hi"))
    return folders.agg(_digest_of(part("folder")).alias("replica"))


def differing(mine: list[DataFrame], other: list[DataFrame]) -> DataFrame:
    """file, node of the leaves that differ: roots are compared first, then only the children of nodes that differ."""

    def compare(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(F.col("file").alias("f2"), F.col("node").alias("n2"), F.col("digest").alias("d2"), F.col("lo").alias("l2"))
        both = a.join(b, (F.col("file") == F.col("f2")) & (F.col("node") == F.col("n2")), "full_outer")
        differ = ~F.col("digest").eqNullSafe(F.col("d2")) | ~F.col("lo").eqNullSafe(F.col("l2"))
        return both.where(differ).select(F.coalesce("file", "f2").alias("file"), F.coalesce("node", "n2").alias("node"))

    bad = cut_lineage(compare(mine[-1], other[-1]))
    for a, b in zip(mine[-2::-1], other[-2::-1]):
        parents = sized(bad.select(F.col("file").alias("bf"), F.col("node").alias("bn")), width=32)
        under = lambda x: x.join(parents, (x["file"] == F.col("bf")) & (F.expr(f"node div {FAN}") == F.col("bn")), "left_semi")
        bad = cut_lineage(compare(under(a), under(b)))
    return bad


LEAF = "page_id long, file long, ordinal long, offset long, length long, digest string"


def matched(mine: list[tuple], other: list[tuple]) -> list[tuple]:
    """Leaves of one file, in LEAF's order, with a status: by digest, then by id, then by place."""
    out, left = [], list(mine)
    rest = {k: r for k, r in enumerate(other)}

    def pair(key, status) -> None:
        nonlocal left
        free: dict = {}
        for k in reversed(list(rest)):
            if key(rest[k]) is not None:
                free.setdefault(key(rest[k]), []).append(k)
        still = []
        for r in left:
            at = free.get(key(r))
            if key(r) is None or not at:
                still.append(r)
                continue
            out.append((*r, status(r, rest.pop(at.pop()))))
        left = still

    pair(lambda r: (r[5], r[2]), lambda a, b: "ok")
    pair(lambda r: r[5], lambda a, b: "moved")
    pair(lambda r: r[0], lambda a, b: "corrupt")
    # a record that can't be read has no id; it takes the place between its neighbours
    pair(lambda r: (r[2],), lambda a, b: "corrupt")
    return out + [(*r, "missing") for r in left] + [(*r, "extra") for r in rest.values()]


def audit(mine: DataFrame, other: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """One row a record of either replica: its place and digest, its file's root and the replica's in either, and status."""
    mine, other = cut_lineage(mine), cut_lineage(other)  # a line a record, read by every level
    a, b = levels(mine, per_file), levels(other, per_file)
    whole = replica_root(a[-1]).join(replica_root(b[-1]).withColumnRenamed("replica", "other_replica"))  # one row each
    whole = cut_lineage(whole)
    roots = a[-1].select("file", F.col("digest").alias("root")).join(b[-1].select("file", F.col("digest").alias("other_root")), "file", "full_outer")
    same = whole.first()
    if same["replica"] == same["other_replica"]:
        rows = mine.withColumn("status", F.lit("ok"))
    else:
        bad = sized(differing(a, b).withColumnRenamed("node", "ordinal"), width=32)
        spoiled = lambda side: side.join(bad, ["file", "ordinal"], "left_semi").select(*[c.split()[0] for c in LEAF.split(", ")])

        def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
            found = matched(*[[tuple(r.values()) for r in t.sort_by("ordinal").to_pylist()] for t in (left, right)])
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            return pa.table([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in LEAF.split(", ")] + ["status"])

        # a file's leaves are some multiple of per_file at most
        judged = spoiled(mine).groupBy("file").cogroup(spoiled(other).groupBy("file")).applyInArrow(run, LEAF + ", status string")
        rows = mine.join(bad, ["file", "ordinal"], "left_anti").select(mine.columns).withColumn("status", F.lit("ok")).unionByName(judged)
    return rows.join(roots, "file", "left").crossJoin(F.broadcast(whole)).select("page_id", "file", "ordinal", "offset", "length", "digest", "root", "other_root", "replica", "other_replica", "status")  # whole is one row
