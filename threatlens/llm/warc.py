"""WARC archives: written by Spark's text sink, read back in splits by boundary chains.

Writing: one record per row, ended by an empty line; the sink's line separator is
the record end. Rows whose payload another row with a smaller id holds become
revisit records of that one.

Reading: an archive is split at the magic line, wherever it stands, also inside
payloads. What makes a magic line a record is not its look but the chain:

1. each task walks the pieces of its splits and parses what may be a header; such
   a candidate names its successor, the byte after its stated length and the next
   magic line. Inside a split pointer jumping (the successor of the successor, and
   so on) leads every candidate to the first offset beyond the split;
2. offsets count from the split's first piece; sums of the splits before give their
   place in the file. Candidates that some split's chains lead to are a file's portals;
   pointer jumping over the portals, from the file's start, tells which are reached.
   At most one portal of a split is reached: the split's first true record;
3. a second scan starts at that record in every split and hops from length to length,
   so headers inside payloads are never taken for records. Records that go over the
   end of a split are put together from their parts by (file, offset).

Shuffles carry offsets only, and the bytes of records cut by a split's end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import store

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

BROADCAST_BYTES = 8 << 20        # lookup tables up to this size are broadcast
HOT_PARTS = 1000                 # a key with more than 1/1000 of the rows is hot: at most so many keys
SPLITS_PER_SCAN = 100_000        # splits whose chains one scan takes along


def sha1_base32(payload: Column) -> Column:
    """SHA-1 in upper-case base32 (32 characters), from the hexadecimal digits five at a time."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda g: F.conv(
        F.substr(F.sha1(payload), g * 5 + 1, F.lit(5)), 16, 2))

    def letters(bits):
        twenty = F.lpad(bits, 20, "0")
        return F.concat(*[F.substr(F.lit(BASE32), F.conv(F.substr(twenty, F.lit(1 + 5 * j), F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))
                          for j in range(4)])

    return F.array_join(F.transform(groups, letters), "")


def _lookup(left: DataFrame, right: DataFrame, key: str, salt: Column) -> DataFrame:
    """``left`` with the columns of ``right`` (one row per ``key``; its column ``n`` says how many rows
    of ``left`` have the key). Broadcast up to ``BROADCAST_BYTES``; beyond that only hot keys are, and
    their rows are dealt by ``salt`` through the shuffle that finds the other keys."""
    n_keys, rows = right.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n_keys * 200 <= BROADCAST_BYTES:
        return left.join(F.broadcast(right.drop("n")), key, "left")
    value = [c for c in right.columns if c not in (key, "n")]
    hot = right.where(F.col("n") * HOT_PARTS >= rows).select(key, *[F.col(c).alias(f"hot_{c}") for c in value], F.lit(True).alias("is_hot"))
    cold = right.where(F.col("n") * HOT_PARTS < rows).select(F.col(key).alias("cold_key"), *value)
    dealt = left.join(F.broadcast(hot), key, "left")
    cold_key = F.when(F.col("is_hot"), F.concat(F.lit("hot "), salt.cast("string"))).otherwise(F.col(key))
    found = dealt.withColumn("look_key", cold_key).join(cold, F.col("look_key") == F.col("cold_key"), "left")
    return found.select(*left.columns, *[F.coalesce(f"hot_{c}", c).alias(c) for c in value])


def record_id(key: Column, digest: Column) -> Column:
    """Id of a page's record; null keys have an empty number."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), digest, F.lit(">"))


def page_of(record: Column) -> Column:
    """The page's key from a record id (null: none)."""
    return F.regexp_extract(record, "^<urn:page:(-?[0-9]+):", 1).try_cast("long")


def typed(pages: DataFrame, key: str, url: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """(key, url, payload, digest, first): first is the smallest key of the rows with an equal payload
    of at least ``min_bytes`` bytes where that is another row's, else null."""
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{url}`").cast("string").alias("url"),
                        F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b"")).alias("payload"))
    same = F.concat(F.sha2("payload", 256), F.octet_length("payload").cast("string"))
    rows = rows.withColumn("same", F.when(F.octet_length("payload") >= min_bytes, same).otherwise(
        F.concat(F.lit("short "), F.coalesce(F.col("key").cast("string"), F.lit("")))))
    copies = store(rows.where(F.octet_length("payload") >= min_bytes).groupBy("same").agg(
        F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null"), "warc-copies")
    known = _lookup(rows, copies, "same", F.xxhash64("key", "url"))
    return known.select("key", "url", "payload", sha1_base32(F.col("payload")).alias("digest"),
                        F.when(~F.col("key").eqNullSafe(F.col("first")), F.col("first")).alias("first"))


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
                   min_bytes: int = 0, date: str = DATE) -> None:
    """Write one record per row below ``path``, which must not exist: revisit records for payloads of
    ``min_bytes`` bytes or more that a row with a smaller key holds, else responses.

    Null payloads are empty, null keys come last (they never are the first of a group that has a key) and
    null urls leave their line out; line ends in a url are percent-encoded. Rows that share the smallest key
    and the payload are all responses. Payloads may hold any bytes, magic lines included; other columns are
    ignored; an empty table gives archives without records.
    """
    rows = typed(pages, key, url, payload, min_bytes)
    revisit = F.col("first").isNotNull()
    http = F.concat(F.lit(HTTP), F.octet_length("payload").cast("string"), F.lit(END))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.octet_length("payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    some = lambda c: F.coalesce(c, F.lit(""))
    head = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("key"), F.col("digest"))), line("WARC-Date", F.lit(date)),
        some(line("WARC-Target-URI", uri)), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        some(F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)),
                                      line("WARC-Refers-To", record_id(F.col("first"), F.col("digest")))))),
        line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", length.cast("string")), F.lit("\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string")))
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", END).text(path)


# -- reading -----------------------------------------------------------------

def _header(piece: bytes):
    """(bytes up to the block, stated length) if a piece begins like a record's header, else None."""
    at = piece.find(b"\r\n\r\n")
    if at < 0:
        return None
    length = None
    for row in piece[:at].split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if not colon or not name or b" " in name:
            return None
        if name.lower() == b"content-length":
            value = value.strip()
            if not value.isdigit() or len(value) > 15:
                return None
            length = int(value)
    return None if length is None else (at + 4, length)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, piece) between magic lines, in the order of each split."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.col("value").cast("binary").alias("piece"))


def _split_runs(batches):
    """(file, split, its rows in order) for each split; the rows are to be used up."""
    import itertools

    def rows():
        for b in batches:
            lists = [b.column(i) for i in range(b.num_columns)]
            for at in range(0, b.num_rows, 256):
                yield from zip(*[c.slice(at, 256).to_pylist() for c in lists])

    for (file, split), group in itertools.groupby(rows(), key=lambda r: (r[0], r[1])):
        yield file, split, group


def _candidates(pieces: DataFrame) -> DataFrame:
    """Per split a row with its bytes (``total``) and per candidate record (at, to, last), counted from the
    split's first piece: the first offset beyond the split that its chain leads to (null: the chain
    breaks) and the last record before that. An offset is the byte after a magic line."""
    step = len(MAGIC)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for file, split, group in _split_runs(batches):
            starts, nexts, pos = [], [], 0
            for r in group:
                found = _header(r[2]) if split or pos else None      # nothing precedes a file's first piece
                if found:
                    starts.append(pos)
                    nexts.append(pos + sum(found) + len(END) + step)
                pos += len(r[2]) + step
            at, to = np.array(starts, dtype=np.int64), np.array(nexts, dtype=np.int64)
            # node i: candidate i; its pointer goes to itself where the chain leaves the split or breaks
            where = np.searchsorted(at, to)
            inside = (where < len(at)) & (at[np.minimum(where, len(at) - 1)] == to) if len(at) else np.zeros(0, dtype=bool)
            jump = np.where(inside, where, np.arange(len(at)))
            while len(at) and (jump[jump] != jump).any():
                jump = jump[jump]
            out, last = to[jump], at[jump]
            leaves = out >= pos
            n = len(at) + 1
            yield pa.RecordBatch.from_arrays([
                pa.array([file] * n, pa.string()), pa.array([split] * n, pa.int64()), pa.array([None, *starts], pa.int64()),
                pa.array([None, *(o if x else None for o, x in zip(out.tolist(), leaves.tolist()))], pa.int64()),
                pa.array([None, *last.tolist()], pa.int64()), pa.array([pos] + [None] * (n - 1), pa.int64()),
            ], names=["file", "split", "at", "to", "last", "total"])

    return pieces.mapInArrow(run, "file string, split long, at long, to long, last long, total long")


def chains(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, base, entry, owner, whole): where each split lies in its file, its first true record
    (counted from the split's first piece; null: none), the record that reaches into it from before
    (offset in the file) and whether the file's chain ends at the file's end."""
    edges = store(_candidates(_pieces(spark, path)), "warc-candidates")
    by_file = Window.partitionBy("file").orderBy("split")
    splits = store(edges.where("total is not null").select("file", "split", "total").withColumn(
        "base", F.sum("total").over(by_file) - F.col("total")), "warc-splits")
    placed = edges.where("at is not null").join(splits.select("file", "split", "base"), ["file", "split"]).select(
        "file", "split", "base", (F.col("at") + F.col("base")).alias("at"), (F.col("to") + F.col("base")).alias("to"),
        (F.col("last") + F.col("base")).alias("last"))
    start = splits.where("split = 0").select("file", F.lit(len(MAGIC)).cast("long").alias("at"))
    portals = store(placed.where("to is not null").select("file", F.col("to").alias("at")).unionByName(start).distinct().join(
        placed, ["file", "at"]).select("file", "split", "base", "at", "to", "last"), "warc-portals")
    jump, reached = portals.where("to is not null").select("file", "at", "to"), start
    while jump.head(1):                                          # as many rounds as the logarithm of the splits of a file
        reached = store(reached.unionByName(reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct(),
                        "warc-reached")
        twice = jump.select("file", F.col("at").alias("from"), F.col("to").alias("at"))
        jump = store(twice.join(jump, ["file", "at"]).select("file", F.col("from").alias("at"), "to"), "warc-jumps")
    entries = portals.join(reached, ["file", "at"]).select("file", "split", (F.col("at") - F.col("base")).alias("entry"), "last")
    ends = splits.groupBy("file").agg(F.sum("total").alias("at")).join(reached, ["file", "at"]).select("file", F.lit(True).alias("whole"))
    empty = splits.groupBy("file").agg(F.sum("total").alias("t")).where(F.col("t") == len(MAGIC)).select("file", F.lit(True).alias("empty"))
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    out = splits.join(entries, ["file", "split"], "left").join(ends, "file", "left").join(empty, "file", "left")
    return store(out.select("file", "split", "base", "entry", F.last("last", ignorenulls=True).over(before).alias("owner"),
                            F.coalesce("whole", "empty", F.lit(False)).alias("whole")), "warc-chains")


_PARSED = ("file string, offset long, record_type string, record_id string, uri string, refers_to string, "
           "stated_digest string, payload binary, complete boolean")


def _parsed(file, offset, record: bytes):
    head, length = _header(record)
    fields = {}
    for row in record[:head].split(b"\r\n"):
        name, _, value = row.partition(b":")
        fields[name.lower()] = value.strip().decode("utf-8", "replace")
    block = record[head:head + length]
    if fields.get(b"content-type", "").startswith("application/http"):
        block_head, _, block = block.partition(b"\r\n\r\n")
    digest = fields.get(b"warc-payload-digest")
    return (file, offset, fields.get(b"warc-type"), fields.get(b"warc-record-id"), fields.get(b"warc-target-uri"),
            fields.get(b"warc-refers-to"), digest[5:] if digest and digest[:5].lower() == "sha1:" else digest, block,
            len(record) >= head + length)


def _batch(rows, schema):
    import pyarrow as pa

    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _arrow(ddl: str):
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def _records_of_splits(rows: DataFrame) -> DataFrame:
    """Rows of ``_PARSED`` for records within their split; parts of others as (file, offset, part_at, part)."""
    step, magic = len(MAGIC), MAGIC.encode()
    ddl = _PARSED + ", part_at long, part binary"
    schema = _arrow(ddl)

    def run(batches):
        out, held = [], 0

        def cut(file, offset, at, parts):
            return (file, offset, *[None] * 7, at, magic.join(parts))

        for file, split, group in _split_runs(batches):
            pos, target, parts, offset, need, at = 0, None, [], None, 0, 0
            for _, _, piece, base, entry, owner in group:
                if pos == 0:
                    target, offset, at = entry, owner, base          # parts of the record that reaches into the split
                if pos == target:
                    if parts and offset is not None:
                        if need:
                            out.append((*_parsed(file, offset, magic.join(parts)), None, None))
                        else:
                            out.append(cut(file, offset, at, parts))
                    found = _header(piece)
                    need = sum(found) if found else 0
                    target = pos + need + len(END) + step if found else None
                    parts, offset, at = [], base + pos, base + pos
                if offset is not None:
                    parts.append(piece)
                    held += len(piece)
                pos += len(piece) + step
                if held > 8 << 20:
                    yield _batch(out, schema)
                    out, held = [], 0
            if parts:
                if need and target == pos:                           # the record ends with the split
                    out.append((*_parsed(file, offset, magic.join(parts)), None, None))
                else:
                    out.append(cut(file, offset, at, parts))
        yield _batch(out, schema)

    return rows.mapInArrow(run, ddl)


def _records_of_parts(parts: DataFrame) -> DataFrame:
    """Records put together from the parts that several splits hold."""
    whole = parts.groupBy("file", "offset").agg(F.sort_array(F.collect_list(F.struct("part_at", "part"))).alias("parts")).select(
        "file", "offset", F.array_join(F.transform("parts", lambda p: p["part"].cast("string")), MAGIC).cast("binary").alias("record"))

    schema = _arrow(_PARSED)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 16):
                rows = zip(*[c.slice(at, 16).to_pylist() for c in b.columns])
                yield _batch([_parsed(f, o, r) for f, o, r in rows if _header(r)], schema)

    return whole.mapInArrow(run, _PARSED)


def read_archives(spark: SparkSession, path: str, broken: str = "raise") -> DataFrame:
    """The records of all archives below ``path``: file, offset (of the byte after the magic line), record_type,
    record_id, uri, refers_to, stated_digest, payload, complete (as long as stated).

    Only records that the chain from the file's start reaches; magic lines and whole records inside
    payloads stay payload. A file whose chain does not end at its last byte raises ValueError, or with
    ``broken="keep"`` gives the records before the break. Files without records give none. Records and
    files may be of any length; a record must fit a row.
    """
    info = chains(spark, path)
    n_splits, bad = info.agg(F.count(F.lit(1)), F.count_if(~F.col("whole"))).first()
    if bad and broken != "keep":
        raise ValueError(f"{bad} splits lie in archives whose record chain breaks off below {path}")
    scans = max(1, -(-n_splits // SPLITS_PER_SCAN))
    out = None
    for k in range(scans):                                        # each takes the files of one hash class
        mine = (lambda c: F.pmod(F.xxhash64(c), F.lit(scans)) == k) if scans > 1 else (lambda c: F.lit(True))  # noqa: B023
        rows = _pieces(spark, path).where(mine("file")).join(
            F.broadcast(info.where(mine("file")).select("file", "split", "base", "entry", "owner")), ["file", "split"])
        part = _records_of_splits(rows.select("file", "split", "piece", "base", "entry", "owner"))
        out = part if out is None else out.unionByName(part)
    names = [c.split(" ")[0] for c in _PARSED.split(", ")]
    within = out.where("part is null").select(*names)
    return within.unionByName(_records_of_parts(out.where("part is not null").select("file", "offset", "part_at", "part")))


def resolved(records: DataFrame) -> DataFrame:
    """(record_id, record_type, refers_to, payload_bytes, payload_digest, intact) of responses and revisits, a
    revisit with the measures of the response it refers to. intact: the digests, stated and measured, agree."""
    seen = store(records.where(F.col("record_type").isin("response", "revisit")).select(
        "record_id", "record_type", "refers_to", "stated_digest", "complete",
        F.octet_length("payload").cast("long").alias("bytes"), sha1_base32(F.col("payload")).alias("digest")), "warc-records")
    responses = seen.where("record_type = 'response'")
    revisits = seen.where("record_type = 'revisit'")
    wanted = revisits.where("refers_to is not null").groupBy("refers_to").agg(F.count(F.lit(1)).alias("n"))
    known = store(wanted.join(responses.groupBy(F.col("record_id").alias("refers_to")).agg(
        F.min("bytes").alias("payload_bytes"), F.min("digest").alias("payload_digest")), "refers_to"), "warc-referred")
    back = _lookup(revisits, known, "refers_to", F.xxhash64("record_id"))
    own = responses.withColumn("payload_bytes", F.col("bytes")).withColumn("payload_digest", F.col("digest"))
    return own.unionByName(back.select(*own.columns)).select(
        "record_id", "record_type", "refers_to", "payload_bytes", "payload_digest",
        (F.col("complete") & F.col("stated_digest").eqNullSafe(F.col("payload_digest"))).alias("intact"))


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives to the shared folder and read them back."""
    path = scratch_path(pages.sparkSession, "warc-archives")
    write_archives(pages, path, min_bytes=min_bytes)
    return resolved(read_archives(pages.sparkSession, path))
