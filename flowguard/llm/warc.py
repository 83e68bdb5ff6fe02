"""WARC archives: written as one gzip member per record, read back in byte ranges that are found by gzip's magic."""

from __future__ import annotations

import hashlib
import zlib
from base64 import b32encode
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.llm.common import small_join
from flowguard.session import cut_lineage

MAGIC = b"\x1f\x8b\x08"
#: A gzip member of nothing. It ends in a zero byte, as every member of a record below 16 MiB does.
NOTHING = bytes.fromhex("1f8b08000000000002ff03000000000000000000")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Copies of a repeated row that one row of the plan stands for before it is expanded.
COPIES = 4096
#: Bytes that a task gathers before it hands them on.
FLUSH = 1 << 24


def payload_digest(payload: bytes) -> str:
    return b32encode(hashlib.sha1(payload).digest()).decode()


def _header(value: str) -> str:
    """A header value without control characters or blanks at its ends."""
    return quote(value, safe="!\"#$&'()*+,-./:;<=>?@[\\]^_`{|}~ ").strip()


def record(kind: str, name: str, identity: str | None, uri: str | None, date: str, payload: bytes, size: int, digest: str, refers: str | None = None) -> bytes:
    """One record: a whole response, or a revisit that has the response's HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:{name}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    lines += [f"WARC-Target-URI: {_header(uri)}"] if uri is not None else []
    lines += [f"WARC-Source-Identity: {quote(identity, safe='')}"] if identity is not None else []
    lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:{refers}>"] if kind == "revisit" else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(content: bytes) -> bytes:
    """A gzip member without its last byte, which is zero; large ones are followed by an empty member for that."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    packed = packer.compress(content) + packer.flush()
    return packed[:-1] if packed[-1] == 0 else packed + NOTHING[:-1]


def plan_records(pages: DataFrame, identity: str = "page_id", uri: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """`identity`, `uri`, `payload`, `kind` and `refers` (identity of the response) of every row.

    Of rows with equal payloads of at least `least` bytes the one with the smallest identity (null last, then by uri, null
    last) is the response and the others revisit it; smaller payloads are all responses. Payloads stay where they are:
    digests of repeated payloads are joined, by broadcast after their size was measured, else salted. Rows that repeat
    the response itself are counted first and expanded again, so any number of them costs one payload per task.
    """
    rows = pages.select(F.col(f"`{identity}`").cast("string").alias("identity"), F.col(f"`{identity}`").alias("order"), F.col(f"`{uri}`").cast("string").alias("uri"),
                        F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    least_row = F.struct(F.col("order").isNull().alias("a"), F.col("order").alias("order"), F.col("uri").isNull().alias("b"), "uri")
    slim = rows.where(F.octet_length("payload") >= least).select("digest", least_row.alias("row"))
    first = slim.groupBy("digest", "row").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(
        F.min(F.struct("row", "n")).alias("first"), F.sum("n").alias("total")).where("total > 1")
    first = cut_lineage(first.select("digest", F.col("first.row.order").cast("string").alias("refers"), F.col("first.row.uri").alias("first_uri"),
                                     F.col("first.n").alias("n"), F.lit(True).alias("repeated")))
    known = small_join(rows.withColumn("spread", F.monotonically_increasing_id()), first, ["digest"], ["spread"])
    again = F.coalesce("repeated", F.lit(False))
    is_first = F.coalesce(F.col("identity").eqNullSafe(F.col("refers")) & F.col("uri").eqNullSafe(F.col("first_uri")), F.lit(False))
    kind = F.when(again & ~is_first, "revisit").otherwise("response")

    def judged(some: DataFrame) -> DataFrame:
        return some.select("identity", "uri", "payload", kind.alias("kind"), F.when(again & ~is_first, F.col("refers")).alias("refers"))

    if first.where("n > 1").isEmpty():
        return judged(known)
    many = F.coalesce(again & is_first & (F.col("n") > 1), F.lit(False))
    equal = known.where(many).groupBy("digest", "identity", "uri", "n").agg(F.first("payload").alias("payload"))
    response = equal.select("identity", "uri", "payload", F.lit("response").alias("kind"), F.lit(None).cast("string").alias("refers"))
    lots = equal.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 2) div {COPIES}")))).repartition("identity", "lot")
    copies = F.least(F.lit(COPIES).cast("bigint"), F.col("n") - 1 - F.col("lot") * COPIES)
    revisits = lots.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies))).select(
        "identity", "uri", "payload", F.lit("revisit").alias("kind"), F.col("identity").alias("refers"))
    return judged(known.where(~many)).unionByName(response).unionByName(revisits)


def write_archives(planned: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """One gzip member per record of `plan_records`, in as many archives as there are tasks.

    Spark's text writer is the one that writes bytes to any store: every row goes out as its member without the last byte,
    and the line end is that byte, so the files are plain concatenations of members.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def named(identity: str | None) -> str:
            return f"page:{'' if identity is None else quote(identity, safe='')}"

        made, size = [], 0
        for batch in batches:
            for identity, uri, text, kind, refers, number in zip(*(batch.column(i) for i in range(6))):
                payload = text.as_py().encode()
                digest, first = payload_digest(payload), kind.as_py() == "response"
                name = f"{named(identity.as_py())}:{digest if first else number.as_py()}"
                made.append(member(record(kind.as_py(), name, identity.as_py(), uri.as_py(), date, payload, len(payload), digest,
                                          None if first else f"{named(refers.as_py())}:{digest}")))
                size += len(made[-1])
                if size > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["member"])
                    made, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["member"])
    numbered = planned.select("identity", "uri", "payload", "kind", "refers", F.monotonically_increasing_id().alias("number"))
    numbered.mapInArrow(pack, "member binary").select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\x00").text(folder)


RECORD = ("kind string, identity string, uri string, record_id string, refers_to string, payload_bytes bigint, payload_digest string, payload binary, "
          "sound boolean")


def parse(content: bytes) -> dict | None:
    """A record from a member's content; None without a WARC header."""
    head, found, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    length = fields.get("content-length", "")
    block = rest[:int(length)] if length.isdigit() else rest
    http = fields.get("content-type", "").replace(" ", "").startswith("application/http")
    top, _, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    stated = [v for k, _, v in (line.partition(b":") for line in top.split(b"\r\n")) if k.strip().lower() == b"content-length"]
    kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    size = int(stated[0]) if stated and stated[0].strip().isdigit() else len(payload)
    whole = kind != "response" or (len(payload) == size and digest in (None, payload_digest(payload)))
    identity = fields.get("warc-source-identity")
    return {"kind": kind, "identity": None if identity is None else unquote(identity), "uri": fields.get("warc-target-uri"), "record_id": fields.get("warc-record-id"),
            "refers_to": fields.get("warc-refers-to"), "payload_bytes": size, "payload_digest": digest, "payload": payload if kind != "revisit" else None,
            "sound": whole and length == str(len(block))}


def begins(piece: bytes) -> bool:
    """True if what follows the magic is a gzip header and inflates to the start of a record, or of nothing."""
    if len(piece) < 7 or piece[0] & 0xE0:
        return False
    opened = zlib.decompressobj(31)
    try:
        start = opened.decompress(MAGIC + piece, 5)
    except zlib.error:
        return False
    return b"WARC/".startswith(start) if opened.eof else start == b"WARC/" or (not start and len(piece) < 64)


class Members:
    """Joins pieces between magics to members: a member takes pieces until gzip says it is complete and its sum agrees."""

    def __init__(self, inside: bool):
        self.inside = inside  # the first pieces may belong to a member that began before
        self.reset()

    def reset(self) -> None:
        self.opened, self.made = None, []

    def feed(self, piece: bytes) -> Iterator[bytes | None]:
        """Contents completed by a piece; None for a member that is damaged."""
        fresh = self.opened is None
        if fresh:
            if not begins(piece):
                if not self.inside and piece.strip(b"\0"):
                    yield None
                return
            self.opened, self.inside = zlib.decompressobj(31), False
        try:
            self.made.append(self.opened.decompress(MAGIC + piece))
        except zlib.error:
            self.reset()
            yield None
            if not fresh and begins(piece):
                yield from self.feed(piece)
            return
        if self.opened.eof:
            content = b"".join(self.made)
            self.reset()
            if content:
                yield content

    def end(self) -> Iterator[None]:
        if self.opened is not None:
            yield None


def _records(contents: Iterator[bytes | None], payloads: bool) -> Iterator[dict]:
    for content in contents:
        found = (None if content is None else parse(content)) or {"sound": False}
        yield found if payloads else found | {"payload": None}


_SCHEMA = pa.schema([(n, {"bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}.get(t, pa.string()))
                     for n, t in (f.split() for f in RECORD.split(", "))])


def _emit(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 500 + len(row.get("payload") or b"")
        if size > FLUSH:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _by_range(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    """Records that start in each byte range; a range whose last member is not complete gives a row that says so."""
    def found() -> Iterator[dict]:
        state, where = None, None
        for batch in batches:
            files, starts, pieces = (batch.column(i) for i in range(3))
            for i in range(len(batch)):
                at = (files[i].as_py(), starts[i].as_py())
                if at != where:
                    if state is not None and state.opened is not None:
                        yield {"file": where[0], "open": True}
                    state, where = Members(at[1] > 0), at
                    if not at[1]:
                        first = pieces[i].as_py()
                        if first.strip(b"\0"):
                            yield {"file": at[0], "open": False, "sound": False}
                        continue  # what stands before the first magic of a file
                for row in _records(state.feed(pieces[i].as_py()), payloads):
                    yield {"file": at[0], "open": False, **row}
        if state is not None and state.opened is not None:
            yield {"file": where[0], "open": True}
    return _emit(found(), pa.schema([("file", pa.string()), ("open", pa.bool_()), *_SCHEMA]))


def _in_sequence(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    """Records of whole files, their pieces in order."""
    def found() -> Iterator[dict]:
        state, where = None, None
        for batch in batches:
            for file, start, at, piece in zip(*[batch.column(i) for i in range(4)]):
                if file.as_py() != where:
                    if state is not None:
                        yield from _records(state.end(), payloads)
                    state, where = Members(False), file.as_py()
                    if piece.as_py().strip(b"\0"):
                        yield {"sound": False}
                    continue
                yield from _records(state.feed(piece.as_py()), payloads)
        if state is not None:
            yield from _records(state.end(), payloads)
    return _emit(found(), _SCHEMA)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the archives in a folder: type, identity, uri, ids, size and digest of the full payload, payload, `sound`.

    The archives are split like any text. Spark's reader cuts each byte range at gzip's magic and owns what starts inside;
    a candidate counts as a member if its header is valid and inflates to the start of a WARC record. Magic also occurs
    by chance inside members: pieces are joined until the member's own end mark and sum agree. Where such a member runs
    over the end of a range, which is noticed because it is still open there, its file is decoded again in one sequence,
    piece after piece. Files must not be named .gz, as Hadoop would then inflate them as one stream.

    `sound` is false for a response whose payload disagrees with its stated size or digest, and for members that are cut
    off, damaged or no records, which have no other value. Without `payloads` that column is null. Empty archives and empty members give no rows.
    """
    pieces = (spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(folder)
              .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"),
                      F.col("value").cast("binary").alias("piece")))
    schema = "file string, open boolean, " + RECORD
    found = pieces.select("file", "start", "piece").mapInArrow(lambda batches: _by_range(batches, payloads), schema)
    torn = cut_lineage(found.select("file", "open").where("open").select("file").distinct())
    if torn.isEmpty():
        return found.drop("file", "open")
    whole = found.join(torn, "file", "left_anti").drop("file", "open")
    again = pieces.join(torn, "file", "left_semi").repartition("file").sortWithinPartitions("file", "start", "at")
    return whole.unionByName(again.mapInArrow(lambda batches: _in_sequence(batches, payloads), RECORD))
