"""WARC archives as a PySpark Python data source (``format("warc")``).

Reading plans files into partitions of about ``split_bytes``, parses the headers
of every record first, tests the pushed predicates (``warc_type``, ``record_id``,
``target_uri``, ``payload_digest``, ``refers_to``, ``payload_length``) on them, and
inflates a payload only for records that pass and only if payloads are wanted
(option ``payload``).  Each record is one gzip member whose extra field ``SL``
holds the member's length, so an unwanted record costs a header's worth of
inflating and a seek; files of other writers, without that field or not
compressed, are read as well.

Writing streams Arrow batches of each task to a file below ``_temporary``, and the
driver moves the files of successful tasks when the job commits, so attempts lost
with an executor leave nothing behind that a reader would see.
"""

import struct
import uuid
import zlib
from dataclasses import dataclass
from posixpath import basename

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .work import fresh_path, materialise

SCHEMA = "warc_type string, record_id string, target_uri string, warc_date string, payload_digest string, refers_to string, payload_length long, headers map<string,string>, payload binary"
ARROW = pa.schema(
    [(c, pa.string()) for c in ("warc_type", "record_id", "target_uri", "warc_date", "payload_digest", "refers_to")] + [("payload_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
)
SPLIT_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
#: Bytes inflated at a time while a record's headers are looked for.
PEEK = 2048
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _filesystem(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


# ---- writing ----------------------------------------------------------------------------------------


def _clean(value: str) -> str:
    """Header values hold no line breaks."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(row: dict) -> bytes:
    """One record as a gzip member with its own length in the extra field."""
    revisit = row["warc_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n".encode()
    payload = b"" if revisit else (row["payload"] or b"")
    lines = ["WARC/1.1", f"WARC-Type: {row['warc_type']}", f"WARC-Record-ID: <{_clean(row['record_id'])}>", f"WARC-Date: {row['warc_date'] or '1970-01-01T00:00:00Z'}"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_clean(row['target_uri'])}")
    lines.append(f"WARC-Payload-Digest: sha256:{row['payload_digest']}")
    if revisit:
        lines += [f"WARC-Refers-To: <{_clean(row['refers_to'])}>", f"WARC-Profile: {REVISIT}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = ("\r\n".join(lines) + "\r\n\r\n").encode() + http
    data = packer.compress(body) + packer.compress(payload) + packer.compress(b"\r\n\r\n") + packer.flush()
    crc = zlib.crc32(b"\r\n\r\n", zlib.crc32(payload, zlib.crc32(body)))
    size = 10 + 2 + 8 + len(data) + 8
    stated = size < 1 << 32  # a longer member has no such field and is found by reading on
    extra = struct.pack("<H", 8) + b"SL" + struct.pack("<HI", 4, size) if stated else b""
    return b"\x1f\x8b\x08" + (b"\x04" if stated else b"\0") + b"\0" * 4 + b"\x00\xff" + extra + data + struct.pack("<II", crc, (len(body) + len(payload) + 4) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator):
        from pyspark import TaskContext

        fs, root = _filesystem(self.path)
        context = TaskContext.get()
        folder = f"{root}/_temporary/{self.job}"
        fs.create_dir(folder, recursive=True)
        files, out, room = [], None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    data = record_bytes(row)
                    # a file that is full gives way to the next one, so that readers have files of about a partition each
                    if out is None or room < len(data):
                        if out is not None:
                            out.close()
                        files.append(f"{folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}-{len(files):04d}.warc.gz")
                        out, room = fs.open_output_stream(files[-1], compression=None), SPLIT_BYTES
                    out.write(data)
                    room -= len(data)
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages):
        fs, root = _filesystem(self.path)
        if self.overwrite:
            for old in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
                if old.type == pafs.FileType.File:
                    fs.delete_file(old.path)
        for m in messages:
            for file in m.files if m is not None else ():
                fs.move(file, f"{root}/{basename(file)}")
        self._clear(fs, root)
        with fs.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages):
        self._clear(*_filesystem(self.path))

    def _clear(self, fs, root):
        if fs.get_file_info(f"{root}/_temporary").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/_temporary")


# ---- reading ----------------------------------------------------------------------------------------


@dataclass
class Files(InputPartition):
    files: tuple


class _Member:
    """One gzip member: inflates a little at a time and counts the compressed bytes it has used."""

    def __init__(self, stream, start: int):
        self.stream, self.inflate, self.pending, self.at = stream, zlib.decompressobj(31), b"", start

    def read(self, n: int) -> bytes:
        out = b""
        while len(out) < n and not self.inflate.eof:
            if not self.pending:
                self.pending = self.stream.read(1 << 14)
                self.at += len(self.pending)
                if not self.pending:
                    raise EOFError("a record ends before its length")
            out += self.inflate.decompress(self.pending, n - len(out))
            self.pending = self.inflate.unconsumed_tail
        return out

    def end(self) -> int:
        """Where the next member starts; inflates what is left."""
        while not self.inflate.eof:
            self.read(1 << 16)
        return self.at - len(self.inflate.unused_data)


class _Plain:
    def __init__(self, stream, start: int):
        self.stream, self.at = stream, start

    def read(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.at += len(data)
        return data


def _head(source) -> tuple[dict, bytes] | None:
    """The headers of a record and the bytes read beyond them; None at the end of a file."""
    got = source.read(PEEK).lstrip(b"\r\n")
    while b"\r\n\r\n" not in got:
        more = source.read(PEEK)
        if not more:
            if got.strip():
                raise ValueError("not a WARC record")
            return None
        got = (got + more).lstrip(b"\r\n")
    head, _, rest = got.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}, rest


def _bare(value: str | None) -> str | None:
    return value[1:-1] if value and value[0] == "<" and value[-1] == ">" else value


def _fields(headers: dict) -> dict:
    low = {k.lower(): v for k, v in headers.items()}
    digest = low.get("warc-payload-digest")
    return {
        "warc_type": low.get("warc-type"),
        "record_id": _bare(low.get("warc-record-id")),
        "target_uri": _bare(low.get("warc-target-uri")),
        "warc_date": low.get("warc-date"),
        "payload_digest": digest.partition(":")[2] if digest and ":" in digest else digest,
        "refers_to": _bare(low.get("warc-refers-to")),
        "content_length": int(low.get("content-length", 0)),
        "http": low.get("content-type", "").startswith("application/http"),
        "headers": list(headers.items()),
    }


#: Tests of a header field against a pushed value; a missing field passes none but IS NULL.
TESTS = {
    EqualTo: lambda x, v: x is not None and x == v,
    In: lambda x, v: x is not None and x in v,
    GreaterThan: lambda x, v: x is not None and x > v,
    GreaterThanOrEqual: lambda x, v: x is not None and x >= v,
    LessThan: lambda x, v: x is not None and x < v,
    LessThanOrEqual: lambda x, v: x is not None and x <= v,
    StringStartsWith: lambda x, v: x is not None and x.startswith(v),
    StringEndsWith: lambda x, v: x is not None and x.endswith(v),
    StringContains: lambda x, v: x is not None and v in x,
    IsNotNull: lambda x, v: x is not None,
    IsNull: lambda x, v: x is None,
}
PUSHED = ("warc_type", "record_id", "target_uri", "warc_date", "payload_digest", "refers_to")


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.payload = options.get("payload", "true").lower() == "true"
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.tests = []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                self.tests.append((type(f), f.attribute[0], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        fs, root = _filesystem(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root))
        files = sorted(((f.path, f.size) for f in found if f.type == pafs.FileType.File and not basename(f.path).startswith(("_", "."))), key=lambda f: -f[1])
        plans = []  # largest first, each to the first plan with room
        for file, size in files:
            for plan in plans[-64:]:
                if plan[1] + size <= self.split:
                    plan[0].append(file)
                    plan[1] += size
                    break
            else:
                plans.append([[file], size])
        return [Files(tuple(p[0])) for p in plans] or [Files(())]

    def read(self, partition):
        fs, _ = _filesystem(self.path)
        rows, held = [], 0
        for file in partition.files:
            with fs.open_input_file(file) as stream:
                for row in self._records(stream):
                    rows.append(row)
                    held += len(row["payload"] or b"") + 256
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    def _passes(self, fields: dict) -> bool:
        return all(TESTS[kind](fields[name], value) for kind, name, value in self.tests)

    def _records(self, stream):
        at, size = 0, stream.size()
        while at < size:
            stream.seek(at)
            lead = stream.read(20)
            packed = lead[:2] == b"\x1f\x8b"
            known = struct.unpack("<I", lead[16:20])[0] if packed and len(lead) == 20 and lead[3] & 4 and lead[12:14] == b"SL" else None
            stream.seek(at)
            source = _Member(stream, at) if packed else _Plain(stream, at)
            head = _head(source)
            if head is None:
                if not packed:
                    return
                at = at + known if known else source.end()
                continue
            fields, rest = _fields(head[0]), head[1]
            length = fields.pop("content_length")
            read = None
            wanted = self._passes(fields)
            if wanted:
                http = fields["http"]
                # the HTTP head is a header, too: it holds the payload's length
                while http and b"\r\n\r\n" not in rest and len(rest) < length:
                    more = source.read(min(PEEK, length - len(rest)))
                    if not more:
                        raise EOFError("a record ends before its length")
                    rest += more
                top, body = rest[:length].partition(b"\r\n\r\n")[::2] if http else (b"", rest[:length])
                stated = next((int(x.partition(b":")[2]) for x in top.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                left = length - min(len(rest), length)
                read = {k: v for k, v in fields.items() if k != "http"}
                read["payload_length"] = stated if stated is not None else len(body) + left
                read["payload"] = None
                if self.payload and fields["warc_type"] != "revisit":
                    parts = [body]
                    while left:
                        more = source.read(min(left, 1 << 20))
                        if not more:
                            raise EOFError("a record ends before its length")
                        parts.append(more)
                        left -= len(more)
                    read["payload"] = b"".join(parts)
            if packed:
                at = at + known if known else source.end()
            else:
                at = source.at - len(rest) + length if read is None or read["payload"] is None else source.at - max(0, len(rest) - length)
                while at < size:  # the two line breaks that end a record
                    stream.seek(at)
                    if stream.read(1) not in (b"\r", b"\n"):
                        break
                    at += 1
            if wanted:
                yield read


class WarcDataSource(DataSource):
    """Options: ``path``; ``payload`` (true) to read payloads; ``split_bytes`` per read partition."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema: StructType):
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool):
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known to the session, with predicates pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


# ---- archiving pages --------------------------------------------------------------------------------

#: Payloads below this size are stored each time.
LEAST_REVISIT = 100
#: Digests of repeated payloads that may be broadcast: 200,000 rows are under 20 MB.
BROADCAST_DIGESTS = 200_000
URN = "urn:page:"


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A record per row: response, or revisit of the smallest id with the same payload.

    A null html is an empty payload.  A null id never is the one revisited unless
    no other is there; rows that share the smallest id all are responses.  Long
    texts are stored whole; an empty table gives no records; other columns are
    ignored, whatever their names.
    """
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.select("id", "target_uri", "payload", F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_length"))
    first = rows.where(F.col("payload_length") >= LEAST_REVISIT).groupBy("payload_digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    first = materialise(first, "digests")
    repeated = F.broadcast(first) if first.count() <= BROADCAST_DIGESTS else first
    joined = rows.join(repeated, "payload_digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = F.concat(F.lit(URN), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
        name.alias("record_id"),
        "target_uri",
        F.lit("1970-01-01T00:00:00Z").alias("warc_date"),
        "payload_digest",
        F.when(revisit, F.concat(F.lit(URN), F.col("first").cast("string"))).alias("refers_to"),
        "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archive(pages: DataFrame, path: str | None = None, **columns) -> str:
    """Write ``pages`` as WARC files and return their folder."""
    spark = pages.sparkSession
    register(spark)
    path = path or fresh_path(spark, "warc")
    page_records(pages, **columns).write.format("warc").mode("append").option("path", path).save()
    return path


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` from the archives at ``path``.

    Responses are measured on their decoded payloads; revisits are read by
    headers alone.
    """
    register(spark)
    page = lambda c: F.substring(c, len(URN) + 1, 40).try_cast("long")
    responses = spark.read.format("warc").option("path", path).load().where("warc_type = 'response'")
    revisits = spark.read.format("warc").option("path", path).option("payload", "false").load().where("warc_type = 'revisit'")
    measured = responses.select(page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "warc_type", "refers_to")
    noted = revisits.select(page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "warc_type", "refers_to")
    return measured.unionByName(noted).select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to"))
