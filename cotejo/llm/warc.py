"""Web archives in ZIP packages: a writer, and a reader that range-reads records without extraction."""

import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.llm.shared import durable, new_folder

#: Bytes of an archive in one package, and bytes that one range read takes in about.
PACKAGE_BYTES, RANGE_BYTES = 32 << 20, 4 << 20
#: Payloads below this many bytes are always stored.
LEAST_REVISIT = 100
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_SPACE = uuid.UUID("6f1d0b52-2f3c-4a58-9c54-0a8f4a5f3a10")
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _urn(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, '' if page_id is None else str(page_id))}>"


def _record(page_id, url: str, payload: bytes, size: int, digest: str, kind: str, refers_to, date: str) -> bytes:
    block = _HTTP + payload if kind == "response" else _HTTP
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', lambda m: f'%{ord(m[0]):02X}', url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {size}",
        *([] if page_id is None else [f"WARC-Page-ID: {page_id}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple:
    """One record, from its first byte to its last, as a row of RECORDS; gzipped records are unpacked.

    A payload that differs from its SHA-256 digest raises ValueError. Records of other writers have a
    null page_id; without a SHA-256 digest in hexadecimals it is computed from the payload.
    """
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    page = lambda name: int(fields[name]) if re.fullmatch(r"-?\d+", fields.get(name, "")) else None
    block = rest[: int(fields.get("content-length", 0))]
    http = "application/http" in fields.get("content-type", "")
    payload = block.partition(b"\r\n\r\n")[2] if http else block
    said = fields.get("warc-payload-digest", "")
    digest = said.removeprefix("sha256:") if re.fullmatch("sha256:[0-9a-f]{64}", said) else None
    kind, url = fields.get("warc-type", ""), fields.get("warc-target-uri")
    if kind == "revisit":
        length = page("warc-payload-length")
        return page("warc-page-id"), url, None, length, digest, kind, page("warc-refers-to-page-id")
    found = hashlib.sha256(payload).hexdigest()
    if digest not in (None, found):
        raise ValueError(f"payload of {fields.get('warc-record-id')} differs from its digest")
    return page("warc-page-id"), url, payload, len(payload), found, kind, None


def open_file(path: str):
    fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


def package_members(file) -> list[tuple[str, int, int]]:
    """(name, first data byte, size) of every stored member of a ZIP package, by its central directory; a compressed one raises ValueError."""
    size = file.size()

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    tail_at = max(0, size - 22 - 65535)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    count, length, at = struct.unpack("<HII", tail[end + 10 : end + 20])
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        (far,) = struct.unpack("<Q", tail[end - 12 : end - 4])
        record = read(far, 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("broken ZIP64 end of central directory")
        count, length, at = struct.unpack("<QQQ", record[32:56])
    directory, p, found = read(at, length), 0, []
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, full = *struct.unpack("<H", directory[p + 10 : p + 12]), *struct.unpack("<II", directory[p + 20 : p + 28])
        name_n, extra_n, note_n = struct.unpack("<HHH", directory[p + 28 : p + 34])
        (local,) = struct.unpack("<I", directory[p + 42 : p + 46])
        name = directory[p + 46 : p + 46 + name_n].decode()
        extra = directory[p + 46 + name_n : p + 46 + name_n + extra_n]
        while len(extra) >= 4:
            tag, n = struct.unpack("<HH", extra[:4])
            if tag == 1:
                # ZIP64: only the fields that overflow above, in this order.
                values = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                full = next(values) if full == 0xFFFFFFFF else full
                packed = next(values) if packed == 0xFFFFFFFF else packed
                local = next(values) if local == 0xFFFFFFFF else local
            extra = extra[4 + n :]
        if method != 0:
            raise ValueError(f"member {name} is compressed; only stored members can be range-read")
        own = read(local, 30)
        found.append((name, local + 30 + sum(struct.unpack("<HH", own[26:30])), full))
        p += 46 + name_n + extra_n + note_n
    return found


def record_places(file) -> list[tuple[int, int]]:
    """(first byte in the package, bytes) of every record, by the indexes (CDX lines that end in JSON, plain or gzipped) in the package."""
    members = package_members(file)
    base = {name.removeprefix("archive/"): at for name, at, _ in members if name.startswith("archive/")}
    places = []
    for name, at, size in members:
        if re.fullmatch(r"indexes/.*\.cdxj?(\.gz)?", name):
            file.seek(at)
            raw = file.read(size)
            for line in (gzip.decompress(raw) if name.endswith(".gz") else raw).splitlines():
                if b"{" in line:
                    x = json.loads(line[line.index(b"{") :])
                    if x["filename"] not in base:
                        raise ValueError(f"the index names {x['filename']}, which is not in the package")
                    places.append((base[x["filename"]] + int(x["offset"]), int(x["length"])))
    return sorted(places)


class _Forward:
    """An output stream that zipfile writes from front to back."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def write(self, data) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        self.out.flush()


def write_packages(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes rows of RECORDS (payload as stored) as packages under folder; returns (path, records), one row each.

    Every record is a gzip member of its own in an archive that the package stores as it is, so records can be read by range. Each task names its own files, so a repeated task writes others and only those of the one that succeeded are in the result, which is written at once.
    """

    def run(batches):
        fs, inner = pyarrow.fs.FileSystem.from_uri(folder)
        body, index = io.BytesIO(), []
        date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        stamp = re.sub(r"\D", "", date)

        def flush():
            name = f"{uuid.uuid4().hex}.wacz"
            fs.create_dir(inner, recursive=True)
            with fs.open_output_stream(f"{inner}/{name}") as out, zipfile.ZipFile(_Forward(out), "w", zipfile.ZIP_STORED) as z:
                z.writestr(zipfile.ZipInfo("archive/data.warc.gz"), body.getbuffer())
                z.writestr(zipfile.ZipInfo("indexes/index.cdxj"), "".join(index))
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(index)], pa.int64())], names=["path", "records"])

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"))):
                raw = gzip.compress(_record(row[0], row[1] or "", (row[2] or "").encode(), *row[3:], date), 6, mtime=0)
                index.append(f"{row[0]} {stamp} " + json.dumps({"filename": "data.warc.gz", "offset": body.tell(), "length": len(raw)}) + "\n")
                body.write(raw)
                if body.tell() >= package_bytes:
                    yield flush()
                    body, index = io.BytesIO(), []
        if index:
            yield flush()

    return durable(pages.mapInArrow(run, "path string, records long"), "packages")


def read_packages(packages: DataFrame) -> DataFrame:
    """Rows of RECORDS from the packages named in column path. A task lists a package's ranges; then every range is a row of its own to read."""

    def ranges(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_file(path) as file:
                    places = record_places(file)
                run: list = []
                for place in [*places, None]:
                    if run and (place is None or place[0] + place[1] - run[0][0] > RANGE_BYTES):
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([[a for a, _ in run]], pa.list_(pa.int64())), pa.array([[n for _, n in run]], pa.list_(pa.int64()))], names=["path", "at", "n"])
                        run = []
                    if place:
                        run.append(place)

    def records(batches):
        for batch in batches:
            for path, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                with open_file(path) as file:
                    file.seek(at[0])
                    raw = file.read(at[-1] + n[-1] - at[0])
                rows = [parse_record(raw[a - at[0] : a - at[0] + k]) for a, k in zip(at, n)]
                kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in RECORDS.split(", ")])

    spark = packages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = packages.select("path").repartition(parts).mapInArrow(ranges, "path string, at array<long>, n array<long>")
    return listed.repartition(parts).mapInArrow(records, RECORDS)


def deduplicated(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as rows of RECORDS: of equal payloads of at least 100 bytes the one with the smallest id is a response, the others revisit it."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("payload"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html, 256).alias("payload_digest"))
    # Ids and digests alone find the revisits; payloads then meet them by page, so the copies of a page served everywhere don't meet in one task.
    short = rows.where(f"payload_bytes >= {LEAST_REVISIT} and page_id is not null").select("page_id", "payload_digest")
    first = short.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first <> last").drop("last")
    revisits = short.join(first, "payload_digest").where("page_id <> first").distinct()
    joined = rows.join(revisits.hint("shuffle_hash"), ["page_id", "payload_digest"], "left")
    again = F.col("first").isNotNull()
    return joined.select(
        "page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"),
    )


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes one record a page into packages in the shared folder and reads them back.

    Null html is an empty payload and null urls are empty. Rows of equal id are records each; a null id is a
    response that nothing refers to. Of equal payloads the smallest id is the response, so ties can't occur. A payload of any
    length is one record and one read; a package may exceed its usual size by one record. An empty table gives no package and no rows. Other columns are not kept. The file system of the folder must be one that
    pyarrow opens on all executors.
    """
    return read_packages(write_packages(deduplicated(pages), new_folder(spark, "warc")))


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f ON p.d = f.d
"""
