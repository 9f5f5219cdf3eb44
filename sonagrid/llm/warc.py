"""WARC archives from a deterministic sharded writer, and their reader.

Records are range-sorted by page id. The bounds of ranges come from exact
counts of bytes, found by halving the space of ids where it is crowded, so they
depend on the pages and on parameters only; a hot id is cut by payload digest.
A task writes gzip members one by one, and rolls to the next file at a
compressed size or where a range ends; files are named by range and turn. A
file grows under a temporary name of its attempt and takes its final name when
it is complete; a task that runs again writes the same bytes. The manifest (one
row for each file, with size and digest) is a table whose own commit makes the
archive valid: readers open what it lists, so leftovers of lost tasks are never
seen. The same pages give the same files, whatever their order and partitions.

Headers and digests come from the payloads at the time of writing. Of records
with equal payloads the one with the largest page id is a response, the others
are revisit records that refer to it and carry no payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonagrid.llm.common import join_by_key, shared_dir, written

_MANIFEST = "path string, first_id long, records long, bytes long, sha256 string"
_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, warc_bytes long"
#: Ranges at most, and bits of the id by which a crowded range is looked at more closely.
MOST_RANGES, FIRST_BITS, NEXT_BITS = 4096, 12, 6
_SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space of URLs in RFC 4122

#: Records without a date of their own: the archive is the same on every run.
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, sha: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE_ID, f'{page_id}:{sha}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit if refers_to is given."""
    sha = digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    target = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, sha)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target or None),
        ("WARC-Payload-Digest", f"sha1:{sha}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if refers_to is not None else None),
        ("WARC-Refers-To", record_id(refers_to, sha) if refers_to is not None else None),
        ("X-Page-ID", None if page_id is None else str(page_id)),
        ("X-Refers-To-Page-ID", None if refers_to is None else str(refers_to)),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return head.encode("ascii") + block + b"\r\n\r\n"


class _Writer:
    """Files of one task under a folder that any process can reach."""

    def __init__(self, folder: str, roll_bytes: int, level: int):
        from pyarrow import fs

        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.roll_bytes, self.level = roll_bytes, level
        self.out, self.part, self.turn = None, None, 0

    def add(self, part: int, page_id: int | None, data: bytes) -> dict | None:
        done = None
        if self.out is not None and (self.size >= self.roll_bytes or part != self.part):
            done = self.close()
        if self.out is None:
            self.turn = self.turn + 1 if part == self.part else 0
            self.part = part
            self.name = f"{self.root}/part-{part:06d}-{self.turn:06d}.warc.gz"
            self.temporary = f"{self.root}/_tmp-{uuid.uuid4().hex}"
            self.out, self.sha, self.size, self.records, self.first = self.store.open_output_stream(self.temporary), hashlib.sha256(), 0, 0, page_id
        member = gzip.compress(data, self.level, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1
        return done

    def close(self) -> dict:
        from pyarrow import fs

        self.out.close()
        self.out = None
        there = self.store.get_file_info(self.name)
        if there.type == fs.FileType.File and there.size == self.size:
            self.store.delete_file(self.temporary)  # an attempt before this one wrote the same bytes
        else:
            if there.type == fs.FileType.File:
                self.store.delete_file(self.name)
            self.store.move(self.temporary, self.name)
        return {"path": self.name, "first_id": self.first, "records": self.records, "bytes": self.size, "sha256": self.sha.hexdigest()}


def _write(folder: str, roll_bytes: int, level: int):
    def run(it):
        writer, refers, done = _Writer(folder, roll_bytes, level), {}, []
        for batch in it:
            parts, ids, kinds, shas = (batch.column(x).to_pylist() for x in ("part", "page_id", "kind", "sha"))
            for i, (part, page_id, kind, sha) in enumerate(zip(parts, ids, kinds, shas)):
                if kind == 0:  # what the following rows of this id refer to
                    if refers.get("id") != page_id:
                        refers = {"id": page_id}
                    refers[sha] = batch.column("refers_to")[i].as_py()
                    continue
                target = refers.get(sha) if refers.get("id") == page_id else None
                payload = (batch.column("html")[i].as_py() or "").encode("utf-8", "surrogatepass")
                if file := writer.add(part, page_id, record(page_id, batch.column("url")[i].as_py(), payload, target)):
                    done.append(file)
        if writer.out is not None:
            done.append(writer.close())
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("path", pa.string()), ("first_id", pa.int64()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    return run


# --- ranges -------------------------------------------------------------------

_SIGN = 1 << 63


def _prefix(bits: int):
    """The first bits of page_id in the order of ids; null is before all others.
    The last two hex digits' worth (bits above 64) are of the payload's digest."""
    # the sign bit flipped, so that negative ids come first
    id_ = F.coalesce("page_id", F.lit(-_SIGN)).bitwiseXOR(F.lit(-_SIGN))
    if bits <= 64:
        return F.struct(F.shiftrightunsigned(id_, 64 - bits).alias("id"), F.lit(0).cast("long").alias("cut"))
    return F.struct(id_.alias("id"), F.conv(F.substring("sha", 1, 2), 16, 10).cast("long").alias("cut"))


def ranges(rows: DataFrame, range_bytes: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """(bits, prefix, cut, part) for each leaf of the space of ids, and the number
    of parts: neighbouring leaves share a part of about range_bytes, or of the
    MOST_RANGES-th part of everything. rows: page_id, sha, bytes.

    A leaf with more is looked at more closely until it is one id, which is cut
    by the payload's digest. At most MOST_RANGES leaves are cut in a round.
    """
    at = rows.agg(F.sum("bytes"), F.min("page_id"), F.max("page_id"), F.count(F.lit(1)) - F.count("page_id")).first()
    if at[0] is None:
        return [], 0
    most = max(range_bytes, -(-at[0] // MOST_RANGES))
    low, high = ((v if v is not None else -_SIGN) + _SIGN for v in (None if at[3] else at[1], at[2]))
    bits = min(64, 64 - (low ^ high).bit_length() + FIRST_BITS)
    leaves, crowded = [], None
    while True:
        look = rows.withColumn("key", _prefix(bits))
        if crowded is not None:
            look = look.join(F.broadcast(rows.sparkSession.createDataFrame(crowded, "id long, cut long").select(F.struct("id", "cut").alias("of"))), _prefix(before) == F.col("of"))
        found = [((r.key.id % (1 << 64)), r.key.cut, r.n) for r in look.groupBy("key").agg(F.sum("bytes").alias("n")).collect()]
        crowded = [(i, c) for i, c, n in found if n > most] if bits <= 64 else []
        again = set(crowded)
        leaves += [(i << max(0, 64 - bits), c, n, bits, i) for i, c, n in found if (i, c) not in again]
        if not crowded:
            break
        crowded = [(i - (1 << 64) if i >= _SIGN else i, c) for i, c in crowded]
        before, bits = bits, (65 if bits == 64 else min(64, bits + NEXT_BITS))
    out, part, full = [], 0, 0
    for _, cut, n, depth, prefix in sorted(leaves):
        if full and full + n > most:
            part, full = part + 1, 0
        full += n
        out.append((depth, prefix - (1 << 64) if prefix >= _SIGN else prefix, cut, part))
    return out, part + 1


def _with_part(rows: DataFrame, leaves: list[tuple[int, int, int, int]]) -> DataFrame:
    """rows with the part of their leaf; leaves are bounded, see ranges()."""
    spark = rows.sparkSession
    found = []
    for depth in sorted({x[0] for x in leaves}):
        here = spark.createDataFrame([x[1:] for x in leaves if x[0] == depth], f"id long, cut long, part{depth} int")
        rows = rows.join(F.broadcast(here.select(F.struct("id", "cut").alias(f"leaf{depth}"), f"part{depth}")), _prefix(depth) == F.col(f"leaf{depth}"), "left").drop(f"leaf{depth}")
        found.append(F.col(f"part{depth}"))
    part = F.coalesce(*found) if found else F.lit(0)
    return rows.withColumn("part", part).drop(*[f"part{d}" for d in {x[0] for x in leaves}])


def write(pages: DataFrame, folder: str, least_bytes: int = 0, roll_bytes: int = 16 << 20, level: int = 5, range_bytes: int = 16 << 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages as WARC files in folder (a URI that pyarrow can open); the manifest, as a table.

    A null page is an empty payload; a null address gives a record without
    target. Rows with equal payloads of at least least_bytes: the largest page
    id is the response (if several rows have it, all of them), the others
    revisit it; a null id is smaller than any other. No rows give an empty
    manifest. Files end at roll_bytes, compressed, and at the end of a range of
    about range_bytes; records of one id and payload are one range's. Other
    columns are not read.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("long")
    keys = written(rows.groupBy("page_id", "sha").agg(F.sum(size + 500).alias("bytes"), F.max(size).alias("size")), "pages")
    long = keys.where(F.col("size") >= least_bytes)
    last = written(long.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1"), "responses")
    links = join_by_key(long.select("page_id", "sha"), last, ["sha"], "n").where("refers_to is not null").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    both = links.select("page_id", F.lit(0).alias("kind"), "sha", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "refers_to").union(
        rows.select("page_id", F.lit(1), "sha", "url", "html", F.lit(None).cast("long"))
    )
    leaves, parts = ranges(keys, range_bytes)
    # more tasks than ranges, so that few tasks have two
    files = _with_part(both, leaves).repartition(max(1, 4 * parts), "part").sortWithinPartitions("part", "page_id", "kind", "sha", "url").mapInArrow(_write(folder, roll_bytes, level), _MANIFEST)
    files.write.mode("overwrite").parquet(f"{folder}/_manifest")
    return pages.sparkSession.read.schema(_MANIFEST).parquet(f"{folder}/_manifest")


def parse(stream) -> object:
    """(header fields, block) of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError("not a WARC record")
            continue
        fields = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8").partition(":")
            fields[key.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields["content-length"]))


def _read(it):
    number = lambda x: None if x is None else int(x)
    for batch in it:
        for content in batch.column("content"):
            rows = []
            for fields, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())))):
                sha = fields["warc-payload-digest"].removeprefix("sha1:")
                if digest(block) != fields["warc-block-digest"].removeprefix("sha1:"):
                    raise ValueError(f"block digest of {fields['warc-record-id']}")
                size = int(fields["x-payload-length"])
                if fields["warc-type"] == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if digest(payload) != sha or len(payload) != size:
                        raise ValueError(f"payload digest of {fields['warc-record-id']}")
                rows.append(
                    {
                        "page_id": number(fields.get("x-page-id")),
                        "payload_bytes": size,
                        "payload_digest": sha,
                        "record_type": fields["warc-type"],
                        "refers_to": number(fields.get("x-refers-to-page-id")),
                        "warc_bytes": len(block),
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("warc_bytes", pa.int64())]))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Records of the files that the manifest lists, digests verified."""
    spark = manifest.sparkSession
    name = lambda c: F.substring_index(c, "/", -1)
    listed = manifest.select(name("path").alias("name"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(folder).select(name("path").alias("name"), "content")
    files = files.join(listed, "name", "left_semi")
    return files.select("content").mapInArrow(_read, _RECORDS)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archive pages in a new folder below the shared one and read it back."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read(write(pages, folder, least_bytes), folder)
