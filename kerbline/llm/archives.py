"""WARC archives of frame records: a sorted, sharded writer whose bytes follow from the rows alone, and its reader."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from math import isqrt
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.session import MAX_BROADCAST_BYTES, cut_lineage, int_setting

#: Payload of one shard; from ROOT_BYTES each, the number of shards grows with the square root of the input.
SHARD_BYTES, ROOT_BYTES = 16 << 20, 1 << 20
#: Rows of the sample per shard that decides where shards begin.
SAMPLES = 20
#: Parts into which the frames of one payload are dealt to find their response.
SALT = 16
#: Bytes of one read, and of the payloads that a reader hands on at once.
READ_BYTES, HAND_BYTES = 1 << 20, 4 << 20
FILES = "file string, shard int, records long, bytes long, sha256 string"

# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VISIBLE = "!\"#$&'()*+,-./:;=?@[]^_`{|}~"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_name(*parts) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(parts).encode()).digest()[:16], version=4)}>"


def member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own, without a time stamp."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", f"sha1:{digest32(block)}"), ("Content-Length", str(len(block)))])
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def described(name: str, date: str) -> bytes:
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_name("file", name)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return member(fields, b"software: kerbline\r\nformat: WARC File Format 1.1\r\n")


def record(row: dict, payload: bytes, kind: str, date: str) -> bytes:
    """A response with its payload, or a revisit with the header of one."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    key, revisit = row["key"], row["record_type"] == "revisit"
    fields = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", record_name(key, row["uri"], row["same"], row["copy"])), ("WARC-Date", date),
        ("WARC-Target-URI", quote(row["uri"], VISIBLE + "%") if row["uri"] is not None else f"urn:record:{quote(key or '')}"),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest32(payload)}"),
    ]
    if key is not None:
        fields.append(("X-Record-Key", quote(key)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_name(row["kept_key"], row["kept_uri"], row["same"], 1))]
        if row["kept_key"] is not None:
            fields.append(("X-Refers-To-Key", quote(row["kept_key"])))
    return member(fields, block if revisit else block + payload)


class Roll:
    """Files of one shard: each is written under a temporary name and renamed when it is full or the last."""

    def __init__(self, path: str, shard: int, limit: int, date: str):
        self.store, self.root = fs.FileSystem.from_uri(path)
        self.shard, self.limit, self.date, self.place, self.out = shard, limit, date, 0, None

    def add(self, data: bytes):
        if self.out and self.bytes + len(data) > self.limit:
            yield self.close()
        if not self.out:
            self.name = f"frames-{self.shard:06d}-{self.place:06d}.warc.gz"
            self.draft = f"{self.root}/.{self.name}.{uuid.uuid4().hex}"
            self.out = self.store.open_output_stream(self.draft, compression=None)
            self.records, self.bytes, self.sum = -1, 0, hashlib.sha256()
            self._put(described(self.name, self.date))
        self._put(data)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sum.update(data)
        self.records, self.bytes = self.records + 1, self.bytes + len(data)

    def close(self) -> dict:
        self.out.close()
        self.store.move(self.draft, f"{self.root}/{self.name}")
        self.place, self.out = self.place + 1, None
        return {"file": self.name, "shard": self.shard, "records": self.records, "bytes": self.bytes, "sha256": self.sum.hexdigest()}


# --- which record answers for equal payloads, and where shards begin -----------------------------


def _facts(frames: DataFrame, key: str, uri: str, payload: str) -> DataFrame:
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    return frames.select(F.col(key).alias("id"), F.col(uri).cast("string").alias("uri"), F.sha2(body, 256).alias("same"), F.octet_length(body).cast("long").alias("size"), body.alias("payload"))


def _planned(groups: DataFrame, least: int) -> DataFrame:
    """One row per record: `copy` (from 1, among frames alike), `record_type`, and key and uri of the response it refers to."""
    kept = groups.groupBy("same").agg(F.sum("n").alias("total"), F.max(F.struct("id", "uri")).alias("kept")).filter("total > 1")
    # One payload may belong to a large share of the frames: they meet its response in several tasks.
    salted = kept.select("same", "kept", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("id", "uri"), F.lit(SALT)).cast("int")
    rows = groups.withColumn("salt", salt).join(salted, ["same", "salt"], "left").select("id", "uri", "same", "size", "n", "kept", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    first = F.col("id").eqNullSafe(F.col("kept.id")) & F.col("uri").eqNullSafe(F.col("kept.uri")) & (F.col("copy") == 1)
    again = F.col("kept").isNotNull() & ~first & (F.col("size") >= least)
    return rows.select(
        "id", "uri", "same", "copy", (F.col("n") > 1).alias("alike"), F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("kept.id").cast("string")).alias("kept_key"), F.when(again, F.col("kept.uri")).alias("kept_uri"),
    )


FRAME = ["id", "uri", "same"]
ORDER = [*FRAME, "copy"]


def _rank(row) -> tuple:
    """Sorts as Spark does, nulls first."""
    return tuple((v is not None, v) if v is not None else (False,) for v in row)


def _starts(plan: DataFrame, shards: int) -> list[tuple]:
    """First rows of all shards but the first, from the rows with the least hashes: a sample that only the rows decide."""
    if shards == 1:
        return []
    lot = sorted(_rank(r[:4]) for r in plan.select(*ORDER, F.xxhash64(*ORDER).alias("lot")).orderBy("lot", *ORDER).limit(SAMPLES * shards).collect())
    return [lot[len(lot) * i // shards] for i in range(1, shards)]


def _in_shards(rows: DataFrame, starts: list[tuple]) -> DataFrame:
    def place(batches):
        for batch in batches:
            at = [bisect_right(starts, _rank(r)) for r in zip(*(batch.column(c).to_pylist() for c in ORDER))]
            yield batch.append_column("shard", pa.array(at, pa.int32()))

    return rows.mapInArrow(place, T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType())]))


def _payloads(facts: DataFrame, placed: DataFrame, starts: list[tuple]) -> DataFrame:
    """`shard`, the three columns of a frame and its payload: once for every shard that has records of it."""
    names, rows = ["shard", *FRAME, "payload"], facts.select(*FRAME, "payload").withColumn("copy", F.lit(1).cast("long"))
    wanted = placed.filter("alike").select(*FRAME, "shard").distinct()
    n = wanted.count()
    if not n:
        return _in_shards(rows, starts).select(*names)
    marks = wanted.select(F.struct(*FRAME).alias("frame")).distinct()
    if n * 256 <= int_setting(facts.sparkSession, MAX_BROADCAST_BYTES):
        marks = F.broadcast(marks)
    rows = rows.withColumn("frame", F.struct(*FRAME))
    single = _in_shards(rows.join(marks, "frame", "left_anti").drop("frame"), starts).select(*names)
    several = rows.join(marks, "frame", "left_semi").groupBy("frame").agg(F.first("payload").alias("payload"))
    several = several.join(wanted.select(F.struct(*FRAME).alias("frame"), "shard"), "frame").select("shard", "frame.*", "payload")
    return single.unionByName(several)


# --- writer and reader ---------------------------------------------------------------------------


def write_archive(
    frames: DataFrame, path: str, key: str = "frame_index", uri: str = "source_path", payload: str = "tile_details",
    kind: str = "application/json", least_revisit: int = 0, roll_bytes: int = 256 << 20, date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write one WARC record per frame, its stored details as the payload, to `path`.

    Of frames with equal payloads of at least `least_revisit` bytes, the one with the
    largest `key` (then `uri`) becomes the response and the others revisit it; smaller
    payloads are all responses. Records are sorted by (`key`, `uri`, payload digest) and cut
    into shards at rows of a sample that only the rows decide. A shard's task streams
    its records, one gzip member each, into files of at most `roll_bytes` compressed
    (one larger record has a file of its own). Each file is written under a temporary
    name and renamed; a repeated task renames the same bytes over it. Last,
    `manifest.json` gets its name: it lists all files with records, bytes and SHA-256,
    and nothing is read without it. The same rows give the same files, whatever their
    partitions. `path` is a URI that pyarrow can write to (file, hdfs, s3, gs, ...).

    A null payload counts as empty; a null key sorts first and has no key field; a null
    uri becomes urn:record:<key>, other characters than visible ASCII are percent-encoded.
    Frames alike in all three columns are numbered and may lie in several shards. `frames`
    is read twice; a payload that differs then is an error. Other columns are not read; an empty
    table gives a manifest without files. An archive that has a manifest is an error.
    """
    spark = frames.sparkSession
    store, root = fs.FileSystem.from_uri(path)
    if store.get_file_info(f"{root}/manifest.json").type != fs.FileType.NotFound:
        raise FileExistsError(f"{path} holds an archive")
    store.create_dir(root)
    facts = _facts(frames, key, uri, payload)
    groups = cut_lineage(facts.groupBy(*FRAME, "size").agg(F.count(F.lit(1)).alias("n")))
    total = groups.agg(F.sum(F.col("size") * F.col("n"))).first()[0] or 0
    shards = max(1, min(-(-total // SHARD_BYTES), isqrt(total // ROOT_BYTES)))
    plan = _planned(groups, least_revisit)
    starts = _starts(plan, shards)
    placed = cut_lineage(_in_shards(plan, starts).withColumn("key", F.col("id").cast("string")))
    # Of a frame, its payload comes before its records.
    both = placed.drop("alike").unionByName(_payloads(facts, placed, starts), allowMissingColumns=True)
    dealt = both.repartitionById(shards, "shard").sortWithinPartitions("shard", *FRAME, F.col("copy").asc_nulls_first())

    def write(batches):
        roll = frame = body = None
        done = []
        for batch in batches:
            payloads = batch.column("payload")
            for i, row in enumerate(batch.drop_columns(["payload"]).to_pylist()):
                now = (row["shard"], *(row[c] for c in FRAME))
                if row["copy"] is None:
                    frame, body = now, payloads[i].as_py()
                    continue
                if now != frame:
                    raise ValueError(f"frame {row['key']} differed between two reads of the frames")
                if roll is None or roll.shard != row["shard"]:
                    done += [roll.close()] if roll and roll.out else []
                    roll = Roll(path, row["shard"], roll_bytes, date)
                done += roll.add(record(row, body, kind, date))
        done += [roll.close()] if roll and roll.out else []
        schema = pa.schema([("file", pa.string()), ("shard", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
        yield pa.RecordBatch.from_pylist(done, schema=schema)

    draft = f"manifest-{uuid.uuid4().hex}"
    dealt.mapInArrow(write, FILES).write.json(f"{path}/{draft}")
    store.move(f"{root}/{draft}", f"{root}/manifest.json")


def members(source, size: int = READ_BYTES):
    """Bytes of each gzip member of a stream, one whole record at a time, and the running SHA-256 of all that was read."""
    total, unpack, parts = hashlib.sha256(), zlib.decompressobj(31), []
    while data := source.read(size):
        total.update(data)
        while data:
            parts.append(unpack.decompress(data))
            data = unpack.unused_data
            if unpack.eof:
                yield b"".join(parts), total
                unpack, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the last record is cut off")


def parsed(data: bytes) -> tuple[dict, bytes]:
    """Fields (lower-case names) and block of one record, length and block digest checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    size = int(fields["content-length"])
    block = rest[:size]
    if not lines[0].startswith("WARC/1.") or rest[size:] != b"\r\n\r\n" or fields["warc-block-digest"] != f"sha1:{digest32(block)}":
        raise ValueError(f"damaged record {fields.get('warc-record-id')}")
    return fields, block


RECORDS = "frame_index string, source_path string, record_type string, payload_bytes long, payload_digest string, refers_to string, record_id string, refers_to_record string, file string"


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of a committed archive, files dealt over tasks and streamed record by record.

    Columns: `frame_index` and `refers_to` (keys as text, null if absent), `source_path`,
    `record_type`, `payload_bytes` and `payload_digest` of the full payload, `record_id`,
    `refers_to_record`, `file`, and with `payloads` the binary `payload` (null for a
    revisit). Size and SHA-256 of each file, and the digests of each block and payload,
    are checked; anything damaged or cut off is an error, and so is a missing manifest.
    """
    files = spark.read.schema(FILES).json(f"{path}/manifest.json").select("file", "bytes", "sha256")
    names = [part.split()[0] for part in RECORDS.split(", ")]

    def read(batches):
        store, root = fs.FileSystem.from_uri(path)
        held, size = [], 0
        schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.string()) for n in names] + ([("payload", pa.binary())] if payloads else []))
        for batch in batches:
            for entry in batch.to_pylist():
                total = hashlib.sha256()
                with store.open_input_stream(f"{root}/{entry['file']}", compression=None) as source:
                    for data, total in members(source):
                        fields, block = parsed(data)
                        if fields["warc-type"] not in ("response", "revisit"):
                            continue
                        head, _, body = block.partition(b"\r\n\r\n")
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        if fields["warc-type"] == "response" and digest32(body) != digest:
                            raise ValueError(f"damaged payload {fields['warc-record-id']}")
                        length = next(int(line.split(b":")[1]) for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:"))
                        key, refers = fields.get("x-record-key"), fields.get("x-refers-to-key")
                        values = [
                            None if key is None else unquote(key), fields["warc-target-uri"], fields["warc-type"], length, digest, None if refers is None else unquote(refers),
                            fields["warc-record-id"], fields.get("warc-refers-to"), entry["file"],
                        ]
                        row = dict(zip(names, values))
                        if payloads:
                            row["payload"] = body if fields["warc-type"] == "response" else None
                        held.append(row)
                        size += 500 + (len(body) if payloads else 0)
                        if size >= HAND_BYTES:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                if total.hexdigest() != entry["sha256"]:
                    raise ValueError(f"{entry['file']} differs from the manifest")
        yield pa.RecordBatch.from_pylist(held, schema=schema)

    tasks = max(1, min(files.count(), 10_000))
    return files.repartition(tasks).mapInArrow(read, RECORDS + (", payload binary" if payloads else ""))
