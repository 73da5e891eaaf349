"""Token ids as length-delimited binary records with masked checksums and an offset index, written and read by tasks.

A data file is a run of records: length (u64), masked CRC of these 8 bytes (u32), payload, masked CRC of the payload
(u32), all little-endian; the payload is the ids, as u16 where the vocabulary allows, else u32. An index file beside it
has a fixed-size entry for each record, so that a shuffled reader can seek to any of them.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecube.llm.common import free_memory, shared_dir
from tidecube.llm.tokens import default_path, encoder, slices, with_ends

ENTRY = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("n_ids", "<u8")])
MASK = 0xA282EAD8


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = len(payload).to_bytes(8, "little")
    return head + masked_crc(head).to_bytes(4, "little") + payload + masked_crc(payload).to_bytes(4, "little")


def unframe(read, name: str) -> bytes | None:
    """The next payload, None at the end; read(n) gives up to n bytes."""
    head = read(12)
    if not head:
        return None
    if len(head) < 12 or masked_crc(head[:8]) != int.from_bytes(head[8:], "little"):
        raise ValueError(f"{name}: broken length")
    n = int.from_bytes(head[:8], "little")
    body = read(n + 4)
    if len(body) < n + 4 or masked_crc(body[:n]) != int.from_bytes(body[n:], "little"):
        raise ValueError(f"{name}: broken record")
    return body[:n]


def open_fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_records(docs: DataFrame, folder: str, end_id: int, tokenizer: str | None = None, n_files: int | None = None, special: bool = False, file_bytes: int = 128 << 20) -> list[dict]:
    """Writes docs(doc_id, text) in ascending doc_id order, each with end_id, as n_files ranges at most (so many that a range
    has file_bytes of text or less on average, and as many as Spark's shuffles have partitions at least).

    Returns one manifest entry for each file: file, index, width, n_docs, n_tokens and start, the number of ids in the
    files before it. Null texts are empty, so a record always has end_id; a null doc_id sorts first and is marked in the
    index; equal doc_ids follow the order of their texts; extra columns are left out; an empty table gives no files. A file's name is
    new for each attempt of a task and only files of attempts that ended are in the manifest, so a lost executor leaves
    no half file behind that anyone reads. special: special tokens in texts are encoded as such, as the tokenizer's
    library does; else as plain text.
    """
    spark = docs.sparkSession
    path = tokenizer or default_path()
    n = n_files
    if n is None:
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // file_bytes))

    def write(batches):
        from pyspark import TaskContext

        store, base = open_fs(folder)
        part, tag = TaskContext.get().partitionId(), uuid.uuid4().hex
        enc = encoder(path, special)
        kind = "<u2" if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 65536 else "<u4"
        names = [f"{base}/{part:06d}-{tag}.{x}" for x in ("records", "index")]
        data, entries, offset, tokens, count = None, None, 0, 0, 0
        for batch in batches:
            keys = batch.column("doc_id")
            for first, texts in slices(batch, "text"):
                if data is None:
                    store.create_dir(base, recursive=True)
                    data, entries = store.open_output_stream(names[0]), store.open_output_stream(names[1])
                ids, counts = enc.encode(texts)
                ids, ends = with_ends(ids, counts, end_id)
                flat, width = ids.astype(kind).tobytes(), int(kind[2])
                each, records, at = [], [], 0
                for key, end in zip(keys.slice(first, len(texts)).to_pylist(), ends.tolist()):
                    record = frame(flat[width * at : width * end])
                    each.append((key or 0, key is not None, offset, end - at))
                    records.append(record)
                    offset, at = offset + len(record), end
                data.write(b"".join(records))
                entries.write(np.array(each, ENTRY).tobytes())
                tokens, count = tokens + len(ids), count + len(texts)
        if data is not None:
            data.close()
            entries.close()
            scheme = folder.split("://")[0] + "://" if "://" in folder else ""
            rows = [{"part": part, "file": scheme + names[0], "index": scheme + names[1], "width": int(kind[2]), "n_docs": count, "n_tokens": tokens}]
            yield pa.RecordBatch.from_pylist(rows, schema)
        free_memory()

    schema = pa.schema([("part", pa.int32()), ("file", pa.string()), ("index", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    #: ranges part rows of one doc_id, or of none, by how their texts begin, which is the order that they are to have
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = rows.repartitionByRange(n, F.col("doc_id"), F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    made = ranges.mapInArrow(write, "part int, file string, index string, width int, n_docs long, n_tokens long").collect()
    manifest, start = [], 0
    for r in sorted(made, key=lambda r: r["part"]):
        manifest.append(r.asDict() | {"start": start})
        start += r["n_tokens"]
    return manifest


def read_records(spark: SparkSession, manifest: list[dict], binary: bool = False) -> DataFrame:
    """doc_id, start (ids of all records before it), n_tokens and ids of every record, checksums verified.

    ids are an array, or with binary their little-endian unsigned 32-bit integers. A task reads whole files, a few
    records at a time.
    """
    columns = "part int, file string, index string, width int, n_docs long, n_tokens long, start long"
    files = spark.createDataFrame([[m[c.split()[0]] for c in columns.split(", ")] for m in manifest], columns)

    def read(batches):
        for batch in batches:
            for m in batch.to_pylist():
                store, name = open_fs(m["file"])
                with store.open_input_file(open_fs(m["index"])[1]) as f:
                    index = np.frombuffer(f.read(), ENTRY)
                with store.open_input_stream(name, buffer_size=1 << 20) as f:
                    at, done = m["start"], 0
                    while done < len(index):
                        keys, counts, flat = [], [], []
                        while done < len(index) and sum(counts) < 200_000:
                            ids = np.frombuffer(unframe(f.read, name), f"<u{m['width']}").astype(np.int32)
                            e = index[done]
                            if len(ids) != e["n_ids"]:
                                raise ValueError(f"{name}: the index has {e['n_ids']} ids for a record of {len(ids)}")
                            keys.append(int(e["doc_id"]) if e["has_id"] else None)
                            counts.append(len(ids))
                            flat.append(ids)
                            done += 1
                        ends = np.cumsum(counts)
                        if binary:
                            lists = pa.array([x.astype("<u4").tobytes() for x in flat], pa.binary())
                        else:
                            lists = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), np.concatenate(flat))
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(at + ends - counts, pa.int64()), pa.array(counts, pa.int64()), lists], ["doc_id", "start", "n_tokens", "ids"])
                        at += int(ends[-1])

    schema = f"doc_id long, start long, n_tokens long, ids {'binary' if binary else 'array<int>'}"
    if not manifest:
        return spark.createDataFrame([], schema)
    return files.repartition(len(manifest), "part").mapInArrow(read, schema)


def read_at(entry: dict, position: int) -> np.ndarray:
    """The ids of one record of a manifest entry's file, found through its index: for shuffled reads."""
    store, name = open_fs(entry["index"])
    with store.open_input_file(name) as f:
        f.seek(position * ENTRY.itemsize)
        at = np.frombuffer(f.read(ENTRY.itemsize), ENTRY)[0]
    with store.open_input_file(open_fs(entry["file"])[1]) as f:
        f.seek(int(at["offset"]))
        return np.frombuffer(unframe(f.read, name), f"<u{entry['width']}").astype(np.int64)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
