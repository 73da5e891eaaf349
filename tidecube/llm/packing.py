"""Packing: documents as token ids into sequences of one length, with a fixed number of open windows per partition."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecube.llm.common import free_memory, written
from tidecube.llm.tokens import default_path, encoder, slices, with_ends

FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.list_(pa.int32())), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


class Windows:
    """At most `most` open windows of `size` ids. Pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int, most: int, min_cut: int):
        self.size, self.most, self.min_cut = size, most, min_cut
        self.gaps: list[tuple[int, int]] = []  # (gap, window), ascending
        self.open: dict[int, list] = {}
        self.made = 0

    def put(self, doc_id, ids: np.ndarray):
        """Yields the windows that this document fills or pushes out, as (full window's pieces)."""
        n, start = len(ids), 0
        while n - start >= self.size:
            yield [(doc_id, start, ids[start : start + self.size], n)]
            start += self.size
        while start < n:
            rest = n - start
            k = bisect.bisect_left(self.gaps, (rest, -1))
            if k < len(self.gaps):
                gap, w = self.gaps.pop(k)
                take = rest
            elif len(self.gaps) < self.most:
                gap, w, take = self.size, self.made, rest
                self.open[w] = []
                self.made += 1
            else:  # none fits: the fullest goes, filled up by a cut if its gap is worth one
                gap, w = self.gaps.pop(0)
                take = gap if gap >= self.min_cut else 0
            if take:
                self.open[w].append((doc_id, start, ids[start : start + take], n))
                start += take
            if gap == take or not take:
                yield self.open.pop(w)
            else:
                bisect.insort(self.gaps, (gap - take, w))

    def rest(self):
        return [self.open[w] for w in sorted(self.open)]


def rows_of(windows: list, schema: pa.Schema, first: int, task: int | None = None) -> pa.RecordBatch:
    """A record batch with a row for each piece; windows are numbered from first on."""
    pieces = [p for w in windows for p in w]
    per = np.array([len(w) for w in windows], np.int64)
    length = np.array([len(p[2]) for p in pieces], np.int64)
    ends = np.cumsum(length)
    begins = ends - length
    heads = begins[np.cumsum(per) - per] if len(pieces) else begins
    flat = np.concatenate([p[2] for p in pieces]) if pieces else np.empty(0, np.int32)
    offsets = np.concatenate([[0], ends])
    if pa.types.is_binary(schema.field("ids").type):
        ids = pa.Array.from_buffers(pa.binary(), len(pieces), [None, pa.py_buffer((4 * offsets).astype(np.int32)), pa.py_buffer(flat.astype("<u4"))])
    else:
        ids = pa.ListArray.from_arrays(offsets.astype(np.int32), flat)
    columns = {
        "doc_id": [p[0] for p in pieces], "start": [p[1] for p in pieces], "length": length, "ids": ids, "doc_tokens": [p[3] for p in pieces],
        "sequence_id": np.repeat(first + np.arange(len(windows)), per), "offset": begins - np.repeat(heads, per), "task": [task] * len(pieces),
    }
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)


def pack(docs: DataFrame, end_id: int, size: int = 1024, open_windows: int = 64, min_cut: int = 8, merge: int = 16, tokenizer: str | None = None, lean: bool = False, special: bool = False, binary: bool = False) -> DataFrame:
    """Pieces of docs(doc_id, text): doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Each partition keeps open_windows windows. A document's whole windows are sequences of their own; its rest goes to
    the window that it fits best. Where none fits, the fullest is emitted, filled by a cut if its gap is at least
    min_cut ids. What is left open at the end is merged, the leftovers of `merge` partitions at a time, by cutting; the
    end of each such merge becomes sequences whose lengths are powers of two, which need no padding.
    special: special tokens in texts are encoded as such, as the tokenizer's library does; else as plain text.
    binary: ids are their little-endian unsigned 32-bit integers instead of an array.
    lean: memory goes back to the system after every few texts, a tenth slower, for workers that keep much from other stages.
    Null and empty texts are one piece with end_id alone; a null doc_id is kept; repeated rows are packed each; extra
    columns are dropped; an empty table gives no pieces.
    """
    path = tokenizer or default_path()
    plain = pa.schema([(n, pa.binary() if n == "ids" and binary else t) for n, t in FIELDS])
    schema = plain.append(pa.field("task", pa.int64()))
    piece = f"doc_id long, start long, length long, ids {'binary' if binary else 'array<int>'}, doc_tokens long, sequence_id long, offset long"

    def first(batches):
        from pyspark import TaskContext

        free_memory()
        task, enc, windows, made = TaskContext.get().partitionId(), encoder(path, special), Windows(size, open_windows, min_cut), 0
        for batch in batches:
            keys = batch.column("doc_id")
            for at, texts in slices(batch, "text"):
                ids, counts = enc.encode(texts)
                ids, ends = with_ends(ids, counts, end_id)
                done, begin = [], 0
                for key, end in zip(keys.slice(at, len(texts)).to_pylist(), ends.tolist()):
                    done += windows.put(key, ids[begin:end])
                    begin = end
                for k in range(0, len(done), 512):
                    part = done[k : k + 512]
                    yield rows_of(part, schema, (task << 36) + made)
                    made += len(part)
                del ids, done, texts
                if lean:
                    free_memory()
        if left := windows.rest():
            yield rows_of(left, schema, (task << 36) + made, task)
        free_memory()

    def last(group: pa.Table) -> pa.Table:
        from_rows = sorted(group.to_pylist(), key=lambda r: (r["sequence_id"], r["offset"]))
        number, done, window, room = int(from_rows[0]["task"]) // merge, [], [], size
        for r in from_rows:
            ids, at = np.frombuffer(r["ids"], "<i4") if binary else np.asarray(r["ids"], np.int32), 0
            while at < len(ids):
                part = ids[at : at + room]
                window.append((r["doc_id"], r["start"] + at, part, r["doc_tokens"]))
                at, room = at + len(part), room - len(part)
                if not room:
                    done.append(window)
                    window, room = [], size
        left = size - room
        while left:  # powers of two, the largest first
            room, cut, rest = 1 << (left.bit_length() - 1), [], []
            left -= room
            for doc_id, start, ids, total in window:
                take = min(room, len(ids))
                if take:
                    cut.append((doc_id, start, ids[:take], total))
                if take < len(ids):
                    rest.append((doc_id, start + take, ids[take:], total))
                room -= take
            done.append(cut)
            window = rest
        return pa.Table.from_batches([rows_of(done, plain, (1 << 62) + (number << 32))])

    pieces = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(first, f"{piece}, task long"), "pieces")
    closed = pieces.where("task is null").drop("task")
    merged = pieces.where("task is not null").groupBy(F.expr(f"task div {merge}")).applyInArrow(last, piece)
    return closed.unionByName(merged)
