"""Token ids as canonical length-limited Huffman files, in order of the documents' ids.

File: ``TWHF`` and the length of a compressed table with one code length an id, then frames. A frame
holds whole documents: their ids, null flags and token counts, a bit offset for every STEP tokens,
and the code bits. Each of these checkpoints starts an independent block, so that one table
lookup a token decodes all blocks of a frame side by side.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, fresh_path, materialize, shared_dir
from .tokens import encoder, id_lists

MAX_BITS = 16
STEP = 512
FRAME_TOKENS = 1 << 20
FILE_TOKENS = 1 << 23
MAGIC = b"TWHF"
_HEAD = struct.Struct("<IQIQ")


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` for the ids with counts (package-merge); 0: no code."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    max_bits = max(max_bits, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    level, marks = leaves, [np.ones(len(leaves), bool)]
    for _ in range(max_bits - 1):
        m = len(level) // 2 * 2
        both = np.concatenate((leaves, level[0:m:2] + level[1:m:2]))
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        marks.append(rank < len(leaves))
    take, lengths = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for mark in reversed(marks):
        own = int(mark[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    code = last = 0
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        code <<= n - last
        codes[i] = code
        code, last = code + 1, n
    return codes


def encode_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The code bits, most significant first, and the bit offset of every STEP-th token."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    words = np.zeros(int(ends[-1] + 63 >> 6) + 1 if len(ids) else 1, np.uint64)
    if len(ids):
        word, room = at >> 6, 64 - (at & 63) - size
        code = codes[ids]
        fits = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        words[word[first]] = np.add.reduceat(fits, first)
        over = np.flatnonzero(room < 0)
        words[word[over] + 1] += code[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes(), at[::STEP]


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every value of the next ``bits`` bits: the id and its code's length."""
    bits = int(lengths.max(initial=1))
    codes = canonical_codes(lengths)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    span = 1 << (bits - lengths[used].astype(np.int64))
    ids, size = np.zeros(1 << bits, np.uint32), np.ones(1 << bits, np.uint8)
    ids[: span.sum()] = np.repeat(used, span)
    size[: span.sum()] = np.repeat(lengths[used], span)
    assert not len(used) or codes[used[0]] == 0
    return ids, size, bits


def decode_bits(raw: bytes, offsets: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    ids, size, bits = table
    words = np.frombuffer(raw, ">u8").astype(np.uint64)
    words = np.append(words, np.uint64(0))
    out = np.zeros((len(offsets), STEP), np.uint32)
    at, low = offsets.astype(np.int64), np.uint64(64 - bits)
    last = n - (len(offsets) - 1) * STEP
    for k in range(min(STEP, n)):
        if k == last and len(at) > 0:
            at = at[:-1]
            if not len(at):
                break
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        window = (words[word] << shift) | ((words[word + 1] >> np.uint64(1)) >> (np.uint64(63) - shift))
        peek = (window >> low).astype(np.int64)
        out[: len(at), k] = ids[peek]
        at = at + size[peek]
    return out.reshape(-1)[:n]


def tokenize(docs: DataFrame, path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_tokens`` and ``ids`` (little-endian unsigned 16 or 32-bit, as ``width`` says) of whole texts."""

    def factory():
        enc = encoder(path)

        def run(texts):
            ids, counts = enc.encode(texts, end_id)
            return [pa.array(counts), id_lists(ids, counts), pa.array(np.full(len(counts), ids.itemsize, np.int32))]

        return run

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("width", T.IntegerType())]
    return add_columns(docs, [text_col], fields, factory, keep=[id_col])


def token_array(blob, width: int) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if width == 2 else "<u4")


def runs_of(blobs: pa.Array, widths: pa.Array):
    """The ids of all rows, rows of one width together, as they lie in Arrow's buffer."""
    width = widths.to_numpy()
    cuts = np.flatnonzero(np.diff(width)) + 1
    for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(width)]):
        if e > a:
            part = blobs.slice(a, e - a).cast(pa.large_binary())
            ends = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
            raw = np.frombuffer(part.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
            yield np.frombuffer(raw.tobytes(), "<u2" if width[a] == 2 else "<u4")


def id_counts(tokens: DataFrame) -> np.ndarray:
    """Count of each id over all rows; at most one row an id of the vocabulary reaches the driver."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for ids in runs_of(b.column(0), b.column(1)):
                for k in range(0, len(ids), FRAME_TOKENS):
                    n = np.bincount(ids[k : k + FRAME_TOKENS])
                    if len(n) > len(total):
                        total = np.concatenate((total, np.zeros(len(n) - len(total), np.int64)))
                    total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    rows = tokens.select("ids", "width").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def _frame(doc_ids: list, counts: list[int], ids: np.ndarray, codes, lengths) -> bytes:
    raw, offsets = encode_bits(ids, codes, lengths)
    none = np.packbits([d is None for d in doc_ids]).tobytes()
    own = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + none + np.array(counts, "<i8").tobytes()
    own = zlib.compress(own, 1)
    marks = offsets.astype("<u8").tobytes()
    return _HEAD.pack(len(doc_ids), len(ids), len(own), len(raw)) + own + marks + raw


def write_files(tokens: DataFrame, folder: str, id_col: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """Write (id, n_tokens, ids, width) in order of id (nulls first); one row a file: part, n_docs, n_tokens.

    Rows are dealt by ranges of ids. A file takes its name from the number of its range and is put
    in place by a rename, so that a task that runs again writes the same file again.
    """
    lengths = code_lengths(id_counts(tokens), max_bits)
    packed = zlib.compress(lengths.tobytes())
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, -(-total // FILE_TOKENS))

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        store, place = fs.FileSystem.from_uri(folder)
        codes = canonical_codes(lengths)
        doc_ids, counts, held, size, docs, n = [], [], [], 0, 0, 0
        out = None
        temp, final = f"{place}/_tmp-{part}-{attempt}", f"{place}/part-{part:06d}.twhf"
        for b in batches:
            if out is None and b.num_rows:
                out = store.open_output_stream(temp)
                out.write(MAGIC + struct.pack("<I", len(packed)) + packed)
            own, sizes = b.column(0).to_pylist(), b.column(1).to_numpy()
            every = list(runs_of(b.column(2), b.column(3)))
            ids = every[0] if len(every) == 1 else np.concatenate(every) if every else np.empty(0, np.uint16)
            docs, n, at, first = docs + len(own), n + len(ids), 0, 0
            ends = np.cumsum(sizes)
            while first < len(own):  # a frame is closed by the document that fills it
                stop = min(len(own), int(np.searchsorted(ends, at + FRAME_TOKENS - size)) + 1)
                doc_ids += own[first:stop]
                counts += sizes[first:stop].tolist()
                held.append(ids[at : ends[stop - 1]])
                size, at, first = size + int(ends[stop - 1] - at), int(ends[stop - 1]), stop
                if size >= FRAME_TOKENS:
                    out.write(_frame(doc_ids, counts, np.concatenate(held), codes, lengths))
                    doc_ids, counts, held, size = [], [], [], 0
        if out is not None:
            if doc_ids:
                out.write(_frame(doc_ids, counts, np.concatenate(held), codes, lengths))
            out.close()
            if store.get_file_info(final).type == fs.FileType.NotFound:
                store.move(temp, final)
            else:
                store.delete_file(temp)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([docs], pa.int64()), pa.array([n], pa.int64())], names=["part", "n_docs", "n_tokens"])

    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(folder)
    store.create_dir(place, recursive=True)
    rows = tokens.select(id_col, "n_tokens", "ids", "width").repartitionByRange(int(parts), id_col).sortWithinPartitions(id_col, "n_tokens", "ids")
    return materialize(rows.mapInArrow(run, "part long, n_docs long, n_tokens long"), "files")


def frames(raw: bytes):
    """(document ids, token counts, ids) of each frame of a file."""
    assert raw[:4] == MAGIC
    (n,) = struct.unpack_from("<I", raw, 4)
    lengths = np.frombuffer(zlib.decompress(raw[8 : 8 + n]), np.uint8)
    table, at = decode_table(lengths), 8 + n
    while at < len(raw):
        docs, tokens, own, bits = _HEAD.unpack_from(raw, at)
        at += _HEAD.size
        head = zlib.decompress(raw[at : at + own])
        at += own
        none = np.unpackbits(np.frombuffer(head, np.uint8, (docs + 7) // 8, 8 * docs))[:docs]
        doc_ids = [None if x else d for d, x in zip(np.frombuffer(head, "<i8", docs).tolist(), none.tolist())]
        counts = np.frombuffer(head, "<i8", docs, len(head) - 8 * docs)
        marks = -(-tokens // STEP)
        offsets = np.frombuffer(raw, "<u8", marks, at)
        at += 8 * marks
        yield doc_ids, counts, decode_bits(raw[at : at + bits], offsets, tokens, table)
        at += bits


def read_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """The documents of the files: part, nr in the part, doc_id, start in the part, n_tokens, ids_crc32[, ids]."""

    def run(batches):
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1)):
                part, nr, start = int(path.rsplit("part-", 1)[1].split(".")[0]), 0, 0
                for doc_ids, counts, ids in frames(raw.as_buffer().to_pybytes()):
                    data = ids.astype("<u4").tobytes()
                    ends = np.cumsum(counts)
                    begins = ends - counts
                    blobs = [data[4 * s : 4 * e] for s, e in zip(begins.tolist(), ends.tolist())]
                    k = len(doc_ids)
                    cols = [pa.array(np.full(k, part)), pa.array(np.arange(nr, nr + k)), pa.array(doc_ids, pa.int64()), pa.array(begins + start), pa.array(counts), pa.array([zlib.crc32(x) for x in blobs], pa.int64())]
                    names = ["part", "nr", "doc_id", "start", "n_tokens", "ids_crc32"]
                    nr, start = nr + k, start + len(ids)
                    yield pa.RecordBatch.from_arrays(cols + ([pa.array(blobs, pa.binary())] if with_ids else []), names=names + ["ids"] * with_ids)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.twhf").load(folder).select("path", "content")
    return files.mapInArrow(run, "part long, nr long, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def token_files(docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Encode, write and read back all of ``docs``: doc_id, start, n_tokens, ids_crc32.

    Null texts count as empty (their one id is ``end_id``); null ids come first; rows with equal ids
    follow by length and ids; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "huffman")
    shared_dir(spark)
    tokens = materialize(tokenize(docs, path, end_id, id_col, text_col), "tokens")
    files = write_files(tokens, folder, id_col)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a file of FILE_TOKENS ids
    base = files.groupBy("part").agg(F.max("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    back = read_files(spark, folder, with_ids=False)
    return back.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
