"""Token ids in binary files, coded by Simple-8b."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import long_ids, scratch, written
from ._text import MEMO_PIECES, kept_in_worker
from .token_count import piece_encoder

#: How many ids of how many bits a word holds, by its selector, the top 4 bits. Selector 15 is 120 zeros without payload.
LAYOUT = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ZEROS = 120
#: Ids in a block; each block starts a new word, so blocks are decoded side by side.
BLOCK = 4096
#: Ids after which a file is closed.
FILE_IDS = 2_000_000
MAGIC = b"S8BFILE1"
#: Tasks that read files, for each core of the cluster, at most; a task reads one file after the other.
READ_TASKS = 16


def _window_max(x: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while size * 2 <= n:
        x, size = np.maximum(x[:-size], x[size:]), size * 2
    return np.maximum(x[: len(x) - (n - size)], x[n - size :]) if size < n else x


def _widths(ids: np.ndarray) -> np.ndarray:
    """0 for a zero, else k for an id that fits in the bits of layout k - 1 and of no earlier one."""
    width = np.zeros(ids.shape, np.uint8)
    for _, bits in [(0, 0), *LAYOUT][:-1]:
        width += ids >> ids.dtype.type(bits) != 0
    return width


#: The same for each id of up to 16 bits.
_WIDTHS = _widths(np.arange(1 << 16, dtype=np.uint32))


def _codes(blocks: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of some blocks, given as rows with zeros after their ids, and how many words each has."""
    flat = (_WIDTHS[blocks] if blocks.max() < len(_WIDTHS) else _widths(blocks)).ravel()
    choice = np.full(flat.shape, len(LAYOUT), np.uint8)  # for each place the first layout that takes the ids from there on
    for k in range(len(LAYOUT) - 1, -1, -1):
        fits = _window_max(flat, LAYOUT[k][0]) <= k + 1
        np.copyto(choice[: len(fits)], k + 1, where=fits)
    if len(flat) >= ZEROS:
        fits = _window_max(flat, ZEROS) == 0
        np.copyto(choice[: len(fits)], 15, where=fits)
    taken = np.array([0, *(n for n, _ in LAYOUT), ZEROS])
    # all blocks advance together, a word at a time
    at, own, steps = np.zeros(len(blocks), np.int64), np.arange(len(blocks)), []
    while len(own):
        start = own * blocks.shape[1] + at[own]
        picked = choice[start]
        steps.append((own, start, picked))
        at[own] += taken[picked]
        own = own[at[own] < lengths[own]]
    block, start, picked = (np.concatenate(x) for x in zip(*steps, strict=True))
    order = np.argsort(block, kind="stable")
    start, picked = start[order], picked[order]
    words = picked.astype(np.uint64) << np.uint64(60)
    values = blocks.ravel()
    for k, (n, bits) in enumerate(LAYOUT):
        own = np.flatnonzero(picked == k + 1)
        for j in range(n if len(own) else 0):
            words[own] |= values[start[own] + j].astype(np.uint64) << np.uint64(j * bits)
    return words, np.bincount(block, minlength=len(blocks))


def encode(ids: np.ndarray, at_once: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the first word of each block and the end, and the places of escaped ids (those of over 60 bits, coded as 0).

    A word takes as many of the next ids as fit together; at the end of a block zeros are thought to follow.
    """
    escaped = np.flatnonzero(ids >> np.uint64(60)) if ids.dtype.itemsize == 8 else np.zeros(0, np.int64)
    if len(escaped):
        ids = ids.copy()
        ids[escaped] = 0
    words, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for first in range(0, len(ids), at_once * BLOCK):
        own = ids[first : first + at_once * BLOCK]
        n = -(-len(own) // BLOCK)
        rows = np.zeros((n, BLOCK + ZEROS), own.dtype)
        rows[: len(own) // BLOCK, :BLOCK] = own[: len(own) // BLOCK * BLOCK].reshape(-1, BLOCK)
        if len(own) % BLOCK:
            rows[-1, : len(own) % BLOCK] = own[len(own) // BLOCK * BLOCK :]
        code, each = _codes(rows, np.minimum(len(own) - np.arange(n) * BLOCK, BLOCK))
        words.append(code)
        counts.append(each)
    return np.concatenate(words), np.cumsum(np.concatenate(counts)), escaped


def decode(words: np.ndarray, offsets: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids of all blocks, escaped ones as 0; each selector's words are unpacked together."""
    out = np.zeros(n_ids, np.uint64)
    if not n_ids:
        return out
    picked = (words >> np.uint64(60)).astype(np.int64)
    taken = np.array([0, *(n for n, _ in LAYOUT), ZEROS])[picked]
    block = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ends = np.cumsum(taken)
    first = ends - taken
    start = block * BLOCK + first - first[offsets[:-1]][block]
    end = np.minimum((block + 1) * BLOCK, n_ids)
    for k, (n, bits) in enumerate(LAYOUT):
        own = np.flatnonzero(picked == k + 1)
        for j in range(n if len(own) else 0):
            keep = own[start[own] + j < end[own]]
            out[start[keep] + j] = (words[keep] >> np.uint64(j * bits)) & np.uint64((1 << bits) - 1)
    return out


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A file: magic; counts of documents, ids, words, blocks and escapes; then, all little-endian, doc ids and whether each is known, lengths, block offsets, words, places and values of escapes."""
    words, offsets, escaped = encode(ids)
    counts = np.array([len(doc_ids), len(ids), len(words), len(offsets) - 1, len(escaped)], "<u8")
    known = np.array([x is not None for x in doc_ids], np.uint8)
    parts = [np.array([x or 0 for x in doc_ids], "<i8"), known, np.array(lengths, "<u8"), offsets.astype("<u8"), words.astype("<u8"), escaped.astype("<u8"), ids[escaped].astype("<u8")]
    return b"".join([MAGIC, counts.tobytes(), *(x.tobytes() for x in parts)])


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Doc ids, lengths and ids of a file."""
    if data[:8] != MAGIC:
        raise ValueError("not a Simple-8b file")
    docs, n_ids, n_words, blocks, escapes = np.frombuffer(data, "<u8", 5, 8).astype(int)
    at, got = 48, []
    for kind, n in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u8", blocks + 1), ("<u8", n_words), ("<u8", escapes), ("<u8", escapes)):
        got.append(np.frombuffer(data, kind, n, at))
        at += got[-1].nbytes
    doc_ids, known, lengths, offsets, words, places, values = got
    ids = decode(words, offsets.astype(np.int64), int(n_ids))
    ids[places.astype(np.int64)] = values
    return [int(x) if k else None for x, k in zip(doc_ids, known, strict=True)], lengths.astype(np.int64), ids


def text_encoder(path: str):
    """A function from a UTF-8 text to its ids as little-endian 32-bit integers, as the library gives them without special tokens.

    Pieces between ASCII white space are encoded once and remembered: white space never lies in a token.
    """
    from functools import cache
    from struct import Struct

    cut, merge = piece_encoder(path)
    pack_ids = cache(lambda n: Struct(f"<{n}I").pack)

    class Pieces(dict):
        def __missing__(self, piece: bytes) -> bytes:
            low = piece.lower() if piece.isascii() and b"<" not in piece else piece  # special strings match in their own case only
            if low != piece:
                value = self[low]
            elif low.isascii() and low.isalpha():  # a pre-token as it stands
                ids = merge(low.decode(), False)
                value = pack_ids(len(ids))(*ids)
            elif low.isascii() and low[:-1].isalpha() and low[-1:] in b".,;:!?":  # two
                value = self[low[:-1]] + self[low[-1:]]
            else:
                text = piece.decode("utf-8", "replace")
                tokens = cut(text)
                ids = merge(text, True) if tokens is None else [i for t in tokens for i in merge(t, False)]
                value = pack_ids(len(ids))(*ids)
            self[piece] = value
            return value

    pieces = Pieces()

    def run(text: bytes | None) -> bytes:
        if len(pieces) > MEMO_PIECES:
            pieces.clear()
        return b"".join(map(pieces.__getitem__, text.split())) if text else b""

    return run


def write_ids(docs: DataFrame, tokenizer_path: str, folder: str, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of each text and end_id to files in folder, by ascending id; returns the manifest: part, file, path, n_docs, n_ids.

    Documents are dealt to tasks by ranges of ids and sorted in each; a task closes a file after about file_ids ids, so
    it never holds more than those and a document. A file gets a name of its own in every attempt, and only the written
    manifest says which files count, so lost executors and repeated attempts leave no gap or double. The folder must be
    shared, on a file system that pyarrow can open.

    Null text counts as empty; null ids come first; rows that repeat an id follow each other in the order of their text; all rows of one id, and all without, go through one task.
    """
    slim = docs.select(long_ids(docs, id_col), docs[text_col].cast("binary").alias("text"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, encoder, tail = TaskContext.get().partitionId(), kept_in_worker(("text_encoder", tokenizer_path), lambda: text_encoder(tokenizer_path)), np.array([end_id], "<u4").tobytes()
        doc_ids, lengths, chunks, held, files = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(chunks), "<u4")
            path = f"{root}/ids-{part:05d}-{files:05d}-{uuid.uuid4().hex}.s8b"
            with store.open_output_stream(path) as f:
                f.write(pack(doc_ids, lengths, ids))
            return pa.RecordBatch.from_pydict({"part": [part], "file": [files], "path": [path], "n_docs": [len(doc_ids)], "n_ids": [len(ids)]})

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                coded = encoder(text.as_py()) + tail
                doc_ids.append(doc_id)
                lengths.append(len(coded) // 4)
                chunks.append(coded)
                held += lengths[-1]
                if held >= file_ids:
                    yield close()
                    doc_ids, lengths, chunks, held, files = [], [], [], 0, files + 1
        if doc_ids:
            yield close()

    ordered = slim.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return written(ordered.mapInArrow(run, "part long, file long, path string, n_docs long, n_ids long"), "manifest")


def read_ids(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """What the files of a manifest hold: doc_id, start (ids of all documents before it), ids (bytes, little-endian 32-bit), in a row for each document."""
    order = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))
    files = files.repartition(max(1, min(manifest.count(), READ_TASKS * spark.sparkContext.defaultParallelism)))

    def run(batches):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with store.open_input_stream(path) as f:
                    doc_ids, lengths, ids = unpack(f.read())
                ends, ids = np.cumsum(lengths), ids.astype("<u4")
                starts = ends - lengths
                for at in range(0, len(doc_ids), 1000):
                    own = slice(at, at + 1000)
                    data = [ids[a:b].tobytes() for a, b in zip(starts[own], ends[own], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids[own], pa.int64()), pa.array(base + starts[own], pa.int64()), pa.array(data, pa.binary())], ["doc_id", "start", "ids"]
                    )

    return files.mapInArrow(run, "doc_id long, start long, ids binary")


def round_trip(docs: DataFrame, tokenizer_path: str, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids to files in the shared folder and reads them back; see ``write_ids`` and ``read_ids``."""
    folder = scratch(docs.sparkSession, "ids")
    folder = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    manifest = write_ids(docs, tokenizer_path, folder, end_id=end_id, id_col=id_col, text_col=text_col, file_ids=file_ids)
    return read_ids(docs.sparkSession, folder, manifest)

