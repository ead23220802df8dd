"""Token ids of texts, packed into rows of fixed length by best-fit decreasing, as little-endian binary.

Texts are encoded by a byte-level BPE vocabulary (a tiktoken rank file). Each text's ids, with an end mark, are cut
into pieces of a row's length without loss. Pieces go to packing groups by a hash, so that a group has
a bounded number of tokens whatever the texts look like; in a group they are placed longest first, each into the
fullest row that still has room, which a segment tree over the free lengths finds in logarithmic time. A group's rows
leave as matrices of ids, cumulative segment lengths and positions that begin anew with each segment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.common import CHUNK_BYTES, chunks, lean, parts, text_bytes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that parts text before the merges of the rank files (a fixed value of that vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ends each document, and fills rows; free in the vocabulary.
END_ID = 50_256
ROW_TOKENS = 2048
#: Tokens of a packing group, on average; rows of one written matrix.
GROUP_TOKENS, MATRIX_ROWS = 1 << 20, 64
#: A text's bytes are about so many times its tokens; only the number of groups hangs on it.
BYTES_PER_TOKEN = 2.6


def encoding(path: str = VOCABULARY):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("xylem", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Bytes of spaces in ASCII, and bytes that surely begin no space (C2, E1, E2 and E3 begin those beyond ASCII).
SPACE, SOLID = np.zeros(256, bool), np.ones(256, bool)
SPACE[[32, *range(9, 14)]] = True
SOLID[[*range(9, 14), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = False


def cuts(body: np.ndarray) -> np.ndarray:
    """Where a text's bytes may be parted without changing its ids: any of the places, or all of them.

    The pattern parts the last space of a run that something follows from those before it: a blank goes with the word
    after it, another is a piece of its own. So a text may be parted before such a space.
    """
    return np.flatnonzero(SPACE[body[:-1]] & SOLID[body[1:]])


class Encoder:
    """Ids of texts. A text is encoded whole, a very long one in parts of about CHUNK_BYTES, so that memory follows its bytes and not Python's lists of its ids."""

    def __init__(self, path: str = VOCABULARY) -> None:
        self.encode_ordinary = encoding(path).encode_ordinary

    def ids(self, text: str | None) -> np.ndarray:
        """Little-endian uint16 ids of a text and END_ID. A null is empty."""
        out = [np.array(self.encode_ordinary(part), "<u2") for part in pieces(text or "")]
        return np.concatenate([*out, np.array([END_ID], "<u2")])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin (one more entry: the end)."""
        out = [self.ids(text) for text in column.to_pylist()]
        return np.concatenate([np.zeros(0, "<u2"), *out]), np.concatenate([[0], np.cumsum([len(x) for x in out], dtype=np.int64)])


def pieces(text: str) -> list[str]:
    """A text in parts whose ids one after another are its own, of CHUNK_BYTES at most wherever it may be cut so soon."""
    if len(text) < CHUNK_BYTES:
        return [text]
    body = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    at, out, begin = np.concatenate([[0], cuts(body), [len(body)]]), [], 0
    while begin < len(body):
        k = int(np.searchsorted(at, begin + CHUNK_BYTES, "right")) - 1
        end = int(at[k] if at[k] > begin else at[np.searchsorted(at, begin, "right")])
        out.append(body[begin:end].tobytes().decode())
        begin = end
    return out


def _encoded(path: str, capacity: int):
    """(id, text) -> (id, start, ids): a text's ids in pieces of at most `capacity`, each with its place."""

    def encoded(batches):
        encoder = Encoder(path)
        for batch in parts(batches):
            text, ids = batch.column("text"), batch.column("id")
            _, offsets = text_bytes(text)
            for i, j in chunks(offsets):
                body, begin = encoder.encode(text.slice(i, j - i))
                count = -(-np.diff(begin) // capacity)
                row = np.repeat(np.arange(j - i), count)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * capacity
                bounds = np.append(begin[row] + start, begin[-1])
                held = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((2 * bounds).astype(np.int32)), pa.py_buffer(body)])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + i)), pa.array(start), held], ["id", "start", "ids"])

    return encoded


class FreeRows:
    """Rows by free length: how many there are of each length, in a segment tree that finds the least length of at least so much."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, free: int, by: int) -> None:
        at = free + self.leaves
        while at:
            self.tree[at] += by
            at >>= 1

    def put(self, row: int, free: int) -> None:
        self.rows[free].append(row)
        self._add(free, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """A row whose free length is the least of those of `need` or more, and that length; it leaves the tree."""
        at, tree = need + self.leaves, self.tree
        while not tree[at]:
            while at & 1:  # a right child: nothing further right below its parent
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if tree[2 * at] else 2 * at + 1
        free = at - self.leaves
        self._add(free, -1)
        return self.rows[free].pop(), free


def pack(lengths: list[int], capacity: int = ROW_TOKENS) -> list[list[int]]:
    """Best-fit decreasing: for each row, the pieces in it in the order they were placed. Equal lengths go by index."""
    free, rows = FreeRows(capacity), []
    for piece in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[piece]
        if (found := free.take(n)) is None:
            rows.append([piece])
            row, room = len(rows) - 1, capacity
        else:
            row, room = found
            rows[row].append(piece)
        if room > n:
            free.put(row, room - n)
    return rows


def _packed(capacity: int, matrix_rows: int):
    def packed(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["id", "start", "ids"], na_position="first")
        pieces = [np.frombuffer(raw, "<u2") for raw in pdf["ids"]]
        of = [(None if doc is None or doc != doc else int(doc), int(k)) for doc, k in zip(pdf["id"], pdf["start"], strict=True)]
        rows, out = pack([len(p) for p in pieces], capacity), []
        for at in range(0, len(rows), matrix_rows):
            part = rows[at : at + matrix_rows]
            ids = np.full((len(part), capacity), END_ID, "<u2")
            places = np.zeros((len(part), capacity), "<u2" if capacity <= 1 << 16 else "<u4")
            cuts, docs, starts, segments = [], [], [], []
            for i, row in enumerate(part):
                end = 0
                cuts.append(0)
                for p in row:
                    n = len(pieces[p])
                    ids[i, end : end + n], places[i, end : end + n] = pieces[p], np.arange(n)
                    end += n
                    cuts.append(end)
                    docs.append(of[p][0])
                    starts.append(of[p][1])
                segments.append(len(row))
            tokens = int(sum(len(pieces[p]) for row in part for p in row))
            out.append((int(pdf.grp.iloc[0]), at // matrix_rows, len(part), tokens, ids.tobytes(), places.tobytes(), segments, cuts, docs, starts))
        return pd.DataFrame(out, columns=[x.split()[0] for x in MATRIX.split(", ")])

    return packed


#: A row of the result: rows * ROW_TOKENS ids and positions, row by row; segments of each row; their cumulative
#: lengths (each row's begin with 0); and of each segment the document and the place of its first token in it.
MATRIX = "pack_group long, matrix long, n_rows long, n_tokens long, ids binary, positions binary, n_segments array<int>, cu_seqlens array<int>, doc_ids array<long>, doc_starts array<long>"


def packed_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, row_tokens: int = ROW_TOKENS, group_tokens: int = GROUP_TOKENS, matrix_rows: int = MATRIX_ROWS, groups: int | None = None) -> DataFrame:
    """The matrices of all texts of docs (see MATRIX).

    A null or empty text is an end mark alone; a null id stays null. Repeated rows and ties are packed each. Texts of any
    length are cut in pieces of row_tokens, and pieces are dealt to groups by a hash of id, place and row, so a group
    holds about group_tokens whatever the keys, sizes or repeats; a text's pieces carry its id and their places. The
    number of groups comes from a pass over the texts' lengths, or from the caller, who saves that pass. An empty table
    gives an empty result. Other columns are neither read nor returned, so their names don't matter. Ids must be numbers
    or texts of numbers. docs should be a stored table, whose rows a repeated task reads in the same order. The vocabulary file must be at the same path on every executor; its ids fit in 16 bits.
    """
    if groups is None:
        size = docs.agg(F.sum(F.octet_length(text_col)), F.count("*")).first()
        groups = max(1, round(((size[0] or 0) / BYTES_PER_TOKEN + size[1]) / group_tokens))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pieces = rows.mapInArrow(lean(_encoded(vocabulary, row_tokens)), "id long, start long, ids binary")
    grp = F.pmod(F.xxhash64("id", "start", F.monotonically_increasing_id()), F.lit(groups))
    return pieces.withColumn("grp", grp).groupBy("grp").applyInPandas(_packed(row_tokens, matrix_rows), MATRIX)


def write_matrices(packed: DataFrame, path: str) -> None:
    """Writes the matrices as Parquet through Spark's own writer, so any file system that Spark reaches will do."""
    packed.write.mode("errorifexists").parquet(path)


def unpack(row) -> list[tuple[int | None, int, list[int]]]:
    """(document, place, ids) of each segment of a matrix: the inverse, for readers and tests."""
    ids = np.frombuffer(row["ids"], "<u2").reshape(row["n_rows"], -1)
    out, cut, seg = [], 0, 0
    for i, n in enumerate(row["n_segments"]):
        ends = row["cu_seqlens"][cut : cut + n + 1]
        for a, b in zip(ends, ends[1:], strict=False):
            out.append((row["doc_ids"][seg], row["doc_starts"][seg], ids[i, a:b].tolist()))
            seg += 1
        cut += n + 1
    return out
