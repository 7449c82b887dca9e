"""Byte-level BPE by ranks: encoding and decoding on Arrow batches.

Text is split by the vocabulary's pattern. A piece that is a token stands for itself; the other distinct pieces of a batch are
put into padded matrices by length and merged together: each round, every row looks up the ranks of its adjacent pairs in a
hash table, merges its leftmost pair of least rank, and closes the gap; rows without a pair leave the matrix. Pieces longer than
MATRIX_LENGTH, for which whole rounds per merge would take quadratic time, merge the same pairs in the same order from a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of the longest piece that goes through a matrix.
MATRIX_LENGTH = 192
#: Pieces whose ids are remembered from batch to batch.
MEMO = 500_000
#: Rows of a matrix.
MATRIX_ROWS = 1 << 13
#: Bytes of text that one round of matrices serves.
ROUND_BYTES = 4 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from lines of a base64 token and its rank; a vocabulary file is of fixed size and read by the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of their joined bytes; looks up whole arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.int32)
        waiting, found = np.array(keys, np.int64), np.array(values, np.int32)
        at = self.home(waiting)
        while len(waiting):
            free = np.flatnonzero(self.keys[at] == -1)
            self.keys[at[free]] = waiting[free]  # of several that want a slot, the last one gets it
            self.values[at[free]] = found[free]
            lost = self.keys[at] != waiting
            waiting, found, at = waiting[lost], found[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray, none: int) -> np.ndarray:
        """Ids of the joined pairs, `none` where the pair isn't a token."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self.home(keys)
        out = np.full(keys.shape, none, np.int32)
        there = self.keys[at]
        hit = there == keys
        out[hit] = self.values[at[hit]]
        open_at = np.nonzero(~hit & (there != -1))
        keys, at = keys[open_at], at[open_at]
        while len(keys):
            at = (at + 1) & ((1 << self.bits) - 1)
            there = self.keys[at]
            hit = there == keys
            out[tuple(x[hit] for x in open_at)] = self.values[at[hit]]
            more = ~hit & (there != -1)
            open_at, keys, at = tuple(x[more] for x in open_at), keys[more], at[more]
        return out


class BytePairCodec:
    """Encodes and decodes by one vocabulary; special tokens don't exist for it."""

    NONE = np.iinfo(np.int32).max

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.tokens, self.pairs, self.pattern = ranks, PairTable(ranks), regex.compile(pattern)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.pieces[rank] = token
        self.memo: dict[str, bytes] = {}

    def merge_matrix(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of nearly one length, as little-endian 32-bit integers."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(lengths.max())
        padded = pieces if int(lengths.min()) == width else [piece.ljust(width, b"\0") for piece in pieces]
        ids = self.single[np.frombuffer(b"".join(padded), np.uint8).reshape(len(pieces), width)]
        ids[np.arange(width) >= lengths[:, None]] = -1
        ranks = self.pair_ranks(ids)
        rows, done = np.arange(len(pieces)), [b""] * len(pieces)
        while len(rows):
            at = ranks.argmin(axis=1)  # argmin gives the leftmost of equals
            best = ranks[np.arange(len(rows)), at]
            over = best == self.NONE
            if over.any():
                self.finish(done, rows[over], ids[over])
                going = ~over
                rows, ids, ranks, at, best = rows[going], ids[going], ranks[going], at[going], best[going]
                if not len(rows):
                    break
            every = np.arange(len(rows))
            ids[every, at] = best
            ids = np.where(np.arange(ids.shape[1] - 1) > at[:, None], ids[:, 1:], ids[:, :-1])
            ids = ids[:, : max(1, int((ids >= 0).any(axis=0).sum()))]
            pairs = ids.shape[1] - 1
            if not pairs:
                self.finish(done, rows, ids)
                break
            wide = np.concatenate([ranks, np.full((len(rows), 1), self.NONE, np.int32)], axis=1)
            ranks = np.where(np.arange(pairs) > at[:, None], wide[:, 1 : 1 + pairs], wide[:, :pairs])
            for shift in (-1, 0):  # only the pairs on either side of the merged token are new
                place = at + shift
                there = (place >= 0) & (place < pairs)
                k, p = every[there], place[there]
                ranks[k, p] = self.pair_at(ids[k, p], ids[k, p + 1])
        return done

    @staticmethod
    def finish(done: list[bytes], rows: np.ndarray, ids: np.ndarray) -> None:
        real = ids >= 0
        ends = np.cumsum(4 * real.sum(axis=1)).tolist()
        data = ids[real].astype("<u4").tobytes()
        for row, start, end in zip(rows.tolist(), [0, *ends], ends):
            done[row] = data[start:end]

    def pair_ranks(self, ids: np.ndarray) -> np.ndarray:
        return self.pair_at(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else np.full((len(ids), 1), self.NONE, np.int32)

    def pair_at(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = self.pairs.ranks(np.maximum(left, 0), np.maximum(right, 0), self.NONE)
        out[(left < 0) | (right < 0)] = self.NONE
        return out

    def merge_heap(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece, by the same merges: least rank first, leftmost of equals."""
        ids = self.single[np.frombuffer(piece, np.uint8)]
        first = self.pair_at(ids[:-1], ids[1:])
        heap = [(int(r), k) for k, r in enumerate(first) if r != self.NONE]
        heapq.heapify(heap)
        parts, n = [piece[k : k + 1] for k in range(len(piece))], len(piece)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        current = [int(r) for r in first] + [int(self.NONE)]
        token = self.tokens.get
        while heap:
            rank, at = heapq.heappop(heap)
            if current[at] != rank or parts[at] is None:
                continue
            gone = following[at]
            parts[at] += parts[gone]
            parts[gone], current[gone] = None, int(self.NONE)
            following[at] = following[gone]
            if following[at] < n:
                before[following[at]] = at
            for left in (before[at], at):
                if left >= 0:
                    right = following[left]
                    now = token(parts[left] + parts[right]) if right < n else None
                    current[left] = int(self.NONE) if now is None else now
                    if now is not None:
                        heapq.heappush(heap, (now, left))
        return np.array([self.tokens[p] for p in parts if p is not None], np.int32)

    def learn(self, pieces: set[str]) -> None:
        """Puts the ids of pieces into the memo, as little-endian 32-bit integers."""
        buckets: dict[int, tuple[list[str], list[bytes]]] = {}
        memo, token = self.memo, self.tokens.get
        for piece in pieces:
            data = piece.encode("utf-8", "surrogatepass")
            rank = token(data)
            if rank is not None:
                memo[piece] = rank.to_bytes(4, "little")
            elif len(data) > MATRIX_LENGTH:
                memo[piece] = self.merge_heap(data).astype("<u4").tobytes()
            else:
                names, values = buckets.setdefault(len(data) if len(data) < 32 else (len(data) + 15) // 16 * 16, ([], []))
                names.append(piece)
                values.append(data)
        for names, values in buckets.values():
            for low in range(0, len(names), MATRIX_ROWS):
                memo.update(zip(names[low : low + MATRIX_ROWS], self.merge_matrix(values[low : low + MATRIX_ROWS])))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        split = [self.pattern.findall(text) for text in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        unknown = set().union(*split).difference(self.memo)
        if unknown:
            self.learn(unknown)
        for pieces in split:
            yield b"".join(map(self.memo.__getitem__, pieces))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


_codecs: dict[bytes, BytePairCodec] = {}


def codec_of(broadcast) -> BytePairCodec:
    """The vocabulary's codec, made once in each Python worker; told apart from others' by a digest of the whole vocabulary."""
    ranks, pattern, digest = broadcast.value
    if digest not in _codecs:
        _codecs[digest] = BytePairCodec(ranks, pattern)
    return _codecs[digest]


def vocabulary_digest(ranks: dict[bytes, int], pattern: str) -> bytes:
    whole = hashlib.sha256(pattern.encode())
    for token, rank in sorted(ranks.items()):
        whole.update(b"%d %d " % (rank, len(token)) + token)
    return whole.digest()


def encoded(batches: Iterator[pa.RecordBatch], vocabulary, text: int) -> Iterator[pa.RecordBatch]:
    """Batches with the text column replaced by `ids` (list of int32), in rounds of bounded size."""
    codec = codec_of(vocabulary)
    for batch in batches:
        column = batch.column(text)
        start = held = 0
        for at in range(batch.num_rows):
            held += len(column[at].as_buffer() or b"") + 64 if column[at].is_valid else 64
            if held >= ROUND_BYTES or at + 1 == batch.num_rows:
                texts = [x or "" for x in column.slice(start, at + 1 - start).to_pylist()]
                ids = list(codec.encode(texts))
                offsets = np.cumsum([0, *map(len, ids)]) // 4
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))])
                part = batch.slice(start, at + 1 - start)
                columns = [*part.columns]
                columns[text] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                names = [*batch.schema.names]
                names[text] = "ids"
                yield pa.RecordBatch.from_arrays(columns, names=names)
                start, held = at + 1, 0


def decoded(batches: Iterator[pa.RecordBatch], vocabulary, ids: int) -> Iterator[pa.RecordBatch]:
    """Batches with a column `decoded` (binary) added: the bytes that the ids stand for; null ids stand for none."""
    codec = codec_of(vocabulary)
    for batch in batches:
        column = batch.column(ids)
        found = [codec.decode(column[k].values.to_numpy()) if column[k].is_valid and len(column[k].values) else b"" for k in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "decoded"])


def shared_vocabulary(df: DataFrame, ranks: dict[bytes, int], pattern: str):
    """The vocabulary as a Spark broadcast: a few MB whatever the table."""
    return df.sparkSession.sparkContext.broadcast((ranks, pattern, vocabulary_digest(ranks, pattern)))


def bpe_encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) per row, as array<int>. Null or empty texts have no ids; repeated rows stay; other columns aren't read."""
    vocabulary = shared_vocabulary(df, ranks, pattern)
    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(lambda batches: encoded(batches, vocabulary, 1), out)


def bpe_decode(df: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded) per row: the binary column holds the bytes of the ids; null or no ids stand for no bytes. Rows stay as they are."""
    vocabulary = shared_vocabulary(df, ranks, pattern)
    source = df.select(id_col, F.col(ids_col).alias("ids"))
    return source.mapInArrow(lambda batches: decoded(batches, vocabulary, 1), T.StructType([*source.schema.fields, T.StructField("decoded", T.BinaryType())]))


def bpe_round_trip(df: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", *, with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]): both operators and their digests in one pass over the texts.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers, decoded_sha256 over the decoded bytes. Null and empty
    texts have no ids and the digests of nothing; very long texts are read whole; repeated rows stay; an empty table gives an empty
    result; other columns aren't read.
    """
    vocabulary = shared_vocabulary(df, ranks, pattern)
    fields = [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids

    def digested(batches):
        for batch in decoded(encoded(batches, vocabulary, 1), vocabulary, 1):
            ids, texts = batch.column(1), batch.column(2)
            sums = [hashlib.sha256(ids[k].values.to_numpy().astype("<u4").tobytes()).hexdigest() for k in range(batch.num_rows)]
            columns = [batch.column(0), pc.list_value_length(ids).cast(pa.int64()), pa.array(sums), pa.array([hashlib.sha256(x.as_py()).hexdigest() for x in texts])]
            yield pa.RecordBatch.from_arrays(columns + [ids] * with_ids, names=[f.name for f in fields])

    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(digested, T.StructType(fields))
