"""Token counts by a linear longest-match automaton.

Greedy word pieces: the longest vocabulary entry that begins a word, then the longest continuation, and so on. The automaton is a
trie of the vocabulary whose nodes know, for a byte that doesn't continue them, how many pieces are complete by then and which
node stands for the bytes that remain. Each byte of a word is thus read once, and pieces are counted without being built.

A vocabulary whose word beginnings carry a leading space is matched against the word with a space before it. Where no longer entry
begins the word, the space alone is the first piece, so that a vocabulary with all single bytes leaves no word unknown.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole_bytes

#: Words whose counts a worker remembers.
MEMO = 300_000


class PieceAutomaton:
    """Counts the greedy pieces of a word.

    `first` are the entries that begin a word, `later` those that continue one. The empty entry in `first` stands for a piece
    before the word (such as a space) after which all of it is cut by `later`; it is the shortest match, used if there is no other.
    A word that can't be cut that way counts as one unknown piece.
    """

    def __init__(self, first: set[bytes], later: set[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]  # node 0 begins words, node 1 continues them
        entry = [False, False]
        for root, tokens in ((0, first), (1, later)):
            for token in sorted(tokens):
                node = root
                for byte in token:
                    into = self.next[node].get(byte)
                    if into is None:
                        into = self.next[node][byte] = len(self.next)
                        self.next.append({})
                        entry.append(False)
                    node = into
                if token:
                    entry[node] = True
        self.back: list[int] = [-1] * len(self.next)  # -1: the bytes so far can't be cut
        self.popped: list[int] = [0] * len(self.next)
        if b"" in first:
            self.back[0], self.popped[0] = 1, 1
        level = [0, 1]
        while level:  # by depth: a node's failure link leads to a shallower one
            below = []
            for node in level:
                for byte, child in self.next[node].items():
                    below.append(child)
                    if entry[child]:
                        self.back[child], self.popped[child] = 1, 1
                        continue
                    link, pieces = self.back[node], self.popped[node]
                    while link >= 0 and byte not in self.next[link]:
                        pieces += self.popped[link]
                        link = self.back[link]
                    if link >= 0:
                        self.back[child], self.popped[child] = self.next[link][byte], pieces
            level = below

    def count(self, word: bytes) -> int:
        """Pieces of a word; 0 if it can't be cut (or is empty)."""
        node = pieces = 0
        following, back, popped = self.next, self.back, self.popped
        for byte in word:
            while (into := following[node].get(byte)) is None:
                pieces += popped[node]
                node = back[node]
                if node < 0:
                    return 0
            node = into
        while node > 1:
            pieces += popped[node]
            node = back[node]
            if node < 0:
                return 0
        return pieces


class Counts(dict):
    def __init__(self, automaton: PieceAutomaton):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        found = self.automaton.count(word)
        if len(word) < 200:
            self[word] = found
        return found


def split_vocabulary(tokens: set[bytes]) -> tuple[set[bytes], set[bytes]]:
    """(first, later) of a vocabulary whose word beginnings carry a leading space; the space alone gives the empty entry."""
    return {t[1:] for t in tokens if t[:1] == b" "}, {t for t in tokens if t[:1] != b" " and t}


_automata: dict[bytes, PieceAutomaton] = {}


def automaton_of(broadcast) -> PieceAutomaton:
    """The vocabulary's automaton, made once in each Python worker; told apart from others' by a digest of the whole vocabulary."""
    first, later, digest = broadcast.value
    if digest not in _automata:
        _automata[digest] = PieceAutomaton(first, later)
    return _automata[digest]


def vocabulary_digest(first: set[bytes], later: set[bytes]) -> bytes:
    whole = hashlib.sha256(b"%d " % len(first))
    for tokens in (first, later):
        for token in sorted(tokens):
            whole.update(b"%d " % len(token) + token)
    return whole.digest()


def token_counts(df: DataFrame, first: set[bytes], later: set[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_tokens, n_unknown.

    Words are runs without ASCII white space. n_tokens counts an unknown word as one. Null and empty texts have 0 of each; a
    very long word is read like any other; repeated rows stay; other columns aren't read.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast((first, later, vocabulary_digest(first, later)))
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType)] + [T.StructField(c, T.LongType()) for c in ("n_words", "n_tokens", "n_unknown")])

    def counted(batches):
        counts = Counts(automaton_of(vocabulary))
        for batch in batches:
            rows = []
            for text in whole_bytes(batch.column(1)):
                words = (text or b"").split()
                pieces = list(map(counts.__getitem__, words))
                unknown = pieces.count(0)
                rows.append((len(words), sum(pieces) + unknown, unknown))
                if len(counts) > MEMO:
                    counts.clear()
            columns = [pa.array(values, pa.int64()) for values in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(counted, schema)
