"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled into a deterministic automaton over token labels. It
starts as the trie of pre-split words, whose arcs are single bytes. Then, by rising
merge rank, each merge (a, b) -> c is put in by a gadget: wherever an a-arc leads
from state q to p and a b-arc from p to r, the pair is replaced by a c-arc from q to
r; p keeps its other arcs. After the last merge each word's accepting state is
reached by exactly one run, whose arc labels are the word's tokens. Every state has
one incoming arc, so the table (parent, label) holds the whole automaton: a word is
encoded by stepping through it from the accepting state back to the start. Starting
from all strings instead of the words at hand would give states times vocabulary
arcs; the construction is the same.

Tasks encode Arrow batches of documents; words met before are looked up in a bounded
table per Python worker. Decoding emits the bytes of each arc label.

Defined results: null text is empty and has no tokens; invalid UTF-8 made by decoding
arbitrary ids becomes U+FFFD; an id outside the vocabulary raises.
"""

from __future__ import annotations

import gc
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: FIXED VALUE: the pre-split pattern of byte-level BPE files that use their default.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept per worker; longer words than this are not kept.
TABLE_WORDS = 80_000
TABLE_WORD_CHARS = 32
#: Words compiled into one automaton; bytes of a column handled together.
COMPILE_WORDS = 25_000
SLICE_BYTES = 2_000_000


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of the vocabulary's printable alphabet: printable Latin-1
    stands for itself, every other byte for 256, 257, ... in order."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in same]
    return {chr(b): b for b in same} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """What the automaton is compiled from, read from the text of a vocabulary file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.label: dict[int, bytes] = {i: bytes(alphabet[c] for c in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.label |= {i: t.encode() for t, i in self.special.items()}
        self.byte_id = [0] * 256
        for i, raw in self.label.items():
            if len(raw) == 1:
                self.byte_id[raw[0]] = i
        self.packed = {i: i.to_bytes(4, "little") for i in self.label}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.rules: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if (vocab[a], vocab[b]) not in self.rank:
                self.rank[vocab[a], vocab[b]] = (r, vocab[a + b])
                self.rules[r] = (vocab[a], vocab[b], vocab[a + b])
        self.split = regex.compile(SPLIT_PATTERN)
        self.around = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None


def compile_words(words: list[bytes], merges: Merges) -> list[bytes]:
    """Ids (packed) of each word, by the automaton of these words; ``words`` sorted."""
    byte_id, rank = merges.byte_id, merges.rank
    # the trie: a state's incoming arc is (parent, label); children holds outgoing arcs,
    # where an arc moved away by a gadget is told by its state's parent
    parent, label = [0], [-1]
    children: list[list[int] | None] = [None]
    ends, path, last = [], [0], b""
    at_rank: dict[int, list[int]] = {}
    for word in words:
        same = 0
        for x, y in zip(word, last, strict=False):
            if x != y:
                break
            same += 1
        del path[same + 1:]
        state, left = path[-1], label[path[-1]]
        for byte in word[same:]:
            t, new = byte_id[byte], len(parent)
            parent.append(state)
            label.append(t)
            children.append(None)
            if children[state] is None:
                children[state] = [new]
            else:
                children[state].append(new)
            found = rank.get((left, t))
            if found is not None:
                at_rank.setdefault(found[0], []).append(new)
            path.append(new)
            state, left = new, t
        ends.append(state)
        last = word
    # gadgets by rising rank; a merge only opens pairs of higher rank
    ranks = list(at_rank)
    heapq.heapify(ranks)
    while ranks:
        k = heapq.heappop(ranks)
        a, b, c = merges.rules[k]
        right_ends = at_rank.pop(k)
        if a == b:
            right_ends = sorted(set(right_ends))  # a trie numbers states from the start of a word on: leftmost first
        for r in right_ends:
            p = parent[r]
            if label[r] != b or label[p] != a:
                continue  # an earlier gadget took one of the arcs
            q = parent[p]
            parent[r], label[r] = q, c
            children[q].append(r)
            if q:
                found = rank.get((label[q], c))
                if found is not None:
                    if found[0] in at_rank:
                        at_rank[found[0]].append(r)
                    else:
                        at_rank[found[0]] = [r]
                        heapq.heappush(ranks, found[0])
            if children[r]:
                for r2 in children[r]:
                    if parent[r2] == r:
                        found = rank.get((c, label[r2]))
                        if found is not None:
                            if found[0] in at_rank:
                                at_rank[found[0]].append(r2)
                            else:
                                at_rank[found[0]] = [r2]
                                heapq.heappush(ranks, found[0])
    packed, out = merges.packed, []
    for state in ends:
        run = []
        while state:
            run.append(packed[label[state]])
            state = parent[state]
        run.reverse()
        out.append(b"".join(run))
    return out


class Table:
    """A bounded word table of two generations: entries in use move to the young one,
    and when that is full the old one, unused since, is forgotten."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.long: list[str] = []

    def missing(self, keys: set[str]) -> set[str]:
        rest = keys.difference(self.young)
        again = rest.intersection(self.old)
        self.young.update((k, self.old[k]) for k in again)
        return rest - again

    def add(self, made: dict[str, bytes]) -> None:
        self.young.update(made)
        self.long += [k for k in made if len(k) > TABLE_WORD_CHARS]

    def settle(self) -> None:
        """Between two groups of texts: forget long words, and the old when full."""
        for k in self.long:
            self.young.pop(k, None)
        self.long = []
        if len(self.young) > TABLE_WORDS:
            self.old, self.young = self.young, {}


class Encoder:
    """Text -> ids as little-endian unsigned 32-bit bytes.

    A space before a non-space always starts a pre-split word, so a text is first cut
    there; pieces met before come from a bounded table, only new ones are pre-split."""

    def __init__(self, source: str):
        self.merges = Merges(source)
        self.words, self.pieces = Table(), Table()

    def _learn(self, pieces: set[str]) -> None:
        split = {piece: self.merges.split.findall(piece) for piece in pieces}
        todo = sorted((w.encode(), w) for w in self.words.missing({w for ws in split.values() for w in ws}))
        for at in range(0, len(todo), COMPILE_WORDS):
            part = todo[at:at + COMPILE_WORDS]
            self.words.add(dict(zip((w for _, w in part), compile_words([raw for raw, _ in part], self.merges), strict=True)))
        known = self.words.young.__getitem__
        self.pieces.add({piece: b"".join(map(known, ws)) for piece, ws in split.items()})
        self.words.settle()

    def _cut(self, text: str) -> list[str]:
        """Pieces of a text without special tokens; a piece after the first starts with a space."""
        first, *rest = text.split(" ")
        if all(rest) and not any(map(str.isspace, map(itemgetter(0), rest))):
            return [first, *map(" ".__add__, rest)]
        out = [first]
        for x in rest:
            if x and not x[0].isspace():
                out.append(" " + x)
            else:
                out[-1] += " " + x
        return out

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        m = self.merges
        # a text is a list of parts; every other part is a special token
        parts = [m.around.split(t) if m.around and any(map(t.__contains__, m.special)) else [t] for t in texts]
        cut = [[self._cut(part) for part in ps[::2]] for ps in parts]
        new = self.pieces.missing(set().union(*(c for cs in cut for c in cs)))
        if new:
            self._learn(new)
        known = self.pieces.young.__getitem__
        for ps, cs in zip(parts, cut, strict=True):
            out = []
            for i, pieces in enumerate(cs):
                if i:
                    out.append(m.packed[m.special[ps[2 * i - 1]]])
                out += map(known, pieces)
            yield b"".join(out)
        self.pieces.settle()

    def decode(self, ids: bytes) -> str:
        label = self.merges.label
        return b"".join(map(label.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _encoder(source: str) -> Encoder:
    return Encoder(source)


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about SLICE_BYTES of ``column`` (a longer text is one
    alone), so memory does not depend on how long the texts of a batch are."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // SLICE_BYTES
        edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(a, b - a)


def _with_column(df: DataFrame, name: str, kind: T.DataType, arrow: pa.DataType, read: str, make, vocabulary: str) -> DataFrame:
    """``df`` with column ``name`` last, made from column ``read`` batch by batch. The
    vocabulary (a file of fixed size) travels to the workers once, as a broadcast."""
    source = df.sparkSession.sparkContext.broadcast(vocabulary)
    rest = [c for c in df.columns if c != name]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(name, kind, True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(source.value)
        for batch in slices(batches, read):
            made = pa.array(make(encoder, batch.column(batch.schema.get_field_index(read))), arrow)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, made], names=[*rest, name])

    return df.mapInArrow(run, schema)


def encode_documents(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` plus ``ids``: token ids as little-endian unsigned 32-bit integers (binary).
    Column names must differ from one another."""
    def make(encoder: Encoder, column: pa.Array) -> list[bytes]:
        # the automaton is many small lists without cycles; scanning them for garbage costs a fifth of the time
        gc.disable()
        try:
            return list(encoder.encode_batch([t or "" for t in column.to_pylist()]))
        finally:
            gc.enable()

    return _with_column(df, ids, T.BinaryType(), pa.binary(), text, make, vocabulary)


def decode_documents(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` plus ``text``, decoded from ``ids`` (null ids: empty text)."""
    def make(encoder: Encoder, column: pa.Array) -> list[str]:
        return [encoder.decode(x or b"") for x in column.to_pylist()]

    return _with_column(df, text, T.StringType(), pa.string(), ids, make, vocabulary)
