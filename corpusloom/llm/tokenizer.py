"""Problem 8: encoding with a public byte-level BPE by a tokenization automaton.

Compilation. The automaton starts as the loop that reads any byte. Each merge
(u, v) at time t adds one gadget: the state reached by u loses its arc v, and the new
token uv, which inherits u's arcs as an incoming label and v's state as a target,
gets a state of its own as soon as a later merge uses it on the left. So a state is
a token, and the arc w leaves the state of t unless a gadget (y, x) removed it, where
y lies on the right spine of t, x on the left spine of w, and the gadget's time lies
before the times at which y and x disappeared into their parents (at x's own time the
merge further left comes first). Every arc is
therefore decided by the gadget table alone; decided arcs are kept in a transition
table, so that hot words never decide one twice.

Encoding. A text is cut before each run of white space, which no token ever spans,
so each piece is encoded on its own and the piece table serves repeated words.
A new piece is split by the tokenizer's published pattern; each word is read by
walking the automaton over byte positions: position k carries the one token that ends
there and whose arc leaves the state at its start. Decoding emits the arc labels.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of the tokenizer files.
TOKENIZER_DIR = os.environ.get("CORPUSLOOM_TOKENIZERS", "/opt/tokenizers")

# White space as the published pattern understands it (the Unicode property White_Space).
WHITE_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Fixed value: the published word pattern with white space spelt out.
WORD_PATTERN = (
    "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+"
    f"| ?[^{WHITE_SPACE}\\p{{L}}\\p{{N}}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+"
)
PIECE = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")

#: Entries of the piece table of one Python worker; a full table is emptied.
PIECES = 400_000

#: Decided arcs that one Python worker keeps; a full table is emptied.
ARCS = 2_000_000

NEVER = 1 << 30


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level BPE files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in set(shown)]
    table.update({chr(256 + i): b for i, b in enumerate(hidden)})
    return table


class MergeAutomaton:
    """Deterministic automaton over tokens, compiled merge by merge."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.ids = vocab
        self.longest = max(map(len, vocab), default=1)
        self.label = {i: t for t, i in vocab.items()}
        self.born: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.gadget: dict[tuple[int, int], int] = {}
        for time, (u, v) in enumerate(merges):
            self._add(time, vocab[u], vocab[v], vocab[u + v])
        self.arcs: dict[tuple[int, int], bool] = {}
        self.prefixes = {t[:k] for t in vocab for k in range(1, len(t) + 1)}

    def _add(self, time: int, u: int, v: int, uv: int) -> None:
        self.gadget[u, v] = time
        if uv not in self.parts:
            self.parts[uv] = (u, v)
            self.born[uv] = time

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token, time until which it stands on this side) from the outside in."""
        out, until = [], NEVER
        while True:
            out.append((token, until))
            parts = self.parts.get(token)
            if parts is None:
                return out
            until = self.born[token]
            token = parts[side]

    def arc(self, state: int, token: int) -> bool:
        """Whether ``token`` may follow the state reached by the token ``state``."""
        key = (state, token)
        known = self.arcs.get(key)
        if known is None:
            gadget = self.gadget
            right, left = self._spine(state, 1), self._spine(token, 0)
            known = True
            for y, y_until in right:
                for x, x_until in left:
                    time = gadget.get((y, x))
                    if time is not None and time < y_until and time <= x_until:
                        known = False
                        break
                if not known:
                    break
            if len(self.arcs) >= ARCS:
                self.arcs.clear()
            self.arcs[key] = known
        return known

    def word(self, data: bytes) -> list[int]:
        """Token ids of one word of the pre-split; a word that is a token is that token, as ``closed`` makes sure."""
        whole = self.ids.get(data)
        return [whole] if whole is not None else self.walk(data)

    def closed(self) -> bool:
        """Whether the automaton reads every token that merges make as itself."""
        return all(self.walk(self.label[t]) == [t] for t in self.parts)

    def walk(self, data: bytes) -> list[int]:
        n = len(data)
        ends: list[tuple[int, int] | None] = [None] * (n + 1)
        ids, arc, prefixes = self.ids, self.arc, self.prefixes
        for j in range(n):
            if j and ends[j] is None:
                continue
            state = ends[j][0] if j else -1
            for k in range(j + 1, min(n, j + self.longest) + 1):
                part = data[j:k]
                if part not in prefixes:
                    break
                if ends[k] is None:
                    token = ids.get(part)
                    if token is not None and (j == 0 or arc(state, token)):
                        ends[k] = (token, j)
        out, k = [], n
        while k:
            token, k = ends[k]
            out.append(token)
        return out[::-1]


class Encoder:
    """Texts to ids, with a bounded table of pieces already encoded."""

    def __init__(self, source: bytes):
        import regex

        model = json.loads(source)["model"]
        alphabet = byte_alphabet()
        raw = lambda shown: bytes(alphabet[c] for c in shown)
        special = {t["content"] for t in json.loads(source).get("added_tokens", ())}
        vocab = {raw(t): i for t, i in model["vocab"].items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.automaton = MergeAutomaton(vocab, [(raw(a), raw(b)) for a, b in merges])
        self.split = regex.compile(WORD_PATTERN).findall
        self.pieces: dict[str, array] = {}

    def _piece(self, piece: str) -> array:
        ids = array("i")
        for word in self.split(piece):
            ids.extend(self.automaton.word(word.encode("utf-8", "replace")))
        if len(self.pieces) >= PIECES:
            self.pieces.clear()
        if len(piece) <= 64:
            self.pieces[piece] = ids
        return ids

    def encode_into(self, text: str, out: array) -> None:
        known, new = self.pieces.get, self._piece
        for piece in PIECE.findall(text):
            out.extend(known(piece) or new(piece))

    def encode(self, text: str) -> list[int]:
        out = array("i")
        self.encode_into(text, out)
        return out.tolist()

    def count(self, text: str) -> int:
        known, new = self.pieces.get, self._piece
        return sum([len(known(piece) or new(piece)) for piece in PIECE.findall(text)])

    def decode(self, ids) -> str:
        label = self.automaton.label
        return b"".join([label[i] for i in ids]).decode("utf-8", "replace")


_encoders: dict[int, Encoder] = {}


def encoder_of(source) -> Encoder:
    """The worker's encoder for a broadcast tokenizer file; compiled once per Python worker."""
    data = source.value if hasattr(source, "value") else source
    key = hash(data)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(data)
    return _encoders[key]


def tokenizer_file(name: str, folder: str | None = None) -> bytes:
    with open(os.path.join(folder or TOKENIZER_DIR, f"{name}.json"), "rb") as f:
        return f.read()


_closed: set[int] = set()


def broadcast_tokenizer(spark: SparkSession, name: str, folder: str | None = None):
    """The file (1.5 MB, fixed) for all executors, read once on the driver, which also makes sure once that its tokens are read as themselves."""
    data = tokenizer_file(name, folder)
    if hash(data) not in _closed:
        if not Encoder(data).automaton.closed():
            raise ValueError(f"{name}: a token that its own merges do not make")
        _closed.add(hash(data))
    return spark.sparkContext.broadcast(data)


def encode_ids(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, ids) of every row, without special tokens.

    Null and empty texts give an empty list; white space and control characters are
    encoded like any text. Other columns are not read. One pass, no shuffle.
    """
    source = broadcast_tokenizer(df.sparkSession, tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(source)
        for batch in batches:
            flat, offsets = array("i"), array("i", [0])
            for value in batch.column(1).to_pylist():
                if value:
                    encoder.encode_into(value, flat)
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(memoryview(offsets), pa.int32()), pa.array(memoryview(flat), pa.int32()) if len(flat) else pa.array([], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, keys: list[str], text: str, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``keys`` and ``n_tokens`` of every row; null and empty texts count 0."""
    source = broadcast_tokenizer(df.sparkSession, tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(source)
        for batch in batches:
            counts = [encoder.count(v) if v else 0 for v in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), pa.array(counts, pa.int64())], names=[*keys, "n_tokens"])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*[F.col(f"`{k}`").alias(k) for k in keys], F.col(f"`{text}`").alias("_text")).mapInArrow(run, f"{kinds}, n_tokens bigint")


def decode_ids(df: DataFrame, key: str, ids: str, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, text): the arc labels of each list of ids; null lists give null."""
    source = broadcast_tokenizer(df.sparkSession, tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(source)
        for batch in batches:
            texts = [None if v is None else encoder.decode(v) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(f"`{key}`").alias(key), F.col(f"`{ids}`").alias("ids")).mapInArrow(run, f"`{key}` {kind}, text string")
