"""SentencePiece encoding and decoding with weighted finite-state transducers.

Three machines are compiled from a model into state tables.  The normaliser
rewrites the longest rule that matches (the model's own rules, read from its
character map), else copies a character, turns spaces to U+2581 and, where the
model says so, drops repeated ones; it puts a U+2581 in front.  The piece
transducer is a letter tree whose arcs end in piece ids, with byte arcs for
characters that no piece spells.  For BPE models an acceptor of pairs follows.
An input is composed with them, one state for each place in the normalised
text, and the shortest path in the tropical semiring (costs add along a path,
the least path wins) gives the ids: costs are relaxed in topological order.

For a unigram model a piece's cost is its negated score.  A BPE model's scores
only order its merges; there a sequence of pieces is the encoding exactly if
every adjacent pair is left as it is by the merges, so the acceptor gives
legal pairs cost 0 and illegal ones infinite cost.  A prefix has one encoding,
so a place is reached at finite cost by one arc only, and needs one state.

No piece has white space after another character, so the composed machine has
a single state between two words: the best path of a text is the best paths of
its words in turn, and paths of frequent words are kept in a bounded table.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words whose paths a worker keeps in a generation, the longest of them, and
#: the pairs of pieces that it keeps.
KEPT_WORDS, KEPT_LENGTH, KEPT_PAIRS = 400_000, 48, 500_000
INFINITE = float("inf")
#: What stands for a piece at the front, and for a character without one.
FRONT, UNSPELT = -1, -2


@dataclass(frozen=True)
class Model:
    """What a model file says: ``(text, score, kind)`` for each id."""

    pieces: tuple[tuple[str, float, int], ...]
    kind: int = UNIGRAM
    rules: tuple[tuple[str, str], ...] = ()
    dummy_prefix: bool = True
    squeeze: bool = False
    byte_fallback: bool = True


def read_model(path: str = MODEL) -> Model:
    """Read on the driver; raises ValueError for what is not supported."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    norm, train = proto.normalizer_spec, proto.trainer_spec
    if train.model_type not in (UNIGRAM, BPE) or train.treat_whitespace_as_suffix or not norm.escape_whitespaces:
        raise ValueError("only unigram and BPE models with white space as prefix")
    if any(p.type == USER for p in proto.pieces):
        raise ValueError("user-defined pieces are not supported")
    return Model(tuple((p.piece, p.score, p.type) for p in proto.pieces), train.model_type, character_map(norm.precompiled_charsmap), norm.add_dummy_prefix, norm.remove_extra_whitespaces, train.byte_fallback)


def character_map(blob: bytes) -> tuple[tuple[str, str], ...]:
    """The rules ``(text, replacement)`` of a precompiled character map: a
    double-array tree over bytes, whose leaves point into a pool of strings."""
    if not blob:
        return ()
    size = int.from_bytes(blob[:4], "little")
    units, pool = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64), blob[4 + size :]
    below = lambda at: at ^ ((units[at] >> 10) << ((units[at] & 512) >> 6))
    nodes, texts, out = below(np.zeros(1, np.int64)), [b""], []
    letters = np.arange(1, 256)
    while len(nodes):
        child = nodes[:, None] ^ letters
        inside = child < len(units)
        label = units[np.where(inside, child, 0)] & 0x800000FF
        row, col = np.nonzero(inside & (label == letters))
        found = child[row, col]
        texts = [texts[r] + bytes([letters[c]]) for r, c in zip(row, col)]
        nodes = below(found)
        for leaf in np.flatnonzero(units[found] >> 8 & 1):
            at = int(units[nodes[leaf]] & 0x7FFFFFFF)
            out.append((texts[leaf].decode(), pool[at : pool.index(b"\0", at)].decode()))
    return tuple(sorted(out))


class Table:
    """A letter tree as a state table: ``step[state]`` maps a character to the
    next state, ``out[state]`` is what a text that ends there stands for."""

    def __init__(self, entries: Iterable[tuple[str, Any]]) -> None:
        self.step: list[dict[str, int]] = [{}]
        self.out: list[Any] = [None]
        for text, value in entries:
            state = 0
            for c in text:
                following = self.step[state].get(c)
                if following is None:
                    following = self.step[state][c] = len(self.step)
                    self.step.append({})
                    self.out.append(None)
                state = following
            self.out[state] = value

    def longest(self, text: str, at: int) -> tuple[int, Any]:
        """Where the longest match from ``at`` ends, and its output."""
        state, found = 0, (at, None)
        for end in range(at, len(text)):
            state = self.step[state].get(text[end], -1)
            if state < 0:
                break
            if self.out[state] is not None:
                found = (end + 1, self.out[state])
        return found


class Normaliser:
    """The compiled rules; without any, a machine of one state."""

    COPY = {ord(" "): SPACE}
    #: By state (0: no word yet, 1: in a word, 2: spaces after one) and whether
    #: a space is read: the next state and what is written before a character.
    SQUEEZE = (((1, ""), (0, "")), ((1, ""), (2, "")), ((1, SPACE), (2, "")))

    def __init__(self, model: Model) -> None:
        self.table = Table(model.rules) if model.rules else None
        self.squeeze, self.front = model.squeeze, SPACE if model.dummy_prefix else ""

    def rewritten(self, text: str) -> str:
        if self.table is None:
            return text
        at, out = 0, []
        while at < len(text):
            end, new = self.table.longest(text, at)
            out.append(text[at] if new is None else new)
            at = at + 1 if new is None else end
        return "".join(out)

    def __call__(self, text: str) -> str:
        text = self.rewritten(text)
        if self.squeeze:
            state, out = 0, []
            for c in text:
                state, before = self.SQUEEZE[state][c == " "]
                out.append(before if c == " " else before + c)
            text = "".join(out)
        return self.front + text.translate(self.COPY) if text else ""


class Paths(dict):
    """Paths of words met; of two generations the older one goes when the
    younger is full, so memory is bounded and frequent words stay."""

    def __init__(self, find) -> None:
        super().__init__()
        self.find, self.older = find, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.find(word)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


class Transducer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.score = {text: score for text, score, kind in model.pieces if kind == NORMAL and text}
        self.text = [t for t, _, _ in model.pieces]
        self.bytes = {int(t[3:5], 16): i for i, (t, _, k) in enumerate(model.pieces) if k == BYTE}
        self.unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), 0)
        self.unknown_cost = 10.0 - min(self.score.values(), default=0.0)
        self.pieces = Table((text, i) for i, (text, _, kind) in enumerate(model.pieces) if kind == NORMAL and text)
        self.cost = [-score if model.kind == UNIGRAM else 0.0 for _, score, _ in model.pieces]
        self.normalise = Normaliser(model)
        self.simple = not model.rules and model.dummy_prefix and not model.squeeze
        joined = set("".join(t for t in self.score if len(t) > 1))
        if any(SPACE in t.lstrip(SPACE) for t in self.score):
            raise ValueError("pieces with inner white space are not supported")
        # such a character is a word of its own: no piece joins it to another
        alone = "".join(c for c in map(chr, range(32)) if c not in joined)
        one = f"[{re.escape(alone)}]|" if alone else ""
        self.split = re.compile(f"{one}{SPACE}*[^{SPACE}{re.escape(alone)}]+|{SPACE}+").findall
        self.pairs: dict[int, bool] = {}
        self.spine_of: dict[int, tuple[list, list, bool]] = {}
        self.paths = Paths(lambda word: self.path(SPACE + word))

    def merged(self, text: str) -> list[str]:
        """What the merges leave of a short text: best score first, then left."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def accepts(self, last: int, piece: int) -> bool:
        """The acceptor's arc from one piece to the next, made when first
        needed: whether the merges leave the pair as it is."""
        if last < 0:  # at the front, or after a character that no merge joins
            return self.spines(piece)[2]
        found = self.pairs.get(last << 24 | piece)
        if found is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            found = self.pairs[last << 24 | piece] = self.pair_stays(last, piece)
        return found

    def shortest_path(self, word: str) -> list[int]:
        """Ids along the least path through one normalised word; ties: the
        path whose last piece is longest."""
        step, out, weight = self.pieces.step, self.pieces.out, self.cost
        bpe, n = self.model.kind == BPE, len(word)
        cost = [0.0] + [INFINITE] * n
        last, back = [FRONT] * (n + 1), [0] * (n + 1)  # the piece that reaches a state, and from where
        for at in range(n):
            base = cost[at]
            if base == INFINITE:
                continue
            state, before, spelt = 0, last[at], False
            for end in range(at, n):
                state = step[state].get(word[end], -1)
                if state < 0:
                    break
                piece = out[state]
                if piece is None:
                    continue
                spelt = spelt or end == at
                to = end + 1
                if base + weight[piece] < cost[to] and (not bpe or self.accepts(before, piece)):
                    cost[to], last[to], back[to] = base + weight[piece], piece, at
            if not spelt and base + self.unknown_cost < cost[at + 1]:
                cost[at + 1], last[at + 1], back[at + 1] = base + self.unknown_cost, UNSPELT, at
        if cost[n] == INFINITE:  # merges of equal score: no pair of pieces tells which comes first
            return [i for t in self.merged(word) for i in self._ids(t)]
        found, at = [], n
        while at:
            found.append((last[at],) if last[at] >= 0 else self._ids(word[back[at]]))
            at = back[at]
        return [i for ids in reversed(found) for i in ids]

    def _ids(self, text: str) -> tuple[int, ...]:
        piece = self.pieces.longest(text, 0)
        if piece[0] == len(text):
            return (piece[1],)
        return tuple(self.bytes[b] for b in text.encode("utf-8", "replace")) if self.model.byte_fallback else (self.unknown,)

    def spines(self, i: int) -> tuple[list, list, bool]:
        """How the merges build a piece: its last symbols in turn, each with
        the score of the merge that ends it, its first symbols alike, and
        whether they do build it."""
        found = self.spine_of.get(i)
        if found is None:
            parts, score = list(self.text[i]), self.score
            right, left = [], []
            while len(parts) > 1:
                s, at = max(((score[x + y], -k) for k, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in score), default=(None, 0))
                if s is None:
                    break
                at = -at
                if at == len(parts) - 2:
                    right.append((parts[-1], s))
                if at == 0:
                    left.append((parts[0], s))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            right.append((parts[-1], -INFINITE))
            left.append((parts[0], -INFINITE))
            found = self.spine_of[i] = (right, left, len(parts) == 1)
        return found

    def pair_stays(self, i: int, j: int) -> bool:
        """By spines: a merge across the pair happens if it comes
        before the merges that end the two symbols it joins (of equal ones the
        left comes first).  Where scores tie (runs of white space), by merging."""
        if self.text[i][-1] == SPACE:
            a, b = self.text[i], self.text[j]
            return self.merged(a + b) == [a, b]
        right, _, a_whole = self.spines(i)
        _, left, b_whole = self.spines(j)
        get = self.score.get
        for x, x_ends in right:
            for y, y_ends in left:
                s = get(x + y)
                if s is not None and s > x_ends and s >= y_ends:
                    return False
        return a_whole and b_whole

    def path(self, text: str) -> bytes:
        """The path through one word or, where a character stands alone, some."""
        return array("i", [i for word in self.split(text) for i in self.shortest_path(word)]).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        text = text or ""
        if self.simple and text and SPACE not in text and "  " not in text and text[0] != " " != text[-1]:
            return np.frombuffer(b"".join(map(self.paths.__getitem__, text.split(" "))), "<i4")
        words = self.split(self.normalise(text))
        return np.frombuffer(b"".join(self.paths[w[1:]] if w[0] == SPACE != w[-1] and w[1] != SPACE else self.path(w) for w in words), "<i4")

    def spoken(self, text: str | None) -> str:
        """What decoding gives back: the normalised text, with spaces again."""
        if self.simple:
            return text or ""
        text = self.normalise(text or "").replace(SPACE, " ")
        return text[1:] if self.model.dummy_prefix else text

    def outputs(self) -> list[bytes]:
        """The decoder's output for each id."""
        kinds = {CONTROL: lambda t: b"", BYTE: lambda t: bytes([int(t[3:5], 16)]), UNKNOWN: lambda t: " ⁇ ".encode()}
        return [kinds.get(k, lambda t: t.replace(SPACE, " ").encode())(t) for t, _, k in self.model.pieces]

    def decode(self, ids: np.ndarray, outputs: list[bytes]) -> str:
        text = b"".join(map(outputs.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64)))
    values = np.concatenate(parts).astype(np.int32) if parts else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, pa.int32()))


def _shared(df: DataFrame, model: Model | None) -> Broadcast:
    """The model as plain values, of the vocabulary's size."""
    return df.sparkSession.sparkContext.broadcast({"model": asdict(model or read_model())})


def _machine(shared: dict) -> tuple[Transducer, list[bytes]]:
    """Compiled once for each Python worker: its tasks share the copy of the
    broadcast value, and with it the paths of frequent words."""
    if "machine" not in shared:
        t = Transducer(Model(**shared["model"]))
        shared["machine"] = (t, t.outputs())
    return shared["machine"]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids, round_trip`` for each row: the text's piece
    ids, and whether decoding them gives the normalised text back (it does
    unless a text itself has U+2581, or a character no piece or byte spells).

    A null or empty text has no ids and round_trip true; repeated rows repeat;
    an empty table gives no rows; other columns are ignored.
    """
    machine = _shared(docs, model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, outputs = _machine(machine.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                ids = [t.encode(x) for x in texts]
                same = [t.decode(i, outputs) == t.spoken(x) for i, x in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(i) for i in ids], pa.int32()), _lists(ids), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, n_tokens int, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: Model | None = None) -> DataFrame:
    """``doc_id, text`` of each row's ids; null ids decode to an empty text."""
    machine = _shared(encoded, model)
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, outputs = _machine(machine.value)
        for batch in batches:
            texts = [t.decode(np.array(x or [], np.int64), outputs) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {id_type}, text string")
