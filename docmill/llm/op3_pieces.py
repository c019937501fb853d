"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The normaliser (word mark for blanks, dummy prefix), the pieces and the byte
fallback of a model file are compiled to transducers; each input is composed with
them, lazily, and the path of least weight in the tropical semiring (weights add
along a path, the least path wins) gives the ids.

For a unigram model a piece weighs minus its log probability. For a merge (BPE)
model no weight per piece reproduces the merges, so the states carry the last piece
and an arc to the next one weighs 0 if merging leaves the two apart, else infinity.
Merges never cross a boundary exactly if each pair of neighbours stays apart by
itself, so the one path of finite weight is the model's own encoding.

The model is broadcast (its size is fixed) and compiled once per worker, which keeps
the paths of words it has met; nothing but the driver reads the file.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


MODEL = "/opt/tokenizers/piece_bpe_32k.model"
# Fixed values of the model format.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
MEMO = 1 << 19


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value, at, shift = value | (byte & 127) << shift, at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of one message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        width = {1: 8, 5: 4}.get(key & 7)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            if width is None:
                width, at = _varint(data, at)
            value, at = data[at:at + width], at + width
        yield key >> 3, value


class Transducer:
    """Tables compiled from a model file's bytes."""

    def __init__(self, model: bytes):
        pieces, self.kind, norm = [], UNIGRAM, {}
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0" * 4))[0], piece.get(3, NORMAL)))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                norm = dict(_fields(value))
        if norm.get(2) or self.kind not in (UNIGRAM, BPE) or any(k == USER for _, _, k in pieces):
            raise ValueError("models with a character map or user-defined pieces aren't supported")
        self.prefix, self.squeeze = norm.get(3, 1), norm.get(4, 1)
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.weights = [-s for _, s, _ in pieces]
        self.names = [p for p, _, _ in pieces]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        if len(self.bytes) < 256:
            raise ValueError("the model has no byte fallback")
        self.letters = {p for p in self.ids if len(p) == 1}
        # nodes: the piece that ends here or -1, and the arcs by letter
        self.trie: list = [-1, {}]
        for name, i in self.ids.items():
            node = self.trie
            for c in name:
                node = node[1].setdefault(c, [-1, {}])
            node[0] = i
        self.output = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() if k == NORMAL
                       else b"" for p, _, k in pieces]
        inner = {c for p in self.ids if len(p) > 1 for c in p}
        # no piece goes on from another character to a word mark: words are independent
        split = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        alone = "\n" if "\n" not in inner else ""
        self.words = re.compile(
            f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + ("|\n" if alone else "") if split else "(?s).+")
        self.worst = max(self.weights[i] for i in self.ids.values()) + 10 if self.ids else 10
        self.apart: dict[int, float] = {}
        self.schedules: dict[int, list | None] = {}

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        text = text.replace(" ", SPACE)
        return SPACE + text if text and self.prefix else text

    def schedule(self, piece: int) -> list[tuple[float, str, str]] | None:
        """Merges that build a piece from its letters: weight, first and last part after it.

        Starts with the letters themselves; None if merging gives something else.
        """
        parts, weights = list(self.names[piece]), self.weights
        out = [(0.0, parts[0], parts[-1])]
        while len(parts) > 1:
            best, at = math.inf, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and weights[i] < best:
                    best, at = weights[i], k
            if at < 0:
                return None
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            out.append((best, parts[0], parts[-1]))
        return out

    def stays_apart(self, last: int, piece: int) -> bool:
        """Whether merging the letters of both pieces ends with the two of them.

        Each side merges by its own schedule, the better weight first (left on ties),
        until a merge across the boundary would come before both next ones.
        """
        sides = []
        for p in (last, piece):
            if p >= 0 and p not in self.schedules:
                self.schedules[p] = self.schedule(p)
            sides.append(self.schedules[p] if p >= 0 else None)
        left, right = sides
        if right is None or last >= 0 and left is None:
            return False
        if last < 0:
            return True
        x = y = 0
        while True:
            next_left = left[x + 1][0] if x + 1 < len(left) else math.inf
            next_right = right[y + 1][0] if y + 1 < len(right) else math.inf
            across = self.ids.get(left[x][2] + right[y][1])
            if across is not None and self.weights[across] < next_left and self.weights[across] <= next_right:
                return False
            if next_left == next_right == math.inf:
                return True
            if next_left <= next_right:
                x += 1
            else:
                y += 1

    def arc(self, last: int, piece: int) -> float:
        """Weight of an arc that emits ``piece`` from the state ``last`` (-1: none or a byte)."""
        if self.kind == UNIGRAM:
            return self.weights[piece]
        key = last * len(self.names) + piece
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) > MEMO:
                self.apart.clear()
            known = self.apart[key] = 0.0 if self.stays_apart(last, piece) else math.inf
        return known

    def shortest(self, word: str) -> list[int]:
        """Ids on the least path through one normalised word."""
        places = self.finite(word) if self.kind == BPE else self.least(word)
        out: list[int] = []
        for i, piece in places:
            if piece >= 0:
                out.append(piece)
            else:
                out += [self.bytes[b] for b in word[i].encode("utf-8", "replace")]
        return out

    def least(self, word: str) -> list[tuple[int, int]]:
        """Places and pieces (-1: bytes) of the least path, by forward relaxation."""
        n = len(word)
        weight, state, came = [math.inf] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        weight[0] = 0.0
        for i in range(n):
            here, last, node = weight[i], state[i], self.trie
            if here == math.inf:
                continue
            for j in range(i, n):
                node = node[1].get(word[j])
                if node is None:
                    break
                if node[0] >= 0 and (total := here + self.arc(last, node[0])) < weight[j + 1]:
                    weight[j + 1], state[j + 1], came[j + 1] = total, node[0], i
            if word[i] not in self.letters and here + self.worst < weight[i + 1]:
                weight[i + 1], state[i + 1], came[i + 1] = here + self.worst, -1, i
        out = []
        while n > 0:
            out.append((came[n], state[n]))
            n = came[n]
        return out[::-1]

    def finite(self, word: str) -> list[tuple[int, int]]:
        """The one path of finite weight, depth first, the longest arcs first.

        At most one finite path leads to each place, so a place from which none goes
        on is closed for good, and the search is linear in the arcs.
        """
        n, root, names, known = len(word), self.trie, len(self.names), self.apart.get
        closed: set[int] = set()
        path: list[tuple[int, int, list]] = []   # place, piece, shorter arcs
        i, last = 0, -1
        arcs = None
        while i < n:
            if arcs is None:
                arcs, node = [], root
                for j in range(i, n):
                    node = node[1].get(word[j])
                    if node is None:
                        break
                    if node[0] >= 0:
                        arcs.append((j + 1, node[0]))
                if not arcs and word[i] not in self.letters:
                    arcs.append((i + 1, -1))
            base = last * names
            while arcs:
                end, piece = arcs.pop()
                if end in closed:
                    continue
                if piece >= 0:
                    arc = known(base + piece)
                    if (self.arc(last, piece) if arc is None else arc) != 0.0:
                        continue
                path.append((i, piece, arcs))
                i, last, arcs = end, piece, None
                break
            else:
                closed.add(i)
                i, _, arcs = path.pop()
                last = path[-1][1] if path else -1
        return [(i, piece) for i, piece, _ in path]

    def encode(self, text: str, memo: dict[str, list[int]]) -> list[int]:
        out: list[int] = []
        for word in self.words.findall(self.normalise(text)):
            ids = memo.get(word)
            if ids is None:
                ids = self.shortest(word)
                if len(word) <= 32:
                    if len(memo) > MEMO:
                        memo.clear()
                    memo[word] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.output.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def load(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def compiled(holder: dict) -> tuple[Transducer, dict[str, list[int]]]:
    """The transducer of the broadcast model and its memo, kept while the worker lives."""
    if "transducer" not in holder:
        holder["transducer"], holder["memo"] = Transducer(holder["model"]), {}
    return holder["transducer"], holder["memo"]


def _encoded(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer, memo = compiled(model.value)

        def emit(batch, first, ids, ends, exact):
            values = pa.ListArray.from_arrays(pa.array(np.array([0, *ends], np.int32)), pa.array(np.array(ids, np.int32)))
            columns = [batch.column(0).slice(first, len(ends)), values, pa.array(exact, pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "exact"])

        for batch in batches:
            first, ids, ends, exact = 0, [], [], []
            for k, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                own = transducer.encode(text, memo)
                exact.append(transducer.decode(own) == text)
                ids += own
                ends.append(len(ids))
                if len(ids) > 1 << 19:
                    yield emit(batch, first, ids, ends, exact)
                    first, ids, ends, exact = k + 1, [], [], []
            if ends:
                yield emit(batch, first, ids, ends, exact)
    return run


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """``doc_id, ids, n_tokens, exact``, one row per row of ``docs``, whole texts.

    ``exact``: decoding the ids gives the text back (a text that holds the word mark
    itself doesn't). Null and empty texts have no ids. Other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast({"model": load(path)})
    return rows.mapInArrow(_encoded(model), f"doc_id {kind}, ids array<int>, exact boolean").select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "exact")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids are empty, unknown ids are an error."""
    model = encoded.sparkSession.sparkContext.broadcast({"model": load(path)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = compiled(model.value)[0]
        for batch in batches:
            texts = [transducer.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
