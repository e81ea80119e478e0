"""SentencePiece encoding and decoding by weighted finite-state transduction.

Three machines are compiled from a public model and composed lazily with each input:

* the normaliser: the dummy prefix, and a space to the space mark (PieceModel.prepare);
* the piece transducer: a trie of pieces whose leaves return to the start and emit an id,
  and arcs that emit the UTF-8 byte ids of a character that no piece holds;
* for BPE models the neighbour acceptor, whose state is the last id: an arc has weight 0
  if merging the two pieces' characters by score gives exactly these two, else infinity.
  A merge that crosses a border in a longer text would also cross it in the pair alone, so
  the finite path is the library's BPE result. For unigram models the arcs have weight -score.

The answer is the shortest path in the tropical semiring. Where no piece joins two
neighbouring characters every path passes one state, so the input is cut there and the
parts' paths are kept in a bounded cache. Decoding runs the piece transducer backwards.

Edge cases: null texts encode as empty texts do, to no ids, and decode to an empty text. A literal space mark
decodes as a space, as the library's does. Repeated rows give a row each; an empty table
gives none. A text is held whole in its worker and cut into parts before paths are sought,
so no length is too great. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped
from .pieces import SPACE, STAGE_BYTES, Cache, PieceModel, encoded, model, sized_batches

MODEL = "piece_bpe_32k.model"
#: Neighbour pairs and parts that a worker keeps; and in a stage of a pipeline, whose executors hold much else.
PAIR_ENTRIES, MEMO = 500_000, 250_000
STAGE_PAIRS, STAGE_MEMO = 200_000, 80_000
UNKNOWN = -1


class Transducer:
    def __init__(self, pieces: PieceModel, pair_entries: int = PAIR_ENTRIES):
        self.pieces = pieces
        self.root: dict = {}
        for piece, i in pieces.ids.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i
        self.pair_ok: dict[int, bool] = {}
        self.pair_entries = pair_entries
        self.surface = {i: p.replace(SPACE, " ").encode() for i, p in pieces.text.items()} | {i: bytes([b]) for i, b in pieces.byte_of.items()}

    # -- the neighbour acceptor -------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """Characters merged by best score, leftmost first, while a merge is a piece."""
        ids, scores, parts = self.pieces.ids, self.pieces.scores, list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                j = ids.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or scores[j] > best):
                    best, at = scores[j], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def joins(self, left: int, right: int) -> bool:
        key = left << 32 | right
        ok = self.pair_ok.get(key)
        if ok is None:
            a, b = self.pieces.text[left], self.pieces.text[right]
            ok = (a[-1] + b[0]) not in self.pieces.pairs or self.merged(a + b) == [a, b]
            if len(self.pair_ok) >= self.pair_entries:
                self.pair_ok.clear()
            self.pair_ok[key] = ok
        return ok

    def stands(self, piece: int) -> bool:
        """Whether merging a piece's own characters gives the piece."""
        key = piece << 32 | 0xFFFFFFFF
        ok = self.pair_ok.get(key)
        if ok is None:
            text = self.pieces.text[piece]
            ok = self.pair_ok[key] = self.merged(text) == [text]
        return ok

    # -- composition and shortest path -------------------------------------------------

    def arcs(self, token: str, i: int) -> list[tuple[int, int]]:
        """(end, id) of the pieces that start at i, longest first; UNKNOWN for a character that no piece holds."""
        node, j, n, out = self.root.get(token[i]), i + 1, len(token), []
        if node is None:
            return [(j, UNKNOWN)]
        while True:
            piece = node.get("")
            if piece is not None:
                out.append((j, piece))
            node = node.get(token[j]) if j < n else None
            if node is None:
                out.reverse()
                return out
            j += 1

    def path(self, token: str) -> list[int]:
        out: list[int] = []
        at = 0
        for end, piece in self._unigram(token) if self.pieces.unigram else self._bpe(token):
            out += [piece] if piece != UNKNOWN else [self.pieces.byte_id[b] for b in token[at:end].encode()]
            at = end
        return out

    def _bpe(self, token: str) -> list[tuple[int, int]]:
        """The arcs of the path of weight 0: depth first through the states (place, last id), each entered once."""
        n, joins, closed = len(token), self.joins, set()
        held, at, last = [], 0, UNKNOWN
        stack = [iter(self.arcs(token, 0))]
        while True:
            for end, piece in stack[-1]:
                if (end, piece) in closed:
                    continue
                if (end < n or self.stands(piece)) if at == 0 and piece != UNKNOWN else last == UNKNOWN or piece == UNKNOWN or joins(last, piece):
                    closed.add((end, piece))
                    held.append((end, piece))
                    if end == n:
                        return held
                    at, last = end, piece
                    stack.append(iter(self.arcs(token, end)))
                    break
            else:
                stack.pop()
                held.pop()
                at, last = held[-1] if held else (0, UNKNOWN)

    def _unigram(self, token: str) -> list[tuple[int, int]]:
        """The arcs of the path of least weight, by relaxing the positions in order."""
        scores, n = self.pieces.scores, len(token)
        unknown = 10.0 - min(scores.values(), default=0.0)
        best: list = [(0.0, 0, UNKNOWN)] + [None] * n
        for i in range(n):
            if best[i] is not None:
                for end, piece in self.arcs(token, i):
                    total = best[i][0] + (unknown if piece == UNKNOWN else -scores[piece])
                    if best[end] is None or total < best[end][0]:
                        best[end] = (total, i, piece)
        out = []
        while n:
            out.append((n, best[n][2]))
            n = best[n][1]
        return out[::-1]

    # -- texts ---------------------------------------------------------------------------

    def decode(self, ids) -> str:
        """The text of ids; a leading space, the dummy prefix, is dropped."""
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=1)
def machine(path: str, pair_entries: int = PAIR_ENTRIES, memo: int = MEMO) -> tuple[Transducer, Cache]:
    t = Transducer(model(path), pair_entries)
    width = "<u2" if len(t.surface) < 1 << 16 else "<u4"
    return t, Cache(t.pieces, lambda token: np.array(t.path(token), width).tobytes(), b"".join, entries=memo)


def ids_of(path: str, texts: list[str], *sizes: int) -> list[np.ndarray]:
    t, cache = machine(path, *sizes)
    cache.claim()
    ids, ends = encoded([t.pieces.prepare(x) for x in texts], cache.all, "<u2" if len(t.surface) < 1 << 16 else "<u4")
    return np.split(ids.astype("<i4"), ends[1:-1])


def _columns(path: str, doc_ids, texts: list[str], *sizes: int) -> list:
    """doc_id, ids, n_tokens, ids_crc32 and the decoded texts (a list)."""
    t, _ = machine(path, *sizes)
    rows = ids_of(path, texts, *sizes)
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.empty(0, "<i4")])))
    crc = pa.array([zlib.crc32(r.tobytes()) for r in rows], pa.int64())
    return [doc_ids, ids, pa.array(np.diff(ends), pa.int64()), crc, [t.decode(r.tolist()) for r in rows]]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, n_tokens, ids_crc32 (of ids as little-endian u32), decoded (the text of the ids)."""

    def run(batches):
        for batch in sized_batches(batches, 1, STAGE_BYTES):
            *columns, back = _columns(path, batch.column(0), [x or "" for x in batch.column(1).to_pylist()], STAGE_PAIRS, STAGE_MEMO)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(back, pa.string())], names=["doc_id", "ids", "n_tokens", "ids_crc32", "decoded"])

    return mapped(docs.select("doc_id", "text"), run, "doc_id bigint, ids array<int>, n_tokens bigint, ids_crc32 bigint, decoded string", True)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """The ids and their digests, with what decoding gives, hashed: equal to the text's own hash when it is lossless."""

    def run(batches):
        for batch in sized_batches(batches, 1):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            *columns, back = _columns(path, batch.column(0), texts)
            hashes = pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back], pa.string())
            same = pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*columns, hashes, same], names=["doc_id", "ids", "n_tokens", "ids_crc32", "decoded_sha256", "lossless"])

    return mapped(docs.select("doc_id", "text"), run, "doc_id bigint, ids array<int>, n_tokens bigint, ids_crc32 bigint, decoded_sha256 string, lossless boolean", True)
