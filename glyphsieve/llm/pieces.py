"""Exact piece-wise access to a public SentencePiece model.

No piece of the vocabulary holds certain neighbouring characters; no merge or path can
then join them, so a text falls apart there and its pre-tokens can be encoded once and
kept. `PieceModel.prepare` cuts at spaces and line feeds, `PieceModel.factors` at every
other pair that occurs in no piece. Both are exact for identity normalisers with a dummy
prefix; a model with another normaliser is refused.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow.compute import binary_length
from pyarrow.compute import split_pattern as pc_split

SPACE = "▁"
#: Entries a worker keeps before it starts anew, and the longest pre-token that is kept.
CACHE_ENTRIES, CACHE_CHARS = 150_000, 48
#: Pre-tokens that are encoded in one go, those of them that make one text for the library, and the characters from which on one is factored instead.
MANY, LINES, LONG_CHARS = 8192, 64, 1024
_RUNS = re.compile(" {2,}")
#: Signs that end words, and one of them after anything but a letter or digit of Latin-1.
_STOPS = ".,"
_ODD_STOP = re.compile("[.,](?<![0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff][.,])")


@lru_cache(maxsize=2)
def model(path: str) -> "PieceModel":
    return PieceModel(path)


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.path = path
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only identity normalisers with a dummy prefix are supported")
        kinds = type(proto.pieces[0])
        self.unigram = proto.trainer_spec.model_type == 1
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.scores = {i: proto.pieces[i].score for i in self.ids.values()}
        self.text = {i: p for p, i in self.ids.items()}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        # A stop can be cut off after letters if no piece has the two side by side.
        self.stops = not any(p[1] in _STOPS and p[0].isalnum() and p[0] < "\u0100" for p in self.pairs)
        if any("\n" in p or p.find(SPACE, len(p) - len(p.lstrip(SPACE))) >= 0 for p in self.ids):
            raise ValueError("a piece crosses a space or line feed")

    def prepare(self, text: str) -> str:
        """The pre-tokens, parted by spaces: an optional run of the space mark and what follows, or a line feed; '' may occur and means nothing."""
        if not text:
            return ""
        text = text.replace(SPACE, " ") if SPACE in text else text
        if "  " in text or text[0] == " ":
            # Marks of a run stay together with the word after it.
            text = _RUNS.sub(lambda m: " " + SPACE * (len(m[0]) - 1), " " + text)
            return text.replace(" ", " " + SPACE).replace("\n", " \n ")
        text = text.replace(" ", " " + SPACE).replace("\n", " \n ")
        if self.stops and not _ODD_STOP.search(text):
            text = text.replace(".", " .").replace(",", " ,")
        return SPACE + text

    def factors(self, token: str) -> list[str]:
        """A pre-token cut at each pair of characters that no piece holds."""
        pairs, out, at = self.pairs, [], 0
        for i in range(1, len(token)):
            if token[i - 1 : i + 1] not in pairs:
                out.append(token[at:i])
                at = i
        out.append(token[at:])
        return out

    def encode(self, token: str) -> list[int]:
        """The library's ids of a pre-token, without the dummy prefix that it adds to texts."""
        if token[0] == SPACE:
            return self.library.encode(token[1:].replace(SPACE, " ")) if len(token) > 1 else [self.ids[SPACE]]
        return self.library.encode("\n" + token)[2:]

    def encode_many(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens that hold no line feed, with a line feed's before each, and the places of those and the end.

        Many are lines of one text, since no piece crosses a line feed. Where that has no id of its own, and in
        unigram models, whose sums of scores would be rounded otherwise, each is encoded alone.
        """
        feed = self.byte_id.get(10, -1)
        if feed < 0 or self.unigram:
            found = [np.array([feed, *(self.encode(t) if t else [])], np.int32) for t in tokens]
            places = np.cumsum([0, *map(len, found)])
            return np.concatenate([*found, np.empty(0, np.int32)]), places
        found = [np.array(self.library.encode("\n" + "\n".join(tokens[i : i + LINES])), np.int32)[1:] for i in range(0, len(tokens), LINES)]
        ids = np.concatenate([*found, np.empty(0, np.int32)])
        return ids, np.append(np.flatnonzero(ids == feed), len(ids))

    def packed(self, tokens: list[str], kind: str) -> list[bytes]:
        """encode of each, packed."""
        ids, places = self.encode_many(tokens)
        raw, width = ids.astype(kind).tobytes(), np.dtype(kind).itemsize
        starts, ends = ((places[:-1] + 1) * width).tolist(), (places[1:] * width).tolist()
        return [raw[a:b] for a, b in zip(starts, ends, strict=True)]

    def lengths(self, tokens: list[str]) -> list[int]:
        """Number of ids of each."""
        return (np.diff(self.encode_many(tokens)[1]) - 1).tolist()


_holders: list["Bounded"] = []


def drop_memos(but: "Bounded | None" = None) -> None:
    for memo in _holders:
        if memo is not but and (len(memo) > len(memo.fixed) or memo.old):
            memo.old = {}
            memo.clear()
            memo.update(memo.fixed)


class Bounded(dict):
    """A memo of two generations: when the young one is full it becomes the old one, whose entries come back when asked for."""

    def __init__(self, fixed: dict, entries: int = CACHE_ENTRIES, chars: int = CACHE_CHARS):
        super().__init__(fixed)
        self.fixed, self.entries, self.chars, self.old = fixed, entries, chars, {}
        _holders.append(self)

    def claim(self) -> "Bounded":
        """This memo, for use now; a worker that goes from one operator to another keeps no other's entries."""
        drop_memos(self)
        return self

    def __missing__(self, token: str):
        value = self.old.get(token)
        if value is None:
            value = self.make(token)
        self.keep(token, value)
        return value

    def keep(self, token: str, value) -> None:
        if len(token) <= self.chars:
            self.room(1)
            self[token] = value

    def room(self, n: int) -> None:
        """Makes place for n entries."""
        if len(self) + n > self.entries + len(self.fixed):
            self.old = dict(self)
            self.clear()
            self.update(self.fixed)

    def make(self, token: str):
        raise NotImplementedError

    def prefetch(self, tokens: list[str]) -> None:
        """A chance to make many at once."""

    def all(self, tokens: list[str]) -> list:
        values = list(map(self.get, tokens))
        lack = [i for i, v in enumerate(values) if v is None]
        self.prefetch([tokens[i] for i in lack])
        for i in lack:
            values[i] = self[tokens[i]]
        return values


class Cache(Bounded):
    """Pre-token to value: from its factors' values if there are several, else by `encode`; where `many` gives the values of a list, those that `all` lacks are made by that, unless they are long."""

    def __init__(self, pieces: PieceModel, encode, join, known: dict | None = None, entries: int = CACHE_ENTRIES, many=None):
        super().__init__({"": join([])} | (known or {}), entries)
        self.pieces, self.encode, self.join, self.many = pieces, encode, join, many

    def all(self, tokens: list[str]) -> list:
        if self.many is None:
            return super().all(tokens)
        values = list(map(self.get, tokens))
        lack = [i for i, v in enumerate(values) if v is None]
        step = max(1, min(MANY, self.entries))
        for at in range(0, len(lack), step):
            fresh = []
            for i in lack[at : at + step]:
                token = tokens[i]
                if token in self.old or len(token) > LONG_CHARS or "\n" in token:
                    values[i] = self[token]
                else:
                    fresh.append(i)
            names = [tokens[i] for i in fresh]
            made = self.many(names) if names else []
            for i, value in zip(fresh, made, strict=True):
                values[i] = value
            short = {t: v for t, v in zip(names, made, strict=True) if len(t) <= self.chars}
            self.room(len(short))
            self.update(short)
        return values

    def make(self, token: str):
        parts = self.pieces.factors(token)
        return self.join([self[p] for p in parts]) if len(parts) > 1 else self.encode(token)


# -- whole batches ----------------------------------------------------------------------------

#: Text bytes that are worked on at once, and characters of a part of a longer text.
BATCH_BYTES, PART_CHARS = 4 << 20, 2 << 20
#: The same for the stages of a pipeline, whose executors hold much else.
STAGE_BYTES = 1 << 20


def sized_batches(batches, column: int, limit: int = BATCH_BYTES):
    """Arrow batches joined or cut to where their texts reach the limit."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            upto = int(np.searchsorted(ends, base + limit - size, "right"))
            upto = max(upto, at + 1) if not held else max(upto, at)
            if upto > at:
                held.append(batch.slice(at, upto - at))
                size += int(ends[upto - 1] - base)
            if upto < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            at = upto
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def dealt(prepared: list[str]):
    """(distinct chunks, number of each chunk in order, ends of the texts) of space-parted texts.

    Splitting and numbering run in compiled code, so Python sees each distinct chunk of a batch
    once. Longer texts are cut at spaces first.
    """
    parts, owners = [], []
    for text in prepared:
        at = 0
        while len(text) - at > PART_CHARS and (cut := text.find(" ", at + PART_CHARS)) >= 0:
            parts.append(text[at:cut])
            at = cut + 1
        parts.append(text[at:] if at else text)
        owners.append(len(parts))
    words = pc_split(pa.array(parts, pa.large_string()), " ")
    coded = words.values.dictionary_encode() if len(parts) else pa.array([], pa.large_string()).dictionary_encode()
    ends = words.offsets.to_numpy()[np.array(owners, np.int64)] if owners else np.empty(0, np.int64)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), ends


def counted(prepared: list[str], look) -> np.ndarray:
    """The sum over each text of its chunks' numbers. look: distinct chunks to their numbers."""
    chunks, which, ends = dealt(prepared)
    values = np.array(look(chunks), np.int64)
    sums = np.concatenate([[0], np.cumsum(values[which])])
    return np.diff(np.concatenate([[0], sums[ends]]))


def encoded(prepared: list[str], look, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and each text's first place among them and the end. look: distinct chunks to their packed ids."""
    chunks, which, ends = dealt(prepared)
    values = look(chunks)
    width = np.dtype(kind).itemsize
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // width
    flat = np.frombuffer(b"".join(values), kind)
    starts = np.cumsum(sizes) - sizes
    n = sizes[which]
    places = np.concatenate([[0], np.cumsum(n)])
    ids = flat[np.repeat((starts[which] - places[:-1]).astype(np.int32), n) + np.arange(places[-1], dtype=np.int32)] if places[-1] < 1 << 31 else flat[np.repeat(starts[which] - places[:-1], n) + np.arange(places[-1])]
    return ids, np.concatenate([[0], places[ends]])
