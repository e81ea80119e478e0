"""What only codecs can do: strict and lossy decoding, validation, detection and probes, on plain bytes.

Operator ids: D1, D4-D11, D13, V1-V3, V7, V9, V12-V17, X8-X10, X12, X14. Spark reaches these
through the vectorised functions in operators.detect and operators.convert.
"""

from __future__ import annotations

import codecs
import hashlib
import random
import re
import unicodedata
from functools import lru_cache

import numpy as np

from .. import dims
from .names import resolve_codec, tool_spellings

BOMS = [(b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")]
REJECTED = (UnicodeError, LookupError, ValueError)


# -- text ---------------------------------------------------------------------------------------


def strip_bom(text: str) -> str:
    return text.removeprefix("\ufeff")


def text_sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-32-le", "surrogatepass")).hexdigest()


def strict(data: bytes, codec: str) -> str | None:
    """The text, or null where the codec rejects the bytes or does not exist."""
    try:
        return data.decode(codec)
    except REJECTED:
        return None


def decode_whole(data: bytes, codec: str) -> str | None:
    """V2: strict, but an unfinished sequence at the end is dropped. A BOM stays."""
    try:
        name = {"utf-8-sig": "utf-8"}.get(codec, codec)
        if name == "utf-8" and len(data) > 1 and data[-2] == 0xED and data[-1] >= 0xA0:
            return None  # can only become a surrogate, which the incremental decoder finds out later
        return codecs.getincrementaldecoder(name)("strict").decode(data, final=False)
    except REJECTED:
        return None


def looks_like_text(text: str) -> bool:
    """V3."""
    head = text[: dims.TEXT_SCALARS]
    good = sum(c in "\r\n\t" or unicodedata.category(c) not in ("Cc", "Co") for c in head)
    return bool(head) and good >= dims.TEXT_SHARE * len(head)


def valid_text(data: bytes, codec: str) -> bool:
    """V1."""
    text = decode_whole(data, codec) if data else None
    return bool(text) and looks_like_text(text)


def opposite_decodes(data: bytes, codec: str) -> bool:
    """V7: the other byte order reads the bytes and does not begin with U+FFFE."""
    swapped = {"utf-16-le": "utf-16-be", "utf-16-be": "utf-16-le", "utf-32-le": "utf-32-be", "utf-32-be": "utf-32-le", "utf-16": "utf-16-be", "utf-32": "utf-32-be"}.get(codec)
    text = strict(data, swapped) if swapped else None
    return bool(text) and text[0] != "\ufffe"


def reference_reading(data: bytes, codec: str) -> dict:
    """V9: text, its length and digest, or the verdict that there is none."""
    text = strict(data, codec)
    if text is None:
        return {"verdict": "CorpusByteOrderMislabel" if opposite_decodes(data, codec) else "ReferenceDecodeError"}
    if text[:1] == "\ufffe":
        return {"verdict": "CorpusByteOrderMislabel"}
    text = strip_bom(text)
    return {"text": text, "length": len(text), "sha256": text_sha256(text)}


def round_trips(data: bytes, text: str, codec: str) -> bool | None:
    """Encoding the text again gives the bytes, or all but what they begin with."""
    try:
        return data.endswith(text.encode(codec)) if text else True
    except REJECTED:
        return None


# -- evidence ---------------------------------------------------------------------------------


def constraint(data: bytes, codec: str) -> float:
    """Share of single-byte changes of the sample that the codec rejects. The draws are fixed by the seed."""
    data = data[: dims.SAMPLE_BYTES]
    if not data:
        return 0.0
    draw, rejected = random.Random(dims.CONSTRAINT_SEED), 0
    for _ in range(dims.CONSTRAINT_TRIALS):
        at = draw.randrange(len(data))
        changed = bytearray(data)
        changed[at] ^= draw.choice(dims.CONSTRAINT_BITS)
        rejected += strict(bytes(changed), codec) is None
    return rejected / dims.CONSTRAINT_TRIALS


def structure_bearing(codec: str) -> bool:
    """Some non-ASCII letter takes more than a byte."""
    def size(c: str) -> int:
        try:
            return len(c.encode(codec))
        except REJECTED:
            return 0

    return any(size(c) > 1 for c in "é世Ж")


def plausible(data: bytes, names: list[str]) -> list[str]:
    """The codecs that read the sample."""
    head = data[: dims.SAMPLE_BYTES]
    return [c for c in names if strict(head, c) is not None]


def readings(data: bytes, names: list[str]) -> int:
    """How many different texts they read."""
    return len({strict(data[: dims.SAMPLE_BYTES], c) for c in names} - {None})


# -- detection -----------------------------------------------------------------------------------


def entropy(data: bytes) -> float:
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = counts[counts > 0] / len(data)
    return float(-(p * np.log2(p)).sum())


def bom(data: bytes) -> str | None:
    return next((c for mark, c in BOMS if data.startswith(mark)), None)


def utf32_orders(data: bytes) -> tuple[bool, bool]:
    """D4, first half: whether there are 16 bytes and every whole unit is below U+110000 as little-endian, as big-endian."""
    a = np.frombuffer(data, np.uint8, len(data) & ~3).reshape(-1, 4)
    if a.size < dims.UTF32_BYTES:
        return False, False
    return not a[:, 3].any() and bool((a[:, 2] <= 0x10).all()), not a[:, 0].any() and bool((a[:, 1] <= 0x10).all())


def utf32(data: bytes) -> str | None:
    """D4."""
    whole = data[: len(data) & ~3]
    return next((c for fits, c in zip(utf32_orders(data), ("utf-32-le", "utf-32-be"), strict=True) if fits and valid_text(whole, c)), None)


def nul_shares(data: bytes) -> tuple[float, float] | None:
    """Shares of NUL bytes in the even and the odd channel of whole two-byte units; null without any."""
    a = np.frombuffer(data, np.uint8, len(data) & ~1).reshape(-1, 2)
    return (int((a[:, 0] == 0).sum()) / len(a), int((a[:, 1] == 0).sum()) / len(a)) if len(a) else None


def utf16_order(data: bytes) -> str | None:
    """D5, verdict: the codec with over half NUL in its high and under a tenth in its low channel."""
    shares = nul_shares(data)
    if shares is None or len(data) & ~1 < dims.UTF16_BYTES:
        return None
    even, odd = shares
    if even > dims.NUL_HIGH and odd < dims.NUL_LOW:
        return "utf-16-be"
    return "utf-16-le" if odd > dims.NUL_HIGH and even < dims.NUL_LOW else None


def utf16(data: bytes) -> str | None:
    """By NUL shares, else by which channel's bytes are the more uneven."""
    a = np.frombuffer(data, np.uint8, len(data) & ~1).reshape(-1, 2)
    if a.size < dims.UTF16_BYTES:
        return None
    n = len(a)
    guess = utf16_order(data)
    if guess is None and max(nul_shares(data)) >= dims.NUL_FLOOR:
        chi = [256 / n * float((np.bincount(a[:, k], minlength=256).astype(float) ** 2).sum()) - n for k in (0, 1)]
        if chi[0] >= dims.CHI_SQUARE and chi[0] > chi[1]:
            guess = "utf-16-be"
        elif chi[1] >= dims.CHI_SQUARE and chi[1] > chi[0]:
            guess = "utf-16-le"
    return guess if guess and valid_text(a.tobytes(), guess) else None


def unicode_codec(data: bytes) -> tuple[str, bool] | None:
    """(codec, BOM)."""
    marked = bom(data)
    if marked:
        return marked, True
    found = utf32(data) or utf16(data) or ("utf-8" if not data.isascii() and valid_text(data, "utf-8") else None)
    return (found, False) if found else None


#: Multi-byte codecs in the order of preference among equal scores, with the blocks their common characters lie in.
MULTIBYTE = ["euc_jp", "shift_jis", "gb18030", "big5", "euc_kr"]
_ESCAPES = [("iso2022_jp", re.compile(rb"\x1b\$[@B]|\x1b\([BJ]")), ("iso2022_kr", re.compile(rb"\x1b\$\)C")), ("hz", re.compile(rb"~\{.*?~\}", re.S))]
CYRILLIC = ["cp1251", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic"]
_FREQUENT = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъ"


#: The most frequent characters of Chinese texts, in simplified and traditional forms.
_HAN = {"gb18030": "的一是不在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于", "big5": "的一是不在人有我他這個們中來上大為和國地到以說時要就出會可也你對生能而子那得於"}


_ASCII, _KANA, _HANGUL = re.compile("[\x00-\x7f]+"), re.compile("[\u3040-\u30ff]+"), re.compile("[\uac00-\ud7a3]+")
_COMMON = re.compile("[\u3040-\u30ff\uac00-\ud7a3\u4e00-\u9fff、。，！？「」・：；（）《》“”]+")
_LETTERS = re.compile("[A-Za-z]+")
_FREQUENT_HAN = {codec: re.compile(f"[{signs}]+") for codec, signs in _HAN.items()}


def _held(pattern: re.Pattern, text: str) -> int:
    """Characters of a text that runs of a pattern hold."""
    return len(text) - len(pattern.sub("", text))


def _east_asian(text: str, codec: str) -> float | None:
    """How well a text fits the script that a multi-byte codec is for; null where it has too little of any."""
    wide = _ASCII.sub("", text)
    # In a text of Latin letters a few signs can pass for double bytes.
    if not wide or 4 * len(wide) < _held(_LETTERS, text):
        return None
    share = lambda pattern: _held(pattern, wide) / len(wide)
    common = share(_COMMON)
    if common <= 0.85:
        return None
    kana, hangul = share(_KANA), share(_HANGUL)
    if codec in ("euc_jp", "shift_jis"):
        return common + (0.2 if kana > 0.1 else -0.3)
    if codec == "euc_kr":
        return common + (0.2 if hangul > 0.5 else -0.3)
    return common + min(0.2, share(_FREQUENT_HAN[codec])) - hangul - kana


@lru_cache(maxsize=1)
def _cyrillic_weights() -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each single-byte codec the weights of the upper half's letters by their frequency, and the bytes that it does not define."""
    out = {}
    for codec in CYRILLIC:
        signs = [strict(bytes([b]), codec) for b in range(256)]
        weights = [len(_FREQUENT) - _FREQUENT.index(c) if c and c in _FREQUENT else -8 for c in signs[128:]]
        out[codec] = np.array(weights, np.int64), np.array([b for b, c in enumerate(signs) if c is None], np.int64)
    return out


def legacy(data: bytes) -> str | None:
    """Escapes, then multi-byte validity and character distribution, then single-byte letter frequencies."""
    if data.isascii():
        return next((c for c, e in _ESCAPES if e.search(data) and strict(data, c) is not None), "ascii")
    scored = []
    for rank, codec in enumerate(MULTIBYTE):
        text = decode_whole(data, codec)
        score = _east_asian(text, codec) if text else None
        if score is not None:
            scored.append((round(score, 3), -rank, codec))
    if scored:
        return max(scored)[2]
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    high, letters = int(counts[128:].sum()), int(counts[65:91].sum() + counts[97:123].sum())
    if high > 0.3 * (high + letters):
        best = None
        for codec, (weights, undefined) in _cyrillic_weights().items():
            if not counts[undefined].any():
                score = int(counts[128:] @ weights) / high
                if score > 12 and (best is None or score > best[0]):
                    best = score, codec
        if best:
            return best[1]
    return "cp1252" if strict(data, "cp1252") is not None and counts[0x80:0xA0].any() else "iso8859-1"


def detect(content: bytes | None) -> tuple[str, bool] | None:
    """(codec, BOM) or nothing. The entropy gate comes first, then marks and structure, then the legacy stage."""
    data = (content or b"")[: dims.SAMPLE_BYTES]
    if not data or len(data) >= dims.ENTROPY_BYTES and entropy(data) > dims.ENTROPY_BITS:
        return None
    found = unicode_codec(data)
    if found:
        return found
    codec = legacy(data)
    return (codec, False) if codec and valid_text(data, codec) else None


# -- conversion and diagnosis ----------------------------------------------------------------------


def diagnose(data: bytes, codec: str | None, bom_expected: bool, mode: str, decode_only: bool = False) -> dict:
    """One conversion taken apart. mode: production (lossy by construction, X9) or strict."""
    out = {"codec": codec, "stage": None, "error": None, "message": None, "sha256": None, "length": None, "encoded": None, "head": None}
    name = resolve_codec(codec)
    if name is None:
        return out | {"stage": "Detection", "error": "LookupError", "message": f"no codec {codec}"}
    body = data
    mark = {"utf-8-sig": "utf-8"}.get(name, name)
    if bom_expected:
        body = next((data[len(m) :] for m, c in BOMS if c == mark and data.startswith(m)), data)
    try:
        text = strip_bom(body.decode(name, "replace" if mode == "production" else "strict"))
    except REJECTED as e:
        return out | {"stage": "Decode", "error": type(e).__name__, "message": str(e)[: dims.MESSAGE_CHARS]}
    out |= {"sha256": text_sha256(text), "length": len(text), "head": text[: dims.HEAD_CHARS]}
    if decode_only:
        return out
    try:
        return out | {"encoded": len(text.encode("utf-8"))}
    except REJECTED as e:
        return out | {"stage": "Encode", "error": type(e).__name__, "message": str(e)[: dims.MESSAGE_CHARS]}


def decoder_strictness(codec: str) -> str:
    """The first probe that the strict decoder rejects decides whether the production decoder lets it pass."""
    name = resolve_codec(codec)
    if name is None:
        return "Unknown"
    for probe in map(bytes.fromhex, dims.DECODER_PROBES):
        if strict(probe, name) is None:
            try:
                probe.decode(name, "replace")
                return "NonStrict"
            except REJECTED:
                return "Strict"
    return "Unknown"


def encoder_strictness(codec: str) -> str:
    name = resolve_codec(codec)
    if name is None:
        return "Unknown"
    for probe in dims.ENCODER_PROBES:
        try:
            probe.encode(name)
        except REJECTED:
            try:
                probe.encode(name, "replace")
                return "NonStrict"
            except REJECTED:
                return "Strict"
    return "Unknown"


def tool_name(codec: str | None) -> str | None:
    """The first spelling of a codec under which the converter is seen to convert, null if there is none; a codec without a code page has none."""
    if codec not in dims.CODE_PAGES:
        return None
    return next((name for name in tool_spellings(codec) if resolve_codec(name) == codec and convert("probe".encode(codec), None, name)["status"] in ("Converted", "Unchanged")), None)


def convert(content: bytes, detected: str | None, explicit: str | None) -> dict:
    """To UTF-8 without BOM. Nothing is written unless decoding, encoding and reading back are exact."""
    out = {"status": "Error", "stage": None, "reason": None, "output": None}
    source = resolve_codec(explicit) if explicit else detected
    if explicit and source is None:
        return out | {"status": "Refused", "reason": "UnsupportedSource"}
    if source is None:
        return out | {"status": "Skipped", "reason": "EncodingNotIdentified"}
    if explicit and detected and detected.replace("_", "-") in dims.UNAIDED and detected != "ascii" and source.replace("_", "-") not in dims.UNAIDED:
        return out | {"status": "Refused", "reason": "ExplicitSourceConflictsWithDetection"}
    if not explicit and source.replace("_", "-") not in dims.UNAIDED:
        return out | {"status": "Refused", "reason": "LegacySourceNotNamed"}
    text = strict(content, source)
    if text is None:
        return out | {"stage": "Decode", "reason": "InvalidBytes"}
    try:
        made = strip_bom(text).encode("utf-8")
    except REJECTED:
        return out | {"stage": "Encode", "reason": "UnencodableText"}
    if made.decode("utf-8") != strip_bom(text):
        return out | {"stage": "Write", "reason": "VerificationFailed"}
    if made == content:
        return out | {"status": "Unchanged", "output": content}
    return out | {"status": "Converted", "output": made}
