"""Token ids of whole texts by the ``tokenizers`` library, each distinct word encoded once per worker.

The words of a text are encoded apart from each other, because byte-level
tokenizers split at white space before anything else. Ids of seen words are
kept, so that most of a text is looked up. A tokenizer file of another kind is
applied to whole texts without this.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from array import array

import numpy as np

from pricewake.llm.common import worker_cache

# Letters below this are single code points under composition and, but for one, lower-casing.
_LATIN_END, _DOTTED = "\u0250", "\u0130"
# No letters, digits or white space, and nothing a contraction starts with.
_END_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_TWO_SPACES = re.compile(r"\s\s")
_WIDE_ENDS = "。！？｡．"
_OTHER_SPACES = "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WIDE = re.compile(f"[{_OTHER_SPACES}{_WIDE_ENDS}]")
_CLOSERS = "\"')\\]}’”»›」』）】》〉"
# Tokenizers split before white space, and between marks and a letter or digit but for contractions.
_WIDE_END = f"(?<=[{_WIDE_ENDS}])|(?<=[{_WIDE_ENDS}][{_CLOSERS[:1] + _CLOSERS[2:]}])|(?<=[{_WIDE_ENDS}][{_CLOSERS}][{_CLOSERS[:1] + _CLOSERS[2:]}])"
_PIECES = re.compile(f"(?<=\\S)(?=[ \\t\\n\\r\\f\\v{_OTHER_SPACES}])|(?:{_WIDE_END})(?=[^\\W_])")
_ENDS_SENTENCE = re.compile(f"[.!?{_WIDE_ENDS}][{_CLOSERS}]*\\Z")
_WIDE_STOP = re.compile(f"[{_WIDE_ENDS}]+[{_CLOSERS}]*")
_STARTS_LINE = re.compile(r"\s*[\n\r\f\v\x85\u2028\u2029]")
_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[[ord(c) for c in ".!?"]] = True
_WIDE_CLOSERS = {c.encode() for c in "’”›」』）】》〉"}
_MAY_CLOSE = np.zeros(256, bool)
_MAY_CLOSE[[0xBB, *(c[-1] for c in _WIDE_CLOSERS)]] = True
_CLOSING = np.zeros(256, bool)
_CLOSING[[ord(c) for c in "\"')]}"]] = True


class _Written(dict):
    """How byte-level tokenizers write a character: one sign for each of its bytes."""

    def __init__(self):
        printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        rest = [b for b in range(256) if b not in printable]
        self.signs = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def __missing__(self, character: str) -> str:
        self[character] = found = "".join(self.signs[b] for b in character.encode())
        return found


class _Ends(dict):
    """Ids of marks at the end of a word, and of a line end, which tokenizers split off."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, marks: str) -> bytes:
        found = self.encode([marks])[0]
        if len(self) < 10_000:
            self[marks] = found
        return found


class _Known(dict):
    """Ids of words, looked up elsewhere the first time."""

    def __init__(self, look_up):
        self.look_up = look_up

    def __missing__(self, word: str) -> bytes:
        return self.look_up(word)


class TokenIds:
    """Encoder of one tokenizer file, given as its content.

    ``kept`` bounds the words held in memory: when the young half is full, the
    older half is dropped. Ids are little-endian unsigned 32-bit integers.
    """

    def __init__(self, content: str, kept: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.encode_special_tokens = True
        spec = json.loads(content)
        pre = spec.get("pre_tokenizer") or {}
        steps = [pre, *pre.get("pretokenizers", [])]
        byte_level = any(s["type"] == "ByteLevel" for s in steps if s) and spec["model"]["type"] == "BPE"
        splits = [s for s in steps if s.get("type") == "Split"]
        self.drops_space = bool(byte_level and splits and splits[0].get("invert") and splits[0]["behavior"] == "Removed")
        self.keeps_space = bool(byte_level and pre["type"] == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"))
        self.keeps_space &= not spec.get("normalizer")
        self.lower = "Lowercase" in json.dumps(spec.get("normalizer") or {})
        self.letters = _Written()
        self.ends = _Ends(self._encode)
        self.kept = kept
        self.tokenize = self.tokenizer.model.tokenize
        self.space = self.letters[" "] if self.keeps_space else ""
        self.young: dict[str, bytes] = _Known(self._look_up)
        self.old: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in done]

    def _look_up(self, word: str) -> bytes:
        """Ids of a word not held yet. It stands for itself after a space, or as it is if it starts with a line end or follows a space here.

        Words of Latin letters, with or without marks at their end, go to the
        tokenizer's model alone; everything else takes the whole way.
        """
        young = self.young
        ids = self.old.get(word)
        if ids is None:
            ids = self._word(word)
        young[word] = ids
        return ids

    def _word(self, word: str) -> bytes:
        keeps_space = self.keeps_space
        if keeps_space and word[:1] == " ":
            return self._encode([word[1:]])[0]
        stem = word.rstrip(_END_MARKS)
        end = self.ends[word[len(stem) :]] if len(stem) < len(word) else b""
        begin, lead = b"", self.space
        if keeps_space and stem[:1] == "\n":
            stem, lead, begin = stem[1:], "", self.ends["\n"]
        plain = stem.isascii()
        if not stem.isalpha() or not plain and (max(stem) >= _LATIN_END or _DOTTED in stem):
            return self._encode([word if not keeps_space or word[:1] == "\n" else " " + word])[0]
        if end and not begin:
            # The word may be known without its marks.
            ids = self.young.get(stem)
            if ids is not None:
                return ids + end
        if self.lower:
            stem = stem.lower()
        if not plain:
            stem = "".join(map(self.letters.__getitem__, stem))
        return begin + array("I", [x.id for x in self.tokenize(lead + stem)]).tobytes() + end

    def parts(self, texts: list[str]) -> list[list[bytes]]:
        """Per text the ids of its words in order; joined, they are the ids of the text."""
        return [ids for ids, _ in self.parts_and_shape(texts)]

    def parts_and_shape(self, texts: list[str]) -> list[tuple[list[bytes], bool]]:
        """Per text the ids of its words in order, and whether a word ends at each space or line end and nowhere else."""
        if not (self.keeps_space or self.drops_space):
            return [([x], False) for x in self._encode(texts)]
        # Nothing below makes reference cycles, and looking for them among so many words takes long.
        looking = gc.isenabled()
        gc.disable()
        try:
            return self._parts_of_words(texts)
        finally:
            if looking:
                gc.enable()

    def _parts_of_words(self, texts: list[str]) -> list[tuple[list[bytes], bool]]:
        split = [self._split(t) for t in texts]
        if len(self.young) > self.kept // 2:
            self.old, self.young = self.young, _Known(self._look_up)
        ids = self.young.__getitem__
        heads = self._encode([head for head, _, _ in split])
        return [([h, *map(ids, words)], regular) for h, (_, words, regular) in zip(heads, split)]

    def _split(self, text: str) -> tuple[str, list[str], bool]:
        """The first word, which no space precedes, and the others."""
        if self.drops_space:
            if self.lower and _is_latin(text):
                text = text.lower()
            return "", text.replace("\n", " ").split(" "), False
        regular = is_regular(text)
        if regular:
            head, *words = text.replace("\n", " \n").split(" ")
        else:
            head, *pieces = pieces_of(text)
            words = [_key(x) for x in pieces]
        return head, words, regular

    def sentence_ends(self, text: str, parts: list[bytes], regular: bool) -> np.ndarray:
        """Number of ids before each place where a sentence or line ends; a tokenizer not split by words has none."""
        if regular:
            return sentence_ends(text, parts)
        if self.keeps_space:
            pieces = pieces_of(text)
            stops = [bool(_ENDS_SENTENCE.search(a) or _STARTS_LINE.match(b)) for a, b in zip(pieces, pieces[1:])]
        elif self.drops_space:
            words = re.split("([ \n])", text)
            # The first part is the empty one before the first word.
            stops = [False, *[gap == "\n" or bool(_ENDS_SENTENCE.search(a)) for a, gap in zip(words[::2], words[1::2])]]
        else:
            return np.zeros(0, np.int64)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) // 4)
        found = ends[:-1][np.array(stops, bool)]
        if self.keeps_space and _WIDE_STOP.search(text):
            inside = [e - len(p) // 4 + k for x, p, e in zip(pieces, parts, ends) for k in self._stops_inside(x, p)]
            found = np.union1d(found, np.array(inside, np.int64))
        return found

    def _stops_inside(self, piece: str, ids: bytes) -> list[int]:
        """Number of ids of a piece before each wide end mark in it, as far as an id ends there."""
        marks = [len(piece[: m.end()].encode()) for m in _WIDE_STOP.finditer(piece) if m.end() < len(piece)]
        if not marks:
            return []
        # Byte-level tokens have one sign a byte.
        bounds = np.cumsum([len(self.tokenizer.id_to_token(x)) for x in np.frombuffer(ids, np.uint32).tolist()])
        at = np.searchsorted(bounds, marks)
        return (at[bounds[at] == marks] + 1).tolist()

    def encode(self, texts: list[str]) -> list[bytes]:
        return [b"".join(p) for p in self.parts(texts)]


def _is_latin(text: str) -> bool:
    """Whether all characters are Latin-1, whose lower case is one Latin-1 character that composition leaves alone."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def is_regular(text: str) -> bool:
    """Whether white space is single spaces and line ends between words, and no wide mark ends a sentence without it."""
    if _TWO_SPACES.search(text) or text[:1].isspace() or text[-1:].isspace():
        return False
    if "\r" in text or "\t" in text or "\f" in text or "\v" in text:
        return False
    return text.isascii() or not _WIDE.search(text)


def pieces_of(text: str) -> list[str]:
    """A text split where tokenizers that keep white space do, so that its ids are those of the pieces."""
    return _PIECES.split(text)


def _key(piece: str) -> str:
    """What a piece is held under: after one space by itself, after one line end with it, else as it is after a space."""
    if piece[:1] in " \n" and not piece[1:2].isspace():
        return piece[1:] if piece[0] == " " else piece
    return " " + piece


def sentence_ends(text: str, parts: list[bytes]) -> np.ndarray:
    """Number of ids before each place in a regular text where a sentence or line ends."""
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) // 4)
    raw = np.frombuffer(text.encode(), np.uint8)
    gaps = np.flatnonzero((raw == 32) | (raw == 10))
    last = gaps - 1
    closed = _closers(raw, last)
    while closed.any():
        last = last - closed
        closed = _closers(raw, last)
    stops = (raw[gaps] == 10) | _SENTENCE_END[raw[last]] & (last >= 0)
    return ends[:-1][stops]


def _closers(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bytes of the closing quote or bracket that ends at each place, 0 for none."""
    end = raw[at]
    found = _CLOSING[end].astype(np.int64)
    for i in np.flatnonzero(_MAY_CLOSE[end]):
        k = int(at[i])
        if raw[k - 1 : k + 1].tobytes() == b"\xc2\xbb":
            found[i] = 2
        elif raw[max(0, k - 2) : k + 1].tobytes() in _WIDE_CLOSERS:
            found[i] = 3
    found[at < 0] = 0
    return found


def encoder(content: str, kept: int = 2_000_000) -> TokenIds:
    """The worker's encoder of this tokenizer, made once."""
    key = f"{hashlib.blake2b(content.encode()).hexdigest()}-{kept}"
    return worker_cache("tokens", key, lambda: TokenIds(content, kept))


def read_tokenizer(path: str) -> str:
    """Content of a tokenizer file; of fixed size, so it may go with the tasks."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def public_tokenizer(name: str) -> str:
    """Path of a vocabulary file of the installed collection."""
    import public_tokenizers

    return public_tokenizers.path(name)
