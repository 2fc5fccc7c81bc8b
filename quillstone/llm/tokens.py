"""Token ids of whole texts by the tokenizers library, with repeated pieces encoded once per worker."""

from __future__ import annotations

import json
import os
import re
import string
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Words and other pieces that a worker remembers, the longest of them in characters, and bytes that tell what came before. All bound memory only: others are encoded anew.
REMEMBERED_WORDS, REMEMBERED_PIECES, LONGEST, SEEN = 400_000, 100_000, 48, 1 << 22
#: A space before something that is no white space; a byte-level pre-tokenizer always starts a token there.
_BEFORE = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?!\S)")
#: The public split pattern of byte-level BPE (fixed value).
_SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_MARKS = string.punctuation
#: Characters of texts whose words are looked up together.
TOGETHER = 4_000_000
#: The time from which on a word that falls into remembered parts is itself remembered; until then, its places are for parts.
AGAIN = 4


class _Memory(dict):
    """Remembers what comes first, up to half of its places; the other half is for what comes often enough, as most rare words never do."""

    def __init__(self, places: int):
        self.places, self.seen = places, bytearray(SEEN)

    def keep(self, text: str, ids: bytes, times: int = 2, free: int = 2) -> bytes:
        """ids, remembered from the given time on that text comes, or at once while a part 1 / free of the places isn't taken."""
        n = len(self)
        if n < self.places and len(text) <= LONGEST:
            if free and free * n < self.places:
                self[text] = ids
            elif (count := self.seen[at := hash(text) % SEEN] + 1) >= times:
                self[text] = ids
            else:
                self.seen[at] = count
        return ids


class _Tokens(_Memory):
    """The ids of a pre-token, by the library's model; remembered up to a number."""

    def __init__(self, tokenizer):
        super().__init__(REMEMBERED_PIECES)
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenize = tokenizer.model.tokenize
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        #: What the pre-tokenizer makes of each byte, found by asking it for the characters that UTF-8 writes with that byte.
        self.shown = {}
        for c in [*map(chr, range(0x80)), *map(chr, range(0x80, 0x800)), *(chr(x << 12 | 0x800) for x in range(1, 16) if x != 13), "ࠀ", "퟿", *(chr(x << 18) for x in range(1, 4)), "\U00010000", chr(0x100000), *(chr(0x0800 + (x << 6)) for x in range(32))]:
            for byte, seen in zip(c.encode(), level.pre_tokenize_str(c)[0][0], strict=True):
                self.shown[byte] = seen
        #: Whether printable ASCII but the space is shown as it is; then a word needs no look at its bytes.
        self.as_is = all(self.shown[b] == chr(b) for b in range(0x21, 0x7F))
        self.bytes_of = [struct.pack("<I", x) for x in range(max(tokenizer.get_vocab().values(), default=0) + 1)]

    def ids(self, piece: str) -> bytes:
        if self.as_is and piece.isascii() and piece.isprintable():
            shown = piece.replace(" ", self.shown[0x20])
        else:
            shown = piece.encode().decode("latin-1").translate(self.shown)
        return b"".join([self.bytes_of[x.id] for x in self.tokenize(shown)])

    def __missing__(self, piece: str) -> bytes:
        return self.keep(piece, self.ids(piece))


class _Words(_Memory):
    """The ids of a word with the space before it; remembered up to a number.

    Without the pattern, two kinds of words fall into parts: letters with ASCII marks after them, and what one line
    break between characters other than white space parts, for no pre-token reaches over it.
    """

    def __init__(self, tokens: _Tokens):
        super().__init__(REMEMBERED_WORDS)
        self.tokens = tokens

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():
            return self.keep(word, self.tokens.ids(" " + word))
        core = word.rstrip(_MARKS)
        if core.isalpha():
            return self.keep(word, self[core] + self.tokens[word[len(core) :]], AGAIN, 0)
        line, _, rest = word.partition("\n")
        if rest and line and not line[-1].isspace() and not rest[0].isspace():
            after = self.tokens[rest] if rest.isalpha() else b"".join(map(self.tokens.__getitem__, _SPLIT.findall(rest)))
            return self.keep(word, self[line] + self.tokens["\n"] + after, AGAIN, 0)
        first, *others = _SPLIT.findall(" " + word)
        ids = self[first[1:]] if first[1:].isalpha() else self.tokens[first]
        return self.keep(word, ids + b"".join(map(self.tokens.__getitem__, others)))


class Encoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit bytes, equal to Tokenizer.encode(text, add_special_tokens=False).

    A byte-level pre-tokenizer starts a token at each space that something other than white space follows, so a
    text falls into words there, and its ids are those of its words in order. The library's model encodes every
    pre-token; repeated ones are remembered. A text with a special token's string, which the library looks for
    first, is handed over whole, and so is every text if the tokenizer isn't a byte-level BPE of this kind.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        # each part tells its own settings; the whole file, parsed, would hold the vocabulary and merges once more
        about = lambda part, else_: json.loads(part.__getstate__()) if part else else_
        before, after = about(self.tokenizer.pre_tokenizer, {}), about(self.tokenizer.post_processor, {"type": "ByteLevel"})
        self.plain = type(self.tokenizer.model).__name__ == "BPE" and not self.tokenizer.normalizer and before.get("type") == after["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        if self.plain:
            self.tokens = _Tokens(self.tokenizer)
            self.words = _Words(self.tokens)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str | None], grouped: bool = False) -> list[bytes]:
        """Ids of each text; a null text counts as empty. Grouped, texts share lookups of words, which is faster and takes some 60 to 130 MB more."""
        out, held, size = [b""] * len(texts), [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.plain or any(x in text for x in self.special):
                out[i] = self.whole(text)
            elif (odd := _ODD.search(text)) or not grouped:
                first, *words = _BEFORE.split(text) if odd else text.split(" ")
                out[i] = self.head(first) + b"".join(map(self.words.__getitem__, words))
            else:
                held.append(i)
                size += len(text)
                if size > TOGETHER:
                    self.together(texts, held, out)
                    held, size = [], 0
        if held:
            self.together(texts, held, out)
        return out

    def head(self, first: str) -> bytes:
        """The ids of what comes before the first such space."""
        return b"".join(map(self.tokens.__getitem__, _SPLIT.findall(first))) if first else b""

    def together(self, texts: list[str | None], places: list[int], out: list[bytes]) -> None:
        """Texts without odd spaces: each distinct word of them all is looked up once, and its ids are copied to wherever it stands."""
        split = pc.split_pattern(pa.array([texts[i] for i in places], pa.large_string()), " ")
        found, cuts = split.flatten().dictionary_encode(), split.offsets.to_numpy()
        at = found.indices.to_numpy()
        ids = list(map(self.words.__getitem__, found.dictionary.to_numpy(zero_copy_only=False)))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begins, n = np.cumsum(sizes) - sizes, sizes[at]
        ends = np.cumsum(n)
        copied = np.frombuffer(b"".join(ids), "<u4")[np.arange(ends[-1]) + np.repeat(begins[at] - (ends - n), n)]
        for i, a, b in zip(places, ends[cuts[:-1]].tolist(), ends[cuts[1:] - 1].tolist(), strict=True):
            text = texts[i]
            out[i] = self.head(text[: text.find(" ")] if " " in text else text) + copied[a:b].tobytes()  # a first word has no space before it


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; it stays from task to task."""
    return Encoder(path)
