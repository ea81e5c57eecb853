"""Token identifiers of whole texts, by the tokenizers library, remembered word by word.

For tokenizers that lower-case, drop white space and mark word ends, a text's
identifiers are those of its white-space separated chunks laid end to end. Each
new chunk is encoded by the library and then remembered, if it is short, in two
bounded generations. Chunks of ASCII and Latin-1 characters are cut at the same
places as the tokenizer's own pattern would cut them, many at once, and go to the
library's model without its normaliser and pattern, which cost more than the
model; all others go through the whole tokenizer. Texts with the four control
characters that Python, but not the tokenizer, holds to be white space go to the
library whole, as do all texts of a tokenizer of another kind.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa

from knotwork.llm.common import forgettable, utf8

#: Entries in one generation of remembered chunks, bytes of their identifiers, and characters of the longest chunk remembered.
REMEMBERED, REMEMBERED_BYTES, LONGEST = 1 << 18, 32 << 20, 64
#: New chunks that are cut and encoded at once.
AT_ONCE = 8192

# The normaliser and pre-tokenizer of the kind of tokenizer whose texts can be encoded chunk by chunk.
_NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}

_ODD = "\x1c\x1d\x1e\x1f"
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)


def byte_letters() -> list[str]:
    """The published one-letter names of the 256 bytes, by their rule: printable bytes stand for themselves."""
    named = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return [chr(b) if b in named else chr(next(rest)) for b in range(256)]


def _kinds() -> np.ndarray:
    """What each Latin-1 character is to the pattern; those it treats by longer rules are kept away."""
    kind = np.full(256, _OTHER, np.uint8)
    for c in range(256):
        if chr(c).isalpha():
            kind[c] = _LETTER
        elif chr(c).isnumeric():
            kind[c] = _DIGIT
        elif chr(c).isspace():
            kind[c] = _SPACE
    return kind


class ChunkEncoder:
    """Identifiers as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        self.tokenizer = Tokenizer.from_file(path)
        self.by_chunk = (
            spec["normalizer"] == _NORMALISER and spec["pre_tokenizer"] == _PRE_TOKENIZER and model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>"
            and not model["dropout"] and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or t["content"].split() != [t["content"]] for t in added)
        )
        self.added = [t["content"] for t in added]
        self.young, self.old, self.held = {}, {}, 0
        if self.by_chunk:
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
            self.ends[[i for s, i in model["vocab"].items() if s.endswith("</w>")]] = True
            self.kinds = _kinds()
            self.letters = np.array([ord(c) for c in byte_letters()], "<u4")
            self.letters[ord(" ")] = ord(" ")

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Identifiers of each of some chunks, none of them empty."""
        joined, apart = " ".join(chunks), ["'", *self.added]
        if not joined.isascii() or any(a in joined for a in apart):
            plain = [max(c) <= "ÿ" and not any(a in c for a in apart) for c in chunks]
            if not all(plain):
                made = iter(self._cut(" ".join([c for c, p in zip(chunks, plain, strict=True) if p])))
                rest = iter(self._whole([c for c, p in zip(chunks, plain, strict=True) if not p]))
                return [next(made if p else rest) for p in plain]
        return self._cut(joined)

    def _cut(self, joined: str) -> list[bytes]:
        """Identifiers of each chunk of a text of Latin-1 characters, with one blank between chunks."""
        if not joined:
            return []
        low = np.frombuffer(joined.lower().encode("latin-1"), np.uint8)
        kind = self.kinds[low]
        # a piece begins where the kind changes, and each digit is one; blanks divide chunks
        begins = np.empty(len(low), bool)
        begins[0] = True
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        blank = kind == _SPACE
        begins &= ~blank
        inner = begins.copy()
        inner[0] = False
        inner[1:] &= ~blank[:-1]
        pieces = np.cumsum(begins)
        last = np.append(pieces[np.flatnonzero(blank)], pieces[-1])
        spaced = np.insert(low, np.flatnonzero(inner), ord(" "))
        raw = np.frombuffer(spaced.tobytes().decode("latin-1").encode(), np.uint8)
        ids = np.array(self.model.encode_batch_fast([self.letters[raw].tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, "<u4")
        stops = (np.flatnonzero(self.ends[ids]) + 1)[last - 1] * 4
        data = ids.tobytes()
        ends = stops.tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode(self, texts: list[str], odd: bool) -> list[bytes]:
        """``odd``: a text may hold characters 1C to 1F."""
        if not self.by_chunk:
            return self._whole(texts)
        if odd:
            return [self._whole([t])[0] if any(c in t for c in _ODD) else self.encode([t], False)[0] for t in texts]
        split = [t.split() for t in texts]
        words = list(chain.from_iterable(split))
        found = list(map(self.young.get, words))
        unknown = [k for k, ids in enumerate(found) if ids is None]
        own = self._learnt({words[k] for k in unknown})
        for k in unknown:
            found[k] = own[words[k]]
        stops = list(accumulate(map(len, split)))
        return [b"".join(found[a:b]) for a, b in zip([0, *stops], stops, strict=False)]

    def _learnt(self, new: set[str]) -> dict[str, bytes]:
        """Identifiers of chunks that the young generation lacks; the short ones join it."""
        old = self.old
        out = {w: old[w] for w in new if w in old} if old else {}
        fresh = [w for w in new if w not in out]
        for i in range(0, len(fresh), AT_ONCE):
            part = fresh[i : i + AT_ONCE]
            out.update(zip(part, self._chunks(part), strict=True))
        if len(self.young) + len(out) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.old, self.young, self.held = self.young, {}, 0
        self.held += sum(map(len, out.values()))
        self.young.update(out)
        for w in new:
            if len(w) > LONGEST:
                self.held -= len(self.young.pop(w))
        return out


@forgettable
@lru_cache(2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def encode_column(column: pa.Array, path: str, most: int = 1 << 20):
    """Yield the identifiers of each row of a text column (null: none), a little at a time."""
    own = encoder(path)
    buf, offs = utf8(column)
    odd = bool(((buf >= 0x1C) & (buf <= 0x1F)).any())
    texts = column.to_pylist()
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield from own.encode([t or "" for t in texts[i:j]], odd)
        i = j
