"""Token ids of whole texts by a vocabulary file of the tokenizers library, as little-endian bytes.

Where the tokenizer drops white space, a text is split at ASCII spaces and newlines and each part
is encoded once per worker; a bounded memo keeps what was encoded. This equals encoding the whole
text: no pattern, normalisation or merge of such a tokenizer crosses white space. Any other
tokenizer encodes whole texts.
"""

from __future__ import annotations

import json

import numpy as np

from continuo.llm.common import give_back

#: Parts that a worker remembers at most, and their length.
MAX_PARTS, MAX_PART_CHARS = 500_000, 48
_LOADED: dict[str, WordTokenizer] = {}


def _byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level BPE: visible Latin-1 as itself, others from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


class WordTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        with open(path, encoding="utf-8") as f:
            self.by_parts = self._drops_space(json.load(f))
        self.letters = _byte_letters()
        self.parts: dict[str, bytes] = {"": b""}
        self.most = MAX_PARTS

    @staticmethod
    def _drops_space(config: dict) -> bool:
        """Letter runs, single digits and other visible runs, each on its own, and white space dropped."""
        steps = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
        normalizers = [n.get("type") for n in (config.get("normalizer") or {}).get("normalizers", [])]
        wanted = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] or "\n" in t["content"]) for t in config.get("added_tokens", []))
        byte_level = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
        return plain and byte_level and steps[0] == wanted and normalizers == ["NFC", "Replace", "Lowercase"]

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _run(self, run: str) -> bytes:
        """A lower-case letter run of Latin-1, straight through the library's merges."""
        spelled = run if run.isascii() else "".join(self.letters[b] for b in run.encode())
        return np.array([t.id for t in self.model.tokenize(spelled)], dtype=self.dtype).tobytes()

    def _part(self, part: str) -> bytes:
        """A part's ids. A word with other case or punctuation behind it is put together of remembered ones."""
        if len(part) > MAX_PART_CHARS:
            return self._encode(part)
        word = part.rstrip(".,")
        if word.isalpha() and max(word) <= "ÿ":
            lower = word.lower()
            got = self.parts.get(lower)
            if got is None:
                got = self._remember(lower, self._run(lower))
            if lower == part:
                return got
            if tail := part[len(word) :]:
                got += self.parts[tail] if tail in self.parts else self._remember(tail, self._encode(tail))
        else:
            got = self._encode(part)
        return self._remember(part, got)

    def _remember(self, part: str, ids: bytes) -> bytes:
        if len(self.parts) < self.most:
            self.parts[part] = ids
        return ids

    def forget(self) -> None:
        """Drops the memo; the worker lives on beside other stages."""
        self.parts = {"": b""}
        give_back()

    def ids(self, text: str) -> bytes:
        if not self.by_parts:
            return self._encode(text)
        known, part = self.parts, self._part
        return b"".join([known[p] if p in known else part(p) for p in text.replace("\n", " ").split(" ")])


def load(path: str, most: int = MAX_PARTS) -> WordTokenizer:
    """The worker's tokenizer; from now on it remembers ``most`` parts."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    _LOADED[path].most = most
    return _LOADED[path]


def crc32_of(ids: np.ndarray) -> int:
    import zlib

    return zlib.crc32(ids.astype("<u4").tobytes())
