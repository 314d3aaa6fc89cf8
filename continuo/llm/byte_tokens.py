"""Token ids of whole texts by a byte-level BPE vocabulary whose pieces carry their leading space.

Where the tokenizer cuts texts by the usual byte-level pattern, a single space or newline between two visible
characters always begins a new piece, whatever stands around it. Texts are cut there, and each unit is encoded once
per worker; a bounded memo keeps what was encoded. Units beside longer white space are encoded together with it. This
equals encoding the whole text. Any other tokenizer encodes whole texts.
"""

from __future__ import annotations

import json
from array import array

import numpy as np

from continuo.llm.common import give_back
from continuo.llm.tokens import _byte_letters

#: Units that a worker remembers at most, and their length.
MAX_UNITS, MAX_UNIT_CHARS, MAX_TAILS = 400_000, 48, 1_000
_LOADED: dict[str, UnitTokenizer] = {}


class UnitTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype(self.code)
        with open(path, encoding="utf-8") as f:
            self.by_units = self._cuts_at_space(json.load(f))
        self.units: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    @staticmethod
    def _cuts_at_space(config: dict) -> bool:
        """The byte-level pattern alone, no normalisation, and no added token that holds or takes white space."""
        step = config.get("pre_tokenizer") or {}
        byte_level = step.get("type") == "ByteLevel" and step.get("use_regex") and not step.get("add_prefix_space")
        added = config.get("added_tokens", [])
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])) for t in added)
        return bool(byte_level and plain and not config.get("normalizer"))

    def _encode(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str, lead: str) -> bytes:
        """The ids of a run of letters and the space before it, if any: one piece, straight through the merges."""
        spelled = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        return array(self.code, [t.id for t in self.model.tokenize(lead + spelled)]).tobytes()

    def _few(self, text: str) -> bytes:
        """The ids of an ending or a newline, of which few exist."""
        got = self.tails.get(text)
        if got is None:
            got = self._encode(text)
            if len(self.tails) < MAX_TAILS:
                self.tails[text] = got
        return got

    def _unit(self, unit: str) -> bytes | None:
        """The ids of a unit with its space before it; None if white space beside it decides."""
        line = unit[:1] == "\n"
        core = unit[1:] if line else unit
        if not core or core[0].isspace() or core[-1].isspace():
            return None
        word = core.rstrip(".,")
        if not word.isalpha() or not (word.isascii() or max(word) <= "\u00ff"):
            return self._remember(unit, self._encode(unit if line else " " + unit))
        known = unit[: len(word) + line]
        got = self.units.get(known)
        if got is None:
            got = self._few("\n") + self._letters(word, "") if line else self._letters(word, self.letters[32])
            self._remember(known, got)
        if len(word) < len(core):  # letters end a piece before punctuation
            got = self._remember(unit, got + self._few(core[len(word) :]))
        return got

    def _remember(self, unit: str, ids: bytes) -> bytes:
        if len(self.units) < MAX_UNITS and len(unit) <= MAX_UNIT_CHARS:
            self.units[unit] = ids
        return ids

    def forget(self) -> None:
        """Drops the memo; the worker lives on beside other stages."""
        self.units, self.tails = {}, {}
        give_back()

    def ids(self, text: str) -> bytes:
        if not self.by_units or not text:
            return self._encode(text)
        first, *units = text.replace("\n", " \n").split(" ")
        known, unit = self.units, self._unit
        out = [known[u] if u in known else unit(u) for u in units]
        if None in out or first[-1:].isspace():
            return self._beside_space(first, units, out)
        return b"".join([self._encode(first), *out])

    def _beside_space(self, first: str, units: list[str], known: list[bytes | None]) -> bytes:
        """Units beside longer white space are joined with their neighbours before they are encoded."""
        out, waiting, open_end = [], [first], first[-1:].isspace()
        whole: bytes | None = None if open_end else self._encode(first)
        for unit, ids in zip(units, known, strict=True):
            core = unit[1:] if unit[:1] == "\n" else unit
            if not open_end and core and not core[0].isspace():
                out.append(self._encode("".join(waiting)) if whole is None else whole)
                waiting, whole = [], ids
            else:
                whole = None
            waiting.append(unit if unit[:1] == "\n" else " " + unit)
            open_end = not core or core[-1].isspace()
        out.append(self._encode("".join(waiting)) if whole is None else whole)
        return b"".join(out)


def load(path: str) -> UnitTokenizer:
    if path not in _LOADED:
        _LOADED[path] = UnitTokenizer(path)
    return _LOADED[path]
