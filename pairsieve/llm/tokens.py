"""Token ids of whole texts with a public tokenizer, batch by batch inside Arrow tasks.

The tokenizer treats every stretch between ASCII white space on its own, so each distinct stretch
of a batch is encoded once and the ids are laid out by array operations.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that the tokenizer's lower-casing and normalisation leave alone, and the units it
#: makes of them: letters together, digits one by one, other signs together (fixed values).
PLAIN = re.compile(r"[a-zà-öø-ÿ0-9!-&(-/:;=-@\[-`{-~]+")
UNITS = re.compile(r"[a-zà-öø-ÿ]+|[0-9]|[!-&(-/:;=-@\[-`{-~]+")
#: Distinct units remembered per worker; only speed depends on it.
REMEMBERED = 600_000

_encoders: dict[str, "WordEncoder"] = {}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(name: str) -> "WordEncoder":
    """The worker's encoder for a vocabulary file, loaded once per process."""
    if name not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[name] = WordEncoder(vocabulary_path(name))
    return _encoders[name]


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of all texts as one dictionary-coded array, and the words per text.

    Null texts have none.  Leading or trailing white space leaves empty words behind.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    return lists.flatten().dictionary_encode(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)


class WordEncoder:
    """Encodes with the tokenizers library, without special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # ids of letters and of signs, as the bytes of unsigned 32-bit numbers
        self.letters: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {}
        self.stops = {mark: self._unit(mark, self.signs) for mark in ".,"}

    def word(self, word: str) -> bytes:
        """Ids of one stretch without ASCII white space.

        The units of a plain lower-cased stretch go straight to the tokenizer's model; everything
        else, apostrophes and angle brackets included, takes the full path.
        """
        plain, letters = word.lower(), self.letters
        if plain in letters:
            return letters[plain]
        stop = self.stops.get(plain[-1:], b"")
        core = plain[:-1] if stop else plain
        if core in letters:
            return letters[core] + stop
        if core.isascii() and core.isalpha():
            return self._unit(core, letters) + stop
        if not PLAIN.fullmatch(plain):
            return array("I", self.whole.encode(word, add_special_tokens=False).ids).tobytes()
        return b"".join([letters.get(u) or self._unit(u, letters if u.isalpha() else self.signs) for u in UNITS.findall(plain)])

    def _unit(self, unit: str, known: dict[str, bytes]) -> bytes:
        ids = known.get(unit)
        if ids is None:
            if len(known) >= REMEMBERED:
                known.clear()
            shown = unit if unit.isascii() else self.bytes.pre_tokenize_str(unit)[0][0]
            ids = known[unit] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return ids

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and where each text begins (one more entry)."""
        words, per_text = split_words(texts)
        known = list(map(self.word, words.dictionary.to_numpy(zero_copy_only=False).tolist()))
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat = np.frombuffer(b"".join(known), np.uint32)
        begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(known) else np.zeros(0, np.int64)
        index = words.indices.to_numpy(zero_copy_only=False)
        sizes = lengths[index] if len(known) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        places = np.repeat(begins[index] - ends[:-1], sizes) if len(known) else np.zeros(0, np.int64)
        ids = flat[places + np.arange(ends[-1])]
        text_ends = np.concatenate([[0], np.cumsum(per_text)])
        return ids, ends[text_ends]


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
