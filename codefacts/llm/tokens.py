"""Token ids of whole texts, found word by word and remembered within a bound."""

from __future__ import annotations

import os
from array import array

import numpy as np

TOKENIZER = "word_bpe_49k.json"
#: Words that a worker remembers since it last put some by, and as many that it put by; each takes some 200 bytes.
REMEMBERED = 150_000

_STATE: dict[str, Words] = {}
# Bytes as the letters of a byte-level vocabulary: printable ones stand for themselves, the others follow from 256 on.
_PRINTABLE = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
_OTHERS = [b for b in range(256) if b not in set(_PRINTABLE)]
_LETTERS = [chr(b) if b in set(_PRINTABLE) else chr(256 + _OTHERS.index(b)) for b in range(256)]


class Words(dict):
    """Ids of words as little-endian 16-bit bytes; a word is encoded when it is first asked for.

    When there are many, all are put by; those asked for again come back, so common words stay while rare ones go.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.put_by: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.put_by.get(word)
        if ids is None:
            core = word.rstrip(b".,;:!?#$%&*|")
            if core.isalpha() or _plain(core):
                low = core.lower()
                if len(core) < len(word):
                    ids = self[low] + self[word[len(core) :]]
                elif low != word:
                    ids = self[low]
                else:  # one piece of the tokenizer, already in its normal form: the model alone encodes it
                    letters = word.decode() if word.isascii() else "".join([_LETTERS[b] for b in word])
                    ids = array("H", [t.id for t in self.model.tokenize(letters)]).tobytes()
            else:
                ids = array("H", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()
        self[word] = ids
        return ids

    def forget(self) -> None:
        """Puts all words by if they are many; what was put by before goes."""
        if len(self) > REMEMBERED:
            self.put_by = dict(self)
            self.clear()


def _plain(core: bytes) -> bool:
    """Letters below U+0180, not all of them ASCII, in their normal form and lower case but for A to Z."""
    if core.isascii():
        return False
    letters = core.decode()
    return letters.isalpha() and max(letters) < "ƀ" and "ŉ" not in letters and letters.lower() == core.lower().decode()


def words(path: str) -> Words:
    """The remembered words of this worker."""
    if path not in _STATE:
        _STATE[path] = Words(path)
    return _STATE[path]


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of each text, as the tokenizer gives them for the whole text, without an end mark.

    White space only separates for this tokenizer, so the ids of a text are those of its words in turn. A text that names
    a special token goes through the tokenizer whole.
    """
    out, known = [], words(path)
    for text in texts:
        known.forget()
        if "<|" in text:
            out.append(np.array(known.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16))
            continue
        raw = text.encode("utf-8")
        if b"\xcc" not in raw and b"\xcd" not in raw:  # no combining marks: the case of A to Z does not change the normal form
            raw = raw.lower()
        out.append(np.frombuffer(b"".join(map(known.__getitem__, raw.split())), np.uint16))
    return out


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)
