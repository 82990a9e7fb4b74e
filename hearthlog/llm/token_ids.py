"""Token ids by the tokenizers library, with frequent words encoded once a worker."""

from __future__ import annotations

import json
import os
import re
from array import array

from hearthlog.llm.bpe import letters_of
from hearthlog.llm.common import SegmentCache, kept


#: What a worker keeps of segments, where a caller doesn't say.
MOST_BYTES = 96_000_000


class IdCache:
    """Encodes by a tokenizers file.

    With the byte-level pattern (no normaliser, no prefix space) a text is encoded by the segments of SegmentCache.
    A segment of letters and closing marks, or of two such with a line's end between them, is at most five pre-tokens,
    each of which goes to the library's model directly; all other segments, texts that spell a special token, and
    texts under other pre-tokenisers go through `Tokenizer.encode`.
    """

    _LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-ɏ]+", r"[!-&(-/:-@\[-`{-~]*"  # an apostrophe may begin a contraction
    WORD = re.compile(f"( ?{_LETTERS})({_MARKS})(?:\n({_LETTERS})({_MARKS}))?")

    def __init__(self, path: str, most_bytes: int = MOST_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(self.tokenizer.to_str())
        level = spec["pre_tokenizer"] or {}
        self.by_segments = not spec["normalizer"] and level.get("type") == "ByteLevel" and level.get("use_regex") and not level.get("add_prefix_space")
        self.tokenize = self.tokenizer.model.tokenize
        self.pieces: dict[str, bytes] = {}
        self.cache = SegmentCache(self._encode_segment if self.by_segments else self._encode, most_bytes)

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, text: str) -> bytes:
        # Spaces and line ends are the only characters of ASCII segments that come here which have other letters.
        letters = text.replace(" ", "Ġ").replace("\n", "Ċ") if text.isascii() else letters_of(text.encode())
        return array("I", [t.id for t in self.tokenize(letters)]).tobytes()

    def _encode_segment(self, segment: str) -> bytes:
        body = segment[1:] if segment[:1] == " " else segment
        if body.isascii() and body.isalpha():
            return self._piece(segment)
        plain = self.WORD.fullmatch(segment)
        if plain is None:
            return self._encode(segment)
        word, marks, next_word, next_marks = plain.groups()
        if not marks and next_word is None:
            return self._piece(word)
        known = self.cache.later.get(word[1:]) if word[0] == " " else None
        out = (known or self._piece(word)) + self._marks(marks)
        if next_word is None:
            return out
        return out + self._marks("\n") + self.cache.first[next_word] + self._marks(next_marks)

    def _marks(self, marks: str) -> bytes:
        if len(marks) > 2:
            return self._piece(marks)
        if marks not in self.pieces:
            self.pieces[marks] = self._piece(marks) if marks else b""
        return self.pieces[marks]

    def encode(self, texts: list[str]):
        """Yields the ids of each text as little-endian unsigned 32-bit integers."""
        whole = {i for i, t in enumerate(texts) if not self.by_segments or any(s in t for s in self.special)}
        for i, ids in enumerate(self.cache.encode(["" if i in whole else t for i, t in enumerate(texts)])):
            yield self._encode(texts[i]) if i in whole else ids


def id_cache(path: str, most_bytes: int = MOST_BYTES) -> IdCache:
    """One for each Python worker, until an operator of another kind uses the worker."""
    return kept((path, most_bytes), lambda: IdCache(path, most_bytes))
