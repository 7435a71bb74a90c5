"""Byte-level BPE encoding with the tokenizers library, at corpus speed.

A byte-level BPE never merges across the pieces of its splitting pattern, so a
text's ids are the ids of its pieces one after another.  Words repeat: each distinct
piece goes through the library once and is remembered as bytes.  Pieces are cut by
the same pattern with its classes spelled out up to U+024F, which is much faster;
texts with characters beyond go through the library whole.

A string of an added token inside a text gets that token's id, as in the library's plain call;
such texts go through the library whole.  With ``specials_as_text`` these strings are ordinary text
(``encode_special_tokens``): then a document can't forge a control id.
"""

from __future__ import annotations

import gc
import re
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np

from driftloom.llm.common import limit_threads

#: The public file that the production queries use.
DEFAULT_TOKENIZER = "byte_bpe_50k.json"
#: Distinct pieces that one Python worker remembers (about 200 bytes each).  Beyond
#: that it keeps the half that it saw first: those are the frequent ones.
MEMO_PIECES = 640_000
#: Longer pieces aren't remembered.
MEMO_LENGTH = 64
#: Texts whose pieces are looked up together.
GROUP = 256

#: Unicode's letters, numbers and white space up to U+024F.
_L = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_N = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_S = "\\t-\\r \u0085\u00a0"
_split = re.compile(f" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[^{_S}{_L}{_N}]+| ?[{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall
_beyond = re.compile("[^\x00-\u024f]").search
_word = re.compile(f" ?[{_L}]+").fullmatch


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, specials_as_text: bool = False) -> None:
        limit_threads()
        import public_tokenizers
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path if "/" in path else public_tokenizers.path(path))
        self._tokenizer.encode_special_tokens = specials_as_text
        added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values() if not (specials_as_text and t.special)]
        self._added = re.compile("|".join(map(re.escape, added))).search if added else None
        self._tokenizer.model._resize_cache(0)  # what comes here is new
        self._known: dict[str, bytes] = {}
        (self._newline,) = self._tokenizer.encode("\n", add_special_tokens=False).ids

    def _through_library(self, texts: list[str]) -> list[bytes]:
        encode = self._tokenizer.encode_batch_fast
        return [array("I", e.ids).tobytes() for e in encode(texts, add_special_tokens=False)]

    def _words_through_library(self, words: list[str]) -> list[bytes]:
        """The same for pieces of letters; many to a text, a newline's id between."""
        out: list[bytes] = []
        texts = ["\n".join(words[k : k + 500]) for k in range(0, len(words), 500)]
        for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(e.ids, dtype="<u4")
            raw, at = ids.tobytes(), 0
            for end in (np.flatnonzero(ids == self._newline) * 4).tolist():
                out.append(raw[at:end])
                at = end + 4
            out.append(raw[at:])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text, in order."""
        out: list[bytes] = []
        collecting = gc.isenabled()
        gc.disable()  # millions of lists and strings, none in a cycle
        try:
            for at in range(0, len(texts), GROUP):
                out += self._encode_group(texts[at : at + GROUP])
        finally:
            if collecting:
                gc.enable()
        return out

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        known = self._known
        if len(known) > MEMO_PIECES:
            known = self._known = dict(islice(known.items(), MEMO_PIECES // 2))
        get = known.get
        beyond = [not t.isascii() and _beyond(t) is not None for t in texts]
        if self._added:
            beyond = [far or self._added(t) is not None for t, far in zip(texts, beyond, strict=True)]
        pieces = [[] if far else _split(t) for t, far in zip(texts, beyond, strict=True)]
        parts = [list(map(get, own)) for own in pieces]
        gaps = [[k for k, ids in enumerate(own) if ids is None] if None in own else () for own in parts]
        new = {own[k] for own, at in zip(pieces, gaps, strict=True) for k in at}
        words = list(filter(_word, new))
        fresh = dict(zip(words, self._words_through_library(words), strict=True))
        others = list(new.difference(fresh))
        fresh.update(zip(others, self._through_library(others), strict=True))
        if max(map(len, new), default=0) <= MEMO_LENGTH:
            known.update(fresh)
        else:
            known.update((k, v) for k, v in fresh.items() if len(k) <= MEMO_LENGTH)
        for own, own_parts, at in zip(pieces, parts, gaps, strict=True):
            for k in at:
                own_parts[k] = fresh[own[k]]
        out = list(map(b"".join, parts))
        far = [k for k, is_far in enumerate(beyond) if is_far]
        for k, ids in zip(far, self._through_library([texts[k] for k in far]), strict=True):
            out[k] = ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str = DEFAULT_TOKENIZER, specials_as_text: bool = False) -> PieceEncoder:
    """This Python worker's encoder."""
    return PieceEncoder(path, specials_as_text)
