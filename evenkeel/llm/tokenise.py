"""Exact, cached use of the tokenizers library.

Both vocabularies are read so that no token spans a space that follows a non-space character: the byte-level one starts
a new piece at such a space, the other drops white space.  A text is therefore cut there, and each distinct piece is
encoded by the library once per worker; the joined ids are those of the whole text.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces that each of the two halves of a worker's memory holds; about 250 MB in all.
CACHE_PIECES = 600_000

#: Pieces at the starts of texts and lines that a worker remembers.
CACHE_FIRST = 200_000

#: A space after white space (as Python has it), at which a piece may not end.
_AFTER_SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}] "
#: Letters before this one are composed, and have one lower-case letter each.
_BEYOND = "\u0130"

# Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others for the letters after U+00FF.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
_SPACE = _BYTES[32]
_SAMPLES = ("the", "The", "thoundring", "IT", "straße", "Élan", "ñandú", "ÿÖx", "a", "É")


def _shown(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)


_SIGN = re.compile(r"[!-/:-@\[-`{-~]")
_MARKS = frozenset(",.;:!?")
_CUT = re.compile(r"(?<=\S) ")
_ENCODERS: dict[str, PieceEncoder] = {}


class _Memory(dict):
    """Pieces with their ids, made when they are first asked for.  `old` holds the half that went before."""

    def __init__(self, make, old: dict | None = None):
        super().__init__()
        self.make, self.old = make, old or {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)  # does not ask it to make any
        if ids is None:
            ids = self.make(piece)
        self[piece] = ids
        return ids


class PieceEncoder:
    """Texts to ids, as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # pieces are remembered here, so that the library would only write its memory
        # How a word of plain letters reaches the vocabulary's model: with a mark for the space before it, or lower-cased.
        self.plain = None
        for plain, bare in ((lambda w: _SPACE + _shown(w), _shown), (lambda w: _shown(w.lower()),) * 2):
            if all(self._direct(plain(w)) == self._whole(" " + w) and self._direct(bare(w)) == self._whole(w) for w in _SAMPLES):
                self.plain, self.bare = plain, bare
        self.mark = self.plain("a")[:-1] if self.plain is not None else ""
        self.lower = self.plain is not None and self.plain("A")[-1] == "a"
        self.feed = self._whole("\n")
        self.pieces = _Memory(self._after_space)
        self.first = _Memory(self._at_start)
        self.tails = _Memory(self._whole)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _direct(self, shown: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _after_space(self, piece: str) -> bytes:
        """The ids of a piece that stands after a space.

        A word of letters is one piece to the library, which hands it to the vocabulary's model; here that is done
        without the steps before.  A line feed between two signs or letters is a piece of its own (or none), so that what
        stands before and after it is looked up apart.  Letters that an ASCII sign follows are a word of their own, so
        that a word with a short tail of signs is put together from the two.
        """
        if piece.isalpha():
            if self.plain is not None and max(piece) < _BEYOND:
                return self._direct(self.plain(piece))
        elif "\n" in piece:
            head, _, rest = piece.partition("\n")
            if head and rest and "\n" not in rest and not head[-1].isspace() and not rest[0].isspace():
                return self.pieces[head] + self.feed + self.first[rest]
        else:
            stem, tail = _tailed(piece)
            if tail:
                return self.pieces[stem] + self.tails[tail]
        return self._whole(" " + piece)

    def _at_start(self, piece: str) -> bytes:
        """The ids of a piece at the start of a text or line."""
        stem, tail = _tailed(piece)
        if tail:
            return self.first[stem] + self.tails[tail]
        if self.plain is not None and piece.isalpha() and (piece.isascii() or max(piece) < _BEYOND):
            return self._direct(self.bare(piece))
        return self._whole(piece)

    def _tidy(self) -> None:
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.old = {}
            self.pieces = _Memory(self._after_space, self.pieces)
        if len(self.first) + len(self.tails) > CACHE_FIRST:
            self.first.clear()
            self.tails.clear()

    def _alone(self, text: str) -> bytes:
        """The ids of one text."""
        if any(s in text for s in self.special):
            return self._whole(text)  # a special token may take the space beside it
        first, *rest = _CUT.split(text)
        return self.first[first] + b"".join(map(self.pieces.__getitem__, rest))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes."""
        self._tidy()
        return [self._alone(t) for t in texts]

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that stand after spaces; the most common new ones, words of letters and such words with a sign
        at the end, without the way through `_after_space`."""
        memory, old, tails, tokenize, mark, lower = self.pieces, self.pieces.old, self.tails, self.model.tokenize, self.mark, self.lower
        ids = list(map(memory.get, pieces))
        simple = self.plain is not None
        for i in [i for i, x in enumerate(ids) if x is None]:
            p = pieces[i]
            got = old.get(p)
            if got is None:
                if not (simple and p.isascii()):
                    got = self._after_space(p)
                elif p.isalpha():
                    got = array("I", [t.id for t in tokenize(mark + (p.lower() if lower else p))]).tobytes()
                elif p[-1:] in _MARKS and (stem := p[:-1]).isalpha():
                    head = memory.get(stem)
                    if head is None:
                        head = old.get(stem)
                        if head is None:
                            head = array("I", [t.id for t in tokenize(mark + (stem.lower() if lower else stem))]).tobytes()
                        memory[stem] = head
                    got = head + tails[p[-1]]
                else:
                    got = self._after_space(p)
            memory[p] = ids[i] = got
        return ids

    def encode_flat(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each with the end id (null: that alone), and their offsets.

        Texts are cut and their distinct pieces told apart by Arrow; only those are looked up, once for all texts.
        """
        self._tidy()
        texts = pc.fill_null(texts, "")
        hard = pc.match_substring_regex(texts, _AFTER_SPACE)
        for s in self.special:
            hard = pc.or_(hard, pc.match_substring(texts, s))
        alone = {i: self._alone(texts[i].as_py()) for i in np.flatnonzero(hard.to_numpy(zero_copy_only=False)).tolist()}
        if alone:
            texts = pc.if_else(hard, "", texts)
        cut = pc.split_pattern(texts, " ")
        offsets = cut.offsets.to_numpy().astype(np.int64)
        values = cut.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets -= offsets[0]
        coded = values.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.intp)
        heads = values.take(pa.array(offsets[:-1])).to_pylist()
        ids = self._ids_of(coded.dictionary.to_pylist())
        del cut, values, coded
        pa.default_memory_pool().release_unused()
        index[offsets[:-1]] = len(ids) + np.arange(len(texts))
        first = self.first
        ids += [alone[i] if i in alone else first[h] for i, h in enumerate(heads)]
        index = np.insert(index, offsets[1:], len(ids))
        ids.append(end.to_bytes(4, "little"))
        table = np.frombuffer(b"".join(ids), "<u4")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.cumsum(size) - size
        n = np.take(size, index)
        upto = np.cumsum(n)
        total = int(upto[-1]) if len(upto) else 0
        kind = np.int32 if max(total, len(table)) < 1 << 31 else np.int64
        at = np.repeat((np.take(start, index) - upto + n).astype(kind), n)
        at += np.arange(total, dtype=kind)
        return np.take(table, at), np.concatenate(([0], upto[offsets[1:] + np.arange(len(texts))]))


def _tailed(piece: str) -> tuple[str, str]:
    """(letters, one to three characters from an ASCII sign on), or the piece and nothing.

    U+0130 is left whole: its lower case ends in a mark that would go with the sign.
    """
    if piece[-1:] in _MARKS and piece[:-1].isalpha() and "\u0130" not in piece:
        return piece[:-1], piece[-1]
    m = _SIGN.search(piece)
    if m and len(piece) - m.start() <= 3 and not piece[-1].isspace() and piece[: m.start()].isalpha() and "\u0130" not in piece:
        return piece[: m.start()], piece[m.start() :]
    return piece, ""


def encoder(path: str) -> PieceEncoder:
    """One encoder per file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
