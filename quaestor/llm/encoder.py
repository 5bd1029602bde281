"""Token ids by the tokenizers library, each distinct piece of text encoded once in a worker.

A byte-level BPE tokenizer cuts a text by a pattern and encodes each part alone. Between two parts a text can be cut if both sides are cut
alike without the other; that holds, whatever stands around, (a) after a letter, digit or mark, before a blank; (b) before a space with one of
these behind it; (c) after another blank that stands between two of these; (d) after a letter, before a mark. Letters,
digits and marks here are those of ASCII and of the Latin letters U+00C0 to U+00FF. So pieces between such places are encoded apart, and equal
ones share their ids. A text that holds the content of an added token (as <|endoftext|>) is one piece, for the library alone to cut.
Equal pieces are known by a 64-bit hash and their length.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np

from quaestor.llm.packs import hash_spans

#: Places for remembered pieces in a worker (20 bytes each); a piece goes to one place by its hash, and a later one with that place takes it over.
PLACES = 1 << 21
#: Ids of remembered pieces. When they fill up, a worker forgets all pieces.
POOL = 8 << 20
STEP = 4_000  # pieces encoded at once

_PLAIN = re.compile(rb" ?(?:[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])+")
_LATIN = 0xC3  # first byte of U+00C0 to U+00FF
_NO_LETTER = (0x97, 0xB7)  # second byte of the two of these that are marks


def _symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


SYMBOLS = _symbols()


def _places(data: np.ndarray) -> np.ndarray:
    """Whether a text can be cut before each byte; data has two bytes or more."""
    latin = np.zeros(len(data), bool)  # second byte of a Latin letter or mark
    latin[1:] = data[:-1] == _LATIN
    sign = latin & ((data == _NO_LETTER[0]) | (data == _NO_LETTER[1]))
    within = lambda x, low, n: x - np.uint8(low) < n
    solid, letter, digit = within(data, 0x21, 94), within(data | np.uint8(0x20), 97, 26), within(data, 48, 10)
    space = data == 0x20
    other = within(data, 9, 2) | (data == 13)
    ends, begins = solid | latin, solid | (data == _LATIN)
    cut = np.zeros(len(data), bool)
    cut[1:] = ends[:-1] & (space | other)[1:] | (letter | latin & ~sign)[:-1] & (solid & ~letter & ~digit)[1:]
    cut[1:-1] |= space[1:-1] & begins[2:]
    cut[2:] |= ends[:-2] & other[1:-1] & begins[2:]
    return cut



class Encoder:
    """added: the content of an added token in a text is that token, as by the library's plain encode; else it is encoded as any text."""

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        #: The cuts above hold for this kind of tokenizer only; others encode whole texts.
        self.by_pieces = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        contents = [t["content"] for t in spec.get("added_tokens") or []] if added else []
        #: Finds the added tokens' contents.
        self.added = re.compile(b"|".join(re.escape(t.encode()) for t in contents)) if contents else None
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(PLACES, np.uint64)
        self.begins = np.zeros(PLACES, np.int32)
        self.lengths = np.zeros(PLACES, np.int32)
        self.widths = np.zeros(PLACES, np.int32)  # bytes of each piece, which must agree too
        self.pool, self.filled = np.empty(POOL, self.kind), 0

    def pieces(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte spans that cover all texts; data holds them one after another."""
        if not self.by_pieces:
            starts = np.concatenate([[0], ends[:-1]])
        else:
            cut = np.zeros(len(data) + 1, bool)
            # Neighbours from another text must not count: a line feed that ends one stands before no letter of the next.
            cut[:-1] = _places(data) if len(data) > 1 else False
            if len(data) > 1:
                inner = ends[ends < len(data)]
                near = np.unique(np.concatenate([inner - 1, inner + 1]))
                cut[near[(near > 0) & (near < len(data))]] = False
            if self.added:
                raw, after = data.tobytes(), 0
                for found in self.added.finditer(raw):
                    if found.start() >= after:
                        text = np.searchsorted(ends, found.start(), side="right")
                        after = int(ends[text])
                        cut[int(ends[text - 1]) if text else 0 : after] = False
            cut[0] = True
            cut[ends] = True
            starts = np.flatnonzero(cut[:-1])
        stops = np.append(starts[1:], len(data))
        return starts[stops > starts], stops[stops > starts]

    def _encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece. Letters, with or without a space before, are one part for the model, which needs no pattern then."""
        out, rest = [], []
        for i, piece in enumerate(pieces):
            plain = self.by_pieces and _PLAIN.fullmatch(piece)
            out.append([t.id for t in self.tokenizer.model.tokenize(piece.decode("latin-1").translate(SYMBOLS))] if plain else None)
            if not plain:
                rest.append(i)
        found = self.tokenizer.encode_batch_fast([pieces[i].decode("utf-8", "replace") for i in rest], add_special_tokens=False)
        for i, e in zip(rest, found):
            out[i] = e.ids
        return out

    def _missing(self, data, start, stop) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where each piece's ids begin, their number, all ids) of pieces that aren't remembered."""
        counts, ids = [np.zeros(0, np.int64)], [np.empty(0, self.kind)]
        for lo in range(0, len(start), STEP):
            found = self._encode([data[a:b].tobytes() for a, b in zip(start[lo : lo + STEP], stop[lo : lo + STEP])])
            counts.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), self.kind, int(counts[-1].sum())))
        lengths = np.concatenate(counts)
        return np.cumsum(lengths) - lengths, lengths, np.concatenate(ids)

    def _remember(self, keys, widths, begins, lengths, ids) -> None:
        if self.filled + len(ids) > POOL:
            self._forget()
        if len(ids) > POOL:
            return
        at = (keys & np.uint64(PLACES - 1)).astype(np.int64)
        self.pool[self.filled : self.filled + len(ids)] = ids
        # Of keys with one place the last is written by each of these, so that they agree.
        self.keys[at], self.widths[at] = keys, widths
        self.begins[at], self.lengths[at] = self.filled + begins, lengths
        self.filled += len(ids)

    def spans(self, data: np.ndarray, ends: np.ndarray):
        """(piece starts, piece stops, tokens of each piece, all ids) of texts in data that end at ends."""
        start, stop = self.pieces(data, ends)
        if not len(start):
            return start, stop, np.empty(0, np.int64), np.empty(0, self.kind)
        keys, widths = hash_spans(data, start, stop), stop - start
        at = (keys & np.uint64(PLACES - 1)).astype(np.int64)
        known = (self.keys[at] == keys) & (self.widths[at] == widths)
        begins, lengths, values = self.begins[at].astype(np.int64), self.lengths[at].astype(np.int64), self.pool
        lost = np.flatnonzero(~known)
        if len(lost):
            fresh, first, place = np.unique(keys[lost], return_index=True, return_inverse=True)
            first = lost[first]
            own_begins, own_lengths, ids = self._missing(data, start[first], stop[first])
            values = np.concatenate([values[: self.filled], ids])
            begins[lost], lengths[lost] = self.filled + own_begins[place], own_lengths[place]
            self._remember(fresh, widths[first], own_begins, own_lengths, ids)
        out, _ = gather(values, begins, lengths)
        return start, stop, lengths, out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each begins and the number at last)."""
        ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
        start, _, lengths, ids = self.spans(np.frombuffer(b"".join(texts), np.uint8), ends)
        edge = np.searchsorted(start, np.concatenate([[0], ends]))
        return ids, np.concatenate([[0], np.cumsum(lengths)])[edge]


def gather(values: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[begins[i] : begins[i] + lengths[i]] one after another, and where each begins."""
    at = np.concatenate([[0], np.cumsum(lengths)])
    narrow = np.int32 if max(len(values), at[-1]) < 1 << 31 else np.int64
    index = np.arange(at[-1], dtype=narrow)
    index += np.repeat((begins - at[:-1]).astype(narrow), lengths)
    return values[index], at


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, added: bool = False) -> Encoder:
    """One for each file, kind and worker."""
    if (path, added) not in _ENCODERS:
        _ENCODERS[path, added] = Encoder(path, added)
    return _ENCODERS[path, added]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
