"""Token ids of whole texts with the tokenizers library, at the speed of a dictionary look-up.

Both vocabularies split a text into units before they merge, and a blank followed by a character that is no white
space always starts a new unit. A text is therefore cut there; pieces such as ``word,`` and ``end.\nNext`` are cut
once more into words, signs and line breaks, which are units too. The library encodes each distinct unit once, and
the ids of a text are the joined ids of its units: the same ids as from the whole text.

Texts of ASCII and Latin letters, digits, signs, single blanks and line breaks, which are most, are cut with numpy, many at
a time: units are looked up by a 64-bit hash, so only units not seen before become strings. The bytes of every unit are then
compared with those its hash stands for; a text with a unit that only shares the hash goes the other way. All others
(apostrophes, other scripts, tabs, runs of white space, marks of special tokens, very long texts) go through a dictionary
of their pieces.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterable

import numpy as np
from tokenizers import Tokenizer

#: Pieces, and units, in one of the two generations that a worker keeps: its memory stays bounded however many
#: distinct ones a corpus has, and frequent ones outlive a change of generation.
CACHE_PIECES = 200_000
#: Pieces looked up at a time, few enough for the processor's cache.
_GROUP = 40_000

_BLANK_BEFORE_SPACE = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r" (?=\S)")
_LETTERS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
_LETTERS_THEN_SIGNS = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]+)")


def cut(text: str) -> list[str]:
    """Pieces of a text; each but the first lost its leading blank."""
    return _CUT.split(text) if _BLANK_BEFORE_SPACE.search(text) else text.split(" ")


#: Classes of bytes: other, letter, digit, sign, blank, line break, end of a text. 0xC3 and what may follow it are letters.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]] = 1
_CLASS[48:58] = 2
_CLASS[[i for i in range(33, 127) if not chr(i).isalnum() and i != 39]] = 3
_CLASS[32], _CLASS[10], _CLASS[0] = 4, 5, 6
#: Bytes cut at a time; longer texts are cut piece by piece.
_BUFFER = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2**64."""
    size = 2 * _BUFFER + 2
    out = []
    for base in (_BASE, _INVERSE):
        powers = np.full(size, base, np.uint64)
        powers[0] = 1
        out.append(np.cumprod(powers, dtype=np.uint64))
    return out[0], out[1]


def _plain(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each text of the buffer (each ends with a 0 byte at ``ends``) can be cut by classes of bytes."""
    before = np.concatenate([np.zeros(1, np.uint8), data[:-1]])
    kind, last = _CLASS[data], _CLASS[before]
    led = before == 0xC3
    odd = (kind == 0) | ((data >= 0x80) & (data < 0xC0) & ~led) | (led & ((data == 0x97) | (data == 0xB7)))
    odd |= (kind >= 4) & (kind <= 5) & (last >= 4) | (kind == 6) & (last >= 4) & (last <= 5)
    starts = np.concatenate([[0], ends[:-1] + 1])
    return ~np.logical_or.reduceat(odd, starts) & (data[starts] != 0)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start, start + 1, … of every stretch, one behind the other."""
    done = np.cumsum(lengths)
    return np.repeat(starts - done + lengths, lengths) + np.arange(int(done[-1]) if len(done) else 0)


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of ``data`` on as one number; its last eight bytes are only there to be read."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def _same(a: np.ndarray, starts: np.ndarray, lengths: np.ndarray, b: np.ndarray, other_starts: np.ndarray, other_lengths: np.ndarray) -> np.ndarray:
    """Whether each stretch of bytes of ``a`` (none is empty) equals its stretch of ``b``: by its first and last eight bytes,
    which are all of it up to sixteen, and byte by byte beyond. Both arrays end with eight bytes that belong to no stretch."""
    first, second = _eights(a), _eights(b)
    same = (lengths == other_lengths) & ((first[starts] ^ second[other_starts]) & _MASKS[np.minimum(lengths, 8)] == 0)
    some = np.flatnonzero(same & (lengths > 8))
    if len(some):
        back = lengths[some] - 8
        same[some] = first[starts[some] + back] == second[other_starts[some] + back]
        some = some[same[some] & (back > 8)]
    if len(some):
        n = lengths[some]
        differ = a[_spread(starts[some], n)] != b[_spread(other_starts[some], n)]
        same[some] = ~np.logical_or.reduceat(differ, np.cumsum(n) - n)
    return same


class Generations:
    """Dictionary of bounded size: when the young generation is full, it replaces the old one."""

    def __init__(self, limit: int):
        self.limit = limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def recall(self, keys: Iterable[str]) -> dict[str, bytes]:
        """Values of those keys that the old generation has; they become young again."""
        old = self.old
        found = {k: old[k] for k in keys if k in old}
        self.add(found)
        return found

    def add(self, values: dict[str, bytes]) -> None:
        if len(self.young) + len(values) > self.limit:
            self.old, self.young = self.young, {}
        self.young.update(values)


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str, keeps_blanks: bool, limit: int = CACHE_PIECES):
        """``keeps_blanks``: the vocabulary has tokens with a leading blank (byte level), so the first piece of a
        text differs from the same piece behind a blank. Otherwise it drops white space, ignores case and marks
        the ends of words."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_blanks, self.limit = keeps_blanks, limit
        self.lead = " " if keeps_blanks else ""
        self.known, self.first, self.units = Generations(limit), Generations(limit), Generations(limit)
        self._forget()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Whether a token opens a unit with a leading blank, or closes a word.
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.edge[i] = token.startswith("Ġ") if keeps_blanks else token.endswith("</w>")

    def _word(self, piece: str) -> list[str]:
        """Signs behind a word of letters are a unit of their own; ASCII letters may lose their case where the
        vocabulary ignores it."""
        signed = _LETTERS_THEN_SIGNS.fullmatch(piece)
        word = signed[1] if signed else piece
        if not self.keeps_blanks and word.isascii():
            word = word.lower()
        return [word, signed[2]] if signed else [word]

    def _units_of(self, piece: str) -> list[str]:
        if "\n" not in piece:
            return self._word(piece)
        if not self.keeps_blanks:
            return [u for part in piece.split("\n") if part for u in self._word(part)]
        left, _, right = piece.partition("\n")
        if not left or not right or "\n" in right or left[-1].isspace() or right[0].isspace():
            return [piece]
        return [*self._word(left), "\n", *self._word(right)]

    def _learn_units(self, missing: list[str]) -> dict[str, bytes]:
        """Words of letters are encoded many in one text, whose ids fall apart at the edges of words."""
        out: dict[str, bytes] = {}
        plain = [u for u in missing if _LETTERS.fullmatch(u) and (u[0] == " ") == self.keeps_blanks]
        for at in range(0, len(plain), 256):
            part = plain[at:at + 256]
            text = "".join(part) if self.keeps_blanks else " ".join(part)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            edges = np.flatnonzero(self.edge[ids])
            cuts = np.append(edges, len(ids)) if self.keeps_blanks else np.append(0, edges + 1)
            if len(cuts) != len(part) + 1 or cuts[0] != 0 or cuts[-1] != len(ids):
                continue  # some word has an edge inside: all of this part one by one
            data, cuts = ids.tobytes(), (4 * cuts).tolist()
            out.update((u, data[a:b]) for u, a, b in zip(part, cuts, cuts[1:]))
        other = [u for u in missing if u not in out]
        for at in range(0, len(other), 4096):
            part = other[at:at + 4096]
            for u, encoded in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                out[u] = np.array(encoded.ids, "<u4").tobytes()
        return out

    def _learn(self, known: Generations, missing: set[str], lead: str) -> dict[str, bytes]:
        """Ids of pieces that the young generation lacks."""
        found = known.recall(missing)
        parts = [(p, self._units_of(lead + p)) for p in missing if p not in found]
        have, units = self.units.young.get, {}
        wanted = {u for _, us in parts for u in us}
        units = {u: ids for u in wanted if (ids := have(u)) is not None}
        units |= self.units.recall(u for u in wanted if u not in units)
        new = self._learn_units([u for u in wanted if u not in units])
        self.units.add(new)
        units |= new
        learned = {p: units[us[0]] if len(us) == 1 else b"".join([units[u] for u in us]) for p, us in parts}
        known.add(learned)
        return found | learned

    def _join(self, known: Generations, rows: list[list[str]], lead: str) -> list[bytes]:
        """Joined ids of the pieces of each row."""
        got = [list(map(known.young.get, row)) for row in rows]
        gaps = [None in values for values in got]
        missing = {p for row, values, gap in zip(rows, got, gaps) if gap for p, ids in zip(row, values) if ids is None}
        if missing:
            found = self._learn(known, missing, lead)
            got = [[found[p] if ids is None else ids for p, ids in zip(row, values)] if gap else values
                   for row, values, gap in zip(rows, got, gaps)]
        return [b"".join(values) for values in got]

    def _forget(self) -> None:
        """Empty the table of hashed units: row by hash, and each row's place in the pools of ids and of bytes."""
        self.row: dict[int, int] = {}
        self.bytes, self.spelled = np.zeros(1 << 16, np.uint8), 0
        self.spelling, self.letters = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.pool, self.filled = np.zeros(1 << 16, "<u4"), 0
        self.place, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _rows(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of distinct hashes of the units at these places of ``data``, and whether the row is the unit's own."""
        if len(self.row) + len(hashes) > self.limit and len(self.row):
            self._forget()
        get = self.row.get
        rows = np.array([get(h, -1) for h in hashes.tolist()], np.int64)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            self._add_rows(hashes[missing], rows, missing, data, starts[missing], lengths[missing])
        return rows, _same(data, starts, lengths, self.bytes, self.spelling[rows], self.letters[rows])

    def _add_rows(self, hashes: np.ndarray, rows: np.ndarray, missing: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        spelled = data[_spread(starts, lengths)]
        raw, bounds = spelled.tobytes(), [0, *np.cumsum(lengths).tolist()]
        units = [raw[a:b].decode() for a, b in zip(bounds, bounds[1:])]
        learned = self._learn_units(list(dict.fromkeys(units)))
        ids = [learned[u] for u in units]
        sizes = np.array([len(i) // 4 for i in ids], np.int64)
        first, count, total = len(self.row), len(missing), int(sizes.sum())
        while first + count > len(self.place):
            size = 2 * len(self.place)
            self.place, self.length = np.resize(self.place, size), np.resize(self.length, size)
            self.spelling, self.letters = np.resize(self.spelling, size), np.resize(self.letters, size)
        while self.filled + total > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        while self.spelled + len(spelled) + 8 > len(self.bytes):
            self.bytes = np.resize(self.bytes, 2 * len(self.bytes))
        self.pool[self.filled:self.filled + total] = np.frombuffer(b"".join(ids), "<u4")
        self.bytes[self.spelled:self.spelled + len(spelled)] = spelled
        part = slice(first, first + count)
        self.place[part], self.length[part] = self.filled + np.cumsum(sizes) - sizes, sizes
        self.spelling[part], self.letters[part] = self.spelled + np.cumsum(lengths) - lengths, lengths
        self.filled, self.spelled = self.filled + total, self.spelled + len(spelled)
        rows[missing] = np.arange(first, first + count)
        self.row.update(zip(hashes.tolist(), rows[missing].tolist()))

    def _cut_plain(self, texts: list[bytes]) -> list[bytes | None]:
        """Ids of texts that can be cut by classes of bytes; None for the others."""
        data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes + 1) - 1
        plain = _plain(data, ends)
        if not plain.all():
            chosen = np.flatnonzero(plain)
            out: list[bytes | None] = [None] * len(texts)
            if len(chosen):
                for k, ids in zip(chosen.tolist(), self._cut_plain([texts[k] for k in chosen.tolist()])):
                    out[k] = ids
            return out
        kind = _CLASS[data]
        if not self.keeps_blanks:  # case is ignored: the lower-case letter is 0x20 behind, in ASCII and in Latin
            upper = (data >= 65) & (data <= 90)
            upper[1:] |= (data[:-1] == 0xC3) & (data[1:] < 0x9F)
            data = data + (upper * np.uint8(32))
        fresh = np.ones(len(data), bool)
        fresh[1:] = kind[1:] != kind[:-1]
        if not self.keeps_blanks:
            fresh |= kind == 2  # every digit is a unit
        heads = np.flatnonzero(fresh)
        tails = np.append(heads[1:], len(data))
        what = kind[heads]
        unit = (what <= 3) | (what == 5) if self.keeps_blanks else what <= 3
        starts, stops = heads[unit], tails[unit]
        if self.keeps_blanks:
            starts = starts - ((starts > 0) & (kind[starts - 1] == 4) & (what[unit] <= 3))
        powers, inverse = _powers()
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:len(data)], out=sums[1:])
        hashes = (sums[stops] - sums[starts]) * inverse[starts]
        hashes = (hashes ^ (hashes >> np.uint64(32))) + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        distinct, index, back = np.unique(hashes, return_index=True, return_inverse=True)
        size = stops - starts
        data = np.append(data, np.zeros(8, np.uint8))
        table, own = self._rows(distinct, data, starts[index], size[index])
        # No unit holds a zero byte, so up to eight bytes the masked number is the unit.
        short = _eights(data)[starts] & _MASKS[np.minimum(size, 8)]
        known = short == short[index][back]
        if not own.all():
            known &= own[back]
        some = np.flatnonzero(size > 8)
        if len(some):
            first = index[back[some]]
            known[some] &= _same(data, starts[some], size[some], data, starts[first], size[first])
        rows = table[back]
        lengths = self.length[rows]
        done = np.cumsum(lengths)
        ids = self.pool[_spread(self.place[rows], lengths)].tobytes()
        # Ids before the end of each text: those of the units that stop there or earlier.
        upto = np.concatenate([[0], done])[np.searchsorted(stops, ends, "right")].tolist()
        out = [ids[4 * a:4 * b] for a, b in zip([0, *upto], upto)]
        for k in set(np.searchsorted(ends, starts[~known]).tolist()):
            out[k] = None
        return out

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text; a null text is empty."""
        texts = [t or "" for t in texts]
        out: list[bytes | None] = [None] * len(texts)
        held, size = [], 0
        for k, text in enumerate(texts):
            if not text or len(text) > _BUFFER // 2 or "<|" in text or "\0" in text:
                continue
            held.append((k, text.encode("utf-8", "surrogatepass")))
            size += len(held[-1][1]) + 1
            if size > _BUFFER // 2:
                self._fill(out, held)
                held, size = [], 0
        self._fill(out, held)
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(rest, self._by_pieces([texts[k] for k in rest])):
            out[k] = ids
        return out

    def _fill(self, out: list[bytes | None], held: list[tuple[int, bytes]]) -> None:
        if held:
            for (k, _), ids in zip(held, self._cut_plain([t for _, t in held])):
                out[k] = ids

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        """Ids of any texts, through the dictionary of pieces."""
        out, heads, rests, size = [], [], [], 0
        for text in texts:
            pieces = cut(text) if text else []
            heads.append(pieces[:1])
            rests.append(pieces[1:])
            size += len(pieces)
            if size >= _GROUP:
                out += self._group(heads, rests)
                heads, rests, size = [], [], 0
        return out + self._group(heads, rests)

    def _group(self, heads: list[list[str]], rests: list[list[str]]) -> list[bytes]:
        return [a + b for a, b in zip(self._join(self.first, heads, ""), self._join(self.known, rests, self.lead))]


@functools.lru_cache(maxsize=4)
def encoder(path: str, keeps_blanks: bool) -> PieceEncoder:
    """One encoder per worker process, kept from task to task."""
    return PieceEncoder(path, keeps_blanks)
