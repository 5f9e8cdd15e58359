"""Texts to token ids by pieces that recur.

A byte-level tokenizer splits a text by a pattern before it merges. Between two
characters that are not white space, a single space always begins a new match, and a
single line end is a match of its own, whatever stands elsewhere: so a text may be cut
there, and its ids are those of the pieces in order. Pieces recur, so each is encoded
once and then looked up; when the table is full, pieces not met again go. A comma or full stop
between a letter or digit and white space is a match of its own too, and is cut off, so
that a word is known whatever follows it. A pattern must keep to this: `check` tries it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np

#: Pieces kept at most.
MOST = 300_000
#: White space other than spaces and line ends, and the signs that stand for a comma or full stop cut off: a text that has such a sign itself is cut without them.
_OTHER = re.compile(r"[^\S \n]|[\x02\x03]")
_RARE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x02\x03"  # those of them that are ASCII
_CUT = re.compile(r"(?<=\S) (?=\S)")
_COMMA = re.compile(r",(?<=[^\W_],)(?=[ \n]|\Z)")
_STOP = re.compile(r"\.(?<=[^\W_]\.)(?=[ \n]|\Z)")


def _odd(text: str) -> bool:
    """Whether white space is more than single spaces and line ends between other characters."""
    if text[0].isspace() or text[-1].isspace() or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return True
    return any(c in text for c in _RARE) if text.isascii() else bool(_OTHER.search(text))


#: Texts by which a pattern is tried.
PROBES = ("a b, c. d\ne1, 2. (x) -y, 'z'", "don't  go\n\nthere,\tor.", "é中, 1². Ⅷ_ !!, ?.\nx", "\n a,b . c ,\r\n", "It's 12,5. We'll see\nA.B, c")
Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


class _Codes(dict):
    """Piece to number; a new piece gets the next number and is noted."""

    def __init__(self, owner: PieceTable, prefix: str):
        super().__init__()
        self.owner, self.prefix = owner, prefix

    def __missing__(self, piece: str) -> int:
        owner = self.owner
        self[piece] = code = owner.count
        owner.count += 1
        owner.fresh.append(self.prefix + piece)
        return code


class PieceTable:
    """encode: ids of many pieces, one after another, and ids per piece."""

    def __init__(self, encode: Encode, most: int = MOST):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.count, self.fresh, self.used = 0, [], 0
        self.bare, self.spaced = _Codes(self, ""), _Codes(self, " ")
        self.odd = _Codes(self, " ")  # of texts that are odd: the signs below are themselves here
        self.spaced["\x02"], self.spaced["\x03"] = self.bare[","], self.bare["."]
        self.ids, self.starts, self.lens = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.uses = np.zeros(1 << 14, np.int64)

    def _forget(self) -> None:
        """Drops the pieces met only once since the last time; all of them if that leaves more than half."""
        kept = self.uses[: self.count] > 1
        kept[:2] = True  # the comma and the full stop
        if 2 * kept.sum() > self.most:
            self._clear()
            return
        place, live = (np.cumsum(kept) - 1).tolist(), kept.tolist()
        for codes in (self.bare, self.spaced, self.odd):
            some = {piece: place[c] for piece, c in codes.items() if live[c]}
            codes.clear()
            codes.update(some)
        where = np.flatnonzero(kept)
        lens = self.lens[where]
        ends = np.cumsum(lens)
        ids = self.ids[np.repeat(self.starts[where] - ends + lens, lens) + np.arange(ends[-1])]
        self.count, self.used = len(where), len(ids)
        self.ids[: self.used], self.lens[: self.count], self.starts[: self.count], self.uses[: self.count] = ids, lens, ends - lens, 1

    def _codes(self, text: str) -> list[int]:
        bare, spaced = self.bare, self.spaced
        if not text:
            return []
        if _odd(text):
            first, *rest = _CUT.split(text)
            return [bare[first], *map(self.odd.__getitem__, rest)]
        text = _STOP.sub(" \x03", _COMMA.sub(" \x02", text))
        out: list[int] = []
        for n, line in enumerate(text.split("\n")):
            first, *rest = line.split(" ")
            if n:
                out.append(bare["\n"])
            out.append(bare[first])
            out += map(spaced.__getitem__, rest)
        return out

    def check(self, matches: Callable[[str], list[str]]) -> None:
        """ValueError if a pattern's matches in some texts are not those in the pieces that the texts are cut into."""
        for text in PROBES:
            probe = PieceTable(self.encode)
            codes = probe._codes(text)
            # a piece is noted as it is met first; the comma and the full stop come before all others
            if matches(text) != [m for c in codes for m in matches(probe.fresh[c])]:
                raise ValueError(f"the pattern does not split {text!r} where its pieces begin and end")

    def _learn(self) -> None:
        ids, lens = self.encode(self.fresh)
        at, self.fresh = self.count - len(lens), []
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.count > len(self.lens):
            self.starts, self.lens, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens, self.uses))
        self.uses[at : self.count] = 0
        self.ids[self.used : self.used + len(ids)] = ids
        self.lens[at : self.count] = lens
        self.starts[at : self.count] = self.used + np.cumsum(lens) - lens
        self.used += len(ids)

    def texts(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin and the last one's end; null is empty."""
        if self.count > self.most:
            self._forget()
        codes = [np.array(self._codes(t or ""), dtype=np.int32) for t in texts]
        if self.fresh:
            self._learn()
        each = np.array([len(c) for c in codes], dtype=np.int64)
        all_ = np.concatenate(codes) if codes else np.zeros(0, np.int32)
        self.uses[: self.count] += np.bincount(all_, minlength=self.count)
        lens = self.lens[all_]
        ends = np.cumsum(lens)
        ids = self.ids[np.repeat(self.starts[all_] - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(each)])]
        return ids, bounds
