"""Token ids of whole texts by the tokenizers library, with each distinct chunk encoded once per worker.

A byte-pair tokenizer splits a text by a pattern before it merges, and no
pre-token spans certain places in a text.  Texts are cut at such places only, so
the ids of a text are the ids of its chunks one after the other.  Chunks repeat
far more often than texts; each worker keeps the ids of those it has met.

A text that holds the string of a special token gets that token's id there, as the
library gives it by default; the text is cut around these strings first, before
letters' case is touched, and chunks are encoded as ordinary text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

from marquee.llm import memo

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Unicode white space, as the tokenizers' patterns take it.
_WS = r"\t-\r\x20\x85\xa0  -     　"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: White space stays with what follows it (a pre-token may begin with it).  A
#: word of plain letters may be cut from the plain punctuation that ends the chunk.
_KEEPING_SPACE = re.compile(rf"[ \n]?[{_LETTERS}]+(?=[.,;:!?{_WS}]|\Z)|[.,;:!?]+(?=[{_WS}]|\Z)|[{_WS}]*[^{_WS}]+|[{_WS}]+")
#: For tokenizers that drop white space.
_DROPPING_SPACE = re.compile(rf"[{_LETTERS}]+(?=[.,;:!?{_WS}]|\Z)|[.,;:!?]+(?=[{_WS}]|\Z)|[^{_WS}]+")
#: Chunks that are one pre-token wherever they stand; many are encoded as one line.
_WORD = re.compile(rf"[{_LETTERS}]+")
_SPACED_WORD = re.compile(rf" [{_LETTERS}]+")
LINE = 200
#: Chunks a worker remembers.
CACHE = 600_000


class Encoder:
    """Ids of texts as little-endian unsigned 16-bit integers (all vocabularies here have fewer than 65,536 ids)."""

    def __init__(self, vocabulary: str, drops_space: bool):
        """``drops_space``: the tokenizer ignores white space and letters' case."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = special
        self.around = re.compile("(" + "|".join(map(re.escape, sorted(special, key=lambda x: (-len(x), x)))) + ")") if special else None
        # Chunks are ordinary text: lower-casing may have made one look special.
        self.tokenizer.encode_special_tokens = True
        if self.tokenizer.get_vocab_size() > 65536:
            raise ValueError("ids do not fit 16 bits")
        self.plain_chunks = self._lowered_chunks if drops_space else _KEEPING_SPACE.findall
        self.known: dict[str | int, bytes] = memo.table()
        # Where a plain word ends (its last id is an end-of-word piece) or begins (its first id holds the space).
        self.ends = drops_space
        self.plain, self.between = (_WORD.fullmatch, " ") if drops_space else (_SPACED_WORD.fullmatch, "")
        self.edge = np.zeros(65536, bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.edge[i] = piece.endswith("</w>") if drops_space else piece.startswith("Ġ")

    @staticmethod
    def _lowered_chunks(text: str) -> list[str]:
        """Chunks for a tokenizer that lower-cases: a Latin-1 text is lower-cased before it is cut, as each of its letters has one lower-case form whatever stands around it."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return _DROPPING_SPACE.findall(text)
        return _DROPPING_SPACE.findall(text.lower())

    def chunks(self, text: str) -> list[str | int]:
        """Chunks of a text; a special token is its id."""
        parts = self.around.split(text) if self.around else [text]
        if len(parts) == 1:
            return self.plain_chunks(text)
        return [x for k, part in enumerate(parts) for x in ([self.special[part]] if k % 2 else self.plain_chunks(part))]

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text; a null text has none."""
        memo.take(self.known)
        group: list[list[str | int]] = []
        size = 0
        for text in texts:
            group.append(self.chunks(text or ""))
            size += len(group[-1])
            if size > 200_000:
                yield from self._encode(group)
                group, size = [], 0
        yield from self._encode(group)

    def _encode(self, group: list[list[str | int]]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known.clear()
        new = list(set().union(*group).difference(self.known))
        if new:
            self._learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, chunks)) for chunks in group]

    def _learn(self, new: list[str | int]) -> None:
        """Encode chunks; plain words go many to a line, which costs half as much, and are told apart by their edges."""
        plain, rest = [], []
        for c in new:
            if isinstance(c, int):
                self.known[c] = np.array([c], "<u2").tobytes()
                continue
            (plain if self.plain(c) else rest).append(c)
        lines = [plain[k : k + LINE] for k in range(0, len(plain), LINE)]
        for line, e in zip(lines, self.tokenizer.encode_batch_fast([self.between.join(x) for x in lines], add_special_tokens=False)):
            ids = np.array(e.ids, "<u2")
            at = np.flatnonzero(self.edge[ids]) * 2
            bounds = [0, *(at + 2).tolist()] if self.ends else [*at.tolist(), 2 * len(ids)]
            if len(bounds) != len(line) + 1:
                rest += line
                continue
            raw = ids.tobytes()
            for c, a, b in zip(line, bounds, bounds[1:]):
                self.known[c] = raw[a:b]
        for c, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self.known[c] = np.array(e.ids, "<u2").tobytes()


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(vocabulary: str, drops_space: bool) -> Encoder:
    """The worker's encoder for a vocabulary file: a path, or a file name that the installed vocabulary package has."""
    key = (vocabulary, drops_space)
    if key not in _encoders:
        path = vocabulary
        if os.path.basename(vocabulary) == vocabulary:
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        _encoders[key] = Encoder(path, drops_space)
    return _encoders[key]
