"""Token ids of whole texts from a public tokenizer file.

The tokenizers library does the encoding. A text is first cut at blanks and line ends, where no token of the two
supported kinds can cross; the pieces of a call are numbered by Arrow, marks at their ends are taken off, and
each distinct one is looked up once. It is encoded once per worker and remembered; pieces that are not known yet are
encoded many at a time, and told apart by the blank that the first token of each begins with, or by a separator between
them that always is one token of its own. The memory is bounded: two generations of at most ``REMEMBERED`` pieces and those
of a call, and calls of about ``CALL_BYTES``. Texts with other white space, or with the text of a special token, are
encoded in one call, so that all ids are those of a plain call of the library.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

REMEMBERED = 500_000
# Bytes of texts that are encoded together: the more, the fewer look-ups.
CALL_BYTES = 6 << 20
LONGEST_REMEMBERED = 64
CALL = 2000
# Pieces in one text of a call: the library takes longer for each piece of a long text.
JOINED = 32

# ASCII marks that, at the end of a piece and after a letter, always start a token of their own.
MARKS = ".,!#$%&*|"
# Letters that become a letter and a mark when they are lower-cased or composed; what follows them is not told apart.
_SPLIT = r"\x{130}\x{958}-\x{95f}\x{9dc}-\x{9df}\x{a33}-\x{a5e}\x{b5c}\x{b5d}\x{f43}-\x{f69}\x{fb1d}-\x{fb4e}"
# The end of a piece whose marks are encoded apart.
_MARKED = rf"[^\PL{_SPLIT}](?P<marks>[{re.escape(MARKS)}]+)\z"

# White space other than blanks and line ends, and control characters that some libraries take for white space.
_ODD = ("\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
        "\u2028\u2029\u202f\u205f\u3000")
# Where blanks are kept: texts that are no single blanks and line ends between pieces.
_UNEVEN = rf"\A[ \n]|[ \n]\z|[ \n][ \n]|[{_ODD}]"


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file on this machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def stretches(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First and last row (exclusive) of stretches of about ``CALL_BYTES`` of text, at least a row each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < len(ends):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + CALL_BYTES, side="right")))
        yield low, high
        low = high


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    ``spaced``: the tokenizer keeps blanks, as the first character of the piece that follows (byte-level files).
    Otherwise white space only separates (word-end files).
    """

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        # Tokens that stand for themselves wherever their text occurs; texts with one are encoded in one call. Pieces of
        # other texts hold none, and are not searched for any.
        whole = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.whole = "|".join(whole + [_UNEVEN] * spaced)
        self.tokenizer.encode_special_tokens = True
        self.spaced = spaced
        # Between pieces: a line end, or a control character set off by blanks.
        self.mark, self.between = ("\n", "\n") if spaced else ("\x1e", " \x1e ")
        alone = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.separator = alone[0] if len(alone) == 1 else None
        self.line = np.array(alone, dtype="<u4").tobytes() if spaced else b""
        # Ids of tokens that begin with a blank, if a blank is a token.
        blank = self.tokenizer.encode(" ", add_special_tokens=False).tokens if spaced else []
        self.blank = None
        if len(blank) == 1:
            names = self.tokenizer.get_vocab(with_added_tokens=True)
            self.blank = np.zeros(max(names.values()) + 1, dtype=bool)
            self.blank[[i for name, i in names.items() if name.startswith(blank[0])]] = True
        # Pieces without a text of their own.
        self.empty = {"": b"", "\n": self.line} if spaced else {"": b""}
        self.young: dict[str, bytes] = dict(self.empty)
        self.old: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of texts without white space inside, in joined calls."""
        if self.separator is None:
            return self._encode(pieces)
        out, held = [], []
        for at in range(0, len(pieces), CALL):
            some = pieces[at:at + CALL]
            groups = [some[k:k + JOINED] for k in range(0, len(some), JOINED)]
            bodies = [self.between.join(g) for g in groups]
            for group, body, found in zip(groups, bodies, self.tokenizer.encode_batch_fast(bodies, add_special_tokens=False), strict=True):
                ids = found.ids
                if body.count(self.mark) == ids.count(self.separator) == len(group) - 1:
                    held += ids
                    held.append(self.separator)
                else:
                    out += self._cut(held)
                    out += self._encode(group)
                    held = []
            out += self._cut(held)
            held = []
        return out

    def _encode_blank(self, pieces: list[str]) -> list[bytes]:
        """Ids of texts that are a blank and what follows it without white space, in joined calls."""
        if self.blank is None:
            return self._encode(pieces)
        out = []
        for at in range(0, len(pieces), CALL):
            some = pieces[at:at + CALL]
            groups = [some[k:k + JOINED] for k in range(0, len(some), JOINED)]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)]
            ids = np.array([i for some in found for i in some], dtype="<u4")
            firsts = np.flatnonzero(self.blank[ids])
            ends = np.cumsum([len(some) for some in found])
            if np.diff(np.searchsorted(firsts, ends), prepend=0).tolist() == [len(g) for g in groups]:
                cuts, data = (4 * firsts).tolist(), ids.tobytes()
                out += [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)]
            else:
                out += self._encode(some)
        return out

    def _cut(self, held: list[int]) -> list[bytes]:
        """The ids before each separator."""
        ids = np.array(held, dtype="<u4")
        cuts, data = (4 * np.flatnonzero(ids == self.separator)).tolist(), ids.tobytes()
        return [data[a:b] for a, b in zip([0, *[c + 4 for c in cuts]], cuts, strict=False)]

    def _known(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, remembered or encoded now; only whole results are remembered.

        Where blanks are kept, a piece stands for itself after a blank, or, if it begins with a line end, for itself.
        """
        young, old, line = self.young, self.old, self.line
        found = list(map(young.get, pieces))
        missed = [piece for piece, ids in zip(pieces, found, strict=True) if ids is None]
        if not missed:
            return found
        young.update((piece, old[piece]) for piece in missed if piece in old)
        todo = [piece for piece in missed if piece not in old]
        if self.spaced:
            lines = [p for p in todo if p[0] == "\n"]
            after = [p for p in todo if p[0] != "\n"]
            young.update(zip(lines, [line + ids for ids in self._encode_pieces([p[1:] for p in lines])], strict=True))
            young.update(zip(after, self._encode_blank([" " + p for p in after]), strict=True))
        else:
            young.update(zip(todo, self._encode_pieces(todo), strict=True))
        found = list(map(young.__getitem__, pieces))
        for piece in todo:
            if len(piece) > LONGEST_REMEMBERED:
                young.pop(piece, None)
        if len(young) > REMEMBERED:
            self.old, self.young = young, dict(self.empty)
        return found

    def _encode_distinct(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pieces; a piece and the marks at its end are looked up apart."""
        marked = pc.match_substring_regex(pieces, _MARKED)
        bodies = pc.if_else(marked, pc.ascii_rtrim(pieces, characters=MARKS), pieces).dictionary_encode()
        marks = pc.struct_field(pc.extract_regex(pieces.filter(marked), _MARKED), "marks").dictionary_encode()
        words = bodies.dictionary.to_numpy(zero_copy_only=False).tolist()
        ends = [self.mark + m if self.spaced else m for m in marks.dictionary.to_pylist()]
        found = self._known(words + ends)
        tails = [b"", *[ids[len(self.line):] for ids in found[len(words):]]]
        which = np.zeros(len(pieces), dtype=np.int64)
        which[marked.to_numpy(zero_copy_only=False)] = marks.indices.to_numpy() + 1
        kind = pa.large_binary()
        return pc.binary_join_element_wise(pa.array(found[:len(words)], kind).take(bodies.indices),
                                           pa.array(tails, kind).take(pa.array(which)), pa.scalar(b"", kind))

    def _joined(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts that can be cut into pieces."""
        if self.spaced:
            # A line end before the text tells that no blank is before its first piece; its ids are left out again.
            lined = pc.binary_join_element_wise(pa.scalar("", texts.type), texts, pa.scalar("\n", texts.type))
            split = pc.split_pattern(pc.replace_substring(lined, "\n", " \n"), " ")
        else:
            split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        numbered = split.flatten().dictionary_encode()
        ids = self._encode_distinct(numbered.dictionary).take(numbered.indices)
        _, places, data = ids.buffers()
        ends = np.frombuffer(places, dtype=np.int64)[split.offsets.to_numpy()].tolist()
        data, skip = data.to_pybytes() if data else b"", len(self.line)
        return [data[a + skip:b] for a, b in zip(ends, ends[1:], strict=False)]

    def __call__(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text; none for null."""
        texts = pc.fill_null(texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), "")
        in_one = pc.match_substring_regex(texts, self.whole) if self.whole else pa.array(np.zeros(len(texts), dtype=bool))
        rest = texts.filter(pc.invert(in_one))
        joined = iter(self._joined(rest) if len(rest) else [])
        if len(rest) == len(texts):
            return list(joined)
        self.tokenizer.encode_special_tokens = False
        try:
            whole = iter(self._encode(texts.filter(in_one).to_pylist()))
        finally:
            self.tokenizer.encode_special_tokens = True
        return [next(whole if one else joined) for one in in_one.to_pylist()]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """This worker's encoder for a file; it is kept between tasks."""
    key = (path, spaced)
    if key not in _encoders:
        _encoders[key] = Encoder(path, spaced)
    return _encoders[key]
