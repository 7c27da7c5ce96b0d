"""Encode whole texts through their distinct blank-separated pieces.

A byte-level pre-tokenizer never lets a token run across a single blank or line
break that stands between two other characters: the blank always opens the next
token, the line break is a token of its own. So the ids of a text are the ids of
its pieces: each with its blank in front, the first of a line without. Texts of a
block are split and their pieces numbered by Arrow; only distinct pieces become
Python strings, the frequent ones are answered by a bounded cache, and the rest
reach the encoder. Arrow then lays the pieces' ids out in text order. A text with
white space beside a blank or line break, or at its ends, is encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text whose distinct pieces are encoded together.
BLOCK_BYTES = 16 << 20
#: Pieces kept per worker process. They are taken from the first blocks, most frequent
#: first; later new pieces are encoded for their block and then forgotten.
CACHE_PIECES = 400_000


class PieceCache:
    """``encode_pieces`` and ``encode_whole`` map a list of strings to the bytes of
    their ids; the former gets strings without line breaks or outer white space
    (but for the blank in front). ``split=False``: pieces do not stand alone; neither
    do those of a text that holds a string of ``whole_if``."""

    def __init__(self, encode_pieces: Callable[[list[str]], list[bytes]],
                 encode_whole: Callable[[list[str]], list[bytes]], limit: int = CACHE_PIECES, split: bool = True,
                 whole_if: Sequence[str] = ()):
        self.encode_pieces, self.encode_whole, self.limit, self.split = encode_pieces, encode_whole, limit, split
        self.whole_if = whole_if
        self.cache: dict[str, bytes | None] = {"": b""}
        self.line_break = encode_whole(["\n"])[0]

    def _ids(self, pieces: list[str], counts: np.ndarray) -> list[bytes | None]:
        """Ids of distinct pieces; a piece behind a line break starts with it. None: cannot stand alone."""
        found = [self.cache.get(p, b"?") for p in pieces]
        new = [i for i, x in enumerate(found) if x == b"?"]
        first, later = [], []
        for i in new:
            p = pieces[i]
            body = p[1:] if p[0] == "\n" else p
            if body and not body[0].isspace() and not body[-1].isspace():
                (first if p[0] == "\n" else later).append(i)
            else:
                found[i] = None
        made = self.encode_pieces([pieces[i][1:] for i in first] + [" " + pieces[i] for i in later])
        for i, ids in zip(first, made):
            found[i] = self.line_break + ids
        for i, ids in zip(later, made[len(first):]):
            found[i] = ids
        room = self.limit - len(self.cache)
        if room > 0:
            keep = np.array(new, "int64")
            keep = keep[np.argsort(-counts[keep], kind="stable")[:room // 2 + 1]]  # the next blocks have frequent ones too
            self.cache.update((pieces[i], found[i]) for i in keep.tolist())
        return found

    def encode(self, texts: pa.Array | list[str], blank: bool = False) -> Iterator[bytes]:
        """Encoded ids of each text, with ``blank`` of a blank and the text; null counts as empty."""
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        front = " " if blank else ""
        if not self.split:
            yield from self.encode_whole([front + t for t in column.to_pylist()])
            return
        alone = np.zeros(len(column), bool)
        for string in self.whole_if:
            alone |= pc.match_substring(column, string).to_numpy(zero_copy_only=False)
        # Every line starts a piece that begins with the line break; what stands before the first is empty.
        # With a blank in front the first piece is one like those behind it.
        marked = column if blank else pc.binary_join_element_wise("\n", column, "")
        marked = pc.replace_substring(marked, "\n", " \n")
        marked = pc.binary_join_element_wise(" ", marked, "") if blank else marked
        lists = pc.split_pattern(marked, " ")
        bounds = lists.offsets.to_numpy()
        numbered = lists.flatten().dictionary_encode()
        pieces, number = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
        found = self._ids(pieces, np.bincount(number, minlength=len(pieces)))
        broken = np.array([x is None for x in found])
        laid = pa.array([x or b"" for x in found], pa.binary()).take(numbered.indices)
        data, ends = laid.buffers()[2], np.frombuffer(laid.buffers()[1], "int32")
        data = memoryview(data) if data is not None else memoryview(b"")
        empty = number == pieces.index("") if "" in pieces else np.zeros(len(number), bool)
        wrong = np.concatenate([[0], np.cumsum(broken[number] | empty)])  # one empty piece opens every text
        skip = 0 if blank else len(self.line_break)
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            if alone[i] or wrong[b] - wrong[a] > 1:
                yield self.encode_whole([front + column[i].as_py()])[0]
            else:
                yield bytes(data[ends[a] + skip:ends[b]])
