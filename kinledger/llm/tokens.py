"""Exact tokenizer ids of whole texts, with each distinct word encoded once.

Both public tokenizers cut their input before they merge, and a single space
between two visible characters is always such a cut. So a text is the sequence of
its space-separated pieces, each with its space in front, and equal pieces have
equal ids. Pieces are found and numbered by Arrow, distinct pieces that were not
met before go through the tokenizers library, and ids are gathered by numpy.
A text with any other spacing (runs of blanks, blanks at an end or next to a line
break), or with the string of one of the file's added tokens (<|endoftext|> and the like, which
the library reads as that token), goes through the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space in any tokenizer's sense, or taken for it to be safe.
_BLANK = r"[\t\n\x0b\f\r\x1c-\x1f\x{85}\p{Z}]"
_UNSAFE = rf"(^|{_BLANK}) | ({_BLANK}|$)"
_LATIN = np.dtype("<u4")


class WordTokenizer:
    """``ids(texts)`` of a public tokenizer file.

    ``remember`` bounds the distinct pieces kept (about 200 bytes each); beyond it,
    pieces are encoded anew in each block, with the same ids.
    """

    def __init__(self, path: str, remember: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.remember = remember
        added = [re.escape(t.content) for _, t in sorted(self.tok.get_added_tokens_decoder().items())]
        self.unsafe = "|".join([_UNSAFE, *added])
        self.memo: dict[str, bytes] = {}
        # a mark that stands alone as one id, put between pieces so that one call encodes many of them
        self.mark, self.mark_id = None, None
        for mark, inner in (("\n", "\n"), (" \x00", "\x00")):
            ids = self.tok.encode(f" a{mark} b", add_special_tokens=False).ids
            one = self.tok.encode(" a", add_special_tokens=False).ids, self.tok.encode(" b", add_special_tokens=False).ids
            if len(ids) == len(one[0]) + 1 + len(one[1]) and ids[: len(one[0])] == one[0]:
                self.mark, self.inner, self.mark_id = mark, inner, ids[len(one[0])]
                break

    def _plain(self, pieces: list[str]) -> list[bytes]:
        got = self.tok.encode_batch(pieces, add_special_tokens=False)
        return [np.array(e.ids, _LATIN).tobytes() for e in got]

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that follow a space, many in a call."""
        if self.mark is None:
            return self._plain([" " + p for p in pieces])
        out: list[bytes] = [b""] * len(pieces)
        easy = [k for k, p in enumerate(pieces) if self.inner not in p and not p[-1:].isspace() and p]
        for at in range(0, len(easy), 2000):
            part = easy[at : at + 2000]
            ids = np.array(self.tok.encode_batch_fast(["".join(" " + pieces[k] + self.mark for k in part)], add_special_tokens=False)[0].ids, _LATIN)
            ends = np.flatnonzero(ids == self.mark_id)
            if len(ends) != len(part):  # a piece holds the mark's id itself
                for k, b in zip(part, self._plain([" " + pieces[k] for k in part])):
                    out[k] = b
                continue
            raw, begin = ids.tobytes(), 0
            for k, end in zip(part, ends.tolist()):
                out[k] = raw[4 * begin : 4 * end]
                begin = end + 1
        done = set(easy)
        rest = [k for k in range(len(pieces)) if k not in done]
        for k, b in zip(rest, self._plain([" " + pieces[k] for k in rest])):
            out[k] = b
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's ids begin (one more entry than texts)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        unsafe = pc.match_substring_regex(texts, self.unsafe)
        lists = pc.split_pattern(pc.if_else(unsafe, pa.scalar("", pa.large_string()), texts), " ")
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        first = np.asarray(lists.offsets)[:-1].astype(np.int64)
        ends = np.asarray(lists.offsets)[1:].astype(np.int64)
        coded = lists.values.dictionary_encode()
        index = np.asarray(coded.indices).astype(np.int64)
        words = coded.dictionary.to_pylist()
        got = [self.memo.get(w) for w in words]
        missing = [k for k, b in enumerate(got) if b is None]
        for k, b in zip(missing, self._encode([words[k] for k in missing])):
            got[k] = b
            if len(self.memo) < self.remember:
                self.memo[words[k]] = b
        # first pieces have no space in front; an unsafe text is one such piece
        whole = np.asarray(unsafe)
        heads = [t if u else None for t, u in zip(texts.filter(unsafe).to_pylist(), [True] * int(whole.sum()))]
        at_heads = np.flatnonzero(whole)
        plain = np.flatnonzero(~whole)
        firsts = [words[k] for k in index[first[plain]].tolist()]
        firsts += heads
        if firsts:
            index[first[np.concatenate([plain, at_heads])]] = len(got) + np.arange(len(firsts))
            got += self._plain(firsts)
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        flat = np.frombuffer(b"".join(got), _LATIN)
        begin = np.concatenate([[0], np.cumsum(size)])
        lens = size[index]
        after = np.concatenate([[0], np.cumsum(lens)])
        ids = flat[np.repeat(begin[index] - after[:-1], lens) + np.arange(after[-1])] if after[-1] else flat[:0]
        return ids, np.concatenate([after[first], after[ends[-1:]]]) if len(first) else np.zeros(1, np.int64)


def blocks(batch: pa.RecordBatch, column: str, most: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``most`` bytes, one row at least.

    After each, what Arrow has freed goes back to the system: its pool would keep about 200 MB of a worker otherwise.
    """
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    total, begin = np.cumsum(size), 0
    while begin < batch.num_rows:
        base = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, base + most, "right")))
        yield batch.slice(begin, end - begin)
        pa.default_memory_pool().release_unused()
        begin = end


_READY: dict[str, WordTokenizer] = {}


def tokenizer(path: str, remember: int = 900_000) -> WordTokenizer:
    """One per Python worker; the last call says how many pieces it may keep."""
    if path not in _READY:
        _READY[path] = WordTokenizer(path, remember)
    tok = _READY[path]
    tok.remember = remember
    if len(tok.memo) > remember:
        tok.memo = {}
    return tok
