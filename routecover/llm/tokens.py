"""Token ids by the tokenizers library, with pieces seen before looked up instead of encoded again."""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from routecover.llm.texts import give_back

#: Classes of bytes: a space, other ASCII white space, letters, digits, other ASCII, bytes of characters that may be anything.
SPACE, BREAK, LETTER, DIGIT, MARK, OPEN = range(6)
CLASS = np.full(256, OPEN, np.uint8)
CLASS[:128] = MARK
CLASS[[9, 10, 11, 12, 13]] = BREAK
CLASS[32] = SPACE
for _first, _last, _kind in ((48, 57, DIGIT), (65, 90, LETTER), (97, 122, LETTER), (0xC3, 0xC5, LETTER)):
    CLASS[_first : _last + 1] = _kind  # C3 to C5 begin the letters of Latin-1 and Latin Extended-A
#: Characters that Unicode, but not ASCII, counts as white space, and those on which libraries differ.
OTHER_SPACE = r"[\x1c-\x1f\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
APOSTROPHE, BREAK_LINE = 39, "\n"


def cut_places(data: np.ndarray, is_start: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each byte of joined UTF-8 texts; ``is_start`` marks where texts begin.

    All cuts lie where byte-level pre-tokenization ends a match whatever stands to the left, and no piece but a run of white space
    ends in white space, so a piece encodes on its own as it does in its text:
    before white space; between letters, digits and marks (not from an apostrophe to a letter, as in 's); before the last character of a longer
    run of white space with something after it; and after such a character unless it is a space. Nothing is cut beside other characters.
    """
    kind = CLASS[data]
    second = np.zeros(len(data), bool)  # of a Latin letter's two bytes
    second[1:] = (data[:-1] >= 0xC3) & (data[:-1] <= 0xC5)
    kind[second] = LETTER
    for sign in np.flatnonzero(second & ((data == 0x97) | (data == 0xB7))).tolist():  # of these, C3 97 and C3 B7 are the signs of times and division
        if data[sign - 1] == 0xC3:
            kind[sign - 1 : sign + 1] = OPEN
    white = kind <= BREAK
    a, b = kind[:-1], kind[1:]
    word = (kind >= LETTER) & (kind <= MARK)
    cut = is_start.copy()
    inner = ~white[:-1] & white[1:]
    inner |= word[:-1] & word[1:] & (a != b) & ~((data[:-1] == APOSTROPHE) & (b == LETTER))
    inner |= (a == BREAK) & ~white[1:]
    ends_run = np.zeros(len(data), bool)
    ends_run[:-1] = white[:-1] & ~white[1:] & ~is_start[1:]
    inner |= white[:-1] & ends_run[1:]
    cut[1:] |= inner
    return cut


class WordEncoder:
    """Encodes whole texts exactly as the library does, at the cost of their new pieces.

    Texts are cut at places where the library's pre-tokenization surely ends a match (``cut_places``); the distinct pieces of a chunk are
    looked up, and new ones are encoded together. A text that holds an added token or white space outside ASCII, and every text if
    the vocabulary isn't a plain byte-level one, is given to the library whole. About ``max_bytes`` of pieces and ids are
    kept, then the table starts anew; pieces over ``max_piece`` bytes are not kept. Results never depend on what is kept.
    """

    def __init__(self, path: str, max_bytes: int = 24 << 20, max_piece: int = 64):
        self.library = Tokenizer.from_file(path)
        self.max_bytes, self.max_piece = max_bytes, max_piece
        before = json.loads(self.library.pre_tokenizer.__getstate__()) if self.library.pre_tokenizer else {}
        self.plain = self.library.normalizer is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.line_id = self.library.encode(BREAK_LINE, add_special_tokens=False).ids
        self._start_anew()

    def _start_anew(self) -> None:
        self.pieces = pa.array([], pa.binary())
        self.flat = np.empty(1 << 18, np.int32)
        self.ends = np.zeros(1, np.int64)  # of row r: ends[r + 1]

    def _by_library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of(self, lines: list[bytes], others: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in one array, and how many each has; ``lines`` are encoded as lines of one text."""
        flat, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for i in range(0, len(lines), 4096):
            ids = np.array(self._by_library([b"\n".join(lines[i : i + 4096]).decode()])[0], np.int32)
            inside = ids != self.line_id[0]
            stops = np.append(np.flatnonzero(~inside), len(ids))
            flat.append(ids[inside])
            sizes.append(np.diff(stops, prepend=-1) - 1)
        for ids in self._by_library([p.decode() for p in others]):
            flat.append(np.array(ids, np.int32))
            sizes.append(np.array([len(ids)]))
        return np.concatenate(flat), np.concatenate(sizes)

    def _rows_of(self, distinct: pa.Array) -> tuple[np.ndarray, int]:
        """Each distinct piece's row, and the number of rows that are kept after this chunk."""
        rows = pc.index_in(distinct, value_set=self.pieces)
        new = pc.is_null(rows)
        fresh = distinct.filter(new)
        known = len(self.pieces)
        if len(fresh) == 0:
            return np.asarray(rows).astype(np.int64), known
        # A piece that is no white space but for a space before it has no line break, and between line breaks is encoded as it is.
        line = np.asarray(pc.match_substring_regex(fresh, r"^ ?[^ \t\n\v\f\r]+$")) if len(self.line_id) == 1 else np.zeros(len(fresh), bool)
        long = np.asarray(pc.greater(pc.binary_length(fresh), self.max_piece))
        order = np.argsort(np.where(long, 2, ~line), kind="stable")  # those that aren't kept come last
        kept = known + int((~long).sum())
        fresh = fresh.take(pa.array(order))
        n_lines = int((line & ~long).sum())
        flat, sizes = self._ids_of(fresh[:n_lines].to_pylist(), fresh[n_lines:].to_pylist())
        start = int(self.ends[-1])
        while start + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(len(self.flat), np.int32)])
        self.flat[start : start + len(flat)] = flat
        self.ends = np.concatenate([self.ends, start + np.cumsum(sizes)])
        self.pieces = pa.concat_arrays([self.pieces, fresh])
        out = np.asarray(rows.fill_null(0)).astype(np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = known + np.arange(len(order))
        out[np.asarray(new)] = place
        return out, kept

    def encode(self, texts: list[str] | pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, each text's followed by ``end_id``; and the n+1 offsets of the texts. A null text is empty."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string()).fill_null("")
        n = len(texts)
        if not n:
            return np.empty(0, np.int32), np.zeros(1, np.int64)
        odd = pc.match_substring_regex(texts, OTHER_SPACE) if self.plain else pa.array(np.ones(n, bool))
        for content in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, content))
        odd = np.flatnonzero(np.asarray(odd))
        by_library = dict(zip(odd.tolist(), self._by_library(texts.take(pa.array(odd)).to_pylist()))) if len(odd) else {}
        if len(odd):
            mask = np.zeros(n, bool)
            mask[odd] = True
            texts = pc.if_else(pa.array(mask), "", texts)
        texts = pa.concat_arrays([texts.cast(pa.large_binary())])  # one buffer from its start
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        size = int(offsets[-1] - offsets[0])
        starts = offsets - offsets[0]
        kept = len(self.pieces)
        if size:
            data = np.frombuffer(texts.buffers()[2], np.uint8)[int(offsets[0]) : int(offsets[-1])]
            is_start = np.zeros(size, bool)
            is_start[starts[:-1][starts[:-1] < size]] = True
            places = np.append(np.flatnonzero(cut_places(data, is_start)), size).astype(np.int32)
            pieces = pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(data)]).dictionary_encode()
            distinct, kept = self._rows_of(pieces.dictionary)
            rows = distinct[np.asarray(pieces.indices)]
            first = np.searchsorted(places, starts)  # each text's first piece
        else:
            rows, first = np.empty(0, np.int64), np.zeros(n + 1, np.int64)
        counts = (self.ends[rows + 1] - self.ends[rows]).astype(np.int32)
        before = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts, dtype=np.int64)])
        lengths = before[first[1:]] - before[first[:-1]] + 1
        for i, ids in by_library.items():
            lengths[i] = len(ids) + 1
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        ids_in_pieces = int(before[-1])
        source = np.repeat(self.ends[rows] - before[:-1], counts)
        source += np.arange(ids_in_pieces)
        body = self.flat[source]
        if by_library:
            parts = []
            for i in range(n):
                parts += [np.array(by_library[i], np.int32) if i in by_library else body[before[first[i]] : before[first[i + 1]]], np.array([end_id], np.int32)]
            out = np.concatenate(parts)
        else:
            out = np.insert(body, before[first[1:]], end_id)
        self._keep(kept, distinct if size else None)
        give_back()
        return out, at

    def _keep(self, kept: int, seen: np.ndarray | None) -> None:
        """Drop the rows that aren't kept; beyond the bound, all but those just seen, or all."""
        if kept < len(self.pieces):
            self.pieces, self.ends = self.pieces[:kept], self.ends[: kept + 1]
        if self.pieces.nbytes + 12 * len(self.pieces) + 4 * int(self.ends[-1]) > self.max_bytes:
            rows = np.unique(seen[seen < kept])
            counts = self.ends[rows + 1] - self.ends[rows]
            flat = np.concatenate([np.empty(0, np.int32), *(self.flat[a:b] for a, b in zip(self.ends[rows].tolist(), self.ends[rows + 1].tolist()))])
            pieces = self.pieces.take(pa.array(rows))
            self._start_anew()
            if pieces.nbytes + 12 * len(pieces) + 4 * len(flat) <= self.max_bytes // 2:
                self.pieces, self.flat = pieces, np.concatenate([flat, np.empty(1 << 18, np.int32)])
                self.ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This Python worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def in_chunks(texts: list[str], max_chars: int = 4_000_000):
    """``(first, last)`` of runs of texts with about ``max_chars`` characters, or one longer text."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        if i > first and total + len(t) > max_chars:
            yield first, i
            first, total = i, 0
        total += len(t)
    if first < len(texts):
        yield first, len(texts)


def byte_chunks(texts: pa.Array, max_bytes: int = 1_500_000):
    """``(first, last)`` of runs of texts with at most ``max_bytes`` bytes together, or one longer text; null counts as empty."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0)), dtype=np.int64)
    first, before = 0, 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, before + max_bytes, "right")))
        yield first, last
        first, before = last, int(ends[last - 1])


def release() -> None:
    """Give this Python worker's encoders back; called by tasks of operators that don't encode, as workers serve many stages."""
    _ENCODERS.clear()
    give_back()
