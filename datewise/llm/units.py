"""The matches of a split pattern in whole texts, found on distinct units.

Under the usual byte-level pattern a space that is followed by something other
than white space always begins a match. Texts are cut there by Arrow, equal
units are put together, and a plain unit (a word with a mark, perhaps a line
break and another word) is taken apart by Arrow too. The pattern itself runs
only over the other distinct units.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Fixed value: the pattern for which cutting before a word's space is exact.
SPACE_LED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text that are cut together, and texts whose ids are put together.
SLICE_BYTES, SLICE_ROWS = 8 << 20, 512
#: Nothing or white space first, in Arrow's dialect.
LOOSE = r"^(?:$|[\t-\r\x{85}\p{Z}])"
#: A unit of up to five matches; only Latin letters, which every Unicode version knows.
MARKS = ".,!?;:"
LATIN = r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+"
PLAIN = rf"^(?P<a>{LATIN})(?P<b>[.,!?;:]?)(?:(?P<c>\n)(?P<d>{LATIN})(?P<e>[.,!?;:]?))?$"


def matches(texts: pa.Array, pattern: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct matches, the match at each place, the first place of each text and the end).

    Nulls are not allowed. A text in which a space is followed by white space or
    by nothing is a unit by itself, and so is every text under another pattern.
    """
    if not len(texts):
        return pa.array([], pa.string()), np.empty(0, np.int32), np.zeros(1, np.int64)
    if pattern == SPACE_LED:
        words, heads, codes, starts = _cut(texts)
    else:
        words, heads, codes, starts = pa.array([], pa.string()), texts.to_pylist(), np.arange(len(texts)), np.arange(len(texts) + 1)
    # ASCII letters and at most one mark: no pattern is needed.
    bare = pc.ascii_rtrim(words, MARKS)
    marked = pc.subtract(pc.binary_length(words), pc.binary_length(bare))
    simple = pc.and_(pc.ascii_is_alpha(bare), pc.less_equal(marked, 1)).to_numpy(zero_copy_only=False).astype(bool)
    mask = pa.array(simple)
    own_mark = marked.filter(mask).to_numpy() == 1
    simple_rows, simple_there = _interleave([
        pc.binary_join_element_wise("", bare.filter(mask), " "),
        pc.if_else(pa.array(own_mark), pc.utf8_slice_codeunits(words.filter(mask), -1), "")])
    others = words.filter(pa.array(~simple))
    parts = pc.extract_regex(others, PLAIN)
    plain = parts.is_valid().to_numpy(zero_copy_only=False).astype(bool)
    columns = [x.cast(pa.string()) for x in parts.filter(pa.array(plain)).flatten()]
    columns[0] = pc.binary_join_element_wise("", columns[0], " ")
    plain_rows, plain_there = _interleave(columns)
    rest = [" " + w for w in others.filter(pa.array(~plain)).to_pylist()] + heads
    find, flat, own = regex.compile(pattern).findall, [], []
    for unit in rest:
        found = find(unit)
        own.append(len(found))
        flat += found
    coded = pa.concat_arrays([simple_rows, plain_rows, pa.array(flat, pa.string())]).dictionary_encode()
    # Units in the order of their runs: simple ones, plain ones, other ones, heads.
    sizes = np.concatenate([simple_there, plain_there, np.array(own, dtype=np.int64)]).astype(np.int64)
    odd = np.flatnonzero(~simple)
    ordered = np.concatenate([np.flatnonzero(simple), odd[plain], odd[~plain], len(words) + np.arange(len(heads))])
    order = np.empty(len(ordered), np.int64)
    order[ordered] = np.arange(len(ordered))
    which = order[codes]
    ends = np.concatenate([[0], np.cumsum(sizes[which])])
    found = gather(np.cumsum(sizes) - sizes, sizes, coded.indices.to_numpy(), which)
    return coded.dictionary, found, ends[starts]


def _interleave(columns: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
    """(the non-empty values row by row, how many each row has)"""
    n, k = len(columns[0]), len(columns)
    rows = pa.concat_arrays(columns).take(pa.array((np.arange(n)[:, None] + n * np.arange(k)).ravel()))
    there = pc.not_equal(rows, "").to_numpy(zero_copy_only=False)
    return rows.filter(pa.array(there)), there.reshape(-1, k).sum(1)


def _cut(texts: pa.Array) -> tuple[pa.Array, list[str], np.ndarray, np.ndarray]:
    """(distinct units without their space, units that begin a text, the unit of each place, first places)"""
    lists = pc.split_pattern(texts, " ")
    offsets = lists.offsets.to_numpy()
    starts, coded = (offsets - offsets[0]).astype(np.int64), lists.flatten().dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy().copy()
    loose = pc.match_substring_regex(words, LOOSE).to_numpy(zero_copy_only=False)
    heads = words.take(pa.array(codes[starts[:-1]])).to_pylist()
    codes[starts[:-1]] = len(words) + np.arange(len(heads))
    whole = np.zeros(len(texts), dtype=bool)
    if loose.any():
        whole = np.logical_or.reduceat(np.concatenate([loose, np.zeros(len(heads), bool)])[codes], starts[:-1])
    if whole.any():
        for k in np.flatnonzero(whole).tolist():
            heads[k] = texts[k].as_py()
        keep = ~np.repeat(whole, np.diff(starts))
        keep[starts[:-1]] = True
        codes, starts = codes[keep], np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[starts]
    # A word that only ever begins a text has no place among the led units.
    placed = np.zeros(len(words) + len(heads), dtype=bool)
    placed[codes] = True
    if not placed.all():
        words = words.filter(pa.array(placed[:len(words)]))
        codes = (np.cumsum(placed) - 1)[codes]
    return words, heads, codes, starts


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> list[pa.RecordBatch]:
    """The batch cut so that a part holds at most `most` bytes of text, or a single row."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
    parts, at = [], 0
    while at < batch.num_rows:
        held = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, held + most, side="right")))
        parts.append(batch.slice(at, end - at))
        at = end
    return parts


def gather(starts: np.ndarray, sizes: np.ndarray, values: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The values of the runs `which`, one run after another."""
    own = sizes[which].astype(np.int64)
    ends = np.cumsum(own)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts[which] - (ends - own), own) + np.arange(total)]


class Runs:
    """Growing arrays of runs of ids, addressed by the run's number."""

    def __init__(self, kind=np.uint32):
        self.n = self.filled = 0
        self.starts, self.sizes, self.values = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, kind)

    def add(self, sizes: np.ndarray, values: np.ndarray) -> None:
        while self.n + len(sizes) > len(self.sizes):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        while self.filled + len(values) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        at = slice(self.n, self.n + len(sizes))
        self.sizes[at] = sizes
        self.starts[at] = self.filled + np.cumsum(sizes, dtype=np.int64) - sizes
        self.values[self.filled:self.filled + len(values)] = values
        self.n += len(sizes)
        self.filled += len(values)

    def of(self, which: np.ndarray) -> np.ndarray:
        return gather(self.starts, self.sizes, self.values, which)
