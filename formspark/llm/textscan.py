"""Vectorised byte scans of Arrow string columns.

Everything works on the raw UTF-8 buffer of a batch of texts: words, word
hashes, shingle hashes and byte windows come from a handful of numpy passes
over some hundred kilobytes at a time instead of Python loops over words.
What a text needs while it is scanned does not follow its length: longer
texts are taken in pieces.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; the widest temporary is 8 to 16 bytes for each.
SLICE_BYTES = 1 << 18
#: Rows handled at a time, so that a row's number fits 16 bits.
MOST_ROWS = 1 << 16

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: close inputs give unrelated 64-bit values."""
    x = x.astype(np.uint64)
    t = x >> np.uint64(30)
    x ^= t
    x *= np.uint64(0xBF58476D1CE4E5B9)
    np.right_shift(x, np.uint64(27), out=t)
    x ^= t
    x *= np.uint64(0x94D049BB133111EB)
    np.right_shift(x, np.uint64(31), out=t)
    x ^= t
    return x


_KNOWN: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the next slice."""
    known = _KNOWN.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if len(known) <= 4 * SLICE_BYTES:
            _KNOWN[int(base)] = known
    return known[:n]


def running_sums(data: np.ndarray) -> np.ndarray:
    """Sums of byte times power up to each place, from which any span's hash follows."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_MULT, len(data)), dtype=np.uint64, out=out[1:])
    return out


def _raw_hashes(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (running[ends] - running[starts]) * powers(_INV, len(running))[starts]


def hashes_of(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans starts[i] to ends[i]."""
    return mix64(_raw_hashes(running, starts, ends) + (ends - starts).astype(np.uint64))


def slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about ``size`` bytes.

    offsets has one entry more than the run has rows and starts at 0.  A text
    longer than ``size`` is a run of its own and comes whole, without a copy.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        end = min(end, row + MOST_ROWS, len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def spaces(data: np.ndarray, first: int, last: int) -> np.ndarray:
    """Is there a white space at each place from ``first`` to before ``last``?"""
    return _SPACE[data[first:last]]


def pieces(column: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES, may_cut: Callable[[np.ndarray, int, int], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each piece, bytes, offsets): like ``slices``, but a text over twice ``size`` comes in several runs.

    It is cut after ``size`` bytes, or before the first place after them
    where ``may_cut`` is true.
    """
    for row, data, offsets in slices(column, size):
        if len(offsets) > 2 or len(data) <= 2 * size:
            yield np.arange(row, row + len(offsets) - 1), data, offsets
            continue
        at = 0
        while at < len(data):
            end = min(at + size, len(data))
            while may_cut is not None and end < len(data):
                found = np.flatnonzero(may_cut(data, end, min(end + size, len(data))))
                if len(found):
                    end += int(found[0])
                    break
                end = min(end + size, len(data))
            yield np.array([row]), data[at:end], np.array([0, end - at])
            at = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each word ``[^\\x20\\x09-\\x0D]+``."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)  # a word can't go on past its text
    edge[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    close = solid.copy()
    close[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(close) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes as they are."""
    upper = (data >= 0x41) & (data <= 0x5A)
    return data + (upper * np.uint8(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return hashes_of(running_sums(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)


def _long_words(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of one long text's words in lower case, a piece at a time; a word may go on over any number of pieces."""
    out, held, length = [], np.zeros(1, np.uint64), 0  # a word that the last piece ended in
    for at in range(0, len(data), size):
        part = lowered(data[at : at + size])
        starts, ends, _ = word_spans(part, np.array([0, len(part)]))
        if length and not (len(starts) and starts[0] == 0):
            out.append(mix64(held + np.uint64(length)))
            length = 0
        if not len(starts):
            continue
        raw, sizes = _raw_hashes(running_sums(part), starts, ends), (ends - starts).astype(np.uint64)
        if length:
            raw[:1] = held + np.uint64(pow(int(_MULT), length, 1 << 64)) * raw[:1]
            sizes[0] += np.uint64(length)
            length = 0
        if ends[-1] == len(part):
            held, length = raw[-1:].copy(), int(sizes[-1])
            raw, sizes = raw[:-1], sizes[:-1]
        out.append(mix64(raw + sizes))
    if length:
        out.append(mix64(held + np.uint64(length)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of ``width`` words, and their rows.

    A row with fewer words, but one at least, has its whole sequence as one
    run.  Runs repeat as they do in the text.
    """
    counts = np.bincount(rows, minlength=n_rows)
    first = np.concatenate(([0], np.cumsum(counts)[:-1])) if n_rows else np.zeros(0, np.int64)
    n = len(words)
    keep = np.arange(n) - first[rows] + width <= counts[rows]
    factors = mix64(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    out = words * factors[0]
    for k in range(1, width):
        out[: n - k] += words[k:] * factors[k]
    out = mix64(out)
    for r in np.flatnonzero((counts > 0) & (counts < width)):
        own = words[first[r] : first[r] + counts[r]]
        out[first[r]] = mix64((own * factors[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))[0]
        keep[first[r]] = True
    return out[keep], rows[keep]


def row_sets(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes in rising order; rows rise too, and there are 65,536 at most."""
    order = np.argsort(hashes)
    order = order[np.argsort(rows[order].astype(np.uint16), kind="stable")]
    hashes, rows = hashes[order], rows[order]
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[fresh], rows[fresh]


def shingle_sets(column: pa.Array | pa.ChunkedArray, width: int, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, shingles, row of each) by slices: each row's distinct shingles of ``width`` lower-case words.

    Of a long text the words' hashes are gathered piece by piece, and the
    shingles of some ten thousand words at a time.
    """
    for first, data, offsets in slices(column, size):
        n = len(offsets) - 1
        if n == 1 and len(data) > 2 * size:
            words, step = _long_words(data, size), max(width, size // 8)
            found = [np.zeros(0, np.uint64)]
            for at in range(0, len(words) if len(words) < width else len(words) - width + 1, step):
                own = words[at : at + step + width - 1]
                found.append(np.unique(shingle_hashes(own, np.zeros(len(own), np.int64), 1, width)[0]))
            tokens = np.unique(np.concatenate(found))
            yield first, 1, tokens, np.zeros(len(tokens), np.int64)
            continue
        data = lowered(data)
        starts, ends, rows = word_spans(data, offsets)
        yield first, n, *row_sets(*shingle_hashes(span_hashes(data, starts, ends), rows, n, width))
