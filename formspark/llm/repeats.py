"""Exact removal of repeated passages (operator 10).

Every text is UTF-8 bytes.  A byte goes if some window of ``length`` bytes
that covers it also starts earlier, in a smaller document or earlier in its
own; windows are judged on the input, not on what is left, and never cross
documents.

Method: suffixes are ordered only through ``length`` bytes, by passes over
digits of five bytes from the most significant one, and a suffix that stands
alone after a pass leaves.  What is left equal after the last pass is exactly
the repeated windows.  Ordering the suffix of every byte would move several
times the corpus, so suffixes are sampled first, in a way that cannot miss a
repeat:

1. Windows are keyed by their minimizer, the 24-byte gram of smallest hash
   (leftmost of equals).  Equal windows have equal minimizers at equal places,
   so a gram that occurs once settles all its windows.  Windows that follow
   each other and share one minimizer form a segment; each sends some 16
   bytes.  Of segments that are equal as a whole, by 64-bit hash, all but the
   first are repeats throughout; what a batch holds of them goes no further.
2. Where one gram has different segments, the bytes of the first of each are
   fetched, and the suffixes that start there are ordered by the passes.
3. A gram that a sample shows to be very common would bring all its segments
   to one task.  Its windows are keyed one by one, by the hash of all their
   bytes, so only equal ones meet, one from each batch at most.

Records travel as packed columns dealt by hash, texts as compressed blocks,
and long texts are scanned in overlapping pieces, so what a task holds beside
the longest text follows neither the input's size nor a text's length.

Defined cases: null text is empty; a null id comes after all others; rows
with equal id are told apart and ordered by a hash of their text, and rows
equal in both are one document; texts shorter than ``length`` lose nothing;
an empty table gives no rows.  ``remove_repeats`` keeps extra columns,
whatever their names; ``repeats`` ignores them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formspark.llm import common
from formspark.llm.textscan import SLICE_BYTES, hashes_of, mix64, running_sums, slices

GRAM = 24
#: Bytes of a digit; a suffix's digit and its group's number share one 64-bit key.
DIGIT = 5
#: Rows of the sample that common grams are found in, and the share of them that such a gram is in.
SAMPLE_ROWS, COMMON = 2048, 1 / 64


def _dealt(doc: np.ndarray, tie: np.ndarray, parts: int) -> np.ndarray:
    return (mix64(doc.view(np.uint64) + mix64(tie.view(np.uint64))) % np.uint64(parts)).astype(np.int64)


def _by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(bounds)):
        yield int(p), order[bounds[p] : bounds[p + 1]]


def _batch(names: list[str], rows: list[tuple], ints: int) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i < ints else pa.binary()) for i, c in enumerate(columns)], names)


def segments(data: np.ndarray, offsets: np.ndarray, length: int, common_grams: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Gram hash, segment hash, row, start and number of windows of each segment.

    Each window of a common gram is a segment of its own, with its bytes' hash for a gram.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    running = running_sums(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = hashes_of(running, at, at + GRAM)
    low = (gram & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    span, reach = length - GRAM + 1, 1
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    whole = np.ones(len(low), bool)  # windows that end inside their text
    sizes = np.diff(offsets)
    tail = np.minimum(sizes, length - 1)
    gone = common.ranges(offsets[1:] - tail, tail)
    whole[gone[gone < len(whole)]] = False
    starts = np.flatnonzero(whole)
    if not len(starts):
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    anchor = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1))))
    first, count = starts[cut], np.diff(np.concatenate((cut, [len(starts)])))
    segment = mix64(hashes_of(running, first, first + count + length - 1) + (anchor[cut] - first).astype(np.uint64))
    gram = gram[anchor[cut]]
    often = _among(gram, common_grams)
    if often.any():
        single = common.ranges(first[often], count[often])
        bytes_hash = hashes_of(running, single, single + length)
        rest = ~often
        gram, segment = np.concatenate([gram[rest], mix64(bytes_hash)]), np.concatenate([segment[rest], bytes_hash])
        first, count = np.concatenate([first[rest], single]), np.concatenate([count[rest], np.ones(len(single), np.int64)])
    row = np.searchsorted(offsets, first, side="right") - 1
    return gram, segment, row, first - offsets[row], count


def _among(values: np.ndarray, some: np.ndarray | None) -> np.ndarray:
    if some is None or not len(some):
        return np.zeros(len(values), bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def all_segments(column: pa.Array, length: int, common_grams: np.ndarray | None = None, size: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, ...]]:
    """``segments`` of a column by runs; of a long text by pieces that overlap by a window less one byte."""
    for first, data, offsets in slices(column, size):
        if len(offsets) > 2 or len(data) <= 2 * size:
            gram, segment, row, start, count = segments(data, offsets, length, common_grams)
            yield gram, segment, row + first, start, count
            continue
        for at in range(0, len(data) - length + 1, size):
            part = data[at : at + size + length - 1]
            gram, segment, row, start, count = segments(part, np.array([0, len(part)]), length, common_grams)
            yield gram, segment, row + first, start + at, count


def _sampled_segments(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, segment, *_ in all_segments(batch.column(0), length):
                pairs = np.unique(np.stack([gram, segment]), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["gram", "segment"])

    return common.tidy(run)


def _common_grams(base: DataFrame, rows: int, length: int) -> np.ndarray:
    """Grams with as many different segments as COMMON of a sample has texts, or more; some thousands at most."""
    share = min(1.0, SAMPLE_ROWS / max(1, rows))
    few = base.where(F.pmod(F.xxhash64("doc", "tie"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    found = few.mapInArrow(_sampled_segments(length), "gram long, segment long").distinct().groupBy("gram").count()
    least = max(16, int(COMMON * min(rows, SAMPLE_ROWS)))
    return np.sort(np.array([r["gram"] for r in found.where(F.col("count") >= least).select("gram").collect()], np.int64).view(np.uint64))


def _anchors(length: int, parts: int, blocks: int, common_grams):
    """Segments dealt by gram; of equal ones in a batch all but the first are settled, and dealt by block."""
    names = ["part", "block", "gram", "segment", "doc", "tie", "whose", "start", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = common_grams.value
        for batch in common.gathered(batches):
            doc, tie = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = [(g, s, r.astype(np.int32), b.astype(np.uint32), n.astype(np.uint16)) for g, s, r, b, n in all_segments(batch.column(2), length, often)]
            if not found:
                continue
            gram, segment, row, start, count = map(np.concatenate, zip(*found, strict=True))
            del found
            rank = np.empty(len(doc), np.int32)  # documents in order; rows of one document rank alike
            by = np.lexsort((tie, doc))
            rank[by] = np.cumsum(np.concatenate(([0], (doc[by][1:] != doc[by][:-1]) | (tie[by][1:] != tie[by][:-1]))))[: len(by)]
            order = np.argsort(segment, kind="stable")
            same = segment[order][1:] == segment[order][:-1]
            together = np.zeros(len(order), bool)
            together[:-1] |= same
            together[1:] |= same
            few = order[together]
            few = few[np.lexsort((start[few], rank[row[few]], gram[few], segment[few]))]
            g, s, r, b = gram[few], segment[few], rank[row[few]], start[few]
            equal = np.concatenate(([False], (g[1:] == g[:-1]) & (s[1:] == s[:-1])))[: len(few)]
            again = equal.copy()  # one occurrence, of rows that are equal in all
            again[1:] &= (r[1:] == r[:-1]) & (b[1:] == b[:-1])
            goes = np.ones(len(gram), bool)
            goes[few[equal]] = False
            rows = []
            own_all = np.flatnonzero(goes)
            for p, own in _by_part((gram[own_all] >> np.uint64(32)).astype(np.int64) % parts, parts):
                own = own_all[own]
                own = own[np.argsort(row[own], kind="stable")]
                docs, whose = np.unique(row[own], return_inverse=True)
                low = (gram[own] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                rows.append((p, None, *map(common.pack, (low, segment[own], doc[docs], tie[docs], np.diff(whose, prepend=0).astype(np.uint16), start[own], count[own]))))
            settled = few[equal & ~again]
            for block, own in _by_part(_dealt(doc[row[settled]], tie[row[settled]], blocks), blocks):
                own = settled[own]
                own = own[np.lexsort((start[own], tie[row[own]], doc[row[own]]))]
                d, e = doc[row[own]], tie[row[own]]
                rows.append((block % parts, block, None, None, *map(common.pack, (np.diff(d, prepend=0), e)), None, *map(common.pack, (start[own], count[own].astype(np.int32)))))
            if rows:
                yield _batch(names, rows, 2)

    return common.tidy(run), "part int, block int, gram binary, segment binary, doc binary, tie binary, whose binary, start binary, count binary"


def _columns(t: pa.Table, names: dict[str, str]) -> list[np.ndarray]:
    return [common.blobs(t, name, kind) for name, kind in names.items()]


def _second_digit(parts: int):
    """Equal segments settle; firsts of the different segments of one gram are asked for."""
    names = ["block", "part", "settled", "doc", "tie", "start", "count"]

    def run(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        known = t.filter(pc.is_valid(t.column("block")))
        rows = [(r["block"], part, 1, r["doc"], r["tie"], r["start"], r["count"]) for r in known.to_pylist()]
        t = t.filter(pc.is_null(t.column("block")))
        if not t.num_rows:
            return pa.Table.from_batches([_batch(names, rows, 3)])
        docs, ties = [], []
        for d, e, w in zip(t.column("doc").to_pylist(), t.column("tie").to_pylist(), t.column("whose").to_pylist(), strict=True):
            whose = np.cumsum(common.unpack(w, "uint16").astype(np.int64))
            docs.append(common.unpack(d, "int64")[whose])
            ties.append(common.unpack(e, "int64")[whose])
        doc, tie = np.concatenate(docs), np.concatenate(ties)
        del docs, ties
        gram, segment, start, count = _columns(t, {"gram": "uint32", "segment": "uint64", "start": "uint32", "count": "uint16"})
        order = np.argsort(gram, kind="stable")
        same = gram[order][1:] == gram[order][:-1]
        together = np.zeros(len(gram), bool)
        together[:-1] |= same
        together[1:] |= same
        order = order[together]  # a gram that stands alone has no repeated window
        gram, segment, doc, tie, start, count = (x[order] for x in (gram, segment, doc, tie, start, count))
        order = np.lexsort((start, tie, doc, segment, gram))
        gram, segment, doc, tie, start, count = (x[order] for x in (gram, segment, doc, tie, start, count))
        again = np.zeros(len(gram), bool)  # one occurrence, of rows that are equal in all
        again[1:] = (doc[1:] == doc[:-1]) & (tie[1:] == tie[:-1]) & (start[1:] == start[:-1]) & (gram[1:] == gram[:-1]) & (segment[1:] == segment[:-1])
        gram, segment, doc, tie, start, count = (x[~again] for x in (gram, segment, doc, tie, start, count))
        fresh = np.ones(len(gram), bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (segment[1:] != segment[:-1])
        firsts = np.flatnonzero(fresh)
        alike = gram[firsts][1:] == gram[firsts][:-1]
        several = np.zeros(len(firsts), bool)
        several[:-1] |= alike
        several[1:] |= alike
        for settled, chosen in ((1, np.flatnonzero(~fresh)), (0, firsts[several])):
            for block, own in _by_part(_dealt(doc[chosen], tie[chosen], parts), parts):
                own = chosen[own]
                own = own[np.lexsort((start[own], tie[own], doc[own]))]
                rows.append((block, part, settled, *map(common.pack, (np.diff(doc[own], prepend=0), tie[own], start[own], count[own].astype(np.int32)))))
        return pa.Table.from_batches([_batch(names, rows, 3)])

    return common.tidy(run), "block int, part int, settled int, doc binary, tie binary, start binary, count binary"


def _blocks(parts: int):
    """Texts by block, compressed together."""
    names = ["block", "doc", "tie", "size", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.gathered(batches):
            doc, tie = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            text = batch.column(2).cast(pa.large_binary()).fill_null(b"")
            rows = []
            for block, own in _by_part(_dealt(doc, tie, parts), parts):
                texts = text.take(pa.array(own)).to_pylist()
                size = np.fromiter(map(len, texts), np.int64, len(texts))
                rows.append((block, *map(common.pack, (doc[own], tie[own], size)), common.pack(np.frombuffer(b"".join(texts), np.uint8))))
            if rows:
                yield _batch(names, rows, 1)

    return common.tidy(run), "block int, doc binary, tie binary, size binary, data binary"


class _Block:
    """The texts of a block, each document once, and a way to find them."""

    def __init__(self, t: pa.Table) -> None:
        self.doc, self.tie, size, self.data = _columns(t, {"doc": "int64", "tie": "int64", "size": "int64", "data": "uint8"})
        self.begin = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
        self.size = size
        self.order = np.lexsort((self.tie, self.doc))
        self.keys = self._key(self.doc, self.tie)
        self.sorted = np.argsort(self.keys, kind="stable")

    @staticmethod
    def _key(doc: np.ndarray, tie: np.ndarray) -> np.ndarray:
        return mix64(doc.view(np.uint64)) * np.uint64(3) + mix64(tie.view(np.uint64))

    def rows(self, doc: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """The first row of each document asked for."""
        return self.sorted[np.searchsorted(self.keys[self.sorted], self._key(doc, tie))]

    def same(self) -> np.ndarray:
        """Of each row the first row of its document."""
        return self.sorted[np.searchsorted(self.keys[self.sorted], self.keys)]


def _contexts(length: int):
    """The bytes of each segment asked for, for the part that asked."""
    names = ["part", "doc", "tie", "start", "count", "data"]

    def run(texts: pa.Table, asked: pa.Table) -> pa.Table:
        rows = []
        if asked.num_rows and texts.num_rows:
            block = _Block(texts)
            for p, d, e, s, c in zip(*(asked.column(x).to_pylist() for x in ("part", "doc", "tie", "start", "count")), strict=True):
                doc, tie = np.cumsum(common.unpack(d, "int64")), common.unpack(e, "int64")
                start, count = common.unpack(s, "uint32"), common.unpack(c, "int32")
                place = block.begin[block.rows(doc, tie)] + start
                data = block.data[common.ranges(place, count.astype(np.int64) + length - 1)]
                rows.append((p, common.pack(doc), e, s, c, common.pack(data)))
        return pa.Table.from_batches([_batch(names, rows, 1)])

    return common.tidy(run), "part int, doc binary, tie binary, start binary, count binary, data binary"


def repeated_windows(data: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Number of each window that occurs again, equal for equal windows and rising with their bytes; -1 of others.

    Most-significant-digit radix passes: a pass orders every group of windows
    that are equal so far by their next DIGIT bytes; who is alone leaves.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data) + 1]).view(">u8")[:, 0].astype(np.uint64)
    alive, group = np.arange(len(windows), dtype=np.int32), np.zeros(len(windows), np.uint64)
    depth = 0
    while depth < length and len(alive):
        room = (64 - int(group[-1]).bit_length()) // 8  # groups rise
        wide = min(DIGIT, room, length - depth)
        key = (group << np.uint64(8 * wide)) | (words[windows[alive] + depth] >> np.uint64(64 - 8 * wide))
        order = np.argsort(key, kind="stable")
        key, alive = key[order], alive[order]
        del order
        same = key[1:] == key[:-1]
        stay = np.zeros(len(key), bool)
        stay[:-1] |= same
        stay[1:] |= same
        key, alive = key[stay], alive[stay]
        group = np.concatenate((np.zeros(1, np.uint64), np.cumsum(key[1:] != key[:-1], dtype=np.uint64)))[: len(key)]
        depth += wide
    out = np.full(len(windows), -1, np.int32)
    out[alive] = group
    return out


def _last_digits(length: int, parts: int):
    names = ["block", "doc", "tie", "start", "count"]

    def run(t: pa.Table) -> pa.Table:
        doc, tie, start, count, data = _columns(t, {"doc": "int64", "tie": "int64", "start": "uint32", "count": "int32", "data": "uint8"})
        start, count = start.astype(np.int64), count.astype(np.int64)
        sizes = count + length - 1
        place = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        kind = repeated_windows(data, common.ranges(place, count).astype(np.int32), length)
        del data
        whose = np.repeat(np.arange(len(count), dtype=np.int32), count)
        at = common.ranges(start, count).astype(np.int32)
        found = np.flatnonzero(kind >= 0)
        rank = np.empty(len(doc), np.int64)
        by_doc = np.lexsort((tie, doc))
        moved = np.concatenate(([0], (doc[by_doc][1:] != doc[by_doc][:-1]) | (tie[by_doc][1:] != tie[by_doc][:-1])))[: len(by_doc)]
        rank[by_doc] = np.cumsum(moved)
        order = found[np.lexsort((at[found], rank[whose[found]], kind[found]))]
        later = order[1:][kind[order][1:] == kind[order][:-1]]
        later.sort()
        # runs of windows of one segment
        edge = np.flatnonzero(np.concatenate(([True], np.diff(later) != 1)) | np.concatenate(([True], np.diff(whose[later]) != 0))) if len(later) else later
        runs, many = later[edge], np.diff(np.concatenate((edge, [len(later)])))
        d, e = doc[whose[runs]], tie[whose[runs]]
        rows = []
        for block, own in _by_part(_dealt(d, e, parts), parts):
            own = own[np.lexsort((at[runs[own]], e[own], d[own]))]
            rows.append((block, *map(common.pack, (np.diff(d[own], prepend=0), e[own], at[runs[own]].astype(np.uint32), many[own].astype(np.int32)))))
        return pa.Table.from_batches([_batch(names, rows, 1)])

    return common.tidy(run), "block int, doc binary, tie binary, start binary, count binary"


def _gone(block: _Block, places: np.ndarray, ends: np.ndarray, whole_characters: bool) -> np.ndarray:
    """Is each byte of a block covered by one of the spans?  Some hundred kilobytes are judged at a time."""
    gone = np.zeros(len(block.data), bool)
    places, ends, depth, a = np.sort(places), np.sort(ends), 0, 0
    while a < len(gone):
        b = min(a + SLICE_BYTES, len(gone))
        while b < len(gone) and (block.data[b] & 0xC0) == 0x80:
            b += 1
        opened = places[np.searchsorted(places, a) : np.searchsorted(places, b)] - a
        closed = ends[np.searchsorted(ends, a) : np.searchsorted(ends, b)] - a
        cover = np.cumsum(np.bincount(opened, minlength=b - a) - np.bincount(closed, minlength=b - a)) + depth
        depth = int(cover[-1])
        own = cover > 0
        if whole_characters:
            heads = np.flatnonzero((block.data[a:b] & 0xC0) != 0x80)
            if len(heads):
                own[heads[0] :] = np.repeat(np.logical_and.reduceat(own, heads), np.diff(np.concatenate((heads, [b - a]))))
        gone[a:b] = own
        a = b
    return gone


def _removed(length: int, with_text: bool, whole_characters: bool):
    def run(texts: pa.Table, repeats: pa.Table) -> pa.Table:
        if not texts.num_rows:
            empty = pa.array([], pa.int64())
            columns = [empty] * 5 + [pa.array([], pa.string())] + ([pa.array([], pa.string())] if with_text else [])
            return pa.table(columns, names)
        block = _Block(texts)
        places, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d, e, s, c in zip(*(repeats.column(x).to_pylist() for x in ("doc", "tie", "start", "count")), strict=True):
            doc, tie = np.cumsum(common.unpack(d, "int64")), common.unpack(e, "int64")
            places.append(block.begin[block.rows(doc, tie)] + common.unpack(s, "uint32"))
            ends.append(places[-1] + common.unpack(c, "int32") + length - 1)
        gone = _gone(block, np.concatenate(places), np.concatenate(ends), whole_characters)
        removed, n_spans, sums, kept = (np.zeros(len(block.doc), np.int64), np.zeros(len(block.doc), np.int64), {}, {})
        for i in np.unique(block.same()).tolist():
            own = gone[block.begin[i] : block.begin[i] + block.size[i]]
            left = block.data[block.begin[i] : block.begin[i] + block.size[i]][~own].tobytes()
            removed[i] = len(own) - len(left)
            n_spans[i] = np.count_nonzero(own[1:] & ~own[:-1]) + int(len(own) > 0 and own[0])
            sums[i] = hashlib.sha256(left).hexdigest()
            if with_text:
                kept[i] = left.decode("utf-8", "replace")
        same = block.same()
        columns = [pa.array(x) for x in (block.doc, block.tie, block.size[same], removed[same], n_spans[same])]
        columns.append(pa.array([sums[int(i)] for i in same]))
        if with_text:
            columns.append(pa.array([kept[int(i)] for i in same]))
        return pa.table(columns, names)

    names = ["doc", "tie", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text
    return common.tidy(run), "doc long, tie long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text


_LAST = (1 << 63) - 1


def _identity(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column, bool]:
    """What tells documents apart and orders them, and whether the second number is needed."""
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    repeated = docs.groupBy(doc.alias("d")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
    return doc, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) if repeated else F.lit(0).cast("long"), repeated


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, with_text: bool = False, whole_characters: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc, tie, n_bytes, n_removed, n_spans, kept_sha256 [, kept_text].

    doc is the id, the largest long for null; kept_text keeps a character
    unless all its bytes go, with ``whole_characters``.
    """
    doc, tie, _ = _identity(docs, id_col, text_col)
    return _repeats(docs.select(doc.alias("doc"), tie.alias("tie"), F.col(text_col).alias("text")), length, with_text, whole_characters)


def _repeats(base: DataFrame, length: int, with_text: bool, whole_characters: bool) -> DataFrame:
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} at least")
    spark = base.sparkSession
    common.lean(spark)
    rows, size = common.text_bytes(base, "text")
    blocks = common.parts_for(size, spark)
    parts = common.parts_for(size / 40 * 22, spark)  # a segment for some 40 bytes, of 22 bytes

    often = spark.sparkContext.broadcast(_common_grams(base, rows, length))
    anchors, schema = _anchors(length, parts, blocks, often)
    dealt = base.mapInArrow(anchors, schema)
    second, schema = _second_digit(blocks)
    judged = common.cut(dealt.groupBy("part").applyInArrow(second, schema))
    pack, schema = _blocks(blocks)
    texts = base.mapInArrow(pack, schema)
    fetch, schema = _contexts(length)
    contexts = texts.groupBy("block").cogroup(judged.where("settled = 0").groupBy("block")).applyInArrow(fetch, schema)
    last, schema = _last_digits(length, blocks)
    found = contexts.groupBy("part").applyInArrow(last, schema)
    every = judged.where("settled = 1").select("block", "doc", "tie", "start", "count").unionByName(found)
    remove, schema = _removed(length, with_text, whole_characters)
    return texts.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(remove, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """``docs``, in its columns, with each text cut to what ``repeats`` keeps; null texts stay null."""
    doc, tie, repeated = _identity(docs, id_col, text_col)
    kept = _repeats(docs.select(doc.alias("doc"), tie.alias("tie"), F.col(text_col).alias("text")), length, True, True)
    if repeated:
        kept = kept.groupBy("doc", "tie").agg(F.first("kept_text").alias("kept_text"))
    d, e, t = (common.free(docs.columns, x) for x in ("__doc", "__tie", "__kept"))
    joined = docs.withColumns({d: doc, e: tie}).withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.lit("")))
    joined = joined.join(kept.select(F.col("doc").alias(d), F.col("tie").alias(e), F.col("kept_text").alias(t)), [d, e])
    return joined.withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.col(t))).select(docs.columns)


def op10_repeats(spark, sf_dir: str) -> DataFrame:
    out = repeats(common.table(spark, sf_dir, "documents"))
    return out.select(F.when(F.col("doc") < _LAST, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
