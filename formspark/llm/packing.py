"""Best-fit packing of tokenized documents into sequences (operator 7).

A document is its token ids and one separator id.  Only documents longer
than a sequence are cut: full pieces from the end, so that the first piece
may be shorter.  Full pieces are sequences by themselves.  The others are
dealt one after the other into bins, and local search alone makes that plain
deal good: documents of one of the emptiest bins move to the fullest bin that
has room, or one or two of them change place with a shorter one, so that the
sum of squared fills rises with every step, until no step is left that empties
bins, or the room of all bins is less than one bin.

Pieces are dealt by hash to groups of some thousands, which pack on their
own; what is left in badly filled bins of all groups is packed again.

Ids come from the byte-level BPE file given.  A text is cut before each
white space that follows a character that is surely none, where no token
can reach across; each distinct cut string is encoded once, new ones of a
run of texts end to end, and remembered in a bounded cache.  A long text is encoded in runs between such places.

Defined cases: null text is empty, and an empty document is its separator
alone; null and repeated ids are packed like any other row; extra columns
are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from formspark.llm import common
from formspark.llm.textscan import hashes_of, mix64, pieces, running_sums

#: Distinct strings that a worker remembers before it starts afresh.
REMEMBERED = 200_000
#: Pieces of a group that is packed in one task.
GROUP = 8192
#: Bins that give first, for each that could be saved; all of them once these find no step.
FIRST_GIVERS = 4
#: A bin filled less is emptied and packed again with those of other groups.
WELL_FILLED = 0.97


class Encoder:
    """Token ids of whole columns of texts."""

    _made: dict[str, Encoder] = {}

    def __init__(self, name: str) -> None:
        self.file, self.plain = public_tokenizers.path(f"{name}.json"), None
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size_of = np.zeros(max(ranks.values()) + 1, np.int64)  # bytes of each id
        self.size_of[list(ranks.values())] = list(map(len, ranks))
        with open(self.file, encoding="utf-8") as lines:
            self.special = [t["content"] for t in json.load(lines)["added_tokens"]]
        self.forget()

    def _alone(self, raw: bytes) -> np.ndarray:
        """Ids of one cut string; the whole tokenizer is loaded only for those with special tokens."""
        text = raw.decode("utf-8", "replace")
        if not any(s in text for s in self.special):
            return self.fast.encode_to_numpy(text)
        if self.plain is None:
            self.plain = Tokenizer.from_file(self.file)
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)

    def _together(self, raw: bytes, ends: np.ndarray) -> list[np.ndarray] | None:
        """Ids and how many each cut string has, of strings end to end that no token reaches across; None with special tokens."""
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            return None
        if any(s in text for s in self.special):
            return None
        ids = self.fast.encode_to_numpy(text)
        last = np.searchsorted(np.cumsum(self.size_of[ids]), ends) + 1
        return [ids, np.diff(last, prepend=0)]

    @classmethod
    def of(cls, name: str) -> Encoder:
        if name not in cls._made:
            cls._made[name] = cls(name)
        return cls._made[name]

    def forget(self) -> None:
        """Known strings are sorted by hash; each has a first place in the pool of ids, and a count."""
        self.known = np.zeros(0, np.uint64)
        self.first, self.count, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encodes new strings: at once those that begin and end as cuts ask for, the others one by one."""
        sizes = ends - starts
        joins = _space(data[starts]) & _sure(data[ends - 1], data[np.maximum(ends - 2, 0)])
        inner = np.flatnonzero(joins)
        found = None
        if len(inner):
            found = self._together(data[common.ranges(starts[inner], sizes[inner])].tobytes(), np.cumsum(sizes[inner]))
        if found is None:
            inner, found = inner[:0], [np.zeros(0, np.uint32), np.zeros(0, np.int64)]
        single = np.setdiff1d(np.arange(len(hashes)), inner, assume_unique=True)
        whole = data.tobytes() if len(single) else b""
        alone = [self._alone(whole[starts[k] : ends[k]]) for k in single.tolist()]
        order = np.concatenate([inner, single])
        count = np.concatenate([found[1], np.fromiter(map(len, alone), np.int64, len(alone))])
        first = len(self.pool) + np.cumsum(count) - count
        back = np.argsort(order)
        place = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, place, hashes)
        self.first, self.count = np.insert(self.first, place, first[back]), np.insert(self.count, place, count[back])
        self.pool = np.concatenate([self.pool, found[0], *alone])

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, ids, bounds of each row's ids) by runs; a long text is several runs of one row."""
        for rows, data, offsets in pieces(column, may_cut=_may_cut):
            if not len(data):
                yield rows, np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
                continue
            cut = np.zeros(len(data) + 1, bool)
            cut[1:-1] = _may_cut(data, 1, len(data))
            cut[offsets] = True
            bounds = np.flatnonzero(cut)
            starts, ends = bounds[:-1], bounds[1:]
            hashes = hashes_of(running_sums(data), starts, ends)
            distinct, sample, back = np.unique(hashes, return_index=True, return_inverse=True)
            if len(self.known) > REMEMBERED:
                self.forget()
            new = ~np.isin(distinct, self.known, assume_unique=True)
            if new.any():
                self._learn(distinct[new], data, starts[sample[new]], ends[sample[new]])
            entry = np.searchsorted(self.known, distinct)[back]
            ids = self.pool[common.ranges(self.first[entry], self.count[entry])]
            total = np.concatenate(([0], np.cumsum(self.count[entry])))
            yield rows, ids, total[np.searchsorted(starts, offsets)]


def _space(byte: np.ndarray) -> np.ndarray:
    return (byte == 0x20) | ((byte >= 0x09) & (byte <= 0x0D))


def _sure(byte: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Does a character that is surely no white space end with ``byte``, after ``lead``?"""
    return ((byte > 0x20) & (byte < 0x7F)) | ((byte >= 0x80) & (lead >= 0xC3) & (lead <= 0xDF))  # or two-byte letters from U+00C0


def _may_cut(data: np.ndarray, first: int, last: int) -> np.ndarray:
    """Places from ``first`` to before ``last`` that no token reaches across: a white space after a sure character."""
    before = data[first - 1 : last - 1]
    lead = data[max(first - 2, 0) : last - 2] if last > 1 else data[:0]
    lead = np.concatenate([np.zeros(len(before) - len(lead), np.uint8), lead])
    return _space(data[first:last]) & _sure(before, lead)


def _pieces(tokenizer: str, size: int, separator: int, groups: int, with_ids: bool):
    names = ["id", "piece", "start", "length", "ids_crc32", "pack_group", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        end = np.array([separator], np.uint32)
        for batch in batches:
            out: list[tuple] = []

            def add(row: int, parts: list[np.ndarray]) -> None:
                own = np.concatenate([*parts, end]).astype("<u4")
                edges = [0, *range(len(own) % size or size, len(own) + 1, size)] if len(own) > size else [0, len(own)]
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    raw = own[a:b].tobytes()
                    out.append((row, k, a, b - a, zlib.crc32(raw), raw if with_ids else None))

            held, of = [], 0  # ids of the row that the last run ended with
            for rows, ids, bounds in encoder.encode(batch.column(1)):
                for i, row in enumerate(rows.tolist()):
                    if held and row != of:
                        add(of, held)
                        held = []
                    held.append(ids[bounds[i] : bounds[i + 1]])
                    of = row
            if held:
                add(of, held)
            if not out:
                continue
            rows, piece, start, length, crc, raw = zip(*out, strict=True)
            id_values = batch.column(0).take(pa.array(rows))
            piece, start, length, crc = (np.array(x, np.int64) for x in (piece, start, length, crc))
            key = mix64(np.array(id_values.fill_null(-1), np.int64).view(np.uint64)) + mix64((crc * 4099 + piece).view(np.uint64))
            order = np.argsort(key, kind="stable")  # equal rows are dealt out by their number
            fresh = np.concatenate(([True], key[order][1:] != key[order][:-1]))
            at = np.arange(len(key))
            number = np.empty(len(key), np.int64)
            number[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
            group = (mix64(key + number.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(groups)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([id_values, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc), pa.array(group), pa.array(raw, pa.binary())], names)

    return common.tidy(run), "id long, piece int, start long, length long, ids_crc32 long, pack_group long, ids binary"


def plain_deal(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of positions, in the order given: a new bin where the next piece doesn't fit the last one."""
    bins: list[list[int]] = []
    room = 0
    for i, n in enumerate(lengths.tolist()):
        if n > room:
            bins.append([])
            room = size
        bins[-1].append(i)
        room -= n
    return bins


class _Search:
    """Bins under local search, with what a step has to find fast.

    ``room`` has each piece's bin's gap, so the best exchange for a piece or
    two is one look over arrays; bins by gap, as bits of one number, give the
    fullest bin that a piece fits.
    """

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, size: int) -> None:
        self.size, self.lengths, self.length = size, lengths.astype(np.int64), lengths.tolist()
        self.bins = [list(b) for b in bins if b]
        self.home, self.room = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        self.gap = [0] * len(self.bins)
        self.by_gap: list[set[int]] = [set() for _ in range(size + 1)]
        self.gaps = 0  # bit g: some bin has a gap of g
        for k, b in enumerate(self.bins):
            self.home[b] = k
            self._place(k)

    def _place(self, k: int) -> None:
        gap = self.size - sum(self.length[i] for i in self.bins[k])
        self.gap[k] = gap
        self.room[self.bins[k]] = gap
        if self.bins[k]:
            self.by_gap[gap].add(k)
            self.gaps |= 1 << gap

    def _lift(self, k: int) -> None:
        gap = self.gap[k]
        self.by_gap[gap].discard(k)
        if not self.by_gap[gap]:
            self.gaps &= ~(1 << gap)

    def free(self) -> int:
        """Room of all bins."""
        return sum(gap * len(own) for gap, own in enumerate(self.by_gap) if own)

    def step(self, giver: int) -> bool:
        """The giver's best step, if it has one; the giver is lifted out meanwhile."""
        self._lift(giver)
        found = self._move(giver) or self._exchange(giver)
        if found:
            out, back, k = found
            self._lift(k)
            self.bins[giver] = [i for i in self.bins[giver] if i not in out] + back
            self.bins[k] = [i for i in self.bins[k] if i not in back] + out
            self.home[out], self.home[back] = k, giver
            self._place(k)
        self._place(giver)
        return bool(found)

    def _move(self, giver: int) -> tuple[list[int], list[int], int] | None:
        """Its longest piece that fits a bin as full as itself or fuller, to the fullest such."""
        for i in sorted(self.bins[giver], key=lambda i: (-self.length[i], i)):
            n = self.length[i]
            fitting = self.gaps >> n
            if fitting:
                gap = n + (fitting & -fitting).bit_length() - 1
                if gap - n < self.gap[giver]:  # else the squares don't rise
                    return [i], [], min(self.by_gap[gap])
        return None

    def _exchange(self, giver: int) -> tuple[list[int], list[int], int] | None:
        """One or two of its pieces for a shorter one: what raises the other bin most, and the squares."""
        by_length: dict[int, list[int]] = {}
        for i in sorted(self.bins[giver]):
            by_length.setdefault(self.length[i], []).append(i)
        some = sorted(by_length, reverse=True)
        gives = [(n, [by_length[n][0]]) for n in some]
        gives += [(n + m, [by_length[n][0], by_length[m][0] if m != n else by_length[n][1]]) for x, n in enumerate(some) for m in some[x:] if m != n or len(by_length[n]) > 1]
        room, best, step = self.room.copy(), 0, None
        room[self.bins[giver]] = -1
        there = np.flatnonzero(room > 0)
        lengths, room = self.lengths[there], room[there]
        rises = np.maximum(room - self.gap[giver], 0)  # by more than this, or the squares don't rise
        for n, chosen in gives:
            gain = n - lengths
            gain[(gain > room) | (gain <= rises)] = 0
            at = int(np.argmax(gain)) if len(gain) else 0
            if len(gain) and gain[at] > best:
                best, step = int(gain[at]), (chosen, [int(there[at])], int(self.home[there[at]]))
        return step


def local_search(bins: list[list[int]], lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins after steps that raise the sum of squared fills; never more of them.

    The emptiest bins give as long as they can, and again while anything
    changed: FIRST_GIVERS for each bin that the room of all bins could save,
    and as many more; then all, from when those find no step.  It ends where
    no bin at all has a step, or none can be saved any more.
    """
    search = _Search(bins, lengths, size)
    changed = few = True
    while changed or few:
        few = few and changed  # the first givers alone, as long as they find steps
        changed = False
        saved = search.free() // size  # bins that could be saved at most
        if not saved:
            break
        order = sorted((k for k, b in enumerate(search.bins) if b and search.gap[k]), key=lambda k: (-search.gap[k], k))
        for giver in order[: FIRST_GIVERS * (saved + 1)] if few else order:
            while search.bins[giver] and search.gap[giver] and search.step(giver):
                changed = True
    return [b for b in search.bins if b]


def pack_lengths(lengths: np.ndarray, size: int) -> list[list[int]]:
    return local_search(plain_deal(lengths, size), lengths, size)


def _pack(size: int, last: bool, first_group: int):
    """Sequence and offset of the pieces of a group; unless ``last``, none for those of badly filled bins."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("ids_crc32", "id", "piece", "start", "length")])
        lengths = t.column("length").to_numpy()
        group = t.column("pack_group")[0].as_py() + first_group
        sequence, offset = np.full(len(lengths), -1), np.zeros(len(lengths), np.int64)
        full, rest = np.flatnonzero(lengths >= size), np.flatnonzero(lengths < size)
        sequence[full] = (group << 32) + np.arange(len(full))
        for k, own in enumerate(pack_lengths(lengths[rest], size)):
            own = rest[own]
            if last or lengths[own].sum() >= WELL_FILLED * size:
                sequence[own] = (group << 32) + len(full) + k
                offset[own] = np.concatenate(([0], np.cumsum(lengths[own])[:-1]))
        t = t.drop_columns(["pack_group"])
        return t.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return common.tidy(run)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, separator: int = 0, tokenizer: str = "byte_bpe_50k", with_ids: bool = False) -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32, sequence_id, offset [, ids, little-endian 32-bit]."""
    common.lean(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    groups = max(1, round(base.count() / GROUP))
    make, schema = _pieces(tokenizer, size, separator, groups, with_ids)
    shape = "id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long"
    pieces = base.mapInArrow(make, schema)
    if groups == 1:
        out = pieces.groupBy("pack_group").applyInArrow(_pack(size, True, 0), shape)
    else:
        packed = common.cut(pieces.groupBy("pack_group").applyInArrow(_pack(size, False, 0), shape))
        left = packed.where("sequence_id < 0")
        again = max(1, round(left.count() / GROUP))
        left = left.drop("sequence_id", "offset").withColumn("pack_group", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(again)).cast("long"))
        left = left.select("id", "piece", "start", "length", "ids_crc32", "pack_group", "ids")
        out = packed.where("sequence_id >= 0").unionByName(left.groupBy("pack_group").applyInArrow(_pack(size, True, groups), shape))
    columns = [F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return out.select(*columns, *(["ids"] if with_ids else []))


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))
