"""Best-fit packing of token sequences, finished by swap-based local search.

Pieces are dealt evenly into groups; a task packs one group with best fit, then improves it: it
takes the emptiest bin and moves its pieces into other underfull bins, exchanges one piece for one
smaller piece, or two pieces for one, whenever that raises the sum of squared fills. A bin that
runs empty is gone. The underfull bins of all groups are then dealt out anew, whole, to as many groups
as their pieces need, each with its share of every fill, and packed again, until one group is left
or a level has as many bins as the one before. So few sequences depend on how many groups there
were, and no group holds much more than GROUP pieces, whatever the lengths are.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import encoder, vocabulary_path
from .frames import keyed, out_id, ready
from .words import flat, slices

CAPACITY = 2048
GROUP = 50_000
OPEN = 16
NONE = 1 << 62


class Bins:
    """Bins by remaining room, with a bit mask of the rooms that occur: best fit is one bit search.

    Exchanges are found by length. A bin of room r that gives a piece of length t away can take up to
    r + t in its place; ``givers`` has the bins by (r + t, t), ``lengths`` the t of each r + t as a bit
    mask, and ``least`` the smallest of them.
    """

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.length = lengths.tolist()
        self.capacity = capacity
        self.items: list[list[tuple[int, int]]] = []
        self.room: list[int] = []
        self.by_room: list[dict[int, None]] = [{} for _ in range(capacity + 1)]
        self.mask = 0
        self.givers: dict[tuple[int, int], dict[int, None]] = {}
        self.lengths = [0] * (2 * capacity + 1)
        self.least = np.full(2 * capacity + 1, NONE)

    def _out(self, b: int) -> None:
        room = self.by_room[self.room[b]]
        del room[b]
        if not room:
            self.mask &= ~(1 << self.room[b])

    def _in(self, b: int, room: int) -> None:
        self.room[b] = room
        self.by_room[room][b] = None
        self.mask |= 1 << room

    def put(self, item: int, b: int) -> None:
        self._out(b)
        insort(self.items[b], (self.length[item], item))
        self._in(b, self.room[b] - self.length[item])

    def take(self, item: int, b: int) -> None:
        self._out(b)
        del self.items[b][bisect_left(self.items[b], (self.length[item], item))]
        self._in(b, self.room[b] + self.length[item])

    def new(self) -> int:
        self.items.append([])
        self.room.append(self.capacity)
        self._in(len(self.room) - 1, self.capacity)
        return len(self.room) - 1

    def least_room(self, size: int) -> int:
        """The smallest room of at least ``size`` that some bin has, or -1."""
        rest = self.mask >> size
        return size + (rest & -rest).bit_length() - 1 if rest else -1

    def best_fit(self) -> None:
        for item in sorted(range(len(self.length)), key=lambda i: (-self.length[i], i)):
            room = self.least_room(self.length[item])
            self.put(item, next(iter(self.by_room[room])) if room >= 0 else self.new())

    def other(self, room: int, b: int) -> int:
        return next((x for x in self.by_room[room] if x != b), -1)

    def show(self, b: int) -> None:
        """From now on bin ``b`` is found by what it can take for one of its pieces."""
        for t in {t for t, _ in self.items[b]} if self.room[b] else ():
            u = self.room[b] + t
            self.givers.setdefault((u, t), {})[b] = None
            self.lengths[u] |= 1 << t
            if t < self.least[u]:
                self.least[u] = t

    def hide(self, b: int) -> None:
        for t in {t for t, _ in self.items[b]} if self.room[b] else ():
            u = self.room[b] + t
            del self.givers[u, t][b]
            if not self.givers[u, t]:
                del self.givers[u, t]
                rest = self.lengths[u] = self.lengths[u] & ~(1 << t)
                self.least[u] = (rest & -rest).bit_length() - 1 if rest else NONE

    def improve_bin(self, a: int) -> bool:
        """One raising step for the hidden bin ``a``: a piece leaves for a fuller bin, or one or two change with a smaller one."""
        sizes = {size: item for size, item in self.items[a]}
        for size in sorted(sizes, reverse=True):
            room = self.least_room(size)
            while 0 <= room < size + self.room[a]:
                b = self.other(room, a)
                if b >= 0:
                    self.hide(b)
                    self.take(sizes[size], a)
                    self.put(sizes[size], b)
                    self.show(b)
                    return True
                room = self.least_room(room + 1)
        for size in sorted(sizes, reverse=True):
            if self.exchange(a, size, [sizes[size]]):
                return True
        own, tried = self.items[a], set()
        for i in range(len(own)):
            if i > 1 and own[i][0] == own[i - 2][0]:
                continue  # two of a length make all its pairs
            for j in range(i):
                size = own[i][0] + own[j][0]
                if size not in tried:
                    tried.add(size)
                    if self.exchange(a, size, [own[i][1], own[j][1]]):
                        return True
        return False

    def exchange(self, a: int, size: int, out: list[int]) -> bool:
        """Give ``out`` of length ``size`` to a bin that becomes fuller than ``a`` is, for one smaller piece, if there is one."""
        fits = self.least[size:size + self.room[a]] < size
        at = int(fits.argmax())
        if not fits[at]:
            return False
        u = size + at
        t = int(self.least[u])
        b = next(iter(self.givers[u, t]))
        back = self.items[b][bisect_left(self.items[b], (t, -1))][1]
        self.hide(b)
        for item in out:
            self.take(item, a)
        self.take(back, b)
        for item in out:
            self.put(item, b)
        self.put(back, a)
        self.show(b)
        return True

    def improve(self) -> None:
        """Local search until no underfull bin has a raising step; each step raises an integer sum."""
        for b in range(len(self.room)):
            self.show(b)
        bins = sorted((b for b in range(len(self.room)) if OPEN < self.room[b] < self.capacity), key=lambda b: -self.room[b])
        again = True
        while again:
            again = False
            for b in bins:
                self.hide(b)
                while self.items[b] and self.room[b] and self.improve_bin(b):
                    again = True
                self.show(b)
            bins = sorted((b for b in range(len(self.room)) if self.items[b] and self.room[b] > OPEN), key=lambda b: -self.room[b])


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each length (all at most ``capacity``), numbered from 0 without gaps."""
    bins = Bins(lengths, capacity)
    bins.best_fit()
    bins.improve()
    out, number = np.zeros(len(lengths), np.int64), 0
    for items in bins.items:
        for _, item in items:
            out[item] = number
        number += bool(items)
    return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = 0, path: str | None = None) -> DataFrame:
    """``_id, _fp, piece, start, length, ids_crc32``: every text's ids and the end id, cut only where longer than ``capacity``."""
    path = path or vocabulary_path()

    def cut(batches):
        coder = encoder(path)
        for batch in batches:
            for part in slices(batch, most=4 << 20):
                ids, first = coder.encode(flat(part.column("text")))
                n = np.diff(first)
                with_end = np.full(len(ids) + len(n), end, "<u4")
                with_end[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                n, begin = n + 1, first[:-1] + np.arange(len(n))
                k = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), k)
                number = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                start = number * capacity
                length = np.minimum(n[row] - start, capacity)
                raw = memoryview(with_end.tobytes())
                at = (begin[row] + start).tolist()
                crc = [zlib.crc32(raw[4 * a:4 * (a + m)]) for a, m in zip(at, length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    part.column("_id").take(pa.array(row)), part.column("_fp").take(pa.array(row)), pa.array(number.astype(np.int32)),
                    pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["_id", "_fp", "piece", "start", "length", "ids_crc32"])

    return keyed(docs).mapInArrow(cut, "_id long, _fp long, piece int, start long, length long, ids_crc32 long")


def _packed(rows: DataFrame, capacity: int, level: int) -> DataFrame:
    """Each group packed; bins that came in (``sequence_id`` of the level before) stay where that takes fewer."""
    names = ["_id", "_fp", "piece", "start", "length", "ids_crc32", "grp", "sequence_id", "offset", "done"]

    def solve(table: pa.Table) -> pa.Table:
        order = np.lexsort([table.column(c).to_numpy() for c in ("piece", "_fp", "_id")])
        table = table.take(pa.array(order))
        length = table.column("length").to_numpy()
        group = table.column("grp")[0].as_py()
        bins = pack(length, capacity)
        fill = np.bincount(bins, length).astype(np.int64)
        if level:
            came = np.unique(table.column("sequence_id").to_numpy(), return_inverse=True)[1]
            came_fill = np.bincount(came, length).astype(np.int64)
            if (len(came_fill), -(came_fill ** 2).sum()) < (len(fill), -(fill ** 2).sum()):
                bins, fill = came, came_fill
        by_bin = np.argsort(bins, kind="stable")
        before = np.cumsum(length[by_bin]) - length[by_bin]
        first = np.r_[True, np.diff(bins[by_bin]) != 0]
        offset = np.empty(len(bins), np.int64)
        offset[by_bin] = before - before[first][np.cumsum(first) - 1]
        done = (capacity - fill <= OPEN)[bins]
        own = {"grp": group, "sequence_id": (level << 48) + (group << 24) + bins, "offset": offset, "done": done}
        return pa.table({c: table.column(c) if c not in own else pa.array(np.full(len(bins), own[c]) if c == "grp" else own[c]) for c in names})

    return rows.groupBy("grp").applyInArrow(
        solve, "_id long, _fp long, piece int, start long, length long, ids_crc32 long, grp long, sequence_id long, offset long, done boolean")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end: int = 0, path: str | None = None, group: int = GROUP) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    Returns one row a piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. A null
    or empty text is its end id alone; a null doc_id stays null; repeated rows are packed as often
    as they occur; an empty table gives no rows; other columns are not read.
    """
    ready(docs.sparkSession)
    # Both levels read the pieces again; the checkpoint spares encoding all texts twice.
    every = pieces(docs, capacity, end, path).checkpoint()
    full = (F.col("length") == capacity)
    spread = F.xxhash64("_id", "_fp", "piece", F.monotonically_increasing_id())
    whole = every.where(full).withColumns({"sequence_id": F.lit(1 << 62) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    groups = max(1, -(-every.where(~full).count() // group))
    rows = every.where(~full).withColumns({"grp": F.pmod(spread, F.lit(groups)), "sequence_id": F.lit(0).cast("long")})
    out, level, before = [whole], 0, None
    while groups > 1:
        got = _packed(rows, capacity, level).checkpoint()
        first = F.col("offset") == 0  # one piece a bin
        n, n_open, pieces_open = got.agg(F.count_if(first), F.count_if(first & ~F.col("done")), F.count_if(~F.col("done"))).first()
        if not n_open or n == before:
            out.append(got)
            break
        out.append(got.where("done"))
        groups, level, before = -(-pieces_open // group), level + 1, n_open
        rows = got.where("not done").select("_id", "_fp", "piece", "start", "length", "ids_crc32", "sequence_id").withColumn(
            "grp", F.pmod(F.xxhash64("sequence_id", F.lit(level)), F.lit(groups)))
    else:
        out.append(_packed(rows, capacity, level))
    columns = [out_id(), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    whole = out[0].select(*columns)
    for more in out[1:]:
        whole = whole.unionByName(more.select(*columns))
    return whole


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    from .frames import documents

    return pack_documents(documents(spark, sf_dir))
