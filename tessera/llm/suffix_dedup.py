"""Suffix-array deduplication of exact substrings (operator 2), by a distributed difference cover.

A byte goes if it lies in a `WINDOW`-byte string that also starts in a document with a smaller id.

1. Pruning, without loss.  Of the 26-byte grams in every 50 bytes, those of least hash are anchors; equal
   strings have equal anchors, so only windows near an anchor that two documents share can count.
   They are cut at anchors into pieces whose borders depend on content alone; equal pieces become one,
   owned by the least document that holds it.  Every later document that holds a piece loses all of its
   windows, so only the owner's windows are left to judge, and of those only the ones near anchors
   that pieces of different owners share.  What is left is the text of the suffix array.  Pieces are
   brought together by their least anchor, so that variants of one piece meet in one block.  A block
   judges its own windows by a suffix array of the block; what it finds no smaller owner for, near
   anchors that other blocks hold, goes to the distributed one.  Anchors of pieces are 38 bytes long.
2. Difference cover modulo 3, over super-characters of 8 bytes at each of the 8 alignments: suffixes in
   classes 1 and 2 are sampled.  Their triples (24 bytes) are sorted over all tasks by ranges and
   named in order; the recursion sorts triples of names (72 bytes), which is deeper than a
   window, so the recursion ends there.
3. The remaining suffixes, class 0, are merged with the sampled ones in each range by
   (character, rank) and (two characters, rank).
4. Adjacent suffixes of the merged order are compared over their first 50 bytes (by 64-bit hash); a run
   of equal prefixes is one string, and its least owner judges it.
5. Verdicts go back to pieces, and from pieces to every document.

Who decides: on the generated tables about an eighth of the text reaches step 2; pieces that later documents hold as a
whole (grouped by two 64-bit hashes of their bytes) are the most of what is removed, and windows with a smaller owner in
their own block are settled by the block's suffix array.  Nothing is lost on the way: what a step can't settle goes on.
Equality of prefixes is that of a 64-bit hash of their 50 bytes, compared between neighbours of the sorted order only.

The ranges come from a bounded sample of suffixes (`SAMPLED` blocks), by their first 16 bytes.  Messages are compressed;
every exchange sends one message per block and range with distinct entries, so what a third of all documents hold is
one entry a block.

Defined results: null counts as empty; texts under 50 bytes lose nothing; rows with one id don't remove
each other's text; rows with a null id are kept whole and take no part; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, answer, bucket_count, dealt, each_block, joined, loosen, messages, pack_text, rest_of, send, squeeze, task_count, tidy, to_blocks
from .common import R1, R2, U64, as_bytes, col, cut, member, mix, per_doc, release, runs, slices, slide_min, winnow

#: Anchors of texts, and those of owners' pieces: longer grams are more anchors, but fewer of them are shared by unlike windows.
WINDOW, GRAM, LONG_GRAM = 50, 26, 38
#: Text of a block of distinct pieces, and of how many holders of its pieces it knows (either, and one more part or piece).
OWNED_BYTES, OWNED_HOLDERS = 1 << 20, 1 << 18
#: One shared anchor in so many ends a piece; pieces are at least so many windows long.
EVERY, LEAST_PIECE = 4, 64
#: Zero bytes after each fragment, so that names near its end exist.
PAD = 40
#: The ranges' borders come from so many blocks, and so many suffixes of each.
SAMPLED, OF_EACH = 1000, 200
RANK_BITS = np.uint64(36)


def anchors(raw: np.ndarray, at: np.ndarray, sums: np.ndarray, size: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors that lie in one document, and the least gram of each window."""
    grams = R1.windows(sums, size)
    low = slide_min(grams, WINDOW - size + 1)
    where = winnow(grams, WINDOW - size + 1, low)
    if len(where):
        where = where[where + size <= at[np.searchsorted(at, where, "right")]]
    return where, mix(grams[where]), low  # minima are small numbers: mixed anew, they spread evenly over buckets


def near(raw: np.ndarray, at: np.ndarray, low: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Starts of the windows of one document whose anchor is in `held` (sorted), as a mask."""
    out = np.zeros(len(raw), bool)
    if not len(low) or not len(held):
        return out
    fresh = np.ones(len(low), bool)
    fresh[1:] = low[1:] != low[:-1]
    first = np.flatnonzero(fresh)
    out[: len(low)] = np.repeat(member(mix(low[first]), held), np.diff(np.append(first, len(low))))
    late = (at[1:, None] - np.arange(1, WINDOW)).ravel()  # starts too near a document's end
    out[late[late >= 0]] = False
    return out


def pieces_of(raw: np.ndarray, at: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces as starts and ends of their windows' starts, both hashes of their bytes, and their least anchor."""
    sums = R1.sums(raw)
    where, keys, low = anchors(raw, at, sums)
    ok = member(keys, held)
    where, keys = where[ok], keys[ok]
    start, end = runs(near(raw, at, low, held))  # never across documents: a document's last starts don't fit
    marks = where[keys % np.uint64(EVERY) == 0]
    lo, hi = np.searchsorted(marks, start, "right"), np.searchsorted(marks, end, "left")
    starts, ends = [], []
    for a, b, i, j in zip(start.tolist(), end.tolist(), lo.tolist(), hi.tolist(), strict=True):
        for c in marks[i:j].tolist():
            if c - a >= LEAST_PIECE:
                starts.append(a), ends.append(c)
                a = c
        starts.append(a), ends.append(b)
    s, e = np.array(starts, np.int64), np.array(ends, np.int64)
    least = np.zeros(len(s), np.uint64)
    if len(s):  # over anchors in the piece; every window has one in it
        lo, hi = np.searchsorted(where, s), np.searchsorted(where, e + WINDOW - GRAM)
        least = np.minimum.reduceat(np.append(keys, np.uint64(U64)), np.stack([lo, hi], 1).ravel())[::2]
    return s, e, R1.spans(sums, s, e + WINDOW - 1), R2.spans(R2.sums(raw), s, e + WINDOW - 1), least


def doc_of(at: np.ndarray, where: np.ndarray) -> np.ndarray:
    return np.searchsorted(at, where, "right") - 1


# --- exchange of anchors -------------------------------------------------------------------


def owners(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, with the least and greatest id of each."""
    if not len(keys):
        return keys, ids, ids
    order = np.argsort(keys)
    k, i = keys[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.minimum.reduceat(i, first), np.maximum.reduceat(i, first)


def shared(sent: DataFrame, with_ids: bool, tasks: int) -> DataFrame:
    """Replies (block, keys, far): each block's keys that documents with different ids hold; far: so do other blocks.

    Without ids, a key that two blocks hold counts as shared: that may keep some that aren't.
    """

    def work(t: pa.Table) -> pa.Table:
        keys, at = joined(t, "keys", np.uint64)
        s = np.sort(keys)
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        if with_ids:
            k, lo, _ = owners(keys, joined(t, "more0", np.int64)[0])
            _, _, hi = owners(keys, joined(t, "more1", np.int64)[0])
            held = k[lo < hi]
        else:
            held = np.unique(np.concatenate([twice, keys[joined(t, "more0", np.uint8)[0] > 0]]))
        ok, far = member(keys, held), member(keys, twice).astype(np.uint8)
        rows = [i for i in range(t.num_rows) if ok[at[i] : at[i + 1]].any()]

        def told(x: np.ndarray) -> pa.Array:
            return pa.array([x[at[i] : at[i + 1]][ok[at[i] : at[i + 1]]].tobytes() for i in rows], pa.binary())

        return pa.table({"block": t.column("block").take(pa.array(rows, pa.int64())), "keys": told(keys), "far": told(far)})

    return dealt(sent, "bucket", tasks).groupBy("bucket").applyInArrow(work, "block long, keys binary, far binary")


# --- the suffix array ----------------------------------------------------------------------


class Fragments(Block):
    """A block of fragments laid out with PAD zero bytes after each."""

    def __init__(self, block: Block):
        self.number, self.ids = block.number, block.ids
        size = np.diff(block.at)
        self.first = np.concatenate([[0], np.cumsum(size + PAD)])
        self.text = np.zeros(int(self.first[-1]) + 8, np.uint8)
        shift = np.repeat(self.first[:-1] - block.at[:-1], size)
        self.text[np.arange(len(block.raw)) + shift] = block.raw
        n = int(self.first[-1])
        self.owner = np.repeat(np.arange(len(size)), size + PAD)
        rel = np.arange(n) - self.first[self.owner]
        self.left = np.repeat(size, size + PAD) - rel  # bytes to the fragment's end
        self.kind = (np.arange(int(size.max(initial=0)) + PAD) // 8 % 3).astype(np.uint8)[rel]
        self.char = np.ndarray(n, ">u8", self.text, strides=(1,)).astype(np.uint64)  # eight bytes from each place on
        self.windows = np.flatnonzero(self.left >= WINDOW)
        #: sampled suffixes that get a rank, and those that get a first name
        self.ranked = np.flatnonzero((self.kind > 0) & (self.left >= WINDOW - 16))
        self.named = np.flatnonzero((self.kind > 0) & (self.left >= WINDOW - 16 - 48))

    def triples(self) -> np.ndarray:
        return np.stack([self.char[self.named + 8 * i] for i in range(3)])

    def hashes(self, p: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the `size` bytes from each of p on."""
        if not hasattr(self, "sums"):
            self.sums = R1.sums(self.text)
        return R1.spans(self.sums, p, p + size)

    def name_triples(self, names: np.ndarray) -> np.ndarray:
        at = np.zeros(len(self.char), np.uint64)
        at[self.named] = names
        return np.stack([at[self.ranked + 24 * i] for i in range(3)])


def fragments_in(block: Block, mask: np.ndarray) -> tuple[Block, tuple[np.ndarray, np.ndarray]]:
    """The text of the runs of windows in mask as a block of their own; which document and place each comes from."""
    start, end = runs(mask)
    which = doc_of(block.at, start)
    size = end - start + WINDOW - 1
    at = np.concatenate([[0], np.cumsum(size)])
    take = np.arange(at[-1]) + np.repeat(start - at[:-1], size)
    out = Block(block.number, block.ids[which].tobytes(), at.astype(np.int64).tobytes(), None, raw=block.raw[take])
    return out, (which.astype(np.int64), (start - block.at[which]).astype(np.int64))


def dense(x: np.ndarray) -> np.ndarray:
    """Ranks of unsigned numbers, from 0; equal ones have equal ranks."""
    order = np.argsort(x)
    s = x[order]
    fresh = np.zeros(len(x), np.uint64)
    fresh[1:] = s[1:] != s[:-1]
    out = np.empty(len(x), np.uint64)
    out[order] = np.cumsum(fresh)
    return out


def packed(*columns: np.ndarray) -> np.ndarray:
    """One number for each row, in the order of the rows (most significant first)."""

    def bits(x: np.ndarray) -> int:
        return int(x.max(initial=0)).bit_length()

    if sum(map(bits, columns)) > 64:
        columns = tuple(dense(x) if bits(x) > 21 else x for x in columns)
    out = columns[0]
    for x in columns[1:]:
        if bits(out) + bits(x) > 64:
            out = dense(out)
        out = (out << np.uint64(bits(x))) | x
    return out


def gathered(t: pa.Table, name: str, kind=np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The rows' arrays end to end, and offsets."""
    parts = [loosen(x.as_py(), kind) for x in t.column(name)]
    return np.concatenate(parts), np.cumsum([0, *map(len, parts)])


def range_of(c: np.ndarray, d: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The range of each pair of characters: how many of the sorted edges [2, n] it isn't below."""
    lo, hi = np.searchsorted(edges[0], c, "left"), np.searchsorted(edges[0], c, "right")
    out = lo.astype(np.int64)
    tied = np.flatnonzero(hi > lo)
    for k in np.unique(lo[tied]):
        mine = tied[lo[tied] == k]
        out[mine] += np.searchsorted(edges[1, k : hi[mine[0]]], d[mine], "right")
    return out


class Entries:
    """Distinct items among many: by equal hashes and, if given, equal words (rows of [k, n]).

    lead: one place of each; back: which entry each item went to.  Entries are in order of their ranges.
    """

    def __init__(self, hashes: np.ndarray, words: np.ndarray | None = None):
        self.order = np.argsort(hashes)
        fresh = self._fresh(hashes)
        if words is not None and (self._differ(words) & ~fresh[1:]).any():
            self.order = np.argsort(hashes, kind="stable")  # hashes collide: entries must come in the same order anywhere
            fresh = self._fresh(hashes)
            fresh[1:] |= self._differ(words)
        self.first = np.flatnonzero(fresh)
        self.lead = self.order[self.first]
        self.went = np.cumsum(fresh) - 1

    def _fresh(self, hashes: np.ndarray) -> np.ndarray:
        s = hashes[self.order]
        return np.concatenate([np.ones(min(1, len(s)), bool), s[1:] != s[:-1]])

    def _differ(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(max(0, len(self.order) - 1), bool)
        for w in words:
            w = w[self.order]
            out |= w[1:] != w[:-1]
        return out

    def by_range(self, place: np.ndarray, key: np.ndarray, turn: int) -> None:
        """place: the range of each entry; within it they come in the order of 32 bits of key, from `turn` on: like ones compress."""
        by = np.arange(len(place))
        for digit in (key >> np.uint64(turn), key >> np.uint64(turn + 16), place, place >> 16):
            by = by[np.argsort(digit[by].astype(np.uint16), kind="stable")]
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        self.lead, self.place, self.by = self.lead[by], place[by], by
        self.back = np.empty(len(self.order), np.int64)
        self.back[self.order] = rank[self.went]

    def least(self, values: np.ndarray) -> np.ndarray:
        """The least value of each entry's items."""
        return np.minimum.reduceat(values[self.order], self.first)[self.by] if len(self.first) else values[:0]

    def messages(self, block: int, *arrays: np.ndarray) -> pa.Table:
        """One row for each range that has entries, with their parts of the arrays."""
        full, start = np.unique(self.place, return_index=True)
        stop = np.append(start[1:], len(self.place))[: len(start)]
        out = {"bucket": pa.array(full.astype(np.int64)), "block": pa.array(np.full(len(full), block, np.int64))}
        for i, x in enumerate(arrays):
            out[f"m{i}"] = pa.array([squeeze(x[a:b]) for a, b in zip(start, stop, strict=True)], pa.binary())
        return pa.table(out)


def named(sent: DataFrame, kind: int, tasks: int) -> DataFrame:
    """Sorts the triples of each range and names them in order; replies (block, kind, bucket, names)."""

    def work(t: pa.Table) -> pa.Table:
        parts = [gathered(t, f"m{i}") for i in range(3)]
        at = parts[0][1]
        rank = dense(packed(*(p[0] for p in parts)))
        names = (np.uint64(t.column("bucket")[0].as_py() + 1) << RANK_BITS) | rank
        return pa.table({"block": t.column("block"), "kind": pa.array(np.full(t.num_rows, kind, np.int64)), "bucket": t.column("bucket"), "names": pa.array([squeeze(names[at[i] : at[i + 1]]) for i in range(t.num_rows)], pa.binary())})

    return dealt(sent, "bucket", tasks).groupBy("bucket").applyInArrow(work, "block long, kind long, bucket long, names binary")


def names_in(replies: pa.Table, kind: int) -> np.ndarray:
    """The answers to a block's distinct entries, in their order; of kind 3 they are flags."""
    rows = sorted((b.as_py(), n.as_py()) for k, b, n in zip(replies.column("kind"), replies.column("bucket"), replies.column("names"), strict=True) if k.as_py() == kind)
    form = np.uint8 if kind == 3 else np.uint64
    return np.concatenate([np.zeros(0, form), *(loosen(n, form) for _, n in rows)])


def judge(c, d, r, r8, r16, h, kind, owner) -> np.ndarray:
    """The least owner of each suffix's window: merges suffixes of class 0 with the sampled ones, then compares
    adjacent prefixes."""
    n = len(c)
    s0, s1, s2 = (np.flatnonzero(kind == k) for k in range(3))
    sampled = np.concatenate([s1, s2])
    sampled = sampled[np.argsort(r[sampled])]
    if c.max(initial=0) >= np.uint64(1 << 32):  # characters, not their ranks
        c, d = np.split(dense(np.concatenate([c, d])), 2)
    one, two = packed(c, r8), packed(c, d, r16)
    s0 = s0[np.argsort(one[s0])]

    def less(others: np.ndarray, key: np.ndarray) -> np.ndarray:
        """How many of others are less than each of s0, whose keys rise."""
        return np.searchsorted(np.sort(key[others]), np.maximum.accumulate(key[s0]))

    place = np.arange(len(s0)) + less(s1, one) + less(s2, two)
    order = np.empty(n, np.int64)
    free = np.ones(n, bool)
    free[place] = False
    order[place], order[free] = s0, sampled
    prefix, least = h[order], np.empty(n, np.int64)
    if n:
        first = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
        least[order] = np.repeat(np.minimum.reduceat(owner[order], first), np.diff(np.append(first, n)))
    return least


def least_owner(sent: DataFrame, tasks: int) -> DataFrame:
    """Judges each range's suffixes; replies whether a smaller owner has each."""

    def work(t: pa.Table) -> pa.Table:
        *words, (kind, _), (owner, _) = [*(gathered(t, f"m{i}") for i in range(6)), gathered(t, "m6", np.uint8), gathered(t, "m7", np.int64)]
        at = words[0][1]
        flags = (judge(*(w for w, _ in words), kind, owner) < owner).astype(np.uint8)
        return pa.table({"block": t.column("block"), "kind": pa.array(np.full(t.num_rows, 3, np.int64)), "bucket": t.column("bucket"), "names": pa.array([squeeze(flags[at[i] : at[i + 1]]) for i in range(t.num_rows)], pa.binary())})

    return dealt(sent, "bucket", tasks).groupBy("bucket").applyInArrow(work, "block long, kind long, bucket long, names binary")


def keys_of(f: Fragments, p: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, ...]:
    """What suffixes at p are merged by: two characters (or their ranks), their own rank, those 8 and 16 bytes on; window hash; class; owner."""
    at = np.zeros(len(f.char), np.uint64)
    at[f.ranked] = ranks
    kind, nothing = f.kind[p], np.uint64(0)
    second = np.where(kind == 1, nothing, f.char[p + 8])
    own, r8, r16 = np.where(kind == 0, nothing, at[p]), np.where(kind == 2, nothing, at[p + 8]), np.where(kind == 1, nothing, at[p + 16])
    return f.char[p], second, own, r8, r16, f.hashes(p, WINDOW), kind.astype(np.uint8), f.ids[f.owner[p]]


def judged_here(f: Fragments) -> np.ndarray:
    """The least owner in the block of each of its windows, by a suffix array of the block."""
    used = np.flatnonzero(f.left > 0)
    f.char[used] = dense(f.char[used]) + np.uint64(1)  # 0 stays behind the end
    names = dense(packed(*f.triples())) + np.uint64(1)
    ranks = dense(packed(*f.name_triples(names))) + np.uint64(1)
    return judge(*keys_of(f, f.windows, ranks))


def flagged(fragments: DataFrame, buckets: int, tasks: int) -> DataFrame:
    """block, index (fragment), spans: runs of window starts whose string a smaller owner holds too."""

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in each_block(batches):
            f = Fragments(block)
            p = f.named[:: max(1, len(f.named) // OF_EACH)]
            yield pa.RecordBatch.from_arrays([pa.array([np.stack([f.char[p], f.char[p + 8]], 1).tobytes()], pa.binary())], ["c"])

    few = fragments.select("block", "ids", "offsets", "text")
    few = few.join(F.broadcast(fragments.select("block").orderBy(F.xxhash64("block")).limit(SAMPLED)), "block", "left_semi")
    got = np.frombuffer(b"".join(bytes(r[0]) for r in few.mapInArrow(drawn, "c binary").collect()), np.uint64).reshape(-1, 2)
    got = got[np.lexsort(got.T[::-1])]
    edges = np.unique(got[np.linspace(0, len(got) - 1, buckets + 1).astype(np.int64)[1:-1]] if len(got) else got, axis=0).T
    message = "bucket long, block long, "
    triple = message + ", ".join(f"m{i} binary" for i in range(3))

    def first_entries(f: Fragments) -> tuple[Entries, np.ndarray]:
        words = f.triples()
        entries = Entries(f.hashes(f.named, 24), words)
        words = words[:, entries.lead]
        entries.by_range(range_of(words[0], words[1], edges), words[0], 32)
        return entries, words[:, entries.by]

    def second_entries(f: Fragments, replies: pa.Table) -> tuple[Entries, np.ndarray]:
        words = f.name_triples(names_in(replies, 1)[first_entries(f)[0].back])
        entries = Entries(f.hashes(f.ranked, 72), words)
        words = words[:, entries.lead]
        entries.by_range((words[0] >> RANK_BITS).astype(np.int64) - 1, words[0], 0)
        return entries, words[:, entries.by]

    def window_entries(f: Fragments) -> Entries:
        entries = Entries(f.hashes(f.windows, WINDOW))
        p = f.windows[entries.lead]
        entries.by_range(range_of(f.char[p], f.char[p + 8], edges), f.char[p], 32)
        return entries

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in each_block(batches):
            entries, words = first_entries(Fragments(block))
            yield from entries.messages(block.number, *words).to_batches()

    names = cut(named(fragments.select("block", "ids", "offsets", "text").mapInArrow(first, triple), 1, tasks), "names")

    def second(block: Block, replies: pa.Table) -> pa.Table:
        entries, words = second_entries(Fragments(block), replies)
        return entries.messages(block.number, *words)

    ranks = cut(named(answer(fragments, names, second, triple, tasks=tasks), 2, tasks), "ranks")
    known = names.unionByName(ranks)

    def third(block: Block, replies: pa.Table) -> pa.Table:
        f = Fragments(block)
        mine = names_in(replies, 2)[second_entries(f, replies)[0].back]
        entries = window_entries(f)
        rows = keys_of(f, f.windows[entries.lead], mine)
        return entries.messages(block.number, *rows[:7], entries.least(f.ids[f.owner[f.windows]]))

    judged = cut(least_owner(answer(fragments, known, third, message + ", ".join(f"m{i} binary" for i in range(8)), tasks=tasks), tasks), "owners")
    release(names)
    release(ranks)
    tidy(fragments.sparkSession)

    def last(block: Block, replies: pa.Table) -> pa.Table:
        f = Fragments(block)
        entries, own = window_entries(f), f.ids[f.owner[f.windows]]
        mask = np.zeros(len(f.char), bool)
        mask[f.windows] = (names_in(replies, 3)[entries.back] > 0) | (entries.least(own)[entries.back] < own)
        start, end = runs(mask)
        which = f.owner[start]
        start, end = start - f.first[which], end - f.first[which]
        cuts = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]])) if len(which) else which
        stops = np.append(cuts[1:], len(which)) if len(which) else which
        return pa.table({"block": pa.array(np.full(len(cuts), block.number, np.int64)), "index": pa.array(which[cuts].astype(np.int64)), "spans": pa.array([np.stack([start[i:j], end[i:j]]).tobytes() for i, j in zip(cuts, stops, strict=True)], pa.binary())})

    return cut(answer(fragments, judged, last, "block long, index long, spans binary", tasks=tasks), "flagged")


def swap(table: DataFrame, *columns: str, of: DataFrame | None = None) -> DataFrame:
    """Some columns of a written table, or of rows of one, written anew; the table goes."""
    out = cut(table.select(*columns), "columns")
    release(of or table)
    tidy(table.sparkSession)
    return out


# --- the operator --------------------------------------------------------------------------


def suffix_dedup(docs: DataFrame, with_text: bool = True, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, the columns of `carry` and,
    with_text, the kept bytes."""
    spark = docs.sparkSession
    blocks = to_blocks(docs, id_col, text_col, carry)
    buckets, tasks = bucket_count(blocks), task_count(blocks)

    def marks(block: Block) -> pa.RecordBatch | None:
        where, keys, _ = anchors(block.raw, block.at, R1.sums(block.raw))
        k, lo, hi = owners(keys, block.ids[doc_of(block.at, where)])
        return messages(block.number, k, buckets, (lo < hi).astype(np.uint8))

    held = cut(shared(send(blocks, marks, 1), False, tasks).drop("far"), "anchors")
    tidy(spark)

    def cut_up(block: Block, replies: pa.Table) -> pa.Table:
        """A row for each distinct piece of the block, the first also with the places of all pieces."""
        s, e, a, b, least = pieces_of(block.raw, block.at, np.sort(joined(replies, "keys", np.uint64)[0]))
        ids = block.ids[doc_of(block.at, s)]
        order = np.lexsort((ids, b, a))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        one, which = order[fresh], np.empty(len(order), np.int64)
        which[order] = np.cumsum(fresh) - 1
        data = [block.raw[i : j + WINDOW - 1].tobytes() for i, j in zip(s[one].tolist(), e[one].tolist(), strict=True)]
        places = [*([squeeze(s, True), squeeze(e, True), squeeze(which)] if len(s) else [])]
        many = np.bincount(which, minlength=len(one)) > 1
        columns = {"a": pa.array(a[one].view(np.int64)), "b": pa.array(b[one].view(np.int64)), "doc": pa.array(ids[one]), "many": pa.array(many), "block": pa.array(np.full(len(one), block.number, np.int64)), "nth": pa.array(np.arange(len(one))), "least": pa.array(least[one].view(np.int64)), "data": pa.array(data, pa.binary())}
        return pa.table(columns | {"places": pa.array(([places] + [None] * len(one))[: len(one)], pa.list_(pa.binary()))})

    pieces = cut(answer(blocks, held, cut_up, "a long, b long, doc long, many boolean, block long, nth long, least long, data binary, places array<binary>", tasks=tasks), "pieces")
    release(held)
    tidy(spark)

    # Distinct pieces in blocks of their own, and who holds them: [piece of the block, block of texts, its nth piece, document, many].
    # Equal pieces come one after another, the owner's first, so a group that goes on in the next part belongs to the last piece.
    most_bytes, most_holders = OWNED_BYTES, OWNED_HOLDERS

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 32, 0
        last, data, ids, members = None, [], [], []

        def emit() -> pa.RecordBatch:
            raw, at = as_bytes(pa.concat_arrays(data))
            return pa.RecordBatch.from_arrays([pa.array([base + made]), pa.array([np.concatenate(ids).tobytes()]), pa.array([at.tobytes()]), pa.array([pack_text(raw)]), pa.array([squeeze(np.concatenate(members, axis=1).ravel())])], ["block", "ids", "offsets", "text", "members"])

        for part in slices(batches, "data", most_bytes):
            a, b, doc, block, nth, many = (col(part, x).cast(pa.int64()).to_numpy() for x in ("a", "b", "doc", "block", "nth", "many"))
            fresh = np.ones(len(a), bool)
            fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            fresh[0] = last != (a[0], b[0])
            last = a[-1], b[-1]
            begin = int(np.argmax(fresh)) if fresh.any() else len(a)
            piece = np.cumsum(fresh) - 1 + sum(map(len, ids))
            rows = np.stack([piece, block, nth, doc, many])
            if begin:
                members.append(rows[:, :begin])
            if begin == len(a):
                continue
            if sum(x.nbytes for x in data) >= most_bytes or sum(x.shape[1] for x in members) >= most_holders:
                yield emit()
                rows[0] -= sum(map(len, ids))
                made, data, ids, members = made + 1, [], [], []
            data.append(col(part, "data").filter(pa.array(fresh)))
            ids.append(doc[fresh])
            members.append(rows[:, begin:])
        if data:
            yield emit()

    # variants of one piece mostly have the same least anchor: sorted by it, they meet in one block
    by = ("least", "a", "b")
    alike = pieces.drop("places").repartitionByRange(tasks, *by).sortWithinPartitions(*by, "doc")
    owned = cut(alike.mapInArrow(gather, "block long, ids binary, offsets binary, text binary, members binary"), "owned")
    places = swap(pieces.where("nth = 0"), "block", "places", of=pieces)

    def piece_marks(block: Block) -> pa.RecordBatch | None:
        where, keys, _ = anchors(block.raw, block.at, R1.sums(block.raw), LONG_GRAM)
        k, lo, hi = owners(keys, block.ids[doc_of(block.at, where)])
        return messages(block.number, k, buckets, lo, hi)

    def fragment(block: Block, replies: pa.Table) -> pa.Table:
        keys, far = joined(replies, "keys", np.uint64)[0], joined(replies, "far", np.uint8)[0]
        low = slide_min(R1.windows(R1.sums(block.raw), LONG_GRAM), WINDOW - LONG_GRAM + 1)
        here, origin = fragments_in(block, near(block.raw, block.at, low, np.sort(keys)))
        mask = np.zeros(len(block.raw), bool)
        again = np.zeros(len(block.raw), bool)
        if len(here.ids):
            f = Fragments(here)
            place = f.windows - f.first[f.owner[f.windows]] + origin[1][f.owner[f.windows]] + block.at[origin[0][f.owner[f.windows]]]
            own = judged_here(f) < f.ids[f.owner[f.windows]]
            mask[place] = own
            again[place] = ~own
        there, origin = fragments_in(block, again & near(block.raw, block.at, low, np.sort(keys[far > 0])))
        start, end = runs(mask)
        which = doc_of(block.at, start)
        local = np.stack([which, start - block.at[which], end - block.at[which]])
        columns = ([block.number], [there.ids.tobytes()], [there.at.tobytes()], [pack_text(there.raw)], [np.stack(origin).tobytes()], [local.astype(np.int64).tobytes()])
        return pa.table(dict(zip(("block", "ids", "offsets", "text", "origin", "local"), columns, strict=True)))

    fragments = cut(answer(owned, shared(send(owned, piece_marks, 2), True, tasks), fragment, "block long, ids binary, offsets binary, text binary, origin binary, local binary", tasks=tasks), "fragments")
    members = swap(owned, "block", "ids", "members")
    found = flagged(fragments, buckets, tasks)

    # verdicts go to the blocks of texts that hold the pieces: nth, owner, number of spans of each, and the spans (windows' starts in the piece)
    def to_blocks_of_texts(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return nothing
        origin = np.frombuffer(left.column("origin")[0].as_py(), np.int64).reshape(2, -1)
        local = np.frombuffer(left.column("local")[0].as_py(), np.int64).reshape(3, -1)
        owner = np.frombuffer(left.column("owners")[0].as_py(), np.int64)
        piece, block, nth, doc, many = loosen(left.column("members")[0].as_py(), np.int64).reshape(5, -1)
        spans = [local]
        for i, data in zip(right.column("index").to_pylist(), right.column("spans").to_pylist(), strict=True):
            found = np.frombuffer(data, np.int64).reshape(2, -1) + origin[1, i]
            spans.append(np.concatenate([np.full((1, found.shape[1]), origin[0, i]), found]))
        spans = np.concatenate(spans, axis=1)
        spans = spans[:, np.argsort(spans[0], kind="stable")]
        count = np.bincount(spans[0], minlength=len(owner))
        owner, count, first = owner[piece], np.where(owner[piece] == doc, count[piece], 0), (np.cumsum(count) - count)[piece]
        told = np.flatnonzero((owner < doc) | (many > 0) | (count > 0))
        told = told[np.argsort(block[told], kind="stable")]
        block, nth, owner, count, first = (x[told] for x in (block, nth, owner, count, first))
        ends = np.concatenate([[0], np.cumsum(count)])
        bounds = spans[1:, np.arange(ends[-1]) + np.repeat(first - ends[:-1], count)]
        blocks, start = np.unique(block, return_index=True)
        stop = np.append(start[1:], len(block))[: len(start)]
        return pa.table({"block": pa.array(blocks.astype(np.int64)), "told": pa.array([np.stack([nth[i:j], owner[i:j], count[i:j]]).tobytes() for i, j in zip(start, stop, strict=True)], pa.binary()), "spans": pa.array([bounds[:, ends[i] : ends[j]].tobytes() for i, j in zip(start, stop, strict=True)], pa.binary())})

    nothing = pa.schema([("block", pa.int64()), ("told", pa.binary()), ("spans", pa.binary())]).empty_table()
    origin = fragments.select("block", "origin", "local").join(members.withColumnRenamed("ids", "owners"), "block")
    told = cut(origin.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(to_blocks_of_texts, "block long, told binary, spans binary"), "told")
    for x in (members, fragments, found):
        release(x)
    tidy(spark)

    def clean(block: Block, replies: pa.Table) -> pa.RecordBatch:
        gone = np.zeros(len(block.raw) + 1, np.int32)
        cuts = [x for x in replies.column("places").to_pylist() if x]
        if cuts:
            s, e, which = loosen(cuts[0][0], np.int64, True), loosen(cuts[0][1], np.int64, True), loosen(cuts[0][2], np.int64)
            has = [x for x in zip(replies.column("told").to_pylist(), replies.column("spans").to_pylist(), strict=True) if x[0]]
            nth, owner, count = np.concatenate([np.zeros((3, 0), np.int64), *(np.frombuffer(x, np.int64).reshape(3, -1) for x, _ in has)], axis=1)
            spans = np.concatenate([np.zeros((2, 0), np.int64), *(np.frombuffer(x, np.int64).reshape(2, -1) for _, x in has)], axis=1)
            row = np.full(which.max() + 1, -1)  # a piece of one place, by its owner and without spans, isn't told
            row[nth] = np.arange(len(nth))
            row = row[which]
            s, e, row = s[row >= 0], e[row >= 0], row[row >= 0]
            later = owner[row] < block.ids[doc_of(block.at, s)]
            np.add.at(gone, s[later], 1)
            np.subtract.at(gone, e[later] + WINDOW - 1, 1)
            s, row = s[~later], row[~later]
            first, count = (np.cumsum(count) - count)[row], count[row]
            at = np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)
            np.add.at(gone, np.repeat(s, count) + spans[0, at], 1)
            np.subtract.at(gone, np.repeat(s, count) + spans[1, at] + WINDOW - 1, 1)
        gone = np.cumsum(gone[:-1]) > 0
        start = gone.copy()
        start[1:] &= ~gone[:-1]
        borders = block.at[:-1][block.at[:-1] < len(block.raw)]
        start[borders] = gone[borders]
        kept = block.raw[~gone]
        at = np.concatenate([[0], np.cumsum(per_doc(~gone, block.at))])
        rows = range(len(block.ids))
        columns = [pa.array(block.ids), pa.array(np.diff(block.at)), pa.array(per_doc(gone, block.at)), pa.array(per_doc(start, block.at)), pa.array([hashlib.sha256(kept[at[i] : at[i + 1]]).hexdigest() for i in rows], pa.string())]
        if with_text:
            columns.append(pa.array([kept[at[i] : at[i + 1]].tobytes() for i in rows], pa.binary()))
        if carry:
            columns += rest_of(block.rest)
        return pa.RecordBatch.from_arrays(columns, [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text, *carry])

    kinds = "".join(f", `{x}` {docs.schema[x].dataType.simpleString()}" for x in carry)
    found = answer(blocks, told.unionByName(places, allowMissingColumns=True), clean, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text + kinds, bool(carry), tasks)
    whole = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    nothing_gone = [F.octet_length(whole).cast("long"), *[F.lit(0).cast("long")] * 2, F.sha2(whole, 256), *[whole] * with_text, *(F.col(f"`{x}`") for x in carry)]
    return found.union(docs.where(F.col(id_col).isNull()).select(F.col(id_col).cast("long"), *nothing_gone))
