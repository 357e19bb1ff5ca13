"""Operators 1 and 7: exact removal of passages that occur earlier in the corpus.

Both remove every symbol (a word for operator 1, a byte for operator 7) covered by a window of n symbols that also
starts earlier: in a document of smaller id, or earlier in the same document.  They share the distributed frame and
differ in the index that decides within a shard:

* `substring_dedup` (1) builds a compressed FM-index of a shard's passages, over a wavelet tree (in the form of a
  wavelet matrix with packed bits), and streams the passages through it by backward search, which gives matching
  statistics; intervals at the threshold are reported where an earlier place is in them.
* `suffix_array_dedup` (7) orders the suffixes of a shard, and expands intervals of the Burrows-Wheeler transform
  breadth-first to the left, which derives common prefixes by increasing value up to n; suffixes between which no
  smaller prefix was met share n bytes.

The frame finds what has to meet in one shard.  Of every n - k + 1 consecutive spans of k symbols the one with the
least hash is an anchor (winnowing), so that each repeated window holds, at the same offset, an anchor that occurs
at each of its places.  Documents are dealt into chunks of about CHUNK bytes by their id.

1. Anchors: each chunk sends a row for each distinct anchor and context (all windows around it): their hashes and the
   first place.
2. Rows sorted by anchor tell, for each of them: alone; the same context occurs earlier (so all its windows do); other
   contexts have the anchor; or so many have it that it is hot.  Only those that aren't alone are told so.
3. Chunks mark the second kind, and send the contexts of the third to a shard of that anchor, where the index decides;
   for hot anchors, whose contexts could be a third of the corpus, they send the windows' 128-bit hashes instead, after
   the least place of each within the chunk.
4. Shards, and the windows' rows in sorted order, return the covered stretches to the chunks, which cut the texts.

What moves are rows, one for each anchor of a chunk at most, so that all of it grows with the input, whatever the number
of chunks; sorted rows are read in batches, of which no more than GROUP are held.  What one key can bring to a task is
CONTEXTS rows a chunk; a chunk holds its documents, and at least one, so memory grows with the longest document only.
Hashes decide where a context occurs as a whole and for hot anchors: there they are of 128 bits (of words known by 64).
Within a shard, words of one hash are compared.

Cases: null texts are empty; a null id counts as the largest; rows of one id are one place, so that repeated rows
don't remove each other, but both lose what an earlier document has; other columns aren't read; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ._common import NULL_ID, PLAIN_WORD, Rolling, flat, mix, ranges, stored, word_hashes, word_spans
from ._indexes import bwt_repeats, fm_repeats

CHUNK = 4 << 20
#: Contexts of one anchor that a chunk sends on; with more the anchor is hot.
CONTEXTS = 8
#: Contexts of one anchor that a shard takes; with more the anchor is hot.
GROUP = 4096
PART = 1 << 16  # symbols handled at once, so that arrays stay in a CPU cache
U32 = np.uint64(32)
HOT, ALONE, COPY, SHARED = np.uint8(3), np.uint8(0), np.uint8(1), np.uint8(2)
#: What moves: entries of step 1 (key: chunk and number of the entry), what is told of them, and rows of step 3.
_ENTRY = "h long, c long, d long, p long, hot boolean, key long"
_TOLD = "chunk long, i long, status int"
_SENT = "kind int, a long, b long, d long, chunk long, row long, lo long, hi long, body binary"
_STRETCH = "chunk long, row long, lo long, hi long"
CONTEXT, WINDOW, COVERED = 1, 2, 3


class Symbols:
    """The symbols of a chunk's documents, in an order that any later pass finds again."""

    def __init__(self, tbl: pa.Table, words: bool):
        doc, text = tbl.column("doc").to_numpy(), tbl.column("text").combine_chunks()
        data, offs = flat(text)
        if len(doc) > 1:
            order = np.argsort(doc, kind="stable")
            same = np.flatnonzero(np.diff(doc[order]) == 0)
            if len(same):  # rows of one id: by text as well
                raw = data.tobytes()
                order = np.array(sorted(range(len(doc)), key=lambda i: (doc[i], raw[offs[i] : offs[i + 1]])), np.int64)
            size = np.diff(offs)
            data, doc = data[ranges(offs[:-1][order], size[order])], doc[order]
            offs = np.append(0, np.cumsum(size[order]))
        else:
            order = np.arange(len(doc))
        self.order, self.doc, self.data, self.offs, self.words = order, doc, data, offs, words
        if words:
            self.starts, self.ends, self.first = word_spans(data, offs, PLAIN_WORD)
        else:
            self.first = offs

    def parts(self):
        """Row ranges of about PART symbols."""
        i, n = 0, len(self.doc)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.first, self.first[i] + PART, "right")) - 1)
            yield i, min(j, n)
            i = min(j, n)

    def hashed(self, rolling: Rolling, i: int, j: int) -> np.ndarray:
        a, b = self.first[i], self.first[j]
        if not self.words:
            return rolling.bytes[self.data[a:b]]
        lo, hi = self.offs[i], self.offs[j]
        return word_hashes(rolling, self.data[lo:hi], self.starts[a:b] - lo, self.ends[a:b] - lo)


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    power = 1
    m = x
    while power * 2 <= w:
        m = np.minimum(m[:-power], m[power:])
        power *= 2
    rest = w - power
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def _covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    depth = np.bincount(starts, minlength=size + 1) - np.bincount(ends, minlength=size + 1)
    return np.cumsum(depth[:size]) > 0


def _tools() -> tuple[Rolling, Rolling]:
    made = _tools.__dict__
    if not made:
        made["both"] = Rolling(), Rolling(0xD6E8FEB86659FD93, 11)
    return made["both"]


@dataclass
class Anchors:
    """Of a chunk: each anchor's row, place in its document, hash, hash of its context, and the context's ends."""

    row: np.ndarray
    pos: np.ndarray
    h: np.ndarray
    c: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def _anchors(sym: Symbols, n: int, k: int) -> Anchors:
    rolling, w, out = _tools()[0], n - k + 1, []
    for i, j in sym.parts():
        base, last = sym.first[i], sym.first[j]
        if last - base < n:
            continue
        prefix = rolling.prefix(sym.hashed(rolling, i, j))
        size = int(last - base)
        first = sym.first[i : j + 1] - base
        grams = rolling.windows(prefix, k)
        ranked = (grams >> U32 << U32) | np.arange(len(grams), dtype=np.uint64)  # the leftmost on ties
        least = _sliding_least(ranked, w)[: size - n + 1]
        finish = np.repeat(first[1:], np.diff(first))
        inside = finish[: len(least)] - np.arange(len(least)) >= n
        chosen = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)[inside]
        if not len(chosen):
            continue
        at = np.unique(chosen) if np.any(chosen[1:] < chosen[:-1]) else chosen[np.append(True, chosen[1:] != chosen[:-1])]
        row = np.searchsorted(first, at, "right") - 1
        lo, hi = np.maximum(at - (n - k), first[row]), np.minimum(at + n, first[row + 1])
        around = mix(rolling.spans(prefix, lo, hi) ^ ((at - lo).astype(np.uint64) << U32))
        start = first[row]
        out.append((row + i, at - start, grams[at], around, lo - start, hi - start))
    if not out:
        z = np.zeros(0, np.int64)
        return Anchors(z, z, z.astype(np.uint64), z.astype(np.uint64), z, z)
    return Anchors(*(np.concatenate(x) for x in zip(*out, strict=True)))


def _by_place(h: np.ndarray, c: np.ndarray, doc: np.ndarray, pos: np.ndarray):
    """Order by (h, c, doc, pos); where a new (h, c) begins in it; and which entries come at a later place than the first of theirs."""
    order = np.lexsort((pos, doc, c, h))
    hs, cs, ds, ps = h[order], c[order], doc[order], pos[order]
    new = np.ones(len(h), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else np.zeros(0, np.int64)
    later = (ds > ds[head]) | (ps > ps[head]) if len(h) else np.zeros(0, bool)
    return order, new, later


SENT = [x.split()[0] for x in _SENT.split(", ")]


def _word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each distinct word: by its hash, but words of one hash are compared."""
    _, one, which = np.unique(word_hashes(_tools()[0], data, starts, ends), return_index=True, return_inverse=True)
    size, head = ends - starts, one[which]
    same = (size == size[head]).all() and (data[ranges(starts, size)] == data[ranges(starts[head], size)]).all()
    if same:
        return which
    raw, numbers = data.tobytes(), {}
    return np.array([numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])


class Sent:
    """What a chunk sends in step 1, in an order that step 3 finds again: one entry for each anchor and context, or one
    for a hot anchor."""

    def __init__(self, sym: Symbols, n: int, k: int):
        self.anchors = a = _anchors(sym, n, k)
        self.order, new, self.later = _by_place(a.h, a.c, sym.doc[a.row], a.pos)
        self.group = np.cumsum(new) - 1
        # The firsts; rows of one id can have several at one place.
        self.lead, self.lead_of = self.order[~self.later], np.flatnonzero(new[~self.later])
        h = a.h[self.lead]
        head = np.ones(len(h), bool)
        head[1:] = h[1:] != h[:-1]
        self.run = np.cumsum(head) - 1
        self.hot = np.bincount(self.run)[self.run] > CONTEXTS if len(h) else head
        self.sent = np.flatnonzero(~self.hot | head)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for x in keys:
        new[1:] |= x[1:] != x[:-1]
    return new


def _told(h: np.ndarray, c: np.ndarray, d: np.ndarray, p: np.ndarray, hot: np.ndarray, burning: bool = False) -> np.ndarray:
    """Status of entries sorted by (h, c, d, p), of whole groups of h.  burning: the group has more entries than these."""
    head, new = _heads(h), _heads(h, c)
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (d > d[first]) | (p > p[first])
    run = np.cumsum(head) - 1
    heated = (np.bincount(run, hot) > 0) | (np.bincount(run) > GROUP) | burning
    several = np.bincount(run, new) > 1
    return np.where(heated[run], HOT, np.where(later, COPY, np.where(several[run], SHARED, ALONE)))


def _meet(batches):
    """From entries sorted by (h, c, d, p), what is told of those that aren't alone.  A group of h can end in a later
    batch: until then at most GROUP + 1 of its entries are held, since more are hot whatever follows."""
    held = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, bool, np.int64)]
    hot = None  # a group that is known to be hot, whose entries aren't held

    def out(status: np.ndarray, key: np.ndarray):
        some = np.flatnonzero(status != ALONE)
        key = key[some]
        return pa.RecordBatch.from_arrays([pa.array(key >> 32), pa.array(key & 0xFFFFFFFF), pa.array(status[some].astype(np.int32))], names=["chunk", "i", "status"])

    for batch in batches:
        cols = [np.concatenate([x, batch.column(k).to_numpy(zero_copy_only=False)]) for k, x in enumerate(held)]
        h = cols[0]
        if hot is not None:
            n = int(np.searchsorted(h != hot, True)) if len(h) else 0
            n = len(h) if len(h) and not (h != hot).any() else n
            yield out(np.full(n, HOT), cols[5][:n])
            cols = [x[n:] for x in cols]
            h = cols[0]
            if not len(h):
                held = cols
                continue
            hot = None
        if not len(h):
            continue
        begin = int(np.flatnonzero(_heads(h))[-1])
        if begin:
            yield out(_told(*(x[:begin] for x in cols[:5])), cols[5][:begin])
        held = [x[begin:] for x in cols]
        if len(held[0]) > GROUP:
            hot = held[0][0]
            yield out(np.full(len(held[0]), HOT), held[5])
            held = [x[:0] for x in held]
    if len(held[0]):
        yield out(_told(*held[:5]), held[5])


def _repeated(n: int):
    """From windows sorted by (hashes, place), the stretches of all but the first place of each."""

    def run(batches):
        last = None  # the window in hand and its first place
        for batch in batches:
            w1, w2, d, chunk, row, lo = (batch.column(k).to_numpy() for k in range(6))
            if not len(w1):
                continue
            new = _heads(w1, w2)
            carried = last is not None and (w1[0], w2[0]) == last[:2]
            at = np.flatnonzero(new)
            d0, p0 = d[at].copy(), lo[at].copy()
            if carried:
                d0[0], p0[0] = last[2:]
            of = np.cumsum(new) - 1
            later = (d > d0[of]) | (lo > p0[of])
            last = (w1[-1], w2[-1], d0[-1], p0[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[later]) for x in (chunk, row, lo, lo + n)], names=["chunk", "row", "lo", "hi"])

    return run


def _merged(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching stretches of a row become one."""
    if not len(row):
        return row, lo, hi
    by = np.lexsort((lo, row))
    row, lo, hi = row[by], lo[by], hi[by]
    step = int(hi.max()) + 2  # rows are laid one after another, with a gap
    upto = np.maximum.accumulate(row * step + hi)
    new = np.ones(len(row), bool)
    new[1:] = row[1:] * step + lo[1:] > upto[:-1]
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(row)) - 1
    return row[at], lo[at], upto[end] - row[at] * step


def _remove(docs: DataFrame, n: int, k: int, words: bool, repeats: Callable, id_col: str, text_col: str, cut: Callable, fields: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = max(1, -(-total // CHUNK))
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    dealt = docs.select(F.col(id_col).alias("id"), doc.alias("doc"), text.alias("text"), F.pmod(F.xxhash64(doc), F.lit(chunks)).alias("chunk"))

    def first(tbl: pa.Table) -> pa.Table:
        sym, chunk = Symbols(tbl, words), tbl.column("chunk")[0].as_py()
        s = Sent(sym, n, k)
        a, at = s.anchors, s.lead[s.sent]
        key = (chunk << 32) + np.arange(len(at))
        return pa.table([a.h[at].view(np.int64), a.c[at].view(np.int64), sym.doc[a.row[at]], a.pos[at], s.hot[s.sent], key], names=["h", "c", "d", "p", "hot", "key"])

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []

        def send(kind: int, count: int, **cols) -> None:
            whole = lambda name, t: pa.array(cols[name], t) if name in cols else pa.nulls(count, t)
            fixed = {"kind": pa.array(np.full(count, kind), pa.int32()), "chunk": pa.array(np.full(count, chunk), pa.int64())}
            out.append(pa.table([fixed.get(x) if x in fixed else whole(x, pa.binary() if x == "body" else pa.int64()) for x in SENT], names=SENT))

        if not left.num_rows:
            return pa.table({x: pa.array([], pa.binary() if x == "body" else pa.int32() if x == "kind" else pa.int64()) for x in SENT})
        sym, chunk = Symbols(left, words), left.column("chunk")[0].as_py()
        s = Sent(sym, n, k)
        a = s.anchors
        status = np.full(len(s.lead), ALONE)
        status[s.sent[right.column("i").to_numpy()]] = right.column("status").to_numpy()
        burning = np.bincount(s.run, status == HOT) > 0
        status[burning[s.run]] = HOT
        hit = s.order[s.later | (status == COPY)[s.lead_of][s.group]]
        done = [(a.row[hit], a.lo[hit], a.hi[hit])]
        at = s.lead[status == SHARED]
        if len(at):
            lo, hi = sym.first[a.row[at]] + a.lo[at], sym.first[a.row[at]] + a.hi[at]
            if words:
                lo, hi = sym.starts[lo], sym.ends[hi - 1]
            body = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(0, np.cumsum(hi - lo)).astype(np.int32).tobytes()), pa.py_buffer(sym.data[ranges(lo, hi - lo)].tobytes())])
            send(CONTEXT, len(at), a=a.h[at].view(np.int64), d=sym.doc[a.row[at]], row=a.row[at], lo=a.lo[at], body=body)
        at = s.lead[status == HOT]
        if len(at):
            count = a.hi[at] - a.lo[at] - n + 1
            row, pos = np.repeat(a.row[at], count), ranges(a.lo[at], count)
            w = np.zeros((2, len(row)), np.uint64)
            for i, j in sym.parts():
                some = np.flatnonzero((row >= i) & (row < j))
                if len(some):
                    lo = sym.first[row[some]] - sym.first[i] + pos[some]
                    for r, rolling in enumerate(_tools()):
                        w[r, some] = rolling.spans(rolling.prefix(sym.hashed(rolling, i, j)), lo, lo + n)
            order, _, later = _by_place(w[0], w[1], sym.doc[row], pos)
            done.append((row[order[later]], pos[order[later]], pos[order[later]] + n))
            at = order[~later]
            send(WINDOW, len(at), a=w[0, at].view(np.int64), b=w[1, at].view(np.int64), d=sym.doc[row[at]], row=row[at], lo=pos[at])
        row, lo, hi = _merged(*(np.concatenate(x) for x in zip(*done, strict=True)))
        send(COVERED, len(row), row=row, lo=lo, hi=hi)
        return pa.concat_tables(out)

    def decide(tbl: pa.Table) -> pa.Table:
        chunk, row, lo, d = (tbl.column(x).to_numpy() for x in ("chunk", "row", "lo", "d"))
        raw, offs = flat(tbl.column("body").combine_chunks())
        size = np.diff(offs)
        if words:
            starts, ends, first = word_spans(raw, offs, PLAIN_WORD)
            values = _word_numbers(raw, starts, ends) + 1
            size = np.diff(first)
        else:
            values = raw.astype(np.int64) + 1
        begin = np.cumsum(size + 1) - size - 1
        symbols = np.zeros(int(size.sum()) + len(size), np.int64)
        symbols[ranges(begin, size)] = values
        owner = np.repeat(np.arange(len(size)), size + 1)
        place = np.arange(len(symbols)) - begin[owner] + lo[owner]
        keys = (np.unique(d, return_inverse=True)[1][owner] << 40) + place
        hit = repeats(symbols, keys, n, int(size.max()))
        # Neighbouring windows of a context are one stretch.
        head = np.ones(len(hit), bool)
        head[1:] = hit[1:] != hit[:-1] + 1
        a, b = hit[head], hit[np.append(head[1:], True)[: len(hit)]]
        return pa.table([chunk[owner[a]], row[owner[a]], place[a], place[b] + n], names=["chunk", "row", "lo", "hi"])

    def last(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty
        sym = Symbols(left, words)
        size = int(sym.first[-1])
        gone = np.zeros(size, bool)
        if right.num_rows:
            row, lo, hi = (right.column(x).to_numpy() for x in ("row", "lo", "hi"))
            gone = _covered(size, sym.first[row] + lo, sym.first[row] + hi)
        ids = left.column("id").combine_chunks().take(pa.array(sym.order))
        return pa.table([ids, *cut(sym, gone)], names=names)

    dealt_by = dealt.groupBy("chunk")
    entries = dealt_by.applyInArrow(first, _ENTRY).repartition("h").sortWithinPartitions("h", "c", "d", "p")
    told = entries.mapInArrow(_meet, _TOLD)
    sent = stored(dealt_by.cogroup(told.groupBy("chunk")).applyInArrow(second, _SENT))
    shards = sent.where(F.col("kind") == CONTEXT).withColumn("shard", F.pmod("a", F.lit(chunks)))
    found = shards.groupBy("shard").applyInArrow(decide, _STRETCH)
    windows = sent.where(F.col("kind") == WINDOW).select("a", "b", "d", "chunk", "row", "lo").repartition("a").sortWithinPartitions("a", "b", "d", "lo")
    covered = sent.where(F.col("kind") == COVERED).select("chunk", "row", "lo", "hi").unionByName(found).unionByName(windows.mapInArrow(_repeated(n), _STRETCH))
    schema = f"`{id_col}` {kind}, {fields}"
    names = [x.split()[0].strip("`") for x in schema.split(", ")]
    empty = pa.table({name: pa.array([], t) for name, t in zip(names, to_arrow_schema(_parse_datatype_string(schema)).types, strict=True)})
    return dealt.groupBy("chunk").cogroup(covered.groupBy("chunk")).applyInArrow(last, schema)


def _strings(data: np.ndarray, offs: np.ndarray, kind) -> pa.Array:
    return pa.Array.from_buffers(kind, len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _removed_spans(first: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the maximal removed runs, which end with their document."""
    edge = np.zeros(len(gone) + 1, bool)
    edge[first] = True
    begin = gone.copy()
    begin[1:] &= ~gone[:-1] | edge[1:-1]
    finish = gone.copy()
    finish[:-1] &= ~gone[1:] | edge[1:-1]
    lo, hi = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    row = np.searchsorted(first, lo, "right") - 1
    return row, lo - first[row], hi - first[row]


def _span_column(rows: int, row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    pairs = pa.ListArray.from_arrays(np.arange(0, 2 * len(lo) + 1, 2, dtype=np.int32), pa.array(np.stack([lo, hi], 1).ravel()))
    return pa.ListArray.from_arrays(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32), pairs)


def _cut_bytes(sym: Symbols, gone: np.ndarray) -> list:
    kept = np.append(0, np.cumsum(~gone))[sym.offs]
    size = np.diff(sym.offs)
    spans = _removed_spans(sym.offs, gone)
    return [pa.array(size), pa.array(size - np.diff(kept)), _span_column(len(size), *spans), _strings(sym.data[~gone], kept, pa.binary())]


def _cut_words(sym: Symbols, gone: np.ndarray) -> list:
    n = np.diff(sym.first)
    live = np.append(0, np.cumsum(~gone))[sym.first]
    starts, ends = sym.starts[~gone], sym.ends[~gone]
    depth = np.zeros(len(sym.data) + 1, np.int8)
    depth[starts] += 1
    depth[ends] -= 1
    keep = np.cumsum(depth[:-1], dtype=np.int8) > 0
    data = sym.data.copy()
    after = np.ones(len(ends), bool)
    after[live[1:][live[1:] > live[:-1]] - 1] = False  # the last of each document
    keep[ends[after]] = True
    data[ends[after]] = 0x20
    offs = np.append(0, np.cumsum(keep))[sym.offs]
    spans = _removed_spans(sym.first, gone)
    return [pa.array(n), pa.array(n - np.diff(live)), _span_column(len(n), *spans), _strings(data[keep], offs, pa.string())]


def substring_dedup(docs: DataFrame, *, n: int = 20, k: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, spans, kept): spans are the removed runs of words, kept the rest joined by a space."""
    return _remove(docs, n, k, True, fm_repeats, id_col, text_col, _cut_words, "n_words bigint, n_removed bigint, spans array<array<bigint>>, kept string")


def suffix_array_dedup(docs: DataFrame, *, n: int = 100, k: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept): spans are the removed runs of bytes, kept the rest as binary."""
    return _remove(docs, n, k, False, bwt_repeats, id_col, text_col, _cut_bytes, "n_bytes bigint, n_removed bigint, spans array<array<bigint>>, kept binary")
