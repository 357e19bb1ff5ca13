"""Operator 2: benchmark decontamination with a generalised suffix automaton.

The automaton holds every substring of the normalised benchmark items (A-Z lower-cased, words of digits, letters and
anything beyond ASCII).  Training texts are streamed through it word by word; the state tells the longest match that
ends at each word, and from a match of `window` words on, the state of its last `window` words tells the items.  An
item of fewer words is a window as a whole.  Before the stream, words outside the benchmark's vocabulary and pairs of
words that no item has are found with array operations, so that only stretches which can hold a window are streamed, and
all stretches of a slab are streamed in step, as arrays of states.

The benchmark is cut into blocks of bounded size (BLOCK bytes of text, by a hash of the item), one automaton each, which
tasks build side by side where there are several.  A finished automaton is flat arrays (sorted edges, links, lengths).
JOINED blocks at a time become one index with a common vocabulary, in which a pair of words tells the blocks that have
it; an index is broadcast at that bounded size, and a task takes each batch of texts through one index after another.

Cases: null texts have no words (0 of everything, clean); null ids pass through; item rows without words hold no
window; several item rows with one id count once, a null item id is written as the empty string; repeated documents
are judged each; other columns are passed through by `remove_contamination` and not read by `scan_contamination`;
empty tables give empty tables, an empty benchmark gives documents without hits.
"""

from __future__ import annotations

import pickle
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ALNUM_WORD, LOWER, Rolling, discard, flat, ranges, slabs, stored, trimmed, word_hashes, word_spans

WINDOW = 13
BLOCK = 512 << 10
#: Blocks of one index, and indexes that a worker keeps; an index takes about 15 bytes for each byte of its items.
JOINED, KEPT = 8, 4
#: Bytes of text that are scanned at once; their hashes take some fifty times as much.
STEP = 512 << 10
#: Bytes of text of rows that are worked on and put out together, and those of which the words are held so that an index is loaded once for them,
#: where a worker doesn't keep all indexes.
PART, GROUP = 2 << 20, 16 << 20
#: A document with at least this share of its words in windows is contaminated.
COVERAGE = 0.05


class SuffixAutomaton:
    """Of several sequences; symbols are hashable."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len = [-1], [0]

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.len.append(length)
        return len(self.len) - 1

    def _split(self, p: int, c, q: int) -> int:
        clone = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.len[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
        return new

    def add(self, sequence) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c)


class ItemIndex:
    """The automata of some blocks of items as flat arrays, with what their states stand for."""

    #: (block, state) offsets are added to these when blocks are joined.
    STATES = ("root", "edge_from", "edge_to", "link", "base", "item_state", "short_state", "above_state")
    ITEMS = ("item_of", "short_item", "above_item", "single_item")
    PLAIN = ("length", "short_len", "above_len", "least")
    CODES = ("edge_code", "pair_first", "pair_second", "single_code")

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        """One block."""
        self.window, self.names = window, [i for i, _ in items]
        self.vocabulary = np.unique(np.concatenate([w for _, w in items]))
        coded = [np.searchsorted(self.vocabulary, w) for _, w in items]
        a = SuffixAutomaton()
        for w in coded:
            a.add(w.tolist())
        edges = np.array([(p, c, q) for p, out in enumerate(a.next) for c, q in sorted(out.items())], np.int64).reshape(-1, 3)
        self.edge_from, self.edge_code, self.edge_to = (np.ascontiguousarray(x) for x in edges.T)
        self.link, self.length = np.maximum(np.array(a.link), 0), np.array(a.len)
        # The state of the last `window` words of a match that ends in a state.
        base = np.arange(len(a.len))
        order = np.argsort(self.length, kind="stable")
        for q in order[1:].tolist():
            if a.len[a.link[q]] >= window:
                base[q] = base[a.link[q]]
        self.base = base
        holds, short = set(), {}
        for k, w in enumerate(coded):
            s = n = 0
            for c in w.tolist():
                s, n = a.next[s][c], n + 1  # an item is a path from the root
                if n > window:
                    while a.len[a.link[s]] >= window:
                        s = a.link[s]
                    n = min(n, a.len[s])
                if n >= window:
                    holds.add((int(base[s]), k))
            if 1 < len(w) < window:
                short.setdefault(s, []).append((len(w), k))
        # Short items that end wherever a longer match ends in a state.
        above: dict[int, list[tuple[int, int]]] = {}
        for q in order[1:].tolist():
            if found := above.get(a.link[q], []) + short.get(a.link[q], []):
                above[q] = found
        table = lambda rows, width: np.array(sorted(rows), np.int64).reshape(-1, width).T.copy()
        self.item_state, self.item_of = table(holds, 2)
        self.short_state, self.short_len, self.short_item = table(((q, *x) for q, found in short.items() for x in found), 3)
        self.above_state, self.above_len, self.above_item = table(((q, *x) for q, found in above.items() for x in found), 3)
        self.single_code, self.single_item = table(((int(w[0]), k) for k, w in enumerate(coded) if len(w) == 1), 2)
        pairs = np.unique(np.concatenate([np.stack([w[:-1], w[1:]], 1) for w in coded]), axis=0)
        self.pair_first, self.pair_second = pairs.T.copy()
        self.pair_block = np.zeros(len(pairs), np.int64)
        self.root, self.least = np.zeros(1, np.int64), np.array([min([len(w) for w in coded if len(w) > 1] + [window])])

    @classmethod
    def joined(cls, blocks: list[ItemIndex]) -> ItemIndex:
        out = cls.__new__(cls)
        out.window, out.names = blocks[0].window, [n for b in blocks for n in b.names]
        out.vocabulary = np.unique(np.concatenate([b.vocabulary for b in blocks]))
        states = np.cumsum([0] + [len(b.link) for b in blocks])
        items = np.cumsum([0] + [len(b.names) for b in blocks])
        for name in cls.STATES:
            setattr(out, name, np.concatenate([getattr(b, name) + k for b, k in zip(blocks, states, strict=False)]))
        for name in cls.ITEMS:
            setattr(out, name, np.concatenate([getattr(b, name) + k for b, k in zip(blocks, items, strict=False)]))
        for name in cls.PLAIN:
            setattr(out, name, np.concatenate([getattr(b, name) for b in blocks]))
        for name in cls.CODES:
            setattr(out, name, np.concatenate([np.searchsorted(out.vocabulary, b.vocabulary)[getattr(b, name)] for b in blocks]))
        out.pair_block = np.concatenate([np.full(len(b.pair_block), k) for k, b in enumerate(blocks)])
        return out

    def ready(self) -> ItemIndex:
        """Sorted for lookups."""
        v = len(self.vocabulary)
        key = self.edge_from * v + self.edge_code
        by = np.argsort(key, kind="stable")
        self.keys, self.to = np.append(key[by], np.iinfo(np.int64).max), np.append(self.edge_to[by], 0)
        key = self.pair_first * v + self.pair_second
        by = np.argsort(key, kind="stable")
        self.pairs, self.pair_at = np.unique(key[by], return_index=True)
        self.pair_at, self.pair_block = np.append(self.pair_at, len(key)), self.pair_block[by]
        by = np.argsort(self.single_code, kind="stable")
        self.single_code, self.single_item = self.single_code[by], self.single_item[by]
        self.says = np.zeros(len(self.link), bool)
        self.says[self.short_state] = self.says[self.above_state] = True
        del self.edge_from, self.edge_code, self.edge_to, self.pair_first, self.pair_second
        return self

    def _stream(self, code: np.ndarray, start: np.ndarray, size: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where matches end that say something: last word, state and length of the match.  All stretches go in step, the longest first."""
        v, by = len(self.vocabulary), np.argsort(-size, kind="stable")
        start, size, root = start[by], size[by], root[by]
        state, length, out = root.copy(), np.zeros(len(root), np.int64), []
        for t in range(int(size[0])):
            k = int(np.searchsorted(-size, -t))  # stretches of more than t words
            s, n, c = state[:k], length[:k], code[start[:k] + t]
            left = np.arange(k)
            while len(left):
                key = s[left] * v + c[left]
                at = np.searchsorted(self.keys, key)
                found = self.keys[at] == key
                s[left[found]] = self.to[at[found]]
                n[left[found]] += 1
                left = left[~found]
                home = s[left] == root[left]
                n[left[home]] = 0
                left = left[~home]
                s[left] = self.link[s[left]]
                home = s[left] == root[left]
                n[left] = np.where(home, 0, self.length[s[left]])
            says = np.flatnonzero((n >= self.window) | self.says[s])
            out.append((start[says] + t, s[says], n[says]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def mark(self, words: np.ndarray, first: np.ndarray, hit: np.ndarray, items: list[set[str]]) -> None:
        """words: hashes; first: of each document, its first word.  Marks the words of windows in hit, and tells the items."""
        v = len(self.vocabulary)
        code = np.searchsorted(self.vocabulary, words)
        code[code == v] = 0
        known = self.vocabulary[code] == words
        depth = np.zeros(len(words) + 1, np.int64)
        told = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]  # (word, item)

        def expanded(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """For each of `asked`, the places of its equals in the sorted `keys`: (number of asked, place)."""
            lo, hi = np.searchsorted(keys, asked), np.searchsorted(keys, asked, "right")
            return np.repeat(np.arange(len(asked)), hi - lo), ranges(lo, hi - lo)

        def note(end: np.ndarray, size, item: np.ndarray) -> None:
            np.add.at(depth, end - size, 1)
            np.add.at(depth, end, -1)
            told.append((end - 1, item))

        if len(self.single_code):
            at = np.flatnonzero(known)
            who, place = expanded(self.single_code, code[at])
            note(at[who] + 1, 1, self.single_item[place])
        both = np.flatnonzero(known[1:] & known[:-1]) + 1
        both = both[~np.isin(both, first)]
        if len(both) and len(self.pairs):
            pair = code[both - 1] * v + code[both]
            k = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            good = self.pairs[k] == pair
            both, k = both[good], k[good]
            count = self.pair_at[k + 1] - self.pair_at[k]
            pos, block = np.repeat(both, count), self.pair_block[ranges(self.pair_at[k], count)]
            by = np.lexsort((pos, block))
            pos, block = pos[by], block[by]
            head = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (pos[1:] != pos[:-1] + 1))[: len(pos)])
            size = np.diff(np.append(head, len(pos))) + 1
            long = size >= self.least[block[head]]
            if long.any():
                head, size = head[long], size[long]
                pos, state, n = self._stream(code, pos[head] - 1, size, self.root[block[head]])
                full = n >= self.window
                who, place = expanded(self.item_state, self.base[state[full]])
                note(pos[full][who] + 1, self.window, self.item_of[place])
                who, place = expanded(self.short_state, state)
                fits = self.short_len[place] <= n[who]
                note(pos[who[fits]] + 1, self.short_len[place[fits]], self.short_item[place[fits]])
                who, place = expanded(self.above_state, state)
                note(pos[who] + 1, self.above_len[place], self.above_item[place])
        hit |= np.cumsum(depth[:-1]) > 0
        word, item = map(np.concatenate, zip(*told, strict=True))
        doc = np.searchsorted(first, word, "right") - 1
        for d, i in np.unique(np.stack([doc, item], 1), axis=0).tolist():
            items[d].add(self.names[i])


def _normal_words(rolling: Rolling, data: np.ndarray, offs: np.ndarray):
    low = LOWER[data]
    starts, ends, first = word_spans(low, offs, ALNUM_WORD)
    return starts, ends, first, word_hashes(rolling, low, starts, ends)


_loaded: dict[str, ItemIndex] = {}


def _load(key: str, blob: bytes) -> ItemIndex:
    """A worker keeps the last KEPT indexes."""
    if key not in _loaded:
        while len(_loaded) >= KEPT:
            _loaded.pop(next(iter(_loaded)))
        _loaded[key] = pickle.loads(blob).ready()
    return _loaded[key]


def _held(rolling: Rolling, rows) -> list[tuple[str, np.ndarray]]:
    out = []
    for i, t in sorted(rows):
        raw = np.frombuffer(t.encode(), np.uint8)
        words = _normal_words(rolling, raw, np.array([0, len(raw)]))[3]
        if len(words):
            out.append((i, words))
    return out


def _indexes(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> list:
    """(key, broadcast) of each index of the benchmark."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-total // BLOCK)

    def sent(index: ItemIndex) -> tuple:
        return uuid.uuid4().hex, spark.sparkContext.broadcast(pickle.dumps(index, 5))

    if blocks <= 1:
        held = _held(Rolling(), map(tuple, items.collect()))
        return [sent(ItemIndex(held, window))] if held else []

    def build(key, tbl):
        held = _held(Rolling(), zip(tbl.column("i").to_pylist(), tbl.column("t").to_pylist(), strict=True))
        return pa.table({"block": [key[0].as_py()], "body": pa.array([pickle.dumps(ItemIndex(held, window), 5) if held else None], pa.binary())})

    built = stored(items.select(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)).alias("block"), "i", "t").groupBy("block").applyInArrow(build, "block bigint, body binary"))
    out = []
    for b in range(0, blocks, JOINED):
        bodies = built.where(F.col("block").between(b, b + JOINED - 1) & F.col("body").isNotNull()).orderBy("block").select("body").collect()
        if bodies:
            out.append(sent(ItemIndex.joined([pickle.loads(r.body) for r in bodies])))
    discard(built)
    return out


def _parts(batches, at: int, indexes: list):
    """The rows of the batches, whose column `at` are texts, in batches of a bounded size: a batch of Spark's is of a number of rows, however long those are."""
    size = PART if len(indexes) <= KEPT else GROUP
    for batch in batches:
        for i, j in slabs(flat(batch.column(at))[1], size):
            yield batch.slice(i, j - i)


def _scan(indexes: list, column):
    """For slabs of texts: (first row, data, offs, starts, ends, first word, hit, items).  All of them meet one index before the next is loaded, unless
    all indexes are kept."""
    rolling = _scan.__dict__.setdefault("rolling", Rolling())
    data, offs = flat(column)
    cuts = list(slabs(offs, STEP))
    group = 1 if len(indexes) <= KEPT else max(1, len(cuts))
    for g in range(0, len(cuts), group):
        found = []
        for i, j in cuts[g : g + group]:
            part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            starts, ends, first, words = _normal_words(rolling, part, o)
            found.append((i, part, o, starts, ends, first, np.zeros(len(words), bool), [set() for _ in range(j - i)], words))
        for key, blob in indexes:
            for *_, first, hit, items, words in found:
                if len(words):
                    _load(key, blob.value).mark(words, first[:-1], hit, items)
        yield from (x[:-1] for x in found)


def scan_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items, contaminated, spans): spans are maximal runs of hit words, as [first, last) byte offsets."""
    indexes = _indexes(benchmark, item_id, item_text, window)
    share = round(1 / coverage)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in _parts(batches, 1, indexes):
            n_words, n_hit, found, spans = [], [], [], []
            for _, _, o, starts, ends, first, hit, items in _scan(indexes, batch.column(1)):
                for d in range(len(o) - 1):
                    h = hit[first[d] : first[d + 1]]
                    n_words.append(len(h))
                    n_hit.append(int(h.sum()))
                    found.append(sorted(items[d]))
                    runs = np.flatnonzero(np.diff(np.concatenate([[0], h.view(np.int8), [0]]))) if n_hit[-1] else np.zeros(0, np.int64)
                    s, e = first[d] + runs[::2], first[d] + runs[1::2] - 1
                    spans.append(np.stack([starts[s] - o[d], ends[e] - o[d]], 1).tolist() if len(s) else [])
            n, h = np.array(n_words, np.int64), np.array(n_hit, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(h), pa.array([len(x) for x in found], pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array((h > 0) & (h * share >= n)), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                names=[id_col, "n_words", "n_hit", "n_items", "items", "contaminated", "spans"],
            )

    schema = f"`{id_col}` {kind}, n_words bigint, n_hit bigint, n_items bigint, items array<string>, contaminated boolean, spans array<array<bigint>>"
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(trimmed(run), schema)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, coverage: float = COVERAGE, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents with their columns: contaminated ones go, others lose the bytes of their spans and stay as they are without any."""
    indexes = _indexes(benchmark, item_id, item_text, window)
    share, at = round(1 / coverage), docs.columns.index(text_col)

    def run(batches):
        for batch in _parts(batches, at, indexes):
            keep, texts, column = [], [], batch.column(at)
            for i, part, o, starts, ends, first, hit, _ in _scan(indexes, column):
                for d in range(len(o) - 1):
                    h = hit[first[d] : first[d + 1]]
                    n = int(h.sum())
                    keep.append(not n or share * n < len(h))
                    if not n or not keep[-1]:
                        texts.append(column[i + d].as_py() if keep[-1] else None)
                        continue
                    live = np.ones(o[d + 1] - o[d], bool)
                    runs = np.flatnonzero(np.diff(np.concatenate([[0], h.view(np.int8), [0]])))
                    for s, e in zip(first[d] + runs[::2], first[d] + runs[1::2] - 1, strict=True):
                        live[starts[s] - o[d] : ends[e] - o[d]] = False
                    texts.append(part[o[d] : o[d + 1]][live].tobytes().decode())
            cols = [pa.array(texts, batch.schema.field(k).type) if k == at else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
