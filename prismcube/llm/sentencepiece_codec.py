"""Operator 4: SentencePiece BPE encoding and decoding by vectorised merge rounds.

The text is cut where no piece of the vocabulary can reach across (before a run of the space symbol, around line
feeds), so that a text is a sequence of independent words.  The distinct words of a slab are found by hashes of their
code points, which are then compared, and encoded together: one flat array of symbols, and in every round the least
rank of a pair is found for each word by a segmented minimum, all pairs of that rank are merged in all words at once,
leftmost first where they overlap, and the array is compacted, until no pair is left.  That is the order of the
library's agenda as long as no pair with the merged symbol has as good a rank; where one has (the vocabulary tells), a
round merges the leftmost pair of the word alone.  A word of any length is encoded so, in at most as many rounds as it
meets ranks.  The texts are then put together from their words' codes.

Cases: a null text is encoded as the empty text (no ids, or the end id alone); a null id is passed through; repeated
rows are encoded each; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Rolling, mix, ranges

SPACE = "▁"
#: Characters of text handled at once; one longer text is a slab of its own.
SLAB_CHARS = 1 << 20
NONE = np.iinfo(np.int32).max


def _fields(buf: bytes):
    """(number, value) of a protocol buffer message."""
    i, n = 0, len(buf)

    def varint():
        nonlocal i
        x = shift = 0
        while True:
            b = buf[i]
            i += 1
            x |= (b & 127) << shift
            if b < 128:
                return x
            shift += 7

    while i < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 1:
            value, i = buf[i : i + 8], i + 8
        elif kind == 5:
            value, i = buf[i : i + 4], i + 4
        else:
            size = varint()
            value, i = buf[i : i + size], i + size
        yield key >> 3, value


class Codec:
    """Encoder and decoder for a BPE model with byte fallback and the identity normaliser."""

    def __init__(self, model: bytes):
        pieces, scores, kinds, norm, model_type = [], [], [], {}, 1
        for no, value in _fields(model):
            if no == 1:
                f = dict(_fields(value))
                pieces.append(f.get(1, b"").decode())
                scores.append(struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0])
                kinds.append(f.get(3, 1))
            elif no == 2:
                model_type = dict(_fields(value)).get(3, 1)
            elif no == 3:
                norm = dict(_fields(value))
        if model_type != 2 or norm.get(2) or norm.get(4, 1) or not norm.get(3, 1) or not norm.get(5, 1) or 4 in kinds or 5 in kinds:
            raise ValueError("only BPE models without normalisation, user-defined and unused pieces are supported")
        self.pieces = pieces
        self.end = pieces.index("</s>")
        self.unk = kinds.index(2)
        self.byte_ids = np.zeros(256, np.int32)
        self.normal = {p: i for i, p in enumerate(pieces) if kinds[i] == 1}
        #: Bytes that each id stands for when decoded.
        self.out = [b""] * len(pieces)
        for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)):
            if k == 6:
                self.byte_ids[int(p[3:5], 16)] = i
                self.out[i] = bytes([int(p[3:5], 16)])
            elif k == 1:
                self.out[i] = p.replace(SPACE, " ").encode()
        self.out[self.unk] = " ⁇ ".encode()
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.normal):
            raise ValueError("a piece reaches across words")
        # Symbols: ids of pieces, then numbers for characters that occur in pieces only; others are -1 - code point.
        self.symbol = dict(self.normal)
        for p in self.normal:
            for c in p:
                self.symbol.setdefault(c, len(pieces) + len(self.symbol))
        self.width = max(self.symbol.values()) + 1
        self.by_code = -1 - np.arange(0x110000, dtype=np.int32)
        for c, i in self.symbol.items():
            if len(c) == 1:
                self.by_code[ord(c)] = i
        self.code_of = np.zeros(self.width, np.int64)  # of a symbol that is one character
        for c, i in self.symbol.items():
            if len(c) == 1:
                self.code_of[i] = ord(c)
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in self.normal.values()}, reverse=True))}
        pairs = {}
        for p, i in self.normal.items():
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = (order[scores[i]], i)
        keys = np.array(sorted(pairs), np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.ranks = np.array([pairs[k][0] for k in keys.tolist()] + [NONE], np.int32)
        self.merged = np.array([pairs[k][1] for k in keys.tolist()] + [-1], np.int32)
        best = np.full(self.width, NONE, np.int64)  # rank of the best pair that each symbol is in
        for k, (r, _) in pairs.items():
            for x in divmod(k, self.width):
                best[x] = min(best[x], r)
        #: Pieces after whose making a pair of as good a rank can come up.
        self.upset = np.zeros(self.width, bool)
        for i in self.normal.values():
            self.upset[i] = best[i] <= order[scores[i]]
        decimal = [f"{i} ".encode() for i in range(len(pieces))]
        self.decimal, self.bytes = _Table(decimal), _Table(self.out)

    # -- merging ---------------------------------------------------------------------------------------------------

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.where((a >= 0) & (b >= 0), a.astype(np.int64) * self.width + b, -1)
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.merged[at], -1)

    def merge(self, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of words, and how many each has; sym: the words' symbols one after another, size: their numbers."""
        words, sizes, syms = [], [], []

        def done(at: np.ndarray, count: np.ndarray, flat: np.ndarray) -> None:
            words.append(at)
            sizes.append(count)
            syms.append(flat)

        at = np.flatnonzero(size > 0)
        size, total = size[at], len(size)
        rank, new = self._lookup(sym, np.append(sym[1:], -1))
        rank[np.cumsum(size) - 1] = NONE
        while len(at):
            starts = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, starts)
            live = least != NONE
            if not live.all():  # finished words leave the array
                keep = np.repeat(live, size)
                done(at[~live], size[~live], sym[~keep])
                sym, rank, new = sym[keep], rank[keep], new[keep]
                at, size, least = at[live], size[live], least[live]
                if not len(at):
                    break
                starts = np.cumsum(size) - size
            word = np.repeat(np.arange(len(size)), size)
            hits = np.flatnonzero(rank == least[word])
            word = word[hits]
            lead = np.append(True, word[1:] != word[:-1])  # the leftmost of each word
            # Of hits that overlap, every second one of their run goes, from the left.
            fresh = lead | np.append(True, hits[1:] != hits[:-1] + 1)
            nth = np.arange(len(hits)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            upset = np.zeros(len(size), bool)
            upset[word[self.upset[new[hits]]]] = True
            chosen = lead | (nth % 2 == 0) & ~upset[word]
            pos, word = hits[chosen], word[chosen]
            sym[pos] = new[pos]
            last = pos + 1 == (starts + size - 1)[word]
            keep = np.ones(len(sym), bool)
            keep[pos + 1] = False
            size = size - np.bincount(word, minlength=len(size))
            now = pos - np.arange(len(pos))  # where the merged symbols are after compaction
            sym, rank, new = sym[keep], rank[keep], new[keep]
            starts = np.cumsum(size) - size
            rank[now[last]] = NONE
            left, right = now[now > starts[word]] - 1, now[~last]
            both = np.concatenate([left, right])
            rank[both], new[both] = self._lookup(sym[both], sym[both + 1])
        if not words:
            return np.zeros(0, np.int32), np.zeros(total, np.int64)
        word, count, flat = (np.concatenate(x) for x in (words, sizes, syms))
        order = np.argsort(word)
        first = np.cumsum(count) - count
        out = np.zeros(total, np.int64)
        out[word] = count
        return flat[ranges(first[order], count[order])], out

    def _with_bytes(self, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols: those outside the vocabulary are one character each, which becomes its bytes."""
        odd = (sym < 0) | (sym >= len(self.pieces))
        if not odd.any():
            return sym, size
        at = np.flatnonzero(odd)
        s = sym[at].astype(np.int64)
        code = np.where(s < 0, -1 - s, self.code_of[np.maximum(s, 0)])
        width = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
        count = np.ones(len(sym), np.int64)
        count[at] = width
        out = np.repeat(sym, count)
        start = (np.cumsum(count) - count)[at]
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])
        for k in range(4):
            some = width > k
            shift = 6 * (width[some] - 1 - k)
            part = code[some] >> shift
            byte = np.where(width[some] == 1, code[some], (lead[width[some]] | part) if k == 0 else 0x80 | (part & 0x3F))
            out[start[some] + k] = self.byte_ids[byte]
        owner = np.repeat(np.arange(len(size)), size)
        return out, np.bincount(owner, count, minlength=len(size)).astype(np.int64)

    # -- texts -----------------------------------------------------------------------------------------------------

    def slab(self, texts: list[str | None]) -> Slab:
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        offs = np.append(0, np.cumsum([len(t) for t in marked]))
        if not len(code):
            z = np.zeros(0, np.int64)
            return Slab(self, z, z, z, np.zeros(len(texts) + 1, np.int64))
        space, feed = code == ord(SPACE), code == 0x0A
        cut = np.ones(len(code), bool)
        cut[1:] = (space[1:] & ~space[:-1]) | feed[1:] | feed[:-1]
        cut[offs[:-1][offs[:-1] < len(code)]] = True
        starts = np.flatnonzero(cut)
        size = np.diff(np.append(starts, len(code)))
        rolling = _rolling()
        prefix = rolling.prefix(mix(code.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
        _, first, word = np.unique(rolling.spans(prefix, starts, starts + size), return_index=True, return_inverse=True)
        head = first[word]
        if not ((size == size[head]).all() and (code == code[np.arange(len(code)) + np.repeat(starts[head] - starts, size)]).all()):
            first, word = np.arange(len(starts)), np.arange(len(starts))  # two words of one hash: each is encoded by itself
        sym = self.by_code[code[ranges(starts[first], size[first])]]
        ids, count = self._with_bytes(*self.merge(sym, size[first]))
        return Slab(self, word, ids, count, np.searchsorted(starts, offs))

    def encode(self, text: str | None, end: bool = False) -> list[int]:
        return self.slab([text]).ids(0).tolist() + [self.end] * end

    def decode(self, ids: list[int]) -> str:
        """Pieces joined; one leading space, which encoding puts before any text, goes."""
        return _first_space(b"".join([self.out[i] for i in ids])).decode(errors="replace")


class _Table:
    """Byte strings by number, to be taken many at once."""

    def __init__(self, strings: list[bytes]):
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.size = np.array([len(x) for x in strings], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def joined(self, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
        """For each run of `count` ids, their strings joined."""
        size = self.size[ids]
        data = self.flat[ranges(self.start[ids], size)].tobytes()
        edge = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(count))].tolist()
        return [data[a:b] for a, b in zip(edge, edge[1:], strict=False)]


class Slab:
    """Codes of some texts: their words, and the ids of each distinct word."""

    def __init__(self, codec: Codec, word: np.ndarray, ids: np.ndarray, count: np.ndarray, first: np.ndarray):
        self.codec, self.word, self.flat, self.count, self.first = codec, word, ids, count, first
        self.start = np.cumsum(count) - count

    def sizes(self) -> np.ndarray:
        """Number of ids of each text."""
        return np.diff(np.append(0, np.cumsum(self.count[self.word]))[self.first])

    def ids(self, text: int) -> np.ndarray:
        w = self.word[self.first[text] : self.first[text + 1]]
        return self.flat[ranges(self.start[w], self.count[w])]

    def joined(self, table: _Table) -> list[bytes]:
        """Each text's ids as the table's strings, joined."""
        if not len(self.word):
            return [b""] * (len(self.first) - 1)
        words = table.joined(self.flat, self.count)
        edge, out, every = self.first.tolist(), [], self.word.tolist()
        for a, b in zip(edge, edge[1:], strict=False):
            out.append(b"".join(itemgetter(*every[a:b])(words)) if b - a > 1 else words[every[a]] if b > a else b"")
        return out


def _rolling() -> Rolling:
    return _rolling.__dict__.setdefault("made", Rolling())


def _first_space(raw: bytes) -> bytes:
    return raw[1:] if raw[:1] == b" " else raw


_codecs: dict[bytes, Codec] = {}


def codec(model: bytes) -> Codec:
    """One for each model in a worker; a worker is used for many tasks."""
    key = hashlib.sha256(model).digest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model)
    return _codecs[key]


def _blocks(texts: list[str | None], chars: int = SLAB_CHARS):
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j] or "") <= chars):
            n += len(texts[j] or "")
            j += 1
        yield texts[i:j]
        i = j


def encode_documents(df: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", end: bool = True, digests: bool = False) -> DataFrame:
    """(id, n_tokens, ids) of every text, or with `digests` (id, n_tokens, ids_sha256, decoded_sha256).

    The digests are taken where the ids are made, so that no array of ids has to leave the worker.  The model file
    is read on the driver and sent to the workers (a vocabulary file: half a megabyte).
    """
    with open(model_path, "rb") as f:
        model = f.read()
    Codec(model)
    id_type = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        c = codec(shared.value)
        for batch in batches:
            n_all, ids_all, dec_all = [], [], []
            for texts in _blocks(batch.column(1).to_pylist()):
                slab = c.slab(texts)
                n_all += (slab.sizes() + end).tolist()
                if digests:
                    last = str(c.end).encode() if end else b""
                    ids_all += [hashlib.sha256(x + last if end else x[:-1]).hexdigest() for x in slab.joined(c.decimal)]
                    dec_all += [hashlib.sha256(_first_space(x)).hexdigest() for x in slab.joined(c.bytes)]
                else:
                    ids_all += [np.append(slab.ids(k), [c.end] * end).astype(np.int32) for k in range(len(texts))]
            cols = [batch.column(0), pa.array(n_all, pa.int64())]
            if digests:
                cols += [pa.array(ids_all, pa.string()), pa.array(dec_all, pa.string())]
            else:
                cols += [pa.array(ids_all, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] if digests else [id_col, "n_tokens", "ids"]
    schema = f"`{id_col}` {id_type}, n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>")
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def decode_documents(df: DataFrame, model_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of arrays of ids; a null array is the empty text."""
    with open(model_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(shared.value)
        pieces = np.frombuffer(b"".join(c.out), np.uint8)
        size = np.array([len(x) for x in c.out], np.int64)
        first = np.cumsum(size) - size
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                at = np.array(ids or [], np.int64)
                raw = pieces[ranges(first[at], size[at])].tobytes()
                texts.append(_first_space(raw).decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return df.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {id_type}, text string")
