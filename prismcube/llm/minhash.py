"""Operator 3: near-duplicate documents by ProbMinHash, banding and exact verification.

A document is the multiset of its 5-word shingles (all its words, if it has fewer), weighted by their counts.  For a
shingle of weight w arrivals of a Poisson process of rate w go to uniformly chosen components of the signature, from
random bits that depend on the shingle only; a component keeps the shingle that arrives first.  Two signatures agree
in a component with the probability Jaccard similarity of the weighted sets.  Arrivals are made in rounds over all
shingles of a slab, and a shingle leaves once its time has passed the largest first arrival of its document.

Texts of the same words are one node from the start (known by a cryptographic 128-bit digest of their words), so that
groups of copies cost one row.  Nodes that share a band of ROWS components meet: in each bucket every node is paired
with the bucket's lead, a pair is verified by both texts, and verified pairs are joined to components; see `linked` for
the rounds, which lose no link within a bucket, while pairs inside groups that hold together already aren't made.  BANDS
bands of ROWS components miss a pair of similarity 0.8 with probability (1 - 0.8**ROWS)**BANDS, about 5e-8.

A link is a similarity of at least `threshold`: the exact probability Jaccard similarity of the weighted sets, or the
exact Jaccard similarity of the plain sets.

Cases: null texts and texts without words are copies of each other; ids are cast to long, and must be numbers; a null id
is the largest, and stays null in the result; rows of one id share one decision in `drop_near_duplicates`; other columns pass through it; empty tables give
empty tables.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import NULL_ID, PLAIN_WORD, Rolling, buckets, discard, flat, linked, mix, slabs, stored, trimmed, word_hashes, word_spans

SIZE, ROWS = 128, 4
BANDS = SIZE // ROWS
WORDS = 5
THRESHOLD = 0.8


def _tools() -> tuple[Rolling, Rolling]:
    made = _tools.__dict__
    if not made:
        made["both"] = Rolling(), Rolling(0xD6E8FEB86659FD93, 5)
    return made["both"]


def digests(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Two longs for each text: 128 bits of a digest of its words."""
    starts, ends, first = word_spans(data, offs, PLAIN_WORD)
    depth = np.zeros(len(data) + 1, np.int8)
    depth[starts] += 1
    depth[ends] -= 1
    keep = np.cumsum(depth[:-1], dtype=np.int8) > 0
    clean = data.copy()
    after = ends[ends < len(data)]
    after = after[~keep[after]]  # the gap after a word counts as one space
    keep[after], clean[after] = True, 0x20
    at = np.append(0, np.cumsum(keep))[offs]
    raw = clean[keep].tobytes()
    return np.frombuffer(b"".join(hashlib.blake2b(raw[a:b].strip(b" "), digest_size=16).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)), np.int64).reshape(-1, 2)


def shingles(data: np.ndarray, offs: np.ndarray, k: int = WORDS):
    """For the distinct shingles: text, hash, count; by text and hash."""
    letters, words = _tools()
    starts, ends, first = word_spans(data, offs, PLAIN_WORD)
    prefix = words.prefix(word_hashes(letters, data, starts, ends))
    size = np.diff(first)
    whole_text = words.spans(prefix, first[:-1], first[1:])
    grams = words.windows(prefix, k)
    doc = np.repeat(np.arange(len(size)), size)
    finish = first[1:][doc]
    whole = np.flatnonzero(finish[: len(grams)] - np.arange(len(grams)) >= k)
    short = np.flatnonzero((size > 0) & (size < k))
    owner = np.concatenate([doc[whole], short])
    h = np.concatenate([grams[whole], whole_text[short]])
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return owner[at], h[at], np.diff(np.append(at, len(h)))


def signatures(texts: int, owner: np.ndarray, h: np.ndarray, count: np.ndarray, m: int = SIZE) -> np.ndarray:
    """texts x m shingles that arrive first; 0 where a text has none."""
    when = np.full(texts * m, np.inf)
    sig = np.zeros(texts * m, np.uint64)
    rate, time, live, j = 1.0 / count, np.zeros(len(h)), np.arange(len(h)), 0
    while len(live):
        # Few are left when short texts fill their last components: many arrivals of each at once.
        block = 1 if len(live) > 2000 else 32
        steps = (np.arange(j + 1, j + 1 + block, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        bits = mix(h[live][:, None] + steps)
        gaps = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) * rate[live][:, None]
        times = time[live][:, None] + np.cumsum(gaps, 1)
        at = (owner[live][:, None] * m + (mix(bits) % np.uint64(m)).astype(np.int64)).ravel()
        t = times.ravel()
        np.minimum.at(when, at, t)
        won = when[at] == t
        sig[at[won]] = np.repeat(h[live], block)[won]
        time[live] = times[:, -1]
        last = when.reshape(texts, m).max(1)
        live = live[time[live] < last[owner[live]]]
        j += block
    return sig.reshape(texts, m)


def _bands(sig: np.ndarray) -> np.ndarray:
    s = sig.reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), s.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, r])
    return key.view(np.int64)


def compared(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two weighted sets (sorted hashes, counts): the larger of the probability Jaccard similarity and the Jaccard
    similarity of the plain sets."""
    (ha, ca), (hb, cb) = a, b
    if not len(ha) or not len(hb):
        return float(len(ha) == len(hb))
    at = np.searchsorted(hb, ha)
    at[at == len(hb)] = 0
    both = hb[at] == ha
    n = int(both.sum())
    plain = n / (len(ha) + len(hb) - n)
    if not n or plain >= THRESHOLD or (ca.max() == 1 and cb.max() == 1):
        return plain
    x, y = ca[both], cb[at[both]]
    pairs = Counter(zip(x.tolist(), y.tolist(), strict=True))
    rest = Counter((c, 0) for c in ca[~both].tolist())
    alone = np.ones(len(hb), bool)
    alone[at[both]] = False
    rest.update((0, c) for c in cb[alone].tolist())
    every = np.array([(*k, v) for k, v in (pairs + rest).items()], float)
    return max(plain, sum(v / float((np.maximum(every[:, 0] / p, every[:, 1] / q) * every[:, 2]).sum()) for (p, q), v in pairs.items()))


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, k1, k2, bands) of every document."""

    def run(batches):
        for batch in batches:
            data, offs = flat(batch.column(1))
            keys, bands = [np.zeros((0, 2), np.int64)], [np.zeros((0, BANDS), np.int64)]
            for i, j in slabs(offs):
                text, cut = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                keys.append(digests(text, cut))
                bands.append(_bands(signatures(j - i, *shingles(text, cut))))
            keys, bands = np.concatenate(keys), np.concatenate(bands).ravel()
            offsets = pa.array(np.arange(0, len(bands) + 1, BANDS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(keys[:, k])) for k in (0, 1)), pa.ListArray.from_arrays(offsets, pa.array(bands))], names=["doc", "k1", "k2", "bands"])

    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    return docs.select(doc, F.col(text_col).cast("string")).mapInArrow(trimmed(run), "doc bigint, k1 bigint, k2 bigint, bands array<bigint>")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) and whether they are linked; see `linked`."""

    def run(batches):
        for batch in batches:
            like, sides = [], []
            for c in ("ta", "tb"):
                column = batch.column(batch.schema.get_field_index(c))
                if pa.types.is_dictionary(column.type):
                    column = column.dictionary_decode()
                sides.append(flat(column))
            for i, j in slabs(sides[0][1] + sides[1][1], 1 << 20):
                sets = []
                for data, offs in sides:
                    owner, h, count = shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                    cut = np.searchsorted(owner, np.arange(j - i + 1))
                    sets.append([(h[a:b], count[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)])
                like += [compared(x, y) for x, y in zip(*sets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x >= threshold for x in like], pa.bool_())], names=["a", "b", "ok"])

    t = pairs.join(texts.select(F.col("u").alias("a"), F.col("text").alias("ta")), "a")
    t = t.join(texts.select(F.col("u").alias("b"), F.col("text").alias("tb")), "b")
    return t.select("a", "b", "ta", "tb").mapInArrow(trimmed(run), "a bigint, b bigint, ok boolean")


def _tokens(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """What `linked` asks of nodes: their distinct shingles and how often they have them."""

    def run(batches):
        for batch in batches:
            data, offs = flat(batch.column(1))
            node = batch.column(0).to_numpy()
            for i, j in slabs(offs):
                owner, h, count = shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield pa.RecordBatch.from_arrays([pa.array(node[i:j][owner]), pa.array(h.view(np.int64)), pa.array(count)], names=["u", "h", "w"])

    return texts.join(nodes, "u", "left_semi").select("u", "text").mapInArrow(trimmed(run), "u bigint, h bigint, w bigint")


def _of_digest(df: DataFrame) -> DataFrame:
    """(u, text): rows of one id can hold several texts; only the one that has the digest stays, once."""

    def run(batches):
        for batch in batches:
            data, offs = flat(batch.column(1))
            found = [digests(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in slabs(offs)]
            asked = np.stack([batch.column(k).to_numpy() for k in (2, 3)], 1)
            same = (np.concatenate(found) == asked).all(1) if found else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "text"]).filter(pa.array(same))

    return df.select("u", "text", "k1", "k2").mapInArrow(trimmed(run), "u bigint, text string").dropDuplicates(["u"])


def near_duplicate_classes(docs: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, class_size) of every document; class_id: the least id of the documents that links connect."""
    kind = docs.schema[id_col].dataType.simpleString()
    signed = stored(_signed(docs, id_col, text_col))
    nodes = signed.groupBy("k1", "k2").agg(F.min("doc").alias("doc"), F.first("bands").alias("bands"))
    nodes = stored(nodes.withColumn("u", F.monotonically_increasing_id()))  # unique, and fixed once written
    spread = nodes.select("u", F.explode("bands").alias("key"))
    met = stored(buckets(spread))  # nodes that share a band
    # One text for each node in question.
    asked = nodes.select("u", "doc", "k1", "k2").join(met.select("u").distinct(), "u", "left_semi")
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    texts = stored(_of_digest(docs.select(doc.alias("doc"), F.col(text_col).cast("string").alias("text")).join(asked, "doc")))
    group = linked(met, lambda pairs: _verified(pairs, texts, threshold), lambda some: _tokens(some, texts), threshold)
    of = nodes.select("u", "k1", "k2").join(group.withColumnRenamed("id", "u"), "u", "left").select("k1", "k2", F.coalesce("component", "u").alias("c"))
    member = stored(signed.select("doc", "k1", "k2").join(of, ["k1", "k2"]).select("doc", "c"))
    discard(signed, nodes, met, texts, group)
    classes = member.groupBy("c").agg(F.min("doc").alias("class"), F.count(F.lit(1)).alias("class_size"))
    blank = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).cast(kind)
    return member.join(classes, "c").select(blank("doc").alias(id_col), blank("class").alias("class_id"), "class_size")


def drop_near_duplicates(docs: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their columns; of each class, the rows of its least id stay."""
    lead = "lead"
    while lead in {c.lower() for c in docs.columns}:
        lead += "_"
    leads = near_duplicate_classes(docs, threshold=threshold, id_col=id_col, text_col=text_col).select(F.coalesce(F.col("class_id").cast("long"), F.lit(NULL_ID)).alias(lead)).distinct()
    return docs.join(leads, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)) == F.col(lead), "left_semi")
