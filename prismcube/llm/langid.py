"""Operator 9: language identification by averaged hashed subword embeddings and a linear softmax.

A word is a run of letters (ASCII letters lower-cased, every byte beyond ASCII); its features are its byte n-grams of
one to four between the marks < and >, and the word itself, hashed into BUCKETS rows of an embedding.  A text is the
average over the features of its words.  Embedding and softmax are trained together by stochastic gradient descent in
numpy on a bounded sample of labelled documents: SAMPLE a language, the least hashes of (doc_id, text), of at most
SAMPLE_CHARS characters.  The texts of a language are counted first, and only those whose hash lies in the share that
holds SAMPLE of them leave their tasks, so that no language's texts meet in one.  A temperature fitted on a fifth of the
sample calibrates the scores, and the rejection threshold is the score below which the held-back texts are mostly
wrong; a sample of which nothing can be held back gives temperature 1 and no threshold.  Prediction reads whole texts:
as the model is linear, each distinct word of a slab is scored once from the product of embedding and softmax.

Cases: null texts and texts without a letter are `und` with score 0; null ids pass through and aren't learned from;
null languages aren't learned from; without any labelled text everything is `und`; repeated rows are predicted each;
other columns aren't read by `identify_language` and pass through `keep_identified`; empty tables give empty tables.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import LETTER_WORD, LOWER, Rolling, flat, mix, ranges, slabs, trimmed, word_hashes, word_spans

BUCKETS, DIM, GRAMS = 1 << 14, 16, (1, 2, 3, 4)
SAMPLE, SAMPLE_CHARS = 600, 20_000
UNKNOWN = "und"
#: Bytes of text scored at once; their words have about a hundred times as many bytes of features.
SLAB = 256 << 10
#: Distinct words of which the features are made at once for training.
PART = 4096
#: Least number of texts drawn of a language in a round, and the length that no weight vector exceeds.
MIN_DRAWS, RADIUS = 300, 8.0


def _features(rolling: Rolling, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of words one after another, and how many each word has."""
    size = ends - starts + 2
    at = np.cumsum(size) - size
    text = np.empty(int(size.sum()), np.uint8)
    text[at], text[at + size - 1] = 0x3C, 0x3E
    text[ranges(at + 1, size - 2)] = data[ranges(starts, size - 2)]
    prefix = rolling.prefix(rolling.bytes[text])
    ids, owner = [mix(rolling.spans(prefix, at, at + size))], [np.arange(len(size))]
    for n in GRAMS:
        count = np.maximum(size - n + 1, 0)
        where = ranges(at, count)
        ids.append(rolling.spans(prefix, where, where + n))
        owner.append(np.repeat(np.arange(len(size)), count))
    who = np.concatenate(owner)
    order = np.argsort(who, kind="stable")
    return (np.concatenate(ids)[order] & np.uint64(BUCKETS - 1)).astype(np.int64), np.bincount(who, minlength=len(size))


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # embedding times softmax: BUCKETS x languages
    bias: np.ndarray
    temperature: float
    reject: float

    def logits(self, rolling: Rolling, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: calibrated logits, and its number of features."""
        low = LOWER[data]
        starts, ends, first = word_spans(low, offs, LETTER_WORD)
        out, total = np.zeros((len(offs) - 1, len(self.langs))), np.zeros(len(offs) - 1)
        if len(starts):
            _, one, which = np.unique(word_hashes(rolling, low, starts, ends), return_index=True, return_inverse=True)
            ids, count = _features(rolling, low, starts[one], ends[one])
            head = np.cumsum(count) - count
            words = np.concatenate([np.add.reduceat(self.table[ids], head, 0), count[:, None]], 1)
            sums = np.zeros((len(which) + 1, words.shape[1]))
            np.cumsum(words[which], 0, out=sums[1:])
            docs = sums[first[1:]] - sums[first[:-1]]
            out, total = docs[:, :-1], docs[:, -1]
        return (out / np.maximum(total, 1)[:, None] + self.bias) / self.temperature, total


def train(texts: list[str], labels: list[str], *, epochs: int = 4, rate: float = 0.4, seed: int = 0) -> LanguageModel:
    """Stochastic gradient descent over snippets of 1 to 40 words; every fifth text is held back for calibration."""
    langs = sorted(set(labels))
    rng, rolling = np.random.default_rng(seed), Rolling()
    target = np.array([langs.index(x) for x in labels])
    raw = "\n".join(texts).encode()
    sizes = np.array([len(t.encode()) for t in texts])
    data = LOWER[np.frombuffer(raw, np.uint8)]
    begin = np.cumsum(sizes + 1) - sizes - 1
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), LETTER_WORD)
    lo, hi = np.searchsorted(starts, begin), np.searchsorted(starts, begin + sizes)
    if not len(starts):
        return LanguageModel(langs, np.zeros((BUCKETS, len(langs)), np.float32), np.zeros(len(langs)), 1.0, 0.0)
    # In parts, as hashing takes many times its text of memory, and the driver's is small.
    parts = []
    for i, j in slabs(np.append(begin, len(data)), SLAB):
        a, b = begin[i], begin[j] if j < len(begin) else len(data)
        w = slice(lo[i], hi[j - 1])
        parts.append(word_hashes(rolling, data[a:b], starts[w] - a, ends[w] - a))
    _, one, which = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
    which = which.astype(np.int32)
    parts = []
    for k in range(0, len(one), PART):
        at, ends_at = starts[one[k : k + PART]], ends[one[k : k + PART]]
        size = ends_at - at
        first = np.cumsum(size) - size
        parts.append(_features(rolling, data[ranges(at, size)], first, first + size))
    ids, count = np.concatenate([x.astype(np.uint16) for x, _ in parts]), np.concatenate([n for _, n in parts])
    head = np.cumsum(count) - count
    del parts, starts, ends, data, raw
    usable = np.flatnonzero(hi > lo)
    held, fit = usable[usable % 5 == 0], usable[usable % 5 != 0]
    if not len(fit):
        held, fit = usable[:0], usable
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)

    def bag(docs: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
        n = hi[docs] - lo[docs]
        take = np.minimum(n, np.ceil(longest ** rng.random(len(docs))).astype(np.int64))
        from_ = lo[docs] + (rng.random(len(docs)) * (n - take + 1)).astype(np.int64)
        words = which[ranges(from_, take)]
        per_doc = np.add.reduceat(count[words], np.cumsum(take) - take)
        return ids[ranges(head[words], count[words])], per_doc

    by_lang = [fit[target[fit] == k] for k in range(len(langs))]
    by_lang = [x for x in by_lang if len(x)]
    each = max(MIN_DRAWS, max(map(len, by_lang)))  # languages are drawn equally often
    rounds, batch = epochs * 2, 64
    for r in range(rounds):
        order, pace = rng.permutation(np.concatenate([rng.choice(x, each) for x in by_lang])), rate * (1 - r / rounds)
        for k in range(0, len(order), batch):
            docs = order[k : k + batch]
            f, n = bag(docs, 40)
            h = np.add.reduceat(emb[f], np.cumsum(n) - n, 0) / n[:, None]
            p = _softmax(h @ out + bias)
            p[np.arange(len(docs)), target[docs]] -= 1
            back = p @ out.T / n[:, None]
            out -= pace * (h.T @ p)
            bias -= pace * p.mean(0)
            np.add.at(emb, f, (-pace * np.repeat(back, n, 0)).astype(np.float32))
            for w in (emb, out):  # projected on a ball, so that no step can run away
                size = np.sqrt((w * w).sum(1, keepdims=True))
                np.divide(w, size / RADIUS, out=w, where=size > RADIUS)
    model = LanguageModel(langs, emb @ out, bias.astype(np.float64), 1.0, 0.0)
    if not len(held):
        return model
    parts = []
    for k in range(0, 6 * len(held), batch):
        f, n = bag(np.repeat(held, 6)[k : k + batch], 400)
        parts.append(np.add.reduceat(model.table[f], np.cumsum(n) - n, 0) / n[:, None] + bias)
    logits = np.concatenate(parts)
    y = target[np.repeat(held, 6)]
    grid = np.geomspace(0.2, 5, 33)
    losses = [-np.log(_softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(losses))])
    p = _softmax(logits / model.temperature)
    best, right = p.max(1), p.argmax(1) == y
    # The largest threshold below which at least half of the held-back snippets are wrong; 0.4 at most.
    for t in np.linspace(0.4, 0, 41):
        low = best < t
        if not low.any() or (~right[low]).mean() >= 0.5:
            model.reject = float(min(t, 0.4))
            break
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from learning."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """From the labelled documents that aren't held out: `sample` of each language."""
    d = df.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(label_col).cast("string").alias("l"))
    d = d.where(~held_out("i") & F.col("i").isNotNull() & F.col("t").isNotNull() & F.col("l").isNotNull() & (F.length("t") <= SAMPLE_CHARS))
    d = d.withColumn("h", F.xxhash64("i", "t"))
    sizes = {r.l: r.n for r in d.groupBy("l").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not sizes:
        return train([], [])
    # So many texts are expected under the share that fewer than `sample` come by six deviations only.
    asked = sample + 6 * sample**0.5 + 36
    top = [(k, min(int(min(1.0, 1.2 * asked / n) * 2**64) - 2**63, 2**63 - 1)) for k, n in sizes.items()]
    cut = df.sparkSession.createDataFrame(top, "l string, top long")
    # A text's copies of one id are one row.
    few = d.join(F.broadcast(cut), "l").where("h <= top").groupBy("l", "h").agg(F.min("t").alias("t")).toArrow()
    rows = sorted(zip(*(few.column(c).to_pylist() for c in ("l", "h", "t")), strict=True))
    chosen = [r for _, group in groupby(rows, itemgetter(0)) for r in islice(group, sample)]
    return train([r[2] for r in chosen], [r[0] for r in chosen])


def _predict(model: LanguageModel, column) -> tuple[np.ndarray, np.ndarray]:
    """(language number or -1, score) of each text."""
    rolling = _predict.__dict__.setdefault("rolling", Rolling())
    data, offs = flat(column)
    lang, score = np.full(len(offs) - 1, -1), np.zeros(len(offs) - 1)
    for i, j in slabs(offs, SLAB):
        part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        logits, total = model.logits(rolling, part, o)
        if not model.langs:
            continue
        p = _softmax(logits)
        ascii_letter = np.append(0, np.cumsum(LETTER_WORD[part] & (part < 0x80)))
        sure = ascii_letter[o[1:]] > ascii_letter[o[:-1]]
        for d in np.flatnonzero(~sure & (total > 0)).tolist():
            sure[d] = any(map(str.isalpha, part[o[d] : o[d + 1]].tobytes().decode(errors="replace")))
        lang[i:j] = np.where(sure, p.argmax(1), -1)
        score[i:j] = np.where(sure, p.max(1), 0)
    return lang, score


def identify_language(df: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score, rejected)."""
    shared = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        model = pickle.loads(shared.value)
        names = np.array([*model.langs, UNKNOWN], object)
        for batch in batches:
            lang, score = _predict(model, batch.column(2))
            cols = [batch.column(0), batch.column(1), pa.array(names[lang].tolist(), pa.string()), pa.array(score, pa.float64()), pa.array((lang < 0) | (score < model.reject))]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "held_out", "lang_pred", "score", "rejected"])

    d = df.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).cast("string"))
    return d.mapInArrow(trimmed(run), f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(df: DataFrame, model: LanguageModel, *, text_col: str = "text") -> DataFrame:
    """The documents, with their columns, whose language isn't rejected."""
    shared, at = df.sparkSession.sparkContext.broadcast(pickle.dumps(model)), df.columns.index(text_col)

    def run(batches):
        model = pickle.loads(shared.value)
        for batch in batches:
            lang, score = _predict(model, batch.column(at))
            yield batch.filter(pa.array((lang >= 0) & (score >= model.reject)))

    return df.mapInArrow(trimmed(run), df.schema)
