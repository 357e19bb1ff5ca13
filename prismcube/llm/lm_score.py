"""Operator 10: masked pseudo-likelihood scores of a bidirectional window network.

A token is a word (a run of letters, digits and bytes beyond ASCII, A-Z lower-cased), known by its 64-bit hash, and
lies in one of CLASSES x WITHIN classes: the most frequent hash buckets of the corpus have one of their own, the others
share the rest.  A token's probability is P(class | context) * P(word | class).  The network predicts the class of every
token from the tokens at the offsets -2, -1, 1 and 2: their embeddings, one table for each offset, are added; a softmax
over CLASSES groups and one over the WITHIN members of the group give the conditional probability.  The word in its class
has its share of all of the class's tokens in the corpus, by the Witten-Bell rule: of n tokens and t distinct words, a word
that occurs k times has (k + e) / (n + t + 1), where e is t + 1 shared evenly by all hashes of the class, which is all that
a word never seen has.  A document's score is the sum of the log-probabilities of all of its tokens, each masked in turn
(the pseudo-log-likelihood).

What is counted and what is trained cover the whole corpus.  Counts: each task sends (word, count) rows, whose sums are
a table of all words, growing with the corpus.  Training: in each round every task takes the current parameters through
all of its texts by stochastic gradient descent in numpy, and sends its parameters in BLOCKS blocks with its number of
tokens; the weighted mean of them is the next round's start: the executors sum 256 blocks into one, in three
levels (the blocks stay arrays, and no task holds more than 256 of one kind).  Only the averaged parameters,
the counts by bucket and the HOT most frequent words, whose size is fixed, come to the driver.  Before the rounds, the
biases are set from the corpus's counts.  Scoring: a task adds the classes and the words among the HOT itself; every
other token is joined with the table of words by shuffling, so no key is hot there.

Cases: null and empty texts have no tokens: sum and mean are 0; a text of one token is scored from the padding alone;
null ids pass through; repeated rows are trained on and scored each; other columns aren't read; an empty table gives
an empty table.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ALNUM_WORD, LOWER, Rolling, flat, slabs, stored, word_hashes, word_spans

BUCKETS = 1 << 16
CLASSES, WITHIN, DIM = 32, 32, 16
VOCABULARY = CLASSES * WITHIN
OWN = VOCABULARY // 2  # most frequent buckets, with a class of their own
OFFSETS = (-2, -1, 1, 2)
PAD = VOCABULARY
BATCH = 8192
BLOCKS = 64
#: Blocks of 2**FAN_BITS tasks are summed in one step, as often as takes 2**24 tasks.
FAN_BITS, LEVELS = 8, 3
#: The most frequent words, whose counts every task has; the others are joined by shuffling.
HOT = 1 << 16
#: Counts of words that a task holds before it sums and sends them.
HELD = 1 << 20


def _rolling() -> Rolling:
    return _rolling.__dict__.setdefault("made", Rolling())


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token, and the first token of each text."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, offs, ALNUM_WORD)
    return word_hashes(_rolling(), low, starts, ends), first


def _bucket(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(BUCKETS - 1)).astype(np.int64)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    words, n = map(np.concatenate, zip(*parts, strict=True))
    by = np.argsort(words)
    words, n = words[by], n[by]
    head = np.flatnonzero(np.append(True, words[1:] != words[:-1])[: len(words)])
    return words[head], np.add.reduceat(n, head) if len(head) else n


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(w, n) of every distinct word over all texts, w being its hash."""

    def batch_of(words, n):
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["w", "n"])

    def run(batches):
        held, size = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
        for batch in batches:
            data, offs = flat(batch.column(0))
            for i, j in slabs(offs):
                held.append(np.unique(_words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])[0], return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    yield batch_of(*_summed(held))
                    held, size = held[:1], 0
        yield batch_of(*_summed(held))

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n"))


class WordShares:
    """P(word | class), see above: what each class has, the HOT words in every task, and all others as a table."""

    def __init__(self, counts: DataFrame, by_bucket: pa.Table, classes: np.ndarray):
        """counts: (w, n), stored.  by_bucket: (bucket, n, types) of them."""
        bucket, n, types = (by_bucket.column(k).to_numpy() for k in ("bucket", "n", "types"))
        total = np.bincount(classes[bucket], n, VOCABULARY) + (distinct := np.bincount(classes[bucket], types, VOCABULARY) + 1)
        hashes = np.maximum(np.bincount(classes, minlength=VOCABULARY), 1) * (2.0**64 / BUCKETS)
        hot = counts.orderBy(F.desc("n"), "w").limit(HOT).toArrow()
        words, n = hot.column("w").to_numpy().view(np.uint64), hot.column("n").to_numpy()
        by = np.argsort(words)
        self.classes, self.even, self.total = classes, distinct / hashes, np.log(total)
        self.words = words[by]
        self.gain = np.log1p(n[by] / self.even[classes[_bucket(self.words)]])
        self.counts = counts

    def tasks(self) -> tuple[np.ndarray, ...]:
        return self.words, self.gain, np.log(self.even) - self.total

    @staticmethod
    def known(words: np.ndarray, cls: np.ndarray, hot: np.ndarray, gain: np.ndarray, unseen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability in its class of each token, as of a word never seen if it isn't hot, and whether it is hot."""
        if not len(hot):
            return unseen[cls], np.zeros(len(cls), bool)
        at = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
        found = hot[at] == words
        return unseen[cls] + np.where(found, gain[at], 0.0), found

    def others(self) -> DataFrame:
        """(w, gain): what the log-probability of a word that isn't hot is above that of a word never seen."""
        shared = self.counts.sparkSession.sparkContext.broadcast(pickle.dumps((self.words, self.classes, self.even)))

        def run(batches):
            hot, classes, even = pickle.loads(shared.value)
            for batch in batches:
                w, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                words = w.view(np.uint64)
                rest = hot[np.minimum(np.searchsorted(hot, words), len(hot) - 1)] != words
                yield pa.RecordBatch.from_arrays([pa.array(w[rest]), pa.array(np.log1p(n[rest] / even[classes[_bucket(words[rest])]]))], names=["w", "gain"])

        return self.counts.select("w", "n").mapInArrow(run, "w bigint, gain double")


class WindowNetwork:
    """Parameters as one float32 vector: embeddings by offset, group softmax, member softmax."""

    shapes = ((len(OFFSETS), VOCABULARY + 1, DIM), (DIM + 1, CLASSES), (VOCABULARY, DIM + 1))

    def __init__(self, vector: np.ndarray, classes: np.ndarray, shares: WordShares | None = None):
        self.vector, self.classes, self.shares = vector, classes, shares
        self.emb, self.group, self.member = self.parts(vector)

    @classmethod
    def parts(cls, vector: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for shape in cls.shapes:
            size = int(np.prod(shape))
            out.append(vector[at : at + size].reshape(shape))
            at += size
        return out

    @classmethod
    def start(cls, counts: dict[int, int], seed: int = 0) -> WindowNetwork:
        rng = np.random.default_rng(seed)
        classes = OWN + np.arange(BUCKETS) % (VOCABULARY - OWN)
        top = sorted(counts, key=lambda b: (-counts[b], b))[:OWN]
        # Frequent classes are dealt over the groups, so that groups are of about one frequency.
        own = np.arange(OWN)
        classes[top] = own[: len(top)]
        place = np.empty(VOCABULARY, np.int64)
        every = np.concatenate([own, np.arange(OWN, VOCABULARY)])
        place[every] = (np.arange(VOCABULARY) % CLASSES) * WITHIN + np.arange(VOCABULARY) // CLASSES
        classes = place[classes]
        vector = rng.normal(0, 0.1, sum(int(np.prod(s)) for s in cls.shapes)).astype(np.float32)
        net = cls(vector, classes)
        total = np.full(VOCABULARY, 0.5)
        if counts:
            np.add.at(total, classes[np.fromiter(counts, np.int64)], np.fromiter(counts.values(), np.float64))
        groups = total.reshape(CLASSES, WITHIN)
        net.group[-1] = np.log(groups.sum(1) / total.sum())
        net.member[:, -1] = np.log(groups / groups.sum(1, keepdims=True)).ravel()
        return net

    def tokens(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Classes of all tokens, their context (a row for each offset), the first token of each text, and the words."""
        words, first = _words(data, offs)
        cls = self.classes[_bucket(words)]
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        context = np.full((len(OFFSETS), len(cls)), PAD)
        for r, o in enumerate(OFFSETS):
            if o < 0:
                same = doc[-o:] == doc[:o]
                context[r, -o:][same] = cls[:o][same]
            else:
                same = doc[:-o] == doc[o:]
                context[r, :-o][same] = cls[o:][same]
        return cls, context, first, words

    def _forward(self, cls: np.ndarray, context: np.ndarray):
        """cls in the order of its groups.  Hidden layer, exponentials of both softmaxes and of the targets, ends of the groups."""
        h = self.emb[0][context[0]]
        for r in range(1, len(OFFSETS)):
            h += self.emb[r][context[r]]
        g = h @ self.group[:-1]
        g += self.group[-1]
        cut = np.searchsorted(cls, np.arange(CLASSES + 1) * WITHIN).tolist()
        m = np.empty((len(cls), WITHIN), np.float32)
        for c in range(CLASSES):  # a matrix product for each group
            if cut[c] < cut[c + 1]:
                w = self.member[c * WITHIN : (c + 1) * WITHIN]
                np.matmul(h[cut[c] : cut[c + 1]], w[:, :-1].T, out=m[cut[c] : cut[c + 1]])
                m[cut[c] : cut[c + 1]] += w[:, -1]
        for x in (g, m):
            np.exp(np.clip(x, -60, 60, out=x), out=x)
        return h, g, m, cut

    def log_probabilities(self, cls: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Of the classes."""
        out = np.empty(len(cls))
        ones = np.ones(WITHIN, np.float32)
        for i in range(0, len(cls), BATCH):
            by = np.argsort(cls[i : i + BATCH].astype(np.uint16), kind="stable")
            c = cls[i : i + BATCH][by]
            _, g, m, _ = self._forward(c, context[:, i : i + BATCH][:, by])
            at = np.arange(len(g))
            p = (g[at, c // WITHIN] / (g @ ones[:CLASSES])) * (m[at, c % WITHIN] / (m @ ones))
            out[i + by] = np.log(np.maximum(p, 1e-30))
        return out

    def descend(self, cls: np.ndarray, context: np.ndarray, rate: float) -> None:
        for i in range(0, len(cls), BATCH):
            by = np.argsort(cls[i : i + BATCH].astype(np.uint16), kind="stable")
            c, x = cls[i : i + BATCH][by], context[:, i : i + BATCH][:, by]
            h, g, m, cut = self._forward(c, x)
            at = np.arange(len(c))
            for e in (g, m):
                e /= e.sum(1, keepdims=True)
            g[at, c // WITHIN] -= 1
            m[at, c % WITHIN] -= 1
            dh = g @ self.group[:-1].T
            step = rate / len(c)
            self.group[:-1] -= step * 8 * (h.T @ g)
            for k in range(CLASSES):
                s = slice(cut[k], cut[k + 1])
                if cut[k] < cut[k + 1]:
                    w = self.member[k * WITHIN : (k + 1) * WITHIN]
                    dh[s] += m[s] @ w[:, :-1]
                    w[:, :-1] -= step * 32 * (m[s].T @ h[s])
                    w[:, -1] -= step * 8 * m[s].sum(0)
            self.group[-1] -= step * 4 * g.sum(0)
            for r in range(len(OFFSETS)):  # rows of one token are summed, not added one by one
                order = np.argsort(x[r].astype(np.uint16), kind="stable")
                ids = x[r][order]
                head = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                n = np.diff(np.append(head, len(ids))).astype(np.float32)
                self.emb[r][ids[head]] -= np.add.reduceat(dh[order], head, 0) * (rate * 0.1 / np.sqrt(n))[:, None].astype(np.float32)


def _mean(parts: DataFrame) -> np.ndarray:
    """The mean parameters, weighted by tokens.  parts: (block, part, tokens, values), part numbering the tasks."""

    def merged(key, tbl):
        n = tbl.column("tokens").to_numpy()
        total = n @ tbl.column("values").combine_chunks().flatten().to_numpy().reshape(len(n), -1)
        return pa.table({"block": [key[0].as_py()], "part": [key[1].as_py()], "tokens": [int(n.sum())], "values": pa.array([total / n.sum()], pa.list_(pa.float64()))})

    for _ in range(LEVELS):
        parts = parts.withColumn("part", F.shiftright("part", FAN_BITS)).groupBy("block", "part").applyInArrow(merged, _PARTS)
    rows = sorted(zip(*(x.to_pylist() for x in parts.select("block", "values").toArrow().columns), strict=True))
    return np.array([v for _, block in rows for v in block], np.float32)


_PARTS = "block bigint, part bigint, tokens bigint, values array<double>"


def train(docs: DataFrame, *, text_col: str = "text", rounds: int = 1, rate: float = 0.5, seed: int = 0) -> WindowNetwork:
    """Counts and gradient descent over all texts; see above."""
    spark = docs.sparkSession
    counts = stored(word_counts(docs, text_col))
    buckets = counts.groupBy(F.col("w").bitwiseAND(BUCKETS - 1).alias("bucket")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).orderBy(F.desc("n"), "bucket").toArrow()  # at most BUCKETS rows
    net = WindowNetwork.start(dict(zip(*(buckets.column(k).to_pylist() for k in ("bucket", "n")), strict=True)), seed)
    shares = WordShares(counts, buckets, net.classes)
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(pickle.dumps((net.vector, net.classes)))
        pace = rate * (1 - k / rounds)

        def run(batches, shared=shared, pace=pace):
            vector, classes = pickle.loads(shared.value)
            local, tokens = WindowNetwork(vector.copy(), classes), 0
            for batch in batches:
                data, offs = flat(batch.column(0))
                for i, j in slabs(offs):
                    cls, context, _, _ = local.tokens(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                    local.descend(cls, context, pace)
                    tokens += len(cls)
            if tokens:
                size = -(-len(vector) // BLOCKS)
                values = [local.vector[i : i + size].astype(np.float64) for i in range(0, len(vector), size)]
                part = [TaskContext.get().partitionId()] * len(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(part, pa.int64()), pa.array([tokens] * len(values), pa.int64()), pa.array(values, pa.list_(pa.float64()))], names=["block", "part", "tokens", "values"])

        new = _mean(docs.select(F.col(text_col).cast("string")).mapInArrow(run, _PARTS))
        if len(new):
            net = WindowNetwork(new, net.classes)
    return WindowNetwork(net.vector, net.classes, shares)


def score_documents(docs: DataFrame, net: WindowNetwork, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, log_likelihood, mean_log_likelihood) of every document, by a network that `train` made."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps((net.vector, net.classes, net.shares.tasks())))

    def run(batches):
        vector, classes, shares = pickle.loads(shared.value)
        net, row = WindowNetwork(vector, classes), TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offs = flat(batch.column(1))
            for i, j in slabs(offs):
                cls, context, first, words = net.tokens(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                inside, hot = WordShares.known(words, cls, *shares)
                sums = np.append(0.0, np.cumsum(net.log_probabilities(cls, context) + inside))
                rare = np.append(0, np.cumsum(~hot))[first]
                rest = pa.ListArray.from_arrays(pa.array(rare, pa.int32()), pa.array(words[~hot].view(np.int64)))
                rows = pa.array(np.arange(row, row + j - i))
                row += j - i
                yield pa.RecordBatch.from_arrays([rows, batch.column(0).slice(i, j - i), pa.array(np.diff(first)), pa.array(sums[first[1:]] - sums[first[:-1]]), rest], names=["row", "id", "n", "s", "rest"])

    # Stored, so that the numbers of the rows stay what they are.
    part = stored(docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"row bigint, id {kind}, n bigint, s double, rest array<bigint>"))
    rest = part.select("row", F.explode("rest").alias("w")).join(net.shares.others(), "w").groupBy("row").agg(F.sum("gain").alias("gain"))
    out = part.select("row", "id", "n", "s").join(rest, "row", "left").withColumn("s", F.col("s") + F.coalesce("gain", F.lit(0.0)))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), F.col("s").alias("log_likelihood"), (F.col("s") / F.greatest("n", F.lit(1))).alias("mean_log_likelihood"))
