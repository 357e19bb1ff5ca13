"""The ten operators against brute force, libraries and SQL, and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import AWKWARD
from prismcube.llm import queries
from prismcube.llm.oracle import SQL

PLAIN = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [tuple(r) for r in df.collect()]


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, duck, name):
    df = queries.queries()[name](spark, data)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    want = sorted(tuple(map(repr, r)) for r in found.fetchall())
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(map(repr, r)) for r in df.select(*names).collect()) == want


# -- 1, 7 ----------------------------------------------------------------------------------------------------------


def removed(docs: list[tuple], n: int, symbols) -> dict:
    """Brute force: id -> kept symbols of each row."""
    key = lambda i: (i is None, i)
    first: dict = {}
    for i, text in docs:
        s = symbols(text)
        for k in range(len(s) - n + 1):
            w, at = s[k : k + n], (key(i), k)
            first[w] = min(first.get(w, at), at)
    out = defaultdict(list)
    for i, text in docs:
        s = symbols(text)
        gone = [False] * len(s)
        for k in range(len(s) - n + 1):
            if first[s[k : k + n]] < (key(i), k):
                gone[k : k + n] = [True] * n
        out[i].append(tuple(x for x, g in zip(s, gone, strict=True) if not g))
    return {k: sorted(v) for k, v in out.items()}


def passages(seed: int, size: int) -> list[tuple]:
    """Documents that share passages, in all overlaps, with a hot one in most of them."""
    r = random.Random(seed)
    parts = [" ".join(r.choice("ab") * r.randint(1, 3) for _ in range(r.randint(5, 40))) for _ in range(8)]
    docs = [(k, " ".join(r.choice(parts) if r.random() < 0.5 else "".join(r.choice("xyz ") for _ in range(30)) for _ in range(r.randint(0, 6)))) for k in range(size)]
    return [*docs, (None, docs[3][1]), (2, docs[2][1]), (size + 1, None), (size + 2, "")]


@pytest.mark.parametrize("seed", [1, 2])
def test_passages(spark, seed, monkeypatch):
    from prismcube.llm import repeats

    monkeypatch.setattr(repeats, "CHUNK", 2000)
    docs = passages(seed, 40)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for n, k, run, symbols, read in (
        (6, 3, repeats.substring_dedup, lambda t: tuple(PLAIN.findall(t or "")), lambda x: tuple(x.split())),
        (25, 8, repeats.suffix_array_dedup, lambda t: tuple((t or "").encode()), lambda x: tuple(bytes(x))),
    ):
        got = defaultdict(list)
        for r in run(df, n=n, k=k).collect():
            got[r["doc_id"]].append(read(r["kept"]))
        assert {i: sorted(v) for i, v in got.items()} == removed(docs, n, symbols)


@pytest.mark.parametrize("contexts", [0, 8])
def test_passages_of_hot_anchors(spark, contexts, monkeypatch):
    """With every anchor hot, windows are decided by their hashes; results are the same."""
    from prismcube.llm import repeats

    monkeypatch.setattr(repeats, "CHUNK", 3000)
    monkeypatch.setattr(repeats, "CONTEXTS", contexts)
    monkeypatch.setattr(repeats, "GROUP", 3)
    docs = passages(5, 40)
    got = defaultdict(list)
    for r in repeats.suffix_array_dedup(spark.createDataFrame(docs, "doc_id long, text string"), n=25, k=8).collect():
        got[r["doc_id"]].append(tuple(bytes(r["kept"])))
    assert {i: sorted(v) for i, v in got.items()} == removed(docs, 25, lambda t: tuple((t or "").encode()))


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_entries_meet_in_batches_of_any_size(size, monkeypatch):
    """Of sorted entries, groups that end in later batches, and groups of more than GROUP."""
    import pyarrow as pa

    from prismcube.llm import repeats

    monkeypatch.setattr(repeats, "GROUP", 12)
    r = random.Random(size)
    rows_ = sorted((r.choice((-5, 1, 2, 3, 3, 3)) if r.random() < 0.4 else r.randrange(100), r.randrange(3), r.randrange(4), r.randrange(3)) for _ in range(300))
    h, c, d, p = (np.array(x, np.int64) for x in zip(*rows_, strict=True))
    hot, key = np.array([r.random() < 0.01 for _ in h]), (np.arange(len(h)) % 5 << 32) + np.arange(len(h))
    batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + size]) for x in (h, c, d, p, hot, key)], names=list("hcdp") + ["hot", "key"]) for i in range(0, len(h), size)]
    got = {(x["chunk"] << 32) + x["i"]: x["status"] for b in repeats._meet(iter(batches)) for x in b.to_pylist()}
    want = {}
    for k in set(h.tolist()):
        at = np.flatnonzero(h == k)
        for i in at:
            first = at[c[at] == c[i]][0]
            later = d[i] > d[first] or p[i] > p[first]
            status = repeats.HOT if hot[at].any() or len(at) > 12 else repeats.COPY if later else repeats.SHARED if len(set(c[at])) > 1 else repeats.ALONE
            if status != repeats.ALONE:
                want[int(key[i])] = int(status)
    assert got == want


def test_messages_grow_with_the_input(spark, monkeypatch):
    """Rows that are sent for four times the texts in chunks a quarter as large, and so sixteen times the pairs of chunks and shards."""
    from prismcube.llm import repeats

    sent = []
    monkeypatch.setattr(repeats, "stored", lambda df, own=repeats.stored: sent.append(out := own(df)) or out)
    for times, chunk in ((1, 40_000), (4, 10_000)):
        monkeypatch.setattr(repeats, "CHUNK", chunk)
        r = random.Random(3)
        docs = [(i, " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(60)) + (" the same passage of some words in each, which has a few more than twenty of them so that it is found as a whole by all" * (i % 3 == 0))) for i in range(100 * times)]
        repeats.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string")).count()
    one, four = (df.count() for df in sent)
    assert 2 * one < four < 6 * one


def test_indexes_agree():
    from prismcube.llm._indexes import bwt_repeats, fm_repeats

    r = np.random.default_rng(3)
    for _ in range(20):
        parts = [np.append(r.integers(1, 4, r.integers(1, 30)), 0) for _ in range(r.integers(1, 9))]
        symbols = np.concatenate(parts).astype(np.int64)
        keys = r.permutation(len(symbols)).astype(np.int64)
        n, depth = 5, max(len(p) for p in parts)
        want, least = [], {}
        spans = [(i, tuple(symbols[i : i + n])) for i in range(len(symbols) - n + 1) if 0 not in symbols[i : i + n]]
        for i, w in spans:
            least[w] = min(least.get(w, keys[i]), keys[i])
        want = [i for i, w in spans if least[w] < keys[i]]
        assert sorted(fm_repeats(symbols, keys, n, depth)) == want
        assert sorted(bwt_repeats(symbols, keys, n, depth)) == want


# -- 2 -------------------------------------------------------------------------------------------------------------


def test_decontamination_removes_spans(spark):
    from prismcube.llm.decontaminate import remove_contamination, scan_contamination

    item = " ".join(f"q{i}" for i in range(15))
    docs = [(1, "alpha " * 400 + item + " omega", 7), (2, item, 7), (3, "clean text", 7), (4, None, 7), (5, "short ITEM here", 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string, items int")
    bench = spark.createDataFrame([(10, item), (11, "item here"), (12, None), (13, "!!"), (None, "never seen words")], "item_id long, text string")
    found = {r.doc_id: r for r in scan_contamination(df, bench).collect()}
    assert (found[1].n_hit, found[1]["items"], found[1].contaminated) == (15, ["10"], False)
    assert (found[2].n_hit, found[2].contaminated) == (15, True) and found[3].n_hit == 0 and found[4].n_words == 0
    assert found[5]["items"] == ["11"] and found[5].contaminated
    kept = {r.doc_id: r.text for r in remove_contamination(df, bench).collect()}
    assert set(kept) == {1, 3, 4} and "q3" not in kept[1] and kept[3] == "clean text" and kept[4] is None


@pytest.mark.parametrize("kept", (0, 4))
def test_decontamination_of_large_batches_in_bounded_memory(kept, monkeypatch):
    """Rows are worked on and put out in parts, whatever batch they come in; all come, in order, with one index kept or none."""
    import pickle
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    from prismcube.llm import decontaminate as d
    from prismcube.llm._common import Rolling

    item = " ".join(f"q{i}" for i in range(15))
    index = d.ItemIndex(d._held(Rolling(), [("10", item)]), d.WINDOW)
    monkeypatch.setattr(d, "_indexes", lambda *_: [(f"large batches {kept}", SimpleNamespace(value=pickle.dumps(index, 5)))])
    monkeypatch.setattr(d, "KEPT", kept)
    if not kept:
        monkeypatch.setattr(d, "GROUP", 2 << 20)
        monkeypatch.setattr(d, "_load", lambda key, blob: pickle.loads(blob).ready())
    texts = [None if i % 100 == 7 else item if i % 100 == 9 else f"{i} " + "plain words " * 250 + (f"{item} end" if i % 10 == 3 else "end") for i in range(6000)]
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    docs = SimpleNamespace(columns=schema.names, schema=schema, mapInArrow=lambda run, _: run)
    run = d.remove_contamination(docs, None)
    batch = pa.RecordBatch.from_arrays([pa.array(range(6000)), pa.array(texts)], schema=schema)
    want = [(i, t and t.replace(item, "")) for i, t in enumerate(texts) if t != item]
    tracemalloc.start()
    try:
        found = 0
        for out in run([batch, batch.slice(0, 0)]):
            assert out.nbytes < 4 << 20
            for i, text in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
                assert (i, text) == want[found]
                found += 1
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == len(want) and most < 80_000_000


@pytest.mark.parametrize("seed", range(8))
def test_automaton_against_brute_force(seed):
    from prismcube.llm.decontaminate import ItemIndex

    r = random.Random(seed)
    items = [(str(i), np.array([r.randrange(6) for _ in range(r.randint(1, 9))], np.uint64)) for i in range(6)]
    # One block, or three that are joined.
    index = (ItemIndex(items, 4) if seed % 2 else ItemIndex.joined([ItemIndex(items[k : k + 2], 4) for k in (0, 2, 4)])).ready()
    for _ in range(60):
        doc = np.array([r.randrange(7) for _ in range(r.randint(0, 25))], np.uint64)
        hit, names = np.zeros(len(doc), bool), [set()]
        index.mark(doc, np.array([0]), hit, names)
        want_hit, want = np.zeros(len(doc), bool), set()
        for name, words in items:
            m = min(4, len(words))
            for k in range(len(words) - m + 1):
                for j in range(len(doc) - m + 1):
                    if (doc[j : j + m] == words[k : k + m]).all():
                        want_hit[j : j + m] = True
                        want.add(name)
        assert (hit == want_hit).all() and names[0] == want


# -- 3, 8 ----------------------------------------------------------------------------------------------------------


def united(nodes, links) -> dict:
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def word_shingles(text) -> Counter:
    w = PLAIN.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def probability_jaccard(a: Counter, b: Counter) -> float:
    total = 0.0
    for x in a.keys() & b.keys():
        total += 1 / sum(max(a[z] / a[x], b[z] / b[x]) for z in a.keys() | b.keys())
    return total


def linked_documents(a: Counter, b: Counter) -> bool:
    if not a or not b:
        return not a and not b
    both = len(a.keys() & b.keys())
    if both < 1:
        return False
    return both / len(a.keys() | b.keys()) >= 0.8 or (max(*a.values(), *b.values()) > 1 and probability_jaccard(a, b) >= 0.8)


def document_classes(docs: list[tuple]) -> dict:
    sets = {i: word_shingles(t) for i, t in docs}
    at = defaultdict(set)
    for i, s in sets.items():
        for x in s or [None]:
            at[x].add(i)
    pairs = {(a, b) for group in at.values() for a in group for b in group if a < b}
    return united(sets, [(a, b) for a, b in pairs if linked_documents(sets[a], sets[b])])


def test_near_duplicates(spark, documents):
    from prismcube.llm.minhash import near_duplicate_classes

    want = document_classes(rows(documents.select("doc_id", "text")))
    got = {r.doc_id: (r.class_id, r.class_size) for r in near_duplicate_classes(documents).collect()}
    assert {i: c for i, (c, _) in got.items()} == want
    sizes = Counter(want.values())
    assert all(n == sizes[c] for c, n in got.values())


def edited(seed: int) -> list[tuple]:
    """A chain of edits, a star of edits and exact copies."""
    r = random.Random(seed)
    base = [f"w{r.randrange(1000)}" for _ in range(120)]
    docs, w = [], base
    for k in range(12):
        w = list(w)
        w[r.randrange(len(w))] = f"c{k}"
        docs.append(" ".join(w))
    for k in range(12):
        w = list(base)
        for _ in range(r.randint(1, 3)):
            w[r.randrange(len(w))] = f"s{k}"
        docs.append(" ".join(w))
    docs += [docs[0]] * 5 + [" ".join(base)] * 3 + ["", None, "tiny"] + ["tiny"]
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates_of_edited_texts(spark, seed):
    from prismcube.llm.minhash import drop_near_duplicates, near_duplicate_classes

    docs = edited(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = document_classes(docs)
    assert {r.doc_id: r.class_id for r in near_duplicate_classes(df).collect()} == want
    assert {r.doc_id for r in drop_near_duplicates(df).collect()} == set(want.values())


def test_unlike_texts_of_one_polynomial_hash_stay_apart(spark):
    """A Thue-Morse sequence and its complement collide in every polynomial hash modulo 2**64, by words (every second one, so that no shingle is common) and by bytes."""
    from prismcube.llm.minhash import drop_near_duplicates

    bits = [bin(i).count("1") & 1 for i in range(4096)]
    docs = [(k, " ".join(f"{'pq'[b ^ k]} {'rs'[b]}" for b in bits), 1) for k in (0, 1)]
    docs += [(2 + k, "x " * 5 + "".join("ab"[b ^ k] for b in bits), 1) for k in (0, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lead int")
    assert sorted(r.doc_id for r in drop_near_duplicates(df).collect()) == [0, 1, 2, 3]


def test_signature_estimates_the_similarity():
    from prismcube.llm.minhash import signatures

    r = np.random.default_rng(0)
    h = r.integers(1, 1 << 62, 60, dtype=np.uint64)
    a, b = {x: int(r.integers(1, 6)) for x in h[:45].tolist()}, {x: int(r.integers(1, 6)) for x in h[15:].tolist()}
    owner = np.repeat([0, 1], [len(a), len(b)])
    sig = signatures(2, owner, np.array([*a, *b], np.uint64), np.array([*a.values(), *b.values()]), 4096)
    want = probability_jaccard(Counter(a), Counter(b))
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / 4096)


def kept_lines(docs: list[tuple]) -> dict:
    """Brute force: id -> kept text; rows are in the order of their ids."""
    norm = lambda x: x.strip(" \t\r\f\x0b").lower()
    texts = sorted({norm(x) for _, t in docs for x in (t or "").split("\n")} - {""})
    sets = {}
    for x in texts:
        sets[x] = {x[i : i + 8] for i in range(max(1, len(x) - 7))}
    at = defaultdict(set)
    for x, s in sets.items():
        for g in s:
            at[g].add(x)
    links = {(a, b) for g in at.values() for a in g for b in g if a < b}
    links = [(a, b) for a, b in links if (n := len(sets[a] & sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    group, seen, out = united(texts, links), set(), {}
    for i, t in docs:
        keep = []
        for x in (t or "").split("\n"):
            c = group.get(norm(x))
            if c is None or c not in seen:
                keep.append(x)
            seen.add(c) if c is not None else None
        out[i] = "\n".join(keep)
    return out


def test_line_dedup(spark, documents):
    from prismcube.llm.lines import dedup_lines

    docs = rows(documents.select("doc_id", "text").orderBy("doc_id"))
    want = kept_lines(docs)
    got = {r.doc_id: r.kept for r in dedup_lines(documents).collect()}
    wrong = [i for i in want if (got[i] or "") != want[i]]
    # A pair of similarity 0.8 is missed with a probability of 0.3 %, others with less: then a line more stays, never less.
    assert len(wrong) <= 0.01 * len(want)
    for i in wrong:
        assert not Counter(want[i].split("\n")) - Counter((got[i] or "").split("\n"))


def test_line_dedup_of_edited_lines(spark):
    from prismcube.llm.lines import drop_repeated_lines

    line = "the quick brown fox jumps over the lazy dog near the river bank today"
    docs = [(1, f"{line}\nkeep me one", "x"), (2, f"  {line.upper()}\t\nkeep me too, please", "x"), (3, line.replace("today", "todaz"), "x"), (4, f"\n\n{line}", "x"), (5, None, "x"), (6, "", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, gone string")
    got = {r.doc_id: r.text for r in drop_repeated_lines(df).collect()}
    assert got == {1: f"{line}\nkeep me one", 2: "keep me too, please", 5: None, 6: ""}


@pytest.mark.parametrize("n", [11, 12, 14, 130])
def test_similar_lines_of_any_length_meet(spark, n):
    from prismcube.llm.lines import signatures

    rng = random.Random(n)
    made = ["".join(rng.choices("abcdefghij ", k=n - 1)) + "x" for _ in range(600)]
    pairs = spark.createDataFrame([(i, x) for i, x in enumerate(made)] + [(i, x + "y") for i, x in enumerate(made)], "i long, l string")
    pairs = pairs.selectExpr("i", "l", "xxhash64(l) as k1", "xxhash64(7, l) as k2")
    keys = pairs.join(signatures(pairs), ["k1", "k2"]).select("i", "k1", F.explode("keys").alias("key"))
    met = keys.groupBy("i", "key").agg(F.count_distinct("k1").alias("k")).where("k = 2").select("i").distinct().count()
    assert len(made) - met <= 12  # 2 to 5 are expected at a similarity of 0.8


def test_lines_that_differ_in_their_spaces_meet(spark):
    """Similar lines of different lengths, beyond 100 characters: none is missed."""
    from prismcube.llm.lines import drop_repeated_lines

    rng = random.Random(2)
    half = lambda: " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(9))
    docs = [(2 * i + k, f"{p}{' ' * w}{q}") for i, (p, q) in enumerate((half(), half()) for _ in range(20)) for k, w in enumerate((16, 6))]
    got = drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == list(range(0, 40, 2))


def similarity(a: str, b: str) -> float:
    x, y = ({t[i : i + 8] for i in range(max(1, len(t) - 7))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_recall_of_edited_lines(spark):
    """Lines of over 100 characters with some words changed, of a similarity of 0.8 or more."""
    from prismcube.llm.lines import repeated_lines

    rng, pairs = random.Random(4), []
    while len(pairs) < 400:
        words = ["".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(2, 8))) for _ in range(30)]
        other = list(words)
        for _ in range(rng.randint(1, 2)):
            other[rng.randrange(30)] = "".join(rng.choices("abcdefghijklmnopqrst", k=5))
        a, b = " ".join(words), " ".join(other)
        if a != b and similarity(a, b) >= 0.8:
            pairs.append((a, b))
    docs = [(2 * i + k, x) for i, pair in enumerate(pairs) for k, x in enumerate(pair)]
    found = {r.d for r in repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert not [d for d in found if d % 2 == 0] and len(found) >= 0.99 * len(pairs)


@pytest.mark.parametrize("seed", range(2))
def test_linked_is_exact_within_buckets(spark, seed):
    """Of one bucket with hundreds of nodes, every link is found, whatever leads there are."""
    from prismcube.llm._common import linked

    rng, nodes = random.Random(seed), {}
    base = list(range(40))
    for u in range(260):
        own = [x for x in base if rng.random() > 0.1] + [rng.randrange(40, 90) for _ in range(rng.randrange(12))]
        nodes[u] = frozenset(own) if u % 3 else frozenset([*base[: rng.randrange(20, 40)], *range(1000 + u // 9 * 30, 1000 + u // 9 * 30 + rng.randrange(1, 14))])
    links = [(a, b) for a in nodes for b in nodes if a < b and len(nodes[a] & nodes[b]) >= 0.8 * len(nodes[a] | nodes[b])]
    sets = spark.createDataFrame([(u, sorted(s)) for u, s in nodes.items()], "u long, s array<long>").cache()

    def verify(pairs):
        both = pairs.join(sets.withColumnsRenamed({"u": "a", "s": "sa"}), "a").join(sets.withColumnsRenamed({"u": "b", "s": "sb"}), "b")
        return both.selectExpr("a", "b", "size(array_intersect(sa, sb)) >= 0.8D * size(array_union(sa, sb)) as ok")

    met = spark.createDataFrame([(1, u) for u in nodes] + [(2, u) for u in range(7)], "key long, u long")
    found = linked(met, verify, lambda some: sets.join(some, "u").selectExpr("u", "explode(s) as h", "1L as w"), 0.8)
    want = united(nodes, links)
    count = Counter(want.values())
    got = {r.id: r.component for r in found.collect()}
    assert {u: c for u, c in want.items() if count[c] > 1} == got


def test_keys_of_the_same_nodes_are_one_bucket(spark):
    """Nodes 1 and 2 meet under five keys, and with 3 under one more: two buckets, whose pairs are made once."""
    from prismcube.llm._common import buckets

    keys = [(k, u) for k in range(5) for u in (1, 2)] + [(9, u) for u in (1, 2, 3)] + [(11, 4)]
    got = buckets(spark.createDataFrame(keys, "key long, u long"))
    assert sorted(rows(got.select("key", "u", "n", "m"))) == [(0, 1, 2, 5), (0, 2, 2, 5), (9, 1, 3, 1), (9, 2, 3, 1), (9, 3, 3, 1)]


def test_pairs_of_several_buckets_are_made_once(spark):
    """Of 40 nodes, each in most of 12 buckets, all pairs between components come, and each of them once."""
    from prismcube.llm._common import _pairs

    rng = random.Random(4)
    of = [(k, u, u % 7, None, k % 5) for k in range(12) for u in range(40) if rng.random() < 0.8]
    want = {(a, b) for _, a, *_ in of for _, b, *_ in of if a % 7 < b % 7 and any((k, a) in {x[:2] for x in of} and (k, b) in {x[:2] for x in of} for k in range(12))}
    got = rows(_pairs(spark.createDataFrame(of, "key long, u long, c long, free struct<n: long, at: long>, df long")))
    assert len(got) == len(want) and set(got) == want


def test_nodes_that_met_in_the_bucket_before_are_not_joined(spark):
    """A family in 30 buckets is paired in the first; a node that joins it in bucket 20 meets all others there, and none after."""
    from prismcube.llm._common import _pairs

    of = [(k, u, u, (100, k), 2) for k in range(30) for u in range(50) if u or k >= 20]
    once = "if(x.free.at > 20 or (x.free.at > 0 and x.u > 0 and y.u > 0), cast(raise_error('paired again') as boolean), true)"
    got = rows(_pairs(spark.createDataFrame(of, "key long, u long, c long, free struct<n: long, at: long>, df long"), once))
    assert len(got) == len(set(got)) and set(got) == {(a, b) for b in range(50) for a in range(b)}


def test_joins_of_pairs_make_few_rows_beyond_pairs(spark):
    """Nodes of one bucket that their numbers and places rule out as pairs aren't joined, one by one or as a group with others, and all other pairs come."""
    from prismcube.llm._common import _pairs

    of = [(0, u, u, (100, 15), 200) for u in range(200)]  # too much is before the bucket for any two
    of += [(k, 1000 + u, u % 2, (100, k), 100 * k) for k in (1, 2) for u in range(100)] + [(2, 2000 + u, 2000 + u, (300, 50), 200) for u in range(100)]
    share = 0.8 / 1.8 * (1 - 1e-9)
    fits = f"least(x.free.n - x.free.at, y.free.n - y.free.at) >= {share}D * (x.free.n + y.free.n)"
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = _pairs(spark.createDataFrame(of, "key long, u long, c long, free struct<n: long, at: long>, df long"), fits, share)
        plans = [got._jdf.queryExecution().executedPlan()]
        found = rows(got)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sorted(found) == sorted({(a, b) for a in range(1000, 1100, 2) for b in range(1001, 1100, 2)})
    joined = []
    for plan in plans:
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
        joined += [plan.metrics().get("numOutputRows").get().value()] if "Join" in plan.nodeName() else []
    assert len(joined) == 3 and min(joined) == len(found) and max(joined) <= len(found) + 100


def test_texts_are_split_once_to_lose_lines(spark):
    """The text is split once for a document, and not once for each line that stays."""
    from prismcube.llm.lines import dedup_lines

    docs = spark.createDataFrame([(1, "one line\nanother of them\none line\nthe last"), (2, "\nthe last\n"), (3, None)], "doc_id long, text string")
    found = dedup_lines(docs)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert sorted(rows(found.select("doc_id", "kept", "n_removed", "n_lines"))) == [(1, "one line\nanother of them\nthe last", 1, 4), (2, "\n", 1, 1), (3, None, 0, 0)]


@pytest.mark.parametrize("pairs", (0, 1 << 16))
def test_line_dedup_of_few_and_many_pairs(spark, documents, pairs, monkeypatch):
    """The same lines go, however what verifies the pairs is fetched."""
    from prismcube.llm import lines

    want = sorted(rows(lines.repeated_lines(documents).select("d", "th", F.sort_array("gone"))))
    monkeypatch.setattr(lines, "FEW_PAIRS", pairs)
    assert sorted(rows(lines.repeated_lines(documents).select("d", "th", F.sort_array("gone")))) == want


@pytest.mark.parametrize("few", (0, 1 << 18))
@pytest.mark.parametrize("n", (0, 1, 400))
def test_components_of_few_and_many_edges(spark, n, few, monkeypatch):
    """The same from the driver and from plans; few edges take two tables, however long a chain they are."""
    from prismcube.llm import _common

    rng, tables, stored = random.Random(n), [], _common.stored
    monkeypatch.setattr(_common, "FEW", few)
    monkeypatch.setattr(_common, "stored", lambda df: tables.append(1) or stored(df))
    edges = [(-5, 2**62), (7, 7)][:n] + [(1000 + i, 1001 + i) for i in range(n // 10)] + [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 3)]
    want = united({x for a, b in edges if a != b for x in (a, b)}, [(a, b) for a, b in edges if a != b])
    got = {r.id: r.component for r in _common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want and (len(tables) == 2 or not few)


def test_bits_rule_out_no_link(spark):
    """Pairs that the bits rule out are below the threshold, and most pairs far below it are ruled out."""
    from prismcube.llm.lines import _marks, _possible

    rng, texts, pairs = random.Random(5), [], []
    for i in range(300):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(rng.randint(2, 60))]
        other = [w if rng.random() > i / 600 else "".join(rng.choices("abcdefgh", k=4)) for w in words]
        texts += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other * (1 + i % 2)))]
        pairs.append((2 * i, 2 * i + 1))
    of = dict(texts)
    marks = _marks(spark.createDataFrame(texts, "u long, l string"))
    may = {r.a: r.may for r in _possible(spark.createDataFrame(pairs, "a long, b long"), marks, 0.8).collect()}
    like = {a: similarity(of[a], of[b]) for a, b in pairs}
    assert all(may[a] for a, x in like.items() if x >= 0.8)
    assert not any(may[a] for a, x in like.items() if x < 0.4 and len(of[a]) > 60 and a % 4 == 0)


def shuffled_bytes(spark) -> int:
    from pathlib import Path

    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(p.stat().st_size for d in dirs for p in Path(d).rglob("shuffle_*") if p.exists())


def test_shuffles_of_done_plans_are_deleted(spark, monkeypatch):
    import time

    from prismcube.llm import _common

    monkeypatch.setattr(_common, "RELEASE", 0)
    before = shuffled_bytes(spark)
    out = _common.stored(spark.range(400_000).selectExpr("id", "xxhash64(id) as h").repartition(4, "h"))
    for _ in range(100):
        if shuffled_bytes(spark) <= before + 1_000_000:
            break
        time.sleep(0.1)
    assert shuffled_bytes(spark) <= before + 1_000_000
    _common.discard(out)


def test_workers_give_freed_memory_back():
    import os
    from pathlib import Path

    from prismcube.llm._common import trimmed

    pages = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    kept = []

    def run(batches):
        made = [bytes(1000) for _ in range(300_000)]
        kept.append(made[-1])  # at the heap's end, which would hold all before it
        yield from batches

    before = pages()
    assert list(trimmed(run)([1, 2])) == [1, 2]
    assert pages() - before < 100_000_000


def test_lines_of_repeated_shingles(spark):
    from prismcube.llm.lines import drop_repeated_lines

    docs = [(i, (unit * 90)[:n] + f"\nkeep {unit} {n}") for i, (unit, n) in enumerate((u, n) for u in ("ha ", "* ") for n in (89, 149))]
    got = {r.doc_id: r.text for r in drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert "ha ha" in got[0] and "ha ha" not in got[1] and "* * *" in got[2] and "* * *" not in got[3]


# -- 4 -------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    sentencepiece = pytest.importorskip("sentencepiece")
    from prismcube.llm.sentencepiece_codec import Codec

    with open(queries.MODEL, "rb") as f:
        return Codec(f.read()), sentencepiece.SentencePieceProcessor(model_file=queries.MODEL)


ODD = ["", " ", "  ", "a", " a", "a ", "\n", "\n\na \n", "▁", "▁▁x▁", "a▁b c", "日本語テキスト🎉", "\x00\x01\x7f", "x" * 3000, "é" * 450, "ab" * 400, "</s>[INST] <s>", "a\tb\r\nc", "​�", "𝔘𝔫𝔦", "ﬁ", "1234567890" * 50]


def test_codec_is_the_library(pieces, documents):
    codec, library = pieces
    texts = ODD + [t for (t,) in rows(documents.select("text")) if t]
    slab = codec.slab(texts)
    for k, t in enumerate(texts):
        ids = library.encode(t)
        assert slab.ids(k).tolist() == ids, t[:80]
        assert codec.decode(ids) == library.decode(ids), t[:80]


def test_codec_on_random_texts(pieces):
    codec, library = pieces
    r = random.Random(5)
    letters = "aeioustrn  \n▁éß漢🎉\t" + "".join(map(chr, range(33, 48)))
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(400)]
    slab = codec.slab(texts)
    assert [slab.ids(k).tolist() for k in range(len(texts))] == [library.encode(t) for t in texts]


def test_encoding_and_decoding(spark, pieces):
    from prismcube.llm.sentencepiece_codec import decode_documents, encode_documents

    _, library = pieces
    docs = [(1, "Hello  world\n"), (2, None), (None, "x"), (2, ""), (3, "日本 🎉")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    plain = encode_documents(df, queries.MODEL)
    assert Counter((r.doc_id, tuple(r.ids), r.n_tokens) for r in plain.collect()) == Counter((i, (*library.encode(t or ""), 2), len(library.encode(t or "")) + 1) for i, t in docs)
    back = decode_documents(plain, queries.MODEL)
    assert Counter(rows(back)) == Counter((i, library.decode([*library.encode(t or ""), 2])) for i, t in docs)
    digests = encode_documents(df, queries.MODEL, digests=True)
    ids = lambda t: [*library.encode(t or ""), 2]
    assert Counter(rows(digests)) == Counter((i, len(ids(t)), sha(" ".join(map(str, ids(t)))), sha(library.decode(ids(t)))) for i, t in docs)


# -- 5, 6 ----------------------------------------------------------------------------------------------------------


def test_sketches_merge_in_any_order(spark, documents):
    from prismcube.llm.quality import measures, quantiles, rated, sketches

    m = rated(measures(documents)).cache()
    whole = quantiles(sketches(m), ["_lang"])
    parts = sketches(m.where("doc_id % 2 = 0")).unionByName(sketches(m.where("doc_id % 2 = 1")))
    parts = parts.groupBy("_lang", "_source", "rule", "bucket").agg(F.sum("n").alias("n"))
    names = ["_lang", "rule", "size", "q1", "q3"]
    by = lambda df: sorted(rows(df.groupBy("_lang", "rule", "bucket").agg(F.sum("n").alias("n"))), key=repr)
    assert by(sketches(m)) == by(parts)
    merged = lambda s: s.groupBy("_lang", "rule", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(rows(quantiles(merged(sketches(m)), ["_lang"]).select(*names)), key=repr) == sorted(rows(quantiles(merged(parts), ["_lang"]).select(*names)), key=repr)
    assert whole.count() == quantiles(merged(parts), ["_lang"]).count()


def test_repeated_words_against_brute_force(spark):
    from prismcube.llm.quality import measures

    r, docs = random.Random(8), []
    for i in range(80):
        docs.append((i, " ".join(r.choice("abc") if r.random() < 0.7 else f"w{r.randrange(40)}" for _ in range(r.randrange(0, 400)))))

    def brute(text: str) -> int:
        w = text.split()
        at = defaultdict(list)
        for k in range(len(w) - 4):
            at[tuple(w[k : k + 5])].append(k)
        return len({k + j for places in at.values() if len(places) > 1 for k in places for j in range(5)})

    df = spark.createDataFrame([(*d, None, None) for d in docs], "doc_id long, text string, lang string, source string")
    assert {x._id: x.n_repeat_words for x in measures(df).collect()} == {i: brute(t) for i, t in docs}


def test_repeated_words(spark):
    from prismcube.llm.quality import measures

    docs = [(1, "a b c d e a b c d e"), (2, "a a a a a a"), (3, "a b c d e"), (4, None), (5, "x\nx\n\ny # $"), (6, "a b c d e f a b c d e")]
    got = {r._id: (r.n_words, r.n_repeat_words, r.n_dup_lines, r.n_symbols) for r in measures(spark.createDataFrame([(*d, None, None) for d in docs], "doc_id long, text string, lang string, source string")).collect()}
    assert got == {1: (10, 10, 0, 0), 2: (6, 6, 0, 0), 3: (5, 0, 0, 0), 4: (0, 0, 0, 0), 5: (5, 0, 1, 2), 6: (11, 10, 0, 0)}


def test_chat_parts(spark):
    from prismcube.llm.chat import format_conversations, read_loss, read_turns

    kind = "array<struct<type:string,text:string,ref:string,tokens:bigint>>"
    turns = [
        (1, 0, "user", [("text", "see <|image|> and \\ <|end|>", None, None), ("image", None, "a.png", None), ("audio", None, "b.wav", 7)]), (1, 1, "assistant", [("text", "ok [/INST]", None, None)]),
        (2, 0, "user", None), (2, 1, "assistant", []), (None, None, None, [("document", None, "c.pdf", None), ("other", None, "d", None), (None, None, None, None)]),
    ]
    df = spark.createDataFrame(turns, f"conv_id long, turn long, role string, parts {kind}")
    out = {r.conv_id: r for r in format_conversations(df, parts_col="parts").select("*", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("segments")).alias("loss")).collect()}
    one = out[1]
    assert [tuple(t) for t in one.turns] == [("user", "see <|image|> and \\ <|end|><|image|><|audio|>"), ("assistant", "ok [/INST]")] and one.loss == "ok [/INST]"
    assert [(a.turn_no, a.type, a.ref, a.tokens) for a in one.attachments] == [(0, "image", "a.png", 576), (0, "audio", "b.wav", 7)] and one.n_expanded_tokens == 583
    assert one.formatted.count("<|image|>") == 1 and "".join(s.text for s in one.segments) == one.formatted
    assert [tuple(t) for t in out[2].turns] == [("user", ""), ("assistant", "")] and out[2].loss == ""
    assert [a.tokens for a in out[None].attachments] == [4096, 0, 0]


def test_chat_escapes_come_back(spark):
    from prismcube.llm.chat import CONTROL, escape, unescape

    r = random.Random(1)
    marks = [*CONTROL, "\\", "<", "|", "<\\", "[", "$1", "\n"]
    texts = ["".join(r.choice(marks) for _ in range(r.randint(0, 8))) for _ in range(300)]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("b")).collect()
    assert all(x.b == x.t and not any(c in x.e for c in CONTROL) for x in out)


# -- 9, 10 ---------------------------------------------------------------------------------------------------------


def test_language_of_held_out_texts(spark, documents):
    from prismcube.llm.langid import fit, identify_language

    out = identify_language(documents, fit(documents)).join(documents.select("doc_id", "lang", "text"), "doc_id").where("held_out and lang is not null and length(text) > 30").collect()
    assert len(out) > 20 and sum(r.lang_pred == r.lang for r in out) / len(out) > 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_language_learns_from_nothing_held_out(spark, documents):
    from prismcube.llm.langid import fit, held_out

    one, two = fit(documents), fit(documents.withColumn("lang", F.when(~held_out(), F.col("lang"))))
    assert one.langs == two.langs and np.array_equal(one.table, two.table)


def test_language_score_against_brute_force(spark, documents):
    """The score of a text, feature by feature."""
    from prismcube.llm._common import Rolling
    from prismcube.llm.langid import BUCKETS, fit, identify_language, mix

    model, rolling = fit(documents), Rolling()

    def bucket(gram: bytes) -> int:
        h = rolling.spans(rolling.prefix(rolling.bytes[np.frombuffer(gram, np.uint8)]), np.array([0]), np.array([len(gram)]))
        return int(h[0]) % BUCKETS

    def brute(text: str) -> np.ndarray:
        found = []
        for word in re.findall(rb"[a-z\x80-\xff]+", text.encode().lower() if text.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())):
            marked = b"<" + word + b">"
            whole = rolling.spans(rolling.prefix(rolling.bytes[np.frombuffer(marked, np.uint8)]), np.array([0]), np.array([len(marked)]))
            found.append(int(mix(whole)[0]) % BUCKETS)
            found += [bucket(marked[i : i + n]) for n in (1, 2, 3, 4) for i in range(len(marked) - n + 1)]
        x = (model.table[found].astype(float).mean(0) + model.bias) / model.temperature
        return np.exp(x - x.max()) / np.exp(x - x.max()).sum()

    docs = [(i, t[:300]) for i, t in rows(documents.where("length(text) > 5").select("doc_id", "text").orderBy("doc_id").limit(12))] + [(-1, "Grüße AN alle, éa 12"), (-1, "Grüße AN alle, éa 12")]
    got = identify_language(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()
    assert len(got) == len(docs)
    for r in got:
        p = brute(dict(docs)[r.doc_id])
        assert model.langs[int(p.argmax())] == r.lang_pred and math.isclose(p.max(), r.score, rel_tol=1e-4)


def test_language_without_held_back_texts(spark):
    """Too few texts to calibrate on: temperature 1, and nothing is rejected but texts without letters."""
    from prismcube.llm.langid import train

    model = train(["hello there", "guten tag"], ["en", "de"])
    assert model.temperature == 1.0 or model.reject <= 0.4
    one = train(["hello"], ["en"])
    assert (one.temperature, one.reject) == (1.0, 0.0)


def test_language_of_texts_without_letters(spark, documents):
    from prismcube.llm.langid import fit, identify_language, keep_identified

    df = spark.createDataFrame([(1, "12 34"), (2, None), (3, ""), (4, "日本語")], "doc_id long, text string")
    model = fit(documents)
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify_language(df, model).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and got[4][0] != "und"
    assert not {1, 2, 3} & {r.doc_id for r in keep_identified(df, model).collect()}
    nothing = fit(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in identify_language(df, nothing).collect()} == {"und"}


def test_scores_prefer_text_of_the_corpus(spark, documents):
    from prismcube.llm.lm_score import score_documents, train

    net = train(documents)
    mixed = documents.where("length(text) > 200").withColumn("text", F.array_join(F.shuffle(F.split("text", " ")), " "))
    real = {r.doc_id: r for r in score_documents(documents.where("length(text) > 200"), net).collect()}
    lost = {r.doc_id: r for r in score_documents(mixed, net).collect()}
    assert np.mean([real[i].mean_log_likelihood - lost[i].mean_log_likelihood for i in real]) > 0
    for r in real.values():
        assert r.log_likelihood < 0 and math.isclose(r.log_likelihood / r.n_tokens, r.mean_log_likelihood)


def test_token_probabilities_against_brute_force(spark, documents):
    """A document's score is the sum over its tokens, each from the four words around it; ties and repeated rows score alike."""
    from prismcube.llm import lm_score

    few = documents.where("length(text) between 20 and 200").limit(6)
    net = lm_score.train(documents)
    docs = rows(few.select("doc_id", "text"))
    got = Counter((r.doc_id, r.n_tokens, round(r.log_likelihood, 2)) for r in lm_score.score_documents(few.unionByName(few), net).collect())
    emb, group, member = (x.astype(float) for x in (net.emb, net.group, net.member))
    known = {r.w: r.n for r in net.shares.counts.collect()}

    def brute(text: str) -> tuple[int, float]:
        words = [int(lm_score._words(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0]) for w in re.findall(rb"[0-9a-z\x80-\xff]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()))]
        cls = [int(net.classes[w % lm_score.BUCKETS]) for w in words]
        total = 0.0
        for i, c in enumerate(cls):
            h = sum(emb[k][cls[i + o] if 0 <= i + o < len(cls) else lm_score.PAD] for k, o in enumerate(lm_score.OFFSETS))
            g, m = np.exp(h @ group[:-1] + group[-1]), member[c // lm_score.WITHIN * lm_score.WITHIN :][: lm_score.WITHIN]
            e = np.exp(m[:, :-1] @ h + m[:, -1])
            n = known[words[i] - (1 << 64) if words[i] >= 1 << 63 else words[i]]
            inside = net.shares.even[c]
            total += math.log(g[c // lm_score.WITHIN] / g.sum() * e[c % lm_score.WITHIN] / e.sum()) + math.log(n + inside) - net.shares.total[c]
        return len(words), total

    want = {i: brute(t) for i, t in docs}
    assert sum(got.values()) == 2 * len(docs) and all(k == 2 for k in got.values())
    for i, n, s in got:
        assert n == want[i][0] and abs(s - want[i][1]) < 0.02 + 1e-4 * abs(s)


def test_probabilities_sum_to_one():
    from prismcube.llm.lm_score import PAD, VOCABULARY, WindowNetwork

    net = WindowNetwork.start({})
    context = np.full((4, VOCABULARY), PAD)
    context[:] = np.array([3, 5, 8, 13])[:, None]
    assert math.isclose(np.exp(net.log_probabilities(np.arange(VOCABULARY), context)).sum(), 1, rel_tol=1e-4)


def test_scores_tell_words_of_one_class_apart(spark, monkeypatch):
    from prismcube.llm import lm_score

    monkeypatch.setattr(lm_score, "HOT", 300)  # so that some words are joined
    rng = random.Random(1)
    words = [f"w{i}x" for i in range(3000)]
    texts = [" ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=60)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    net = lm_score.train(df)
    counts, spread = Counter(" ".join(texts).split()), {}
    for w in [*counts, "neverseen", "alsonot"]:
        raw = np.frombuffer(w.encode(), np.uint8)
        spread[w] = int(lm_score._words(raw, np.array([0, len(raw)]))[0][0])
    of = {w: int(net.classes[h % lm_score.BUCKETS]) for w, h in spread.items()}
    got = {r.text: r.log_likelihood for r in lm_score.score_documents(spark.createDataFrame([(w, w) for w in spread], "doc_id string, text string"), net).withColumnRenamed("doc_id", "text").collect()}
    pad = np.full((4, 1), lm_score.PAD)
    for w, c in of.items():
        n, t = sum(k for v, k in counts.items() if of[v] == c), sum(of[v] == c for v in counts) + 1
        even = t / (int((net.classes == c).sum()) * 2.0**48)
        want = net.log_probabilities(np.array([c]), pad)[0] + math.log((counts[w] + even) / (n + t))
        assert math.isclose(got[w], want, rel_tol=1e-4), w
    assert max(got["neverseen"], got["alsonot"]) < min(got[w] for w in counts)


# -- awkward rows --------------------------------------------------------------------------------------------------


def runs(spark):
    from prismcube.llm import chat, decontaminate, langid, lines, lm_score, minhash, quality, repeats, sentencepiece_codec

    bench = spark.createDataFrame([(1, "four five six"), (2, None)], "item_id long, text string")
    return {
        "1": lambda d: repeats.substring_dedup(d), "2": lambda d: decontaminate.scan_contamination(d, bench), "2 remove": lambda d: decontaminate.remove_contamination(d, bench),
        "3": lambda d: minhash.near_duplicate_classes(d), "3 drop": lambda d: minhash.drop_near_duplicates(d), "4": lambda d: sentencepiece_codec.encode_documents(d, queries.MODEL), "5": lambda d: quality.verdicts(d),
        "6": lambda d: chat.format_conversations(d, id_col="doc_id", turn_col="n_chars", role_col="lang"), "7": lambda d: repeats.suffix_array_dedup(d), "8": lambda d: lines.dedup_lines(d),
        "8 drop": lambda d: lines.drop_repeated_lines(d), "9": lambda d: langid.identify_language(d, langid.fit(d)), "9 keep": lambda d: langid.keep_identified(d, langid.fit(d)),
        "10": lambda d: lm_score.score_documents(d, lm_score.train(d)),
    }


NAMES = ("1", "2", "2 remove", "3", "3 drop", "4", "5", "6", "7", "8", "8 drop", "9", "9 keep", "10")


#: What the awkward rows give, by (id, text): None stands for a null id.
TEXTS = [(i, t) for i, t, *_ in AWKWARD]
EXPECTED = {
    "1": lambda r: (r.doc_id, r.n_words, r.n_removed, r.kept), "2": lambda r: (r.doc_id, r.n_words, r.n_hit, r["items"]), "3": lambda r: (r.doc_id, r.class_id, r.class_size), "4": lambda r: (r.doc_id, r.n_tokens),
    "5": lambda r: (r.doc_id, r.n_words, r.base_failed), "7": lambda r: (r.doc_id, r.n_bytes, r.n_removed), "8": lambda r: (r.doc_id, r.n_lines, r.n_removed), "10": lambda r: (r.doc_id, r.n_tokens),
}
LINES = {5: (1, 1)}  # equal to the line of document 1


def expected(name: str, pieces=None) -> list[tuple]:
    plain = [len(re.findall(r"[^ \t-\r]+", t or "")) for _, t in TEXTS]
    letters = [len(re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t or "")) for _, t in TEXTS]
    if name == "1":
        gone = {7: 29_999}  # every window but the first starts earlier as well
        return [(i, n, gone.get(i, 0), " ".join(re.findall(r"[^ \t-\r]+", t or "")[: n - gone.get(i, 0)])) for (i, t), n in zip(TEXTS, plain, strict=True)]
    if name == "2":
        return [(i, n, 3 * (i in (1, 5)), ["1"] if i in (1, 5) else []) for (i, _), n in zip(TEXTS, letters, strict=True)]
    if name == "3":
        classes = {1: (1, 3), 5: (1, 3), 2: (2, 3), 3: (2, 3), 4: (2, 3), 8: (8, 1)}
        return [(i, *classes.get(i, (i, 1))) for i, _ in TEXTS]
    if name == "4":
        return [(i, len(pieces.encode(t or "")) + 1) for i, t in TEXTS]
    if name == "5":
        return [(i, n, n < 10 or i == 7) for (i, _), n in zip(TEXTS, plain, strict=True)]
    if name == "7":
        gone = {7: 59_998, 8: 49_999}
        return [(i, len((t or "").encode()), gone.get(i, 0)) for i, t in TEXTS]
    if name == "8":
        lines = [sum(bool(x.strip(" \t\r\f\x0b")) for x in (t or "").split("\n")) for _, t in TEXTS]
        return [(i, n, LINES[i][1] if i in LINES else 0) for (i, _), n in zip(TEXTS, lines, strict=True)]
    return [(i, n) for (i, _), n in zip(TEXTS, letters, strict=True)]


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(spark, awkward, name):
    out = runs(spark)[name](awkward)
    found = out.collect()
    assert len(found) == awkward.count() if " " not in name and name != "6" else 0 < len(found) <= awkward.count()
    if " " in name:
        assert out.columns == awkward.columns
    if name in EXPECTED:
        pieces = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=queries.MODEL) if name == "4" else None
        assert Counter(map(repr, map(EXPECTED[name], found))) == Counter(map(repr, expected(name, pieces)))
    ids = Counter(r.doc_id for r in found) if " " in name else {}
    if name == "2 remove":  # the contaminated go
        assert ids == Counter(i for i, _ in TEXTS if i not in (1, 5))
    if name == "3 drop":  # one of each class stays; rows of one id share a decision
        assert ids == Counter({1: 1, None: 1, 2: 1, 6: 1, 7: 1, 8: 1, 9: 1})
    if name == "8 drop":
        assert ids == Counter(i for i, _ in TEXTS if i != 5)
    if name == "9 keep":
        assert not set(ids) & {2, 3, 4, 9}
    if name == "9":
        assert {r.doc_id: (r.lang_pred, r.score) for r in found if r.doc_id in (2, 3, 4, 9)} == {i: ("und", 0.0) for i in (2, 3, 4, 9)}


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty, name):
    out = runs(spark)[name](empty)
    assert out.count() == 0


def test_every_operator_is_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]


def test_lines_texts_are_kept_without_moving_all_lines(spark):
    """Every line of the nodes asked for has its text, few others have, and the plan has no exchange of lines."""
    from prismcube.llm import _common, lines

    docs = spark.range(20000).selectExpr("id as doc_id", "concat('line number ', id, '\\nsecond ', id % 7) as text")
    found = lines.lines_of(docs, "doc_id", "text")
    asked = found.where("d % 100 = 0").select("k1", "k2").distinct().withColumn("u", F.monotonically_increasing_id())
    kept = lines._kept_texts(found, asked)
    assert "hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
    want = {tuple(r) for r in found.join(asked, ["k1", "k2"]).select("d", "pos", "l").collect()}
    got = {tuple(r) for r in kept.where("l is not null").select("d", "pos", "l").collect()}
    assert kept.count() == 40000 and len(want) == 200 + 20000
    assert want <= got and len(got - want) < 40000 // lines.BITS
    assert lines._kept_texts(found, asked.where("false")).where("l is not null").count() == 0
    keys = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "key long, u long")
    assert {tuple(r) for r in _common.met_keys(keys).select("key", "u").collect()} == {(1, 1), (1, 2)}
