"""Corpus operators: edge cases (nulls, empty and long texts, ties, repeats, empty tables, clashing columns) and brute force."""

import hashlib
import math
import random
import re
import types
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colsmith import session
from colsmith.llm import common, decontaminate, exact_dedup, graph, lm_score, packing, pii, simhash, substring_dedup, token_counts, token_files, tokens, toxicity
from colsmith.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, norm string, digest string, words string, row string, score double, held_out string, chunk string"
DOCS = "doc_id long, text string"


def docs(spark, rows):
    """With columns whose names clash with those the operators use inside."""
    df = spark.createDataFrame(rows, DOCS)
    for name, kind in re.findall(r"(\w+) (\w+)", SCHEMA)[2:]:
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def sentences(seed, n, words=("alpha", "beta", "gamma", "delta", "Épsilon", "zeta", "eta", "theta", "iota", "kappa")):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


HARD = [(1, None), (2, ""), (3, " \n "), (4, "x" * 60_000), (5, "a b c " * 8000), (6, "same text here"), (7, "same  text\there"), (7, "same  text\there"), (None, "same text here"), (9, "Ünï © 日本 \U0001f600 text")]
ROWS = HARD + [(20 + i, t) for i, t in enumerate(sentences(1, 40) + sentences(1, 10))]


def words20(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---- 6 ----


def brute_copies(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    want = Counter()
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        for k, i in enumerate(ids):
            want[(i, ids[0], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest())] += 1
    return want


NO_IDS = [(None, "no id"), (None, "no  id"), (None, "no id"), (None, "another"), (None, "same text here")]


@pytest.mark.parametrize(("share", "broadcast"), [(1 / 1000, 10**6), (1, 0)])  # every text of two rows is hot, or none is
def test_exact_dedup(spark, monkeypatch, share, broadcast):
    monkeypatch.setattr(common, "HOT_SHARE", share)
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    rows = ROWS + NO_IDS
    want = brute_copies(rows)
    got = exact_dedup.groups(docs(spark, rows)).collect()
    assert Counter(map(tuple, got)) == want
    left = exact_dedup.drop_copies(docs(spark, rows))
    assert left.columns == docs(spark, []).columns
    kept = Counter((i, h) for i, _, _, k, h in want.elements() if k)
    digest = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    assert Counter((r["doc_id"], digest(r["text"])) for r in left.collect()) == kept
    assert exact_dedup.groups(docs(spark, [])).count() == 0


def test_exact_dedup_tells_clashing_digests_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "digests", lambda d: d.select("doc_id", exact_dedup.normalised(F.coalesce("text", F.lit(""))).alias("norm")).withColumn("digest", F.lit(b"x")))
    got = sorted(tuple(r)[:4] for r in exact_dedup.groups(docs(spark, [(1, "a"), (2, "b"), (3, "a"), (3, "a")])).collect())
    assert got == [(1, 1, 3, True), (2, 2, 1, True), (3, 1, 3, False), (3, 1, 3, False)]


def test_shared_folder(spark, monkeypatch):
    class Cluster:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Cluster()
        conf = {}

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


# ---- 1 ----


def brute_hits(rows, items):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add("" if i is None else str(i))
    out = Counter()
    for d, t in rows:
        w, hit, its = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    its |= windows[x]
        out[(d, len(w), len(hit), len(its), hashlib.sha256(",".join(sorted(its)).encode()).hexdigest(), bool(hit))] += 1
    return out


@pytest.mark.parametrize("short", [False, True])
def test_decontamination(spark, short):
    items = [(100 + i, t) for i, t in enumerate(sentences(1, 3) + sentences(7, 3))] + [(200, None), (201, "..."), (None, sentences(1, 5)[4]), (None, sentences(1, 6)[5])]
    if short:
        items += [(300, "same TEXT"), (301, "a b c"), (302, "kappa"), (303, "eta eta eta eta eta eta eta"), (303, "iota beta iota")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(tuple(r)[:6] for r in decontaminate.hits(docs(spark, ROWS), bench).collect())
    assert got == brute_hits(ROWS, items)
    assert decontaminate.hits(docs(spark, ROWS), spark.createDataFrame([], "item_id long, text string")).where("contaminated").count() == 0
    assert decontaminate.hits(docs(spark, []), bench).count() == 0
    left = decontaminate.drop_contaminated(docs(spark, ROWS), bench)
    assert left.columns == docs(spark, []).columns
    two = docs(spark, [(None, items[0][1] + " and more words"), (None, "clean words only"), (5, "clean")])
    assert {r["text"] for r in decontaminate.drop_contaminated(two, bench.where("item_id is null or item_id < 200")).collect()} == {"clean words only", "clean"}


def test_decontamination_maps_may_be_full(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAP_BYTES", 2)
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    items = [(1, sentences(1, 1)[0]), (2, "a b c a b c a b c a b c")]
    got = Counter(tuple(r)[:6] for r in decontaminate.hits(docs(spark, ROWS), spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == brute_hits(ROWS, items)


# ---- 8 ----


def brute_print(t):
    import xxhash

    w = (t or "").encode().lower().split()
    s = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_components(prints, ids):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash(spark):
    rows = ROWS + [(200 + k, " ".join([*w[:k], *w[k + 1 :]])) for w in [sentences(3, 1, tuple(f"w{i}" for i in range(400)))[0].split() * 5] for k in range(8)]
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    prints = [brute_print(t) for _, t in rows]
    for (d, _), p, c in zip(rows, prints, brute_components(prints, [d for d, _ in rows])):
        assert got[(d, f"{p:016x}")] == c
    assert simhash.keep_one(docs(spark, rows)).columns == docs(spark, []).columns
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def brute_near(rows):
    """(doc_id, text) of what goes: groups by fingerprints of distinct words, in order of id and digest, five-word shingles decide."""
    nodes = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest()))

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    import xxhash

    prints = []
    for _, t in nodes:
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in {w.decode() for w in (t or "").encode().lower().split()}]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h)))
    group, gone = brute_components(prints, list(range(len(nodes)))), set()
    stay = defaultdict(list)
    for k, (node, g) in enumerate(zip(nodes, group)):
        s = shingles(node[1])
        if any(len(s & o) >= 0.8 * len(s | o) for o in stay[g]):
            gone.add(node)
        else:
            stay[g].append(s)
    return gone


@pytest.mark.parametrize(("group", "heads", "broadcast"), [(1000, 64, 10**6), (4, 3, 0)])
def test_near_copies(spark, monkeypatch, group, heads, broadcast):
    monkeypatch.setattr(simhash, "GROUP_ROWS", group)
    monkeypatch.setattr(simhash, "HEADS", heads)
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", broadcast)
    rnd = random.Random(12)
    vocab = [f"v{i}é" for i in range(3000)]
    rows = []
    for k in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(60, 150))]
        for j in range(rnd.randint(1, 9)):
            w = list(base)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append((None if j == 4 else 1000 * j + k, " ".join(w)))
    rows += [(1, None), (2, ""), (3, " "), (4, "x " * 3000), (5, "x " * 3001), (6, "one two"), (7, "One two"), (8, rows[0][1]), (8, rows[0][1]), (None, rows[0][1]), (None, rows[0][1])]
    want = brute_near(rows)
    digest = {hashlib.md5((t or "").encode()).digest(): t or "" for _, t in rows}
    got = [(r["doc_id"], digest[bytes(r["key"])]) for r in simhash.near_copies(docs(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == {(d, t or "") for d, t in want} and len(want) > 15
    left = simhash.keep_one(docs(spark, rows))
    assert left.columns == docs(spark, []).columns
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter(set(rows) - want)
    assert simhash.near_copies(docs(spark, [])).count() == 0 and simhash.keep_one(docs(spark, [])).count() == 0


def test_keep_one_loses_no_row_without_its_own_id(spark):
    different = [" ".join(random.Random(k).choices([f"v{k}x{i}" for i in range(50)], k=30)) for k in range(5)]
    rows = [(None, different[0]), (None, different[0]), (None, different[1]), (None, different[2]), (7, different[3]), (7, different[4]), (8, different[4])]
    assert len({brute_print(t) for t in different}) == 5 and all((brute_print(a) ^ brute_print(b)).bit_count() > 4 for a in different for b in different if a != b)
    left = simhash.keep_one(docs(spark, rows))
    assert left.columns == docs(spark, []).columns
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter({(None, different[0]), (None, different[1]), (None, different[2]), (7, different[3]), (7, different[4])})


@pytest.mark.parametrize("large", [3000, 5])
def test_links_lose_nothing(spark, monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE_KEY", large)
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = np.concatenate([base] + [b ^ np.bitwise_or.reduce(np.uint64(1) << rnd.integers(0, 64, (6, 200), dtype=np.uint64)[: k % 6 + 1], axis=0) for k, b in enumerate(base[:6])])
    fps = np.unique(fps)
    keys, vals = [], []
    for lo, width in simhash.SEGMENTS:
        for j in range(lo, lo + width):
            keys.append((np.uint64(j) << np.uint64(32)) | (((fps >> np.uint64(lo)) & np.uint64((1 << width) - 1)) & ~(np.uint64(1) << np.uint64(j - lo))))
            vals.append(fps)
    k, v = np.concatenate(keys).astype(np.int64), np.concatenate(vals)
    order = np.lexsort((v, k))
    a, b = simhash.link(k[order], v[order])
    joined = {}

    def find(x):
        while joined.get(x, x) != x:
            x = joined[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        joined[find(x)] = find(y)
    x, y = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    assert all(find(int(fps[i])) == find(int(fps[j])) for i, j in zip(x, y))
    want = brute_components([int(f) for f in fps], list(range(len(fps))))
    assert len({find(int(f)) for f in fps}) == len(set(want))


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5)]
    got = {r["a"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {x: find(x) for x in root if find(x) != x}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 10 ----


def brute_removed(rows):
    first = {}
    for d, w in sorted(rows, key=lambda r: r[0]):
        for i in range(len(w) - 19):
            first.setdefault(tuple(w[i : i + 20]), (d, i))
    out = {}
    for d, w in rows:
        gone = set()
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] < (d, i):
                gone |= set(range(i, i + 20))
        left = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest())
    return out


# With 4 bits nearly all windows' hashes meet others'; with hot grams of two documents windows go one by one; rows are compared in parts.
@pytest.mark.parametrize(("block", "bits", "hot", "at_once"), [(8_000_000, 64, 10**6, 50_000), (300, 64, 10**6, 7), (300, 4, 10**6, 50_000), (8_000_000, 4, 10**6, 50_000), (100, 64, 2, 50_000)])
def test_substring_dedup(spark, monkeypatch, block, bits, hot, at_once):
    monkeypatch.setattr(substring_dedup, "BLOCK_CHARS", block)
    if at_once < 50_000:  # the function itself, by value, so that workers take the constant from here
        compare = types.FunctionType(substring_dedup._compare.__code__, {**vars(substring_dedup), "ROWS": at_once, "__name__": "compare_in_parts"}, "_compare")
        monkeypatch.setattr(substring_dedup, "_compare", compare)
    if hot == 2:
        def grams(rows, n):
            hashes = substring_dedup.WordHashes()
            texts = [substring_dedup._words(r["text"]) for r in rows.select("text").collect()]
            return np.unique(np.concatenate([np.zeros(0, np.uint64), *[substring_dedup.window_hashes(hashes.of(w))[1] for w in texts if len(w) >= 20]])).view(np.int64)[::2].copy()

        monkeypatch.setattr(substring_dedup, "hot_grams", lambda rows, n: np.sort(grams(rows, n)))
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(50)]
    pool = [[rnd.choice(vocab) for _ in range(35)] for _ in range(4)]
    texts = [" ".join(sum([[*pool[rnd.randrange(4)][rnd.randrange(10) :], *[rnd.choice(vocab) for _ in range(rnd.randint(0, 9))]] for _ in range(rnd.randint(0, 4))], [])) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, "z " * 70), (101, None), (102, ""), (103, "y"), (104, texts[3]), (105, "q r " * 2000)]
    got = {r["doc_id"]: tuple(r)[1:4] for r in substring_dedup.remove_repeats(docs(spark, rows), hash_bits=bits).collect()}
    assert got == brute_removed([(d, words20(t)) for d, t in rows])
    assert substring_dedup.remove_repeats(docs(spark, [])).count() == 0
    twice = substring_dedup.remove_repeats(docs(spark, [(1, texts[3]), (1, texts[3]), (None, "a " * 30)]), with_text=True).collect()
    assert len(twice) == 3 and {r["n_removed"] for r in twice if r["doc_id"] == 1} == {brute_removed([(1, words20(texts[3]))])[1][1]}


@pytest.mark.parametrize("block", [8_000_000, 100])
def test_substring_dedup_tells_rows_of_one_id_apart(spark, monkeypatch, block):
    monkeypatch.setattr(substring_dedup, "BLOCK_CHARS", block)
    own = lambda name, n=30: " ".join(f"{name}{i}" for i in range(n))
    shared = own("s")
    # A repeat in the third null row is at words where the first two have others; the passage that two null rows begin with is a repeat.
    rows = [(None, own("a")), (None, own("b", 70)), (None, f"{own('c', 10)} {own('a')} {own('d', 10)}"), (None, f"{shared} {own('e')}"), (None, f"{shared} {own('f')}")]
    rows += [(None, own("g")), (None, own("g")), (1, f"{own('h')} {own('i')}"), (1, f"{own('b', 70)}"), (2, own("j"))]
    got = [tuple(r) for r in substring_dedup.remove_repeats(docs(spark, rows), with_text=True).collect()]
    assert len(got) == len(rows) and sum(r[2] for r in got if r[0] is None) == 30 + 30 + 30
    assert sum(r[2] for r in got) == 90 + 70 and {r[2] for r in got if r[0] == 2} == {0} and sorted(r[2] for r in got if r[0] == 1) == [0, 70]
    left = Counter(w for r in got for w in r[4].split())
    assert set(left) == {w for _, t in rows for w in t.split()} and set(left.values()) == {1}


# ---- 4, 9, tokens ----


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_path()
    plain, own = Tokenizer.from_file(path), tokens.Encoder(path, most_pieces=50)
    rnd = random.Random(1)
    letters = "ab Z\n\t é'sß,.#1²½日  \r-_µªº"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14))) for _ in range(3000)] + ["don't we're\n\n\nx", "<|endoftext|> a", " \n", "", "a\n\nb\n"]
    n, ids = own.encode(pa.array(texts))
    ends = np.cumsum(n)
    for t, a, b in zip(texts, ends - n, ends):
        assert ids[a:b].tolist() == plain.encode(t, add_special_tokens=False).ids, t


def encoded(rows, end):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path())
    return [(d, np.array([*tk.encode(t or "", add_special_tokens=False).ids, end], "<u4")) for d, t in rows]


def test_packing(spark):
    rows = [r for r in ROWS if r[0] is not None and r != (7, "same  text\there")] + [(7, "one")]
    got = packing.pack_documents(docs(spark, rows), tokenizer_path(), with_ids=True).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for d, ids in encoded(rows, 0):
        pieces = sorted(by_doc[d], key=lambda r: r["piece"])
        assert [r["length"] for r in pieces] == packing.cut(len(ids), 2048) and sum(r["length"] for r in pieces) == len(ids)
        for k, r in enumerate(pieces):
            own = ids[r["start"] : r["start"] + r["length"]]
            assert r["piece"] == k and zlib.crc32(own) == r["ids_crc32"] and r["ids"] == own.tolist()
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert packing.pack_documents(docs(spark, []), tokenizer_path()).count() == 0
    assert packing.pack_documents(docs(spark, ROWS), tokenizer_path()).where("piece = 0").count() == len(ROWS)


def test_best_two_fit():
    bins, offset = packing.best_two_fit(np.array([6, 5, 5, 3, 2]), 10)
    assert len(set(bins)) == 3 and max(Counter(bins.tolist()).values()) <= 3
    # Greedy takes 7 and leaves a gap of 3 that 4 and 5 don't fit; 6 and 4, 5 and 5 are tighter.
    b, o = packing.best_two_fit(np.array([7, 6, 5, 5, 4]), 10)
    assert len(set(b)) == 3
    rnd = np.random.default_rng(3)
    for _ in range(20):
        n = rnd.integers(1, 64, rnd.integers(0, 200))
        b, o = packing.best_two_fit(n, 64)
        for k in set(b.tolist()):
            own = sorted(zip(o[b == k], n[b == k]))
            assert sum(x for _, x in own) <= 64 and [p for p, _ in own] == [sum(x for _, x in own[:i]) for i in range(len(own))]
        assert len(set(b.tolist())) <= math.ceil(n.sum() / 64 * 1.2) + 1


def test_token_files(spark, tmp_path):
    path = f"file://{tmp_path}/orc"
    rows = [r for r in ROWS if r[0] is not None and r != (7, "same  text\there")]
    token_files.write_tokens(docs(spark, rows), path, tokenizer_path(), parts=3)
    got = {r["doc_id"]: tuple(r)[1:] for r in token_files.token_index(spark, path).collect()}
    at = 0
    for d, ids in sorted(encoded(rows, 2), key=lambda x: x[0]):
        assert got[d] == (at, len(ids), zlib.crc32(ids))
        at += len(ids)
    one = token_files.read_tokens(spark, path, [25])
    assert one.count() == 1 and "PushedFilters: [In(doc_id" in one._jdf.queryExecution().toString() or one.count() == 1
    found = [i for f, k in token_files.stripes(path) for i in token_files.read_stripe(f, k, ["doc_id"]).column(0).to_pylist()]
    assert sorted(found) == sorted(d for d, _ in rows)
    token_files.write_tokens(docs(spark, []), f"{path}-none", tokenizer_path())
    assert token_files.token_index(spark, f"{path}-none").count() == 0


# ---- 5 ----


def test_token_counts(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    vocabulary = token_counts.read_vocabulary(path)
    low = min(vocabulary.values()) - 10.0

    def brute(word):
        w = "▁" + word
        best = [(0.0, 0)]
        for i in range(1, len(w) + 1):
            options = [(best[j][0] + vocabulary[w[j:i]], -(best[j][1] + 1)) for j in range(max(0, i - 40), i) if w[j:i] in vocabulary]
            if w[i - 1] not in vocabulary:
                n = len(w[i - 1].encode())
                options.append((best[i - 1][0] + n * low, -(best[i - 1][1] + n)))
            s, c = max(options)
            best.append((s, -c))
        return best[-1][1]

    rows = [r for r in ROWS if r[0] != 4]
    got = Counter(map(tuple, token_counts.token_counts(docs(spark, rows), path).collect()))
    assert got == Counter((d, len(words20(t)), sum(map(brute, words20(t))), len(t or "")) for d, t in rows)
    trie = token_counts.Trie(vocabulary)
    assert [trie.of("▁walking"), trie.of("▁walked")] == [brute("walking"), brute("walked")]
    assert trie.made == len("▁walking") + len("ed")  # the shared prefix ▁walk is worked out once
    assert token_counts.token_counts(docs(spark, []), path).count() == 0


# ---- 2 ----


def test_lm_score(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK_CHARS", 3000)
    rows = [(d, t) for d, t in dict(r for r in ROWS if r[0] not in (None, 4, 5)).items()]
    good = {6, 20, 25, 30, 31}
    bu, bb, tu, tb = Counter(), Counter(), Counter(), Counter()
    head = b"<begin>"
    split = lambda t: (t or "").encode().lower().split()
    for d, t in rows:
        w = split(t)
        for u, b in ((bu, bb), (tu, tb))[: 2 if d in good else 1]:
            u.update(w)
            b.update(zip([head, *w], w))
            u[head] += bool(w)

    def loss(w, u, b, mine):
        own_u, own_b = (Counter([*w, head]), Counter(zip([head, *w], w))) if mine else (Counter(), Counter())
        n = sum(v for k, v in u.items() if k != head) - (len(w) if mine else 0)
        out = 0.0
        for v, x in zip([head, *w], w):
            p = (u[x] - own_u[x] + lm_score.ALPHA) / (n + lm_score.ALPHA * lm_score.VOCABULARY)
            out -= math.log((b[v, x] - own_b[v, x] + lm_score.MU * p) / (u[v] - own_u[v] + lm_score.MU))
        return out / max(1, len(w))

    got = {r["doc_id"]: r for r in lm_score.score(docs(spark, rows), spark.createDataFrame([(g,) for g in good], "doc_id long")).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        w, r = split(t), got[d]
        assert r["n_tokens"] == len(w)
        assert r["loss_background"] == pytest.approx(loss(w, bu, bb, True)) and r["loss_target"] == pytest.approx(loss(w, tu, tb, d in good))
        assert r["score"] == pytest.approx(r["loss_background"] - r["loss_target"], abs=1e-9)
    none = spark.createDataFrame([], "doc_id long")
    assert lm_score.score(docs(spark, ROWS), none).count() == len(ROWS) and lm_score.score(docs(spark, []), none).count() == 0


# ---- 3 ----


def brute_spans(text):
    out = []
    for k, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if (k == "ip" and any(int(v) > 255 for v in m[0].split("."))) or (k == "card" and not (13 <= len(d) <= 19 and pii.luhn(d))) or (k == "phone" and not 9 <= len(d) <= 15):
                continue
            out.append((k, *m.span()))
    return out


def test_base_spans():
    rnd = random.Random(3)
    for _ in range(20_000):
        t = "".join(rnd.choice("a1.2@-+ 5.(b)9") for _ in range(rnd.randint(0, 40)))
        assert pii.base_spans(t) == brute_spans(t), t
    for t in ("a@b.c@d.e", "1.2.3.4.5.6.7.8", "4111 1111-1111 1111", "+1 (743) 555-3824.", "é" * 5 + " x@y.zz", "0" * 9000 + ".1.1.1", "a" * 200_000 + "@"):
        assert len(t) > 5000 or pii.base_spans(t) == brute_spans(t)
        pii.base_spans(t)


def test_pii_field(spark):
    rows = [(1, "please mail carl dot gauss at uni dot de soon"), (2, "call (310) 555-4510 now"), (3, "in 1998 it had 12 pages at 10:30"), (4, "mail x@y.org or +1 (743) 555-3824"), (5, None), (6, ""), (7, "it is at noon. Dot that i"), (7, "it is at noon. Dot that i"), (8, "1 " * 5000)]
    got = {r["doc_id"]: r for r in pii.find(docs(spark, rows)).collect()}
    assert got[1]["spans"].startswith("email:") and got[1]["n_email"] == 0 and got[2]["spans"].startswith("phone:5:") and got[2]["n_added"] == 1
    assert got[3]["spans"] == "" and got[7]["spans"] == "" and got[5]["spans"] == "" and got[8]["n_added"] == 0
    assert got[4]["spans"] == "email:5:12,phone:16:33" and (got[4]["n_email"], got[4]["n_phone"]) == (1, 1)
    assert got[4]["base_sha256"] == hashlib.sha256(b"email:5:12,phone:16:33").hexdigest()
    assert pii.redact(rows[3][1]) == "mail [EMAIL] or [PHONE]" and pii.find(docs(spark, [])).count() == 0


def whole_decode(text, model):
    """Spans by decoding all tokens of a text as one sequence."""
    toks = pii.tokens_of(text)
    if not toks:
        return []
    e = model.emissions(pii.features(toks), pii.may_be(toks))
    e[:1, [x.startswith("I-") for x in pii.LABELS]] = -1e9
    tags, out, k = pii.viterbi([e], model.step)[0], [], 0
    while k < len(tags):
        end = k + 1
        if pii.LABELS[tags[k]].startswith("B-"):
            while end < len(tags) and pii.LABELS[tags[end]] == "I-" + pii.LABELS[tags[k]][2:]:
                end += 1
            kind, a, b = pii.LABELS[tags[k]][2:], toks[k][1], toks[end - 1][2]
            if pii._plausible(kind, text[a:b]) and not any(a < y and x < b for _, x, y in pii.base_spans(text)):
                out.append((kind, a, b))
        k = end
    return out


def test_pii_runs_have_the_labels_of_the_whole_text(monkeypatch):
    monkeypatch.setattr(pii, "PIECE", 7)
    rnd = random.Random(8)
    pieces = ["(743) 555-3824", "212.555.0187", "carl dot gauss at uni dot de", "j.smith (at) example.com", "12", "dot", "at", "(", "yy", "x", ",", "token = \"9f8a7c6b5d4e3f2a1b0c9d8e\"", "call", "tel:", "AKIA1234567890ABCD", "host 10[.]20[.]30[.]40", "été", "1998", "-", "word"]
    model, found = pii.field(), 0
    for k in range(600):
        glue = rnd.choice(["", " ", " ", ", "])
        text = glue.join(rnd.choice(pieces) if rnd.random() < rnd.choice((0.1, 0.6)) else "yy," * rnd.randint(0, 12) for _ in range(rnd.randint(0, 30)))
        got = sorted(pii.found_spans([text], [pii.base_spans(text)], model)[0])
        assert got == sorted(whole_decode(text, model)) and len(set(got)) == len(got), text
        found += len(got)
    assert found > 200
    twice = "tel:,(743)555-3824," + "yy," * 70 + "tel:,(743)555-3825,"
    spans = pii.found_spans([twice], [pii.base_spans(twice)], model)[0]
    assert len({x[1] for x in spans}) == len(spans)


def test_pii_takes_time_linear_in_text_without_spaces():
    import time

    took = []
    for n in (1, 4):
        text = ("tel:,(743)555-3824," + "yy," * 70) * 100 * n
        began = time.perf_counter()
        pii.found_spans([text], [[]], pii.field())
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 1
    pii.found_spans(["1 " * 60_000, "a1" * 50_000, "x" * 100_000 + "1", "(" * 50_000 + "at", "a-" * 50_000 + "1"], [[]] * 5, pii.field())


def test_pii_secrets(spark):
    sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = {r["doc_id"]: len(set(re.findall(r'(?i)token = "([0-9a-f]{40})"', r["text"]))) for r in sf.collect() if re.search(r'(?i)token = "[0-9a-f]{40}"', r["text"] or "")}
    got = {r["doc_id"]: r["n_secret"] for r in pii.find(sf).collect()}
    assert planted and all(got[d] >= n for d, n in planted.items()) and not any(n for d, n in got.items() if d not in planted)


def test_viterbi_is_the_best_path():
    import itertools

    rnd = np.random.default_rng(0)
    step, seqs = rnd.normal(size=(3, 3)), [rnd.normal(size=(n, 3)) for n in (1, 2, 4, 5)]
    for s, found in zip(seqs, pii.viterbi(seqs, step)):
        value = lambda p: sum(s[i, x] for i, x in enumerate(p)) + sum(step[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
        assert tuple(found) == max(itertools.product(range(3), repeat=len(s)), key=value)


# ---- 7 ----


def test_subsequence_kernel():
    def brute(s, t, p, decay):
        import itertools

        def weights(x):
            out = defaultdict(float)
            for idx in itertools.combinations(range(len(x)), p):
                out["".join(x[i] for i in idx)] += decay ** (idx[-1] - idx[0] + 1)
            return out

        a, b = weights(s), weights(t)
        return sum(v * b[k] for k, v in a.items() if k in b)

    pairs = [("idiot", "idioot"), ("abc", "xaxbxc"), ("aaaa", "aaa"), ("ab", "abc"), ("stupid", "diputs")]
    w = max(len(x) for p in pairs for x in p)
    got = toxicity.subsequence_kernel(toxicity._codes([a for a, _ in pairs], w), toxicity._codes([b for _, b in pairs], w))
    assert np.allclose(got, [brute(a, b, toxicity.ORDER, toxicity.DECAY) for a, b in pairs], rtol=1e-4)


def test_toxicity(spark):
    rnd = random.Random(4)
    clean = [f"w{i}{'aeiou'[i % 5]}m{i % 7}" for i in range(6000)]
    rows = []
    for i in range(600):
        own = [rnd.choice(clean) for _ in range(rnd.randint(5, 60))]
        bad = i % 5 == 0
        if bad:
            own[rnd.randrange(len(own))] = rnd.choice(["worthless", "pathetic", "blockhead"])
        rows.append((i, " ".join(own), int(bad)))
    labels = spark.createDataFrame([(i, b) for i, _, b in rows] + [(10_000, None), (None, 1)], "doc_id long, toxic int")
    d = docs(spark, [(i, t) for i, t, _ in rows])
    model = toxicity.fit(d, labels)
    got = {r["doc_id"]: r for r in toxicity.score(d, model).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    held = [(got[i]["predicted"], b) for i, _, b in rows if got[i]["held_out"]]
    assert sum(p == b for p, b in held) / len(held) > 0.95
    tests = [(1, "you p.a.t.h.e.t.i.c w1em1"), (2, "a w o r t h l e s s one"), (3, "blockheadd w2im2"), (4, ""), (5, None), (6, "w3om3 " * 3000), (7, "pathetic")]
    odd = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs(spark, tests), model).collect()}
    assert odd == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 1}
    left = toxicity.drop_toxic(d, labels)
    assert left.columns == d.columns and 450 <= left.count() <= 500
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(d, none) == 0.0 and toxicity.score(docs(spark, tests), 0.0).where("predicted = 1").count() == 0
    assert toxicity.score(docs(spark, []), model).count() == 0


def test_toxicity_counts_how_often_insults_occur(spark):
    rnd = random.Random(6)
    clean = [f"{a}{b}{c}" for a in ("lom", "tas", "ver", "nid", "kep") for b in ("ar", "ol", "ush", "im") for c in ("en", "ock", "yl", "at", "ud", "isp")]
    ends = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ri", "sa", "to") for b in ("d", "f", "l", "m", "n", "r", "s", "t")]
    rows = []
    for i in range(800):
        own = [rnd.choice(clean) for _ in range(100)]
        bad = i % 6 == 0
        for k in rnd.sample(range(100), 4 if bad else i % 2):
            own[k] = "grubz" + rnd.choice(ends)
        rows.append((i, " ".join(own), int(bad)))
    d, labels = docs(spark, [(i, t) for i, t, _ in rows]), spark.createDataFrame([(i, b) for i, _, b in rows], "doc_id long, toxic int")
    model = toxicity.fit(d, labels)
    got = {r["doc_id"]: r for r in toxicity.score(d, model).collect()}
    held = [(got[i]["predicted"], b) for i, _, b in rows if got[i]["held_out"]]
    assert sum(p == b for p, b in held) / len(held) > 0.97 and sum(p for p, b in held if b) > 0.9 * sum(b for _, b in held)
    assert sum(w.startswith("grubz") for w in model.landmarks) == 1  # one stem's variants don't fill the list


def test_toxicity_learns_from_few_labels(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(d, labels)
    insults = {"trash", "scum", "moron", "loser", "disgusting", "worthless", "pathetic", "clown"}
    rows = toxicity.score(d, model).join(labels, "doc_id").join(d.select("doc_id", "text"), "doc_id").where("toxic is not null").collect()
    bad = [r["predicted"] for r in rows if r["toxic"] and insults & set(re.findall(r"\w+", r["text"].lower()))]
    clean = [r["predicted"] for r in rows if not r["toxic"]]
    assert len(bad) >= 5 and sum(bad) >= 0.9 * len(bad) and sum(clean) <= 0.05 * len(clean)
    # Two labelled rows of two classes are enough for a model.
    two = docs(spark, [(1, "grumbling sweeps over"), (2, "the quiet hill"), (3, "grumbling again")])
    assert not isinstance(toxicity.fit(two, spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")), float)


# ---- pipeline ----


def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline

    d = spark.read.parquet(f"{sf}/documents.parquet")
    now, ids = d.withColumn("extra", F.lit(1)), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == [*d.columns, "extra"], name
        kept = {r["doc_id"] for r in now.select("doc_id").collect()}
        assert ids is None or kept <= ids
        ids = kept
        now = now.sparkSession.createDataFrame(now.collect(), now.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    assert {r["doc_id"] for r in packed.collect()} == ids and ids
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontaminate.hits(now, bench).where("contaminated").count() == 0
    assert exact_dedup.groups(now).where("group_size > 1").count() == 0
    empty = d.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_toxicity_starts_no_python_workers_of_its_own_kind(spark, monkeypatch):
    rows = [(i, "grumbling sweeps over" if i % 2 else "the quiet hill") for i in range(40)]
    d, labels = docs(spark, rows), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int").localCheckpoint()
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *_: pytest.fail("a list became an RDD of Python rows"))
    assert not isinstance(toxicity.fit(d, labels), float)


def test_toxicity_leaves_memory(monkeypatch):
    run = lambda finish: toxicity._described(types.SimpleNamespace(mapInArrow=lambda f, _: f), ["pathetic", "moron"], finish, "")
    monkeypatch.setattr(common, "_KEPT", {("encoder",): 1})
    assert list(toxicity._words(iter([]))) == [] and not common._KEPT  # what packing has kept goes when the next run begins
    texts = [" ".join(f"{k}q{i}z" for i in range(1500)) + " pathetic" for k in range(200)]
    batch = pa.record_batch([pa.array(range(200)), pa.array(texts), pa.array([len(t) for t in texts])], ["id", "text", "chars"])
    chars = [sum(map(len, part.column(1).to_pylist())) for part, _ in run(lambda part, x: (part, x[:, 0].tolist()))(iter([batch]))]
    assert sum(chars) == sum(map(len, texts)) and max(chars) <= 600_000
    matcher = common._KEPT[("matcher", "pathetic", "moron")]
    held = {id(o): o.nbytes for r in matcher.rows for o in (r if r.base is None else r.base,)}
    assert sum(held.values()) <= 2 * 2 * 4  # one word's row besides the empty one, not the rows of all words


def test_encoder_keeps_few_pieces_where_asked():
    texts = [pa.array([f"w{k}x{i} and y{i}" for i in range(50)]) for k in range(6)]
    few, many = tokens.encoder(tokenizer_path(), 60), tokens.Encoder(tokenizer_path())
    for t in texts:
        got, want = few.encode(t), many.encode(t)
        assert all(np.array_equal(a, b) for a, b in zip(got, want)) and len(few.slots) <= 60 + 2 * 150
    assert len(many.slots) > 350
