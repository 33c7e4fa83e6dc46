"""The corpus operators against plain versions, and their behaviour on odd tables."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemill.llm import common, components, decontaminate, elias_fano, language, line_dedup, lm_score, packing, quality, simhash, similar, suffixes, toxicity, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k_doc string, th int, block string"
LONG = "the quick brown fox jumps over the lazy dog and then rests. " * 400
ROWS = [
    (3, "A shared line of text\nown words here\nA shared line of text", "en", "a", 1, "x", 1, "y"),
    (1, "  a SHARED line of text \nother", "en", None, None, None, None, None),
    (1, "  a SHARED line of text \nother", "en", None, None, None, None, None),
    (None, "a shared line of text", None, None, None, None, None, None),
    (7, None, None, None, None, None, None, None),
    (8, "", "fr", None, None, None, None, None),
    (9, LONG, "en", "a", 5, None, None, None),
    (10, LONG + "tail", "en", "a", 5, None, None, None),
    (11, "été où ça déjà voilà 漢字", "fr", "b", 5, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def order(doc_id):
    return (1 << 63) - 1 if doc_id is None else doc_id


def test_line_dedup(odd, none):
    own = {}
    key = lambda x: x.encode().strip(b" \t\n\x0b\x0c\r").lower().decode()
    for r in ROWS:
        for line in (r[1] or "").split("\n"):
            own[key(line)] = min(own.get(key(line), 1 << 63), order(r[0]))
    want = Counter()
    for r in ROWS:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or own[key(x)] == order(r[0])]
        want[r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in line_dedup.digests(odd).collect()) == want
    out = line_dedup.deduplicated(odd)
    assert out.columns == odd.columns and out.count() == len(ROWS) and line_dedup.digests(none).count() == 0


def test_simhash(odd, none):
    def plain(t):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [plain(r[1]) for r in ROWS]
    reach = list(range(len(ROWS)))
    for _ in ROWS:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 4:
                    reach[i] = reach[j] = min(reach[i], reach[j])
    least = {g: min((r[0] for r, x in zip(ROWS, reach) if x == g and r[0] is not None), default=None) for g in set(reach)}
    want = Counter((r[0], f"{p:016x}", least[g]) for r, p, g in zip(ROWS, prints, reach))
    assert Counter(tuple(r) for r in simhash.near_duplicates(odd).collect()) == want
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and simhash.near_duplicates(none).count() == 0


def test_large_groups_of_near_fingerprints(spark):
    base = np.random.default_rng(3).integers(0, 1 << 62)
    fps = sorted({int(base) ^ (1 << i) ^ (1 << j) for i in range(0, 40) for j in range(40)})
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
    components = []
    for blocks in ((6, 2), (7, 3), (8, 4)):
        root = {x: x for x in fps}
        for a, b in simhash.links(nodes, 4, hot=64, blocks=blocks).collect():
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
        components.append(sum(a == b for a, b in root.items()))
    assert components == [1, 1, 1]
    pairs = simhash.links(nodes, 4, hot=64).distinct().collect()
    assert pairs and all((a ^ b) & ((1 << 64) - 1) and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4 for a, b in pairs)
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    assert len({find(x) for x in fps}) == 1


def test_links_of_one_step_are_all_kept():
    root = np.arange(12)
    i, j = np.array([(6, 7), (0, 2), (9, 11), (1, 5), (5, 9), (2, 6), (7, 11)]).T
    simhash.unite(root, i, j)
    assert {k for k in range(12) if root[k] == root[0]} == {0, 1, 2, 5, 6, 7, 9, 11} and (root[root] == root).all()


def test_few_links_are_united_without_rounds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    far = -(1 << 62)
    links = [(k, k + 1) for k in rng.permutation(24).tolist() if k != 12]  # two chains
    links += [(5000, k) for k in range(1000, 1010)] + [(far + 7, far), (far, 2000), (3000, 3000), (1, 0), (1, 0)]
    links += [(4000 + int(a), 4000 + int(b)) for a, b in rng.integers(0, 30, (20, 2))]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    want = sorted((x, find(x)) for x in {x for a, b in links if a != b for x in (a, b)})
    edges, written = spark.createDataFrame(links, "a long, b long"), []
    monkeypatch.setattr(components, "checkpoint", lambda df: written.append(df) or common.checkpoint(df))
    assert sorted(map(tuple, components.components(edges).collect())) == want
    assert len(written) == 2  # the links and the result: disk and time do not grow with partitions x rounds
    assert sorted(map(tuple, components.components(edges, few=len(links) // 2).collect())) == want and len(written) > 4
    assert components.components(edges.limit(0)).count() == components.components(edges.limit(0), few=-1).count() == 0


def test_only_pairs_that_may_be_alike_are_listed():
    rng = np.random.default_rng(8)
    held = []
    for size in (1, 9, 18, 45, 90, 180, 360):
        for _ in range(12):
            base = rng.integers(0, 1 << 63, size, np.uint64)
            for changed in (0, size // 18, size // 10, size // 9, size // 8, size // 4):
                s = base.copy()
                s[:changed] = rng.integers(0, 1 << 63, changed, np.uint64)
                held.append(np.unique(np.append(s, np.uint64(7))))  # one shingle that all have
    n, node = np.array([len(s) for s in held]), np.arange(len(held))
    bits = np.frombuffer(b"".join(map(similar.parities, held)), np.uint64).reshape(-1, 4)
    listed = [p for a, b, *_ in similar.across(np.full(len(held), 7), node, n, node, bits) for p in zip(a.tolist(), b.tolist())]
    near, close = set(), 0
    for j, b in enumerate(held):
        for i, a in enumerate(held[:j]):
            if 5 * n[i] >= 4 * n[j] and 5 * n[j] >= 4 * n[i]:
                close += 1
                if 9 * len(np.intersect1d(a, b)) >= 4 * (n[i] + n[j]):
                    near.add((i, j))
    assert len(listed) == len(set(listed)) and near <= set(listed)  # none is lost
    assert len(listed) < close / 10 and len(near) > 300


def test_near_copies_by_exact_similarity(spark, odd, none):
    rng = np.random.default_rng(5)
    texts = []
    for size in (8, 20, 60, 200, 500):
        for _ in range(4):
            base = [f"w{x}" for x in rng.integers(0, 5000, size)]
            for changed in (0, 1, 1, 2, size // 50, size // 40, size // 25):
                copy = list(base)
                for at in rng.integers(0, size, changed):
                    copy[at] = f"x{rng.integers(0, 1 << 40)}"
                texts.append(" ".join(copy))
    common = " ".join(f"c{k}" for k in range(12))  # a passage alone is no similarity
    texts += [f"{common} " + " ".join(f"y{k}z{j}" for j in range(10)) for k in range(30)] + ["", None, "a b", "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shingles = [frozenset(tuple((t or "").split()[i : i + 5]) for i in range(max(1, len((t or "").split()) - 4))) if t else frozenset() for t in texts]
    reach = list(range(len(texts)))

    def find(x):
        while reach[x] != x:
            x = reach[x]
        return x

    far = 0
    prints = [simhash.fingerprint((t or "").encode(), 5) for t in texts]
    for i, a in enumerate(shingles):
        for j, b in enumerate(shingles[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                far += (prints[i] ^ prints[j]).bit_count() > 4
                reach[max(find(i), find(j))] = min(find(i), find(j))
    assert far  # four bits of SimHash do not reach these
    for tries, turns in ((4, 2), (1, 0)):
        rows = similar.grouped(docs, tries=tries, turns=turns).collect()
        least = {}
        for r in rows:
            least[r["root"]] = min(r["k_doc"], least.get(r["root"], 1 << 62))
        assert {r["k_doc"]: least[r["root"]] for r in rows} == {i: find(i) for i in range(len(texts))}
    assert sorted(r["doc_id"] for r in similar.one_of_each(docs).collect()) == sorted({find(i) for i in range(len(texts))})
    assert similar.one_of_each(odd).columns == odd.columns and similar.one_of_each(none).count() == 0


def test_suffixes(odd, none):
    texts = [(order(r[0]), (r[1] or "").encode()) for r in ROWS]
    first = {}
    for d, b in texts:
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], d), d)
    want = Counter()
    for r, (d, b) in zip(ROWS, texts):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < d:
                gone[p : p + 50] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        want[r[0], len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    assert Counter(tuple(r)[:5] for r in suffixes.dedup(odd).collect()) == want
    assert suffixes.dedup(none).count() == 0


def test_two_stage_sorting():
    rng = np.random.default_rng(0)
    for _ in range(100):
        t = rng.integers(1, rng.integers(2, 6), rng.integers(1, 150)).astype(np.uint8)
        assert suffixes.two_stage(t, 200).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tobytes())


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, u in ((0, 5), (1, 1), (1, 1 << 60), (1000, 1001), (1000, 1 << 40), (5000, 300)):
        v = np.sort(rng.integers(0, u, n, dtype=np.uint64))
        e = elias_fano.EliasFano(v, u)
        x = rng.integers(0, u, 50, dtype=np.uint64)
        assert (e.get(np.arange(n)) == v).all() and (e.successor(x, np.zeros(50), np.full(50, n)) == np.searchsorted(v, x)).all()
        assert (e.successors(np.sort(x), 64) == np.searchsorted(v, np.sort(x))).all() and (not n or (e.stretch(n // 3, n) == v[n // 3 :]).all())


def plain_lm(rows, prior=3.0, discount=0.75):
    """doc_id, held_out, n_tokens, n_known, N, base_score, score by dictionaries, unrounded."""
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    tokens = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    c, pairs, contexts = Counter(), Counter(), Counter()
    for (d, _), ts in zip(rows, tokens):
        if not held(d):
            c.update(ts)
            pairs.update(zip(["start", *ts], ts))
            contexts.update(["start", *ts[:-1]])
    n, v = sum(c.values()), len(c)
    single = lambda w: (c[w] - discount) / n if c[w] else min(1, discount * v / n)
    out = []
    for (d, _), ts in zip(rows, tokens):
        base = sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts)
        p = [(pairs[a, b] + prior * single(b)) / (contexts[a] + prior) for a, b in zip(["start", *ts], ts)]
        out.append((d, held(d), len(ts), sum(c[t] > 0 for t in ts), n, base, sum(map(math.log10, p))))
    return out


def test_very_long_texts(spark):
    """Longer than a chunk of suffixes (2^18 bytes) and a part of shingle hashes (2^16)."""
    rng = np.random.default_rng(14)
    base = [f"w{x}" for x in rng.integers(0, 30_000, 80_000)]
    other = [f"v{x}" for x in rng.integers(0, 30_000, 300)]
    rows = [(1, " ".join(base)), (2, " ".join([*other, *base[100:79_000], *other])), (3, " ".join(other)), (4, " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    h = simhash.shingle_hashes([w.encode() for w in base], 4)
    bits = [2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h) for b in range(64)]
    assert prints[1]["fingerprint"] == prints[4]["fingerprint"] == f"{sum(1 << b for b in range(64) if bits[b]):016x}"
    assert prints[4]["component_id"] == 1

    first, want = {}, {}
    for d, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first.setdefault(b[p : p + 50], d) < d:
                gone[p : p + 50] = True
        want[d] = int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()
    assert {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in suffixes.dedup(docs).collect()} == want
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d, text in rows:
        assert sum(r["length"] for r in pieces if r["doc_id"] == d) == len(t.encode(text, add_special_tokens=False).ids) + 1
    scores = {r["doc_id"]: r for r in lm_score.score(docs).collect()}
    assert scores[1]["n_tokens"] == 80_001 and scores[1]["score"] == scores[4]["score"]
    assert {r["doc_id"]: r["n_words"] for r in quality.judge(docs).collect()} == {1: 80_000, 2: 79_500, 3: 300, 4: 80_000}
    kept = {r["doc_id"] for r in similar.one_of_each(docs).collect()}
    assert kept == {1, 3}


def test_lm_score(spark, odd, none):
    rng = np.random.default_rng(8)
    word = lambda n: " ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) % 3000)
    rows = [(int(i), word(int(rng.integers(0, 200)))) for i in range(300)] + [(5, "the END"), (5, "the END"), (None, "w1 w2 w1"), (9, None), (2, LONG)]
    want = plain_lm(rows)
    for shape in ("8", "3"):  # partitions, and so ranges and frequent words
        spark.conf.set("spark.sql.shuffle.partitions", shape)
        got = sorted(map(tuple, lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
        for g, w in zip(got, sorted(want, key=str)):
            assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 * (1 + abs(w[5]))
            # each token is rounded down by at most 1/16
            assert w[6] - g[2] / 16 - 1e-6 <= g[6] <= w[6] + 1e-6
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    rows = lm_score.score(odd).collect()
    assert len(rows) == len(ROWS) and {r["n_tokens"] for r in rows if r["doc_id"] in (7, 8)} == {1}
    assert lm_score.score(none).count() == 0
    unseen = lm_score.score(spark.createDataFrame([(2, "a b")], "doc_id long, text string").where("doc_id is null or true")).first()
    assert unseen["held_out"] == (zlib.crc32(b"2") % 7 == 2)


def test_packing(odd, none):
    rows = packing.pack(odd, public_tokenizers.path("byte_bpe_50k.json"), capacity=64).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 64
    assert packing.pack(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_best_fit_plan_is_tight():
    lengths = np.random.default_rng(2).integers(1, 2049, 20000)
    histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    steps = packing.plan(histogram, 2048)
    assert steps[:, 4].sum() == len(lengths)
    fill = Counter()
    for length, _, start, _, n in steps.tolist():
        for k in range(start, start + n):
            fill[k] += length
    assert max(fill.values()) <= 2048 and len(fill) <= 1.02 * lengths.sum() / 2048 + 1


def test_plan_is_best_fit_decreasing():
    def plain(lengths, capacity):
        rooms = []
        for n in sorted(lengths, reverse=True):
            fits = [k for k, r in enumerate(rooms) if r >= n]
            k = min(fits, key=lambda k: rooms[k], default=len(rooms))
            if k == len(rooms):
                rooms.append(capacity)
            rooms[k] -= n
        return sorted(rooms)

    rng = np.random.default_rng(4)
    cases = [([12, 12, 3, 3, 2, 2, 2, 2, 2], 20)] + [(rng.integers(1, int(rng.integers(2, 41)), 60).tolist(), 40) for _ in range(200)]
    for lengths, capacity in cases:
        rooms, placed = {}, Counter()
        for length, rank, start, offset, n in packing.plan(dict(Counter(lengths)), capacity).tolist():
            for k in range(start, start + n):
                assert rooms.get(k, capacity) == capacity - offset
                rooms[k] = capacity - offset - length
            placed[length] += n
        assert placed == Counter(lengths) and sorted(rooms.values()) == plain(lengths, capacity)


def test_decontamination_finds_reordered_passages(spark, odd, none):
    item = "one two three four five six seven eight nine ten eleven twelve"
    bench = spark.createDataFrame([(1, item), (2, None), (None, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x Seven eight, nine ten eleven twelve y one two three four five six z"), (2, "one two three four five"), (3, None)], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["coverage"]) for r in decontaminate.contamination(docs, bench).collect()] == [(1, 1, 1.0)]
    assert [r["doc_id"] for r in decontaminate.clean(docs, bench).orderBy("doc_id").collect()] == [2, 3]
    assert decontaminate.contamination(odd, bench).count() == decontaminate.contamination(none, bench).count() == 0


def plain_tile(item, doc, min_tile):
    """Every length from the longest down, every pair of windows."""
    free_i, free_d, out = [True] * len(item), [x >= 0 for x in doc], []
    for size in range(min(len(item), len(doc)), min_tile - 1, -1):
        for d in range(len(doc) - size + 1):
            for i in range(len(item) - size + 1):
                if all(free_i[i : i + size]) and all(free_d[d : d + size]) and item[i : i + size] == doc[d : d + size]:
                    free_i[i : i + size] = free_d[d : d + size] = [False] * size
                    out.append((i, d, size))
    return out


def test_tiles_are_the_greedy_ones():
    rng = np.random.default_rng(6)
    for _ in range(200):
        v = int(rng.choice([2, 3, 10]))
        item, doc = rng.integers(0, v, rng.integers(1, 40)).tolist(), rng.integers(-1, v, rng.integers(1, 60)).tolist()
        for least in (1, 3, 5):
            assert decontaminate.tile(item, doc, least) == plain_tile(item, doc, least)


def test_decontamination_rows(spark):
    rng = np.random.default_rng(7)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 12, n))
    items = [(i, word(int(rng.integers(1, 30)))) for i in range(20)] + [(20, ""), (None, word(9)), (3, word(12))]
    docs = [(i, " ".join(rng.permutation(np.array([word(40), *(t for _, t in items[: i % 5])], object)))) for i in range(40)] + [(1, "W1, w2! w3"), (1, "W1, w2! w3"), (None, items[4][1].upper()), (50, None), (51, "")]
    want, found = Counter(), set()
    for d, text in docs:
        for i, t in items:
            ws, ds = decontaminate.words(t), decontaminate.words(text)
            known = {w: k for k, w in enumerate(dict.fromkeys(ws))}
            tiles = plain_tile([known[w] for w in ws], [known.get(w, -1) for w in ds], min(5, len(ws))) if ws else []
            covered = sum(x[2] for x in tiles)
            if tiles and covered >= 0.8 * len(ws):
                want[d, i, len(ws), covered, len(tiles), round(covered / len(ws), 9)] += 1
                found.add((d, text))
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame([(*r, "mine") for r in docs], "doc_id long, text string, `a.key` string")
    for words in (1_000_000, 40):  # one block, and several
        rows = decontaminate.contamination(table, bench, block_words=words).collect()
        assert Counter((*tuple(r)[:5], round(r["coverage"], 9)) for r in rows) == want
    kept = decontaminate.clean(table, bench)
    assert kept.columns == table.columns and Counter(tuple(r) for r in kept.collect()) == Counter((*r, "mine") for r in docs if r not in found)


def test_language(odd, none):
    rows = language.identify(odd).collect()
    assert len(rows) == len(ROWS) and {r["lang_pred"] for r in rows if r["doc_id"] in (7, 8)} == {"und"}
    assert language.known_language(odd).columns == odd.columns and language.identify(none).count() == 0


def test_quality(odd, none):
    rows = {r["doc_id"]: r for r in quality.judge(odd).collect()}
    assert rows[7]["n_words"] == 0 and rows[7]["base_failed"] and rows[9]["base_failed"] and rows[3]["n_dup_lines"] == 1
    assert quality.line_fault(b"home | about | contact | more") == "navigation" and quality.line_fault(b"A sentence of five words.") is None
    assert quality.line_fault("© 2024 Alle Rechte VORBEHALTEN.".encode()) == "boilerplate"
    assert quality.base(b"a b c x a b c")[4] == 6 and quality.judge(none).count() == 0
    # characters of words are counted, not bytes: 8 of 41 go
    assert abs(quality.clean_lines("漢字漢字漢字漢字\nthis line of words has thirty-three letters.".encode())[1] - 8 / 46) < 0.01


def test_quality_base_columns_and_verdicts(spark):
    rng = np.random.default_rng(9)
    lines = ["the cat sat on the mat and looked at the sea.", "home | about | news | contact", "tous droits réservés", "$$$ *** ###", "one two", "", " \t", "été déjà vu là-bas, où ça ? Oui.", "a b a b a b a b"]
    texts = ["\n".join(rng.choice(lines, int(rng.integers(0, 14)))) for _ in range(60)] + ["x " * 49, "x y z " * 17, " ".join(f"w{k}" for k in range(50)), " ".join(f"w{k}" for k in range(49)), None, LONG]
    spaces = re.compile("[ \t-\r]+")

    def plain(t):
        t = t or ""
        ws = [w for w in spaces.split(t) if w]
        seen, dup = [], 0
        for line in t.split("\n"):
            has = bool(spaces.sub("", line))
            dup += has and line in seen
            seen += [line] * has
        windows = [tuple(ws[k : k + 3]) for k in range(len(ws) - 2)]
        often = Counter(windows)
        repeated = {k + j for k, w in enumerate(windows) for j in range(3) if often[w] > 1}
        failed = len(ws) < 50 or 100 * len(repeated) > 50 * len(ws)
        total = sum(len(spaces.sub("", x)) for x in t.split("\n"))
        lost = sum(len(spaces.sub("", x)) for x in t.split("\n") if quality.line_fault(x.encode()))
        return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(repeated), failed, not failed and 2 * lost <= total

    rows = quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: tuple(r)[1:8] for r in rows} == {i: plain(t) for i, t in enumerate(texts)}


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://X.Example.NET/en/a?b"), (2, None), (3, "nothing"), (4, "https://a.example.com/de/1#x"), (5, "http://m.casino-win.example.org/en/2"), (6, "http://b.org/fr/9")], "page_id long, url string")
    got = {r["page_id"]: tuple(r)[1:] for r in urls.filter_urls(pages).collect()}
    assert got[1] == ("x.example.net", "/en/a", "example.net/en/", "allow") and got[2][:3] == got[3][:3] == ("", "", None)
    assert got[4][2:] == ("example.com/de/", "block") and got[5][2:] == (None, "block") and got[6][2:] == ("org/fr/", "allow")


def test_url_columns(spark):
    made = [f"{a}://{h}{p}" for a in ("http", "", "HTTPS") for h in ("A.net", "net", "xnet", "Example.net:80", "u@example.com", "b.example.COM", "org", "ÄB.org") for p in ("", "/", "/en", "/en/x?/fr/#y", "/de/1", "#/de/", "?q=http://a.net/", "/fr/é")]
    made += ["", "://", "a://b://c/d", "x" * 70_000 + "://host.example.org/fr/" + "y" * 70_000, None]

    def plain(u):
        host = path = ""
        if u and "://" in u:
            rest = u[u.index("://") + 3 :]
            host = re.split(r"[/?#]", rest, maxsplit=1)[0]
            path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(r, v) for v, r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        return host, path, *(max(fits, key=lambda x: len(x[0])) if fits else (None, None))

    table = spark.createDataFrame([(i, u, 1, "z") for i, u in enumerate(made)] + [(0, made[0], 1, "z")], "page_id long, url string, host int, verdict string")
    rows = urls.filter_urls(table).collect()
    assert len(rows) == len(made) + 1 and {r["verdict"] for r in rows} == {"allow", "block"}
    for r in rows:
        host, path, rule, verdict = plain(made[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and verdict in (None, r["verdict"])
    assert urls.filter_urls(table.limit(0)).count() == 0


def test_urls_of_sites_that_are_not_in_the_table():
    weights = urls.fit()

    def blocked(url):
        f = urls.features(*urls.host_and_path(url))
        return weights[f].sum() / np.sqrt(len(f)) + weights[-1] > 0

    names = {n for n, _ in urls.SITES}
    for name, label in (("cheap-pills", 1), ("casino-win", 1), ("spam-farm", 1), ("free-bets", 1), ("kitchen", 0), ("wildlife", 0), ("teachers", 0)):
        assert name not in names and all(blocked(form.format(name + ".")) == bool(label) for form in urls.FORMS)


def test_toxicity(spark, none):
    clean, bad = "the day was calm and the sea was blue for all of us", "you idiot the day was calm you scum"
    docs = spark.createDataFrame([(i, f"{bad if i % 4 == 0 else clean} {i}") for i in range(200)] + [(900, None), (None, "")], "doc_id long, text string")
    labels = docs.where("doc_id < 200").select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    rows = toxicity.toxicity(docs, labels).where("doc_id < 200").collect()
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in rows)
    assert toxicity.toxicity(docs, labels.limit(0)).where("score <> 0").count() == 0
    assert toxicity.toxicity(none, labels).count() == 0


def test_toxicity_probabilities(spark):
    rng = np.random.default_rng(11)
    rows = [(" ".join(f"w{int(x)}" for x in rng.zipf(1.5, int(rng.integers(1, 40))) % 50), int(rng.integers(0, 2)), int(rng.integers(0, 4))) for _ in range(80)] + [("", 1, 0), ("only", 0, 1)]
    sample = spark.createDataFrame(rows, "text string, toxic long, fold long")
    got = {}
    for r in toxicity.probabilities(toxicity.counts(sample)).collect():
        got.setdefault(r["model"], {})[r["word"]] = r["p_toxic"], r["p_ordinary"]
    for model in range(toxicity.FOLDS + 1):
        held = [(toxicity.words(t), y) for t, y, fold in rows if fold != model]
        c = {y: Counter(w for ws, z in held if z == y for w in set(ws)) for y in (0, 1)}
        after = Counter(b for _, b in {p for ws, _ in held for p in zip(ws, ws[1:])})
        vocabulary = set(c[0]) | set(c[1])
        every = sum(after[w] for w in vocabulary) + (len(vocabulary) + 1) / 2

        def p(w, y):
            times = Counter(c[y].values())
            d = times[1] / (times[1] + 2 * times[2]) if times[1] else 0.5
            n = sum(c[y].values())
            return max(c[y][w] - d, 0) / n + d * len(c[y]) / n * (after[w] + 0.5) / every

        assert set(got[model]) == vocabulary
        for w in vocabulary:
            assert np.allclose(got[model][w], (p(w, 1), p(w, 0)), rtol=1e-9)
        for y in (0, 1):  # with the event of a word that no text has
            assert abs(sum(p(w, y) for w in vocabulary) + p("unseen", y) - 1) < 1e-9


def test_toxicity_of_held_out_texts(spark):
    rng = np.random.default_rng(12)
    word = lambda n: [f"w{int(x)}" for x in rng.zipf(1.2, n) % 2000]
    rows = []
    for i in range(900):
        ws = word(int(rng.integers(20, 120)))
        if i % 5 == 0:
            for k in range(0, len(ws), 12):
                ws[k] = f"insult{int(rng.integers(0, 12))}"
        rows.append((i, " ".join(ws), i, "x"))
    docs = spark.createDataFrame([*rows, rows[5], rows[10]], "doc_id long, text string, toxic int, score string")
    labels = spark.range(900).select(F.col("id").alias("doc_id"), F.lit(0).alias("quality"), (F.col("id") % 5 == 0).cast("int").alias("toxic"))
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 902 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held) >= 0.97 * len(held)
    # neither the class with more texts nor a long text changes what a text's words say
    long = spark.createDataFrame([(None, " ".join(word(60_000)), 0, ""), (None, " ".join([*word(20), "insult3"] * 2000), 0, "")], docs.schema)
    scores = [r["predicted"] for r in toxicity.toxicity(docs.unionByName(long), labels).where("doc_id is null").orderBy("score").collect()]
    assert scores == [0, 1]


def test_language_filters_against_exact_sets(spark, none):
    rng = np.random.default_rng(13)
    syllables = {"aa": ["ka", "to", "mi", "re"], "bb": ["schu", "lich", "ter", "au"], "cc": ["ção", "qué", "eau", "où"], "字": ["漢", "語", "文", "字"]}
    text = lambda lang, n: " ".join("".join(rng.choice(syllables[lang], int(rng.integers(1, 4)))) for _ in range(n))
    rows = [(i, text(lang, int(rng.integers(3, 60))), lang, "x") for i, lang in enumerate([*syllables] * 60)]
    odd = [(1000, None, "aa", "x"), (1001, "123 ！？ 🙂 …", "aa", "x"), (1002, "", None, "x"), (None, text("bb", 30), None, "x"), (1004, text("aa", 50_000), None, "x"), (3, rows[3][1], "cc", "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, held_out string")
    got = language.identify(docs).collect()
    assert len(got) == len(rows) + len(odd)
    told = {r["doc_id"]: (r["lang_pred"], r["held_out"], r["score"]) for r in got if r["doc_id"] != 3}
    assert all(told[i][0] == lang for i, _, lang, _ in rows if i != 3)
    assert [told[i][0] for i in (1000, 1001, 1002, None, 1004)] == ["und", "und", "und", "bb", "aa"]
    # shares of n-grams that a language contains, against exact sets of those beyond the least share
    train = docs.where("lang is not null and doc_id < 240")
    filters, letters = language.train(train), language.Letters()
    exact = {}
    for lang in syllables:
        h, n = np.unique(np.concatenate([language.ngram_hashes(letters(t)) for i, t, x, _ in rows if x == lang]), return_counts=True)
        exact[lang] = set(h[n >= 2e-5 * n.sum()].tolist())
    for _, t, _, _ in rows[:40]:
        h = language.ngram_hashes(letters(t))
        for k, lang in enumerate(filters.languages):
            assert abs(filters.shares(h)[k] - sum(x in exact[lang] for x in h.tolist()) / len(h)) < 0.02
    assert not letters.is_letter[0x1F642] and letters.is_letter[0x6F22]
    assert language.identify(none).count() == 0 and language.known_language(docs).columns == docs.columns


def test_only_marks_with_a_text_are_drawn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d"), (2, "c d"), (3, None)], "doc_id long, text string")
    marks = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    assert sorted(tuple(r) for r in toxicity.with_text(docs, marks).collect()) == [(1, 1), (2, 0)]


def test_new_words_are_tokenised_together():
    tokens = packing.Tokens(public_tokenizers.path("byte_bpe_50k.json"), keep=3000)
    calls, real = [0], tokens.tokenizer

    class Counted:
        def __getattr__(self, name):
            calls[0] += name.startswith("encode")
            return getattr(real, name)

    tokens.tokenizer = Counted()
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(rng.choice(list("aeioukrst"), 7)) for _ in range(100)) for _ in range(50)]
    texts += ["a\n\n b\t c  \r\n 'd don't '' 's.. x9 9x é ñ_", "", " ", "\n", " \n \n x\n", "漢 字\n", "<|endoftext|> a", "'s\n'same"]
    want = [np.array(real.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    got = list(tokens.each(texts)) if hasattr(tokens, "each") else list(map(tokens, texts))
    assert got == want and list(map(tokens, texts[-10:])) == want[-10:]
    assert calls[0] < 100  # of some 5,000 different words


def test_new_words_go_to_the_model_alone():
    tokens = packing.Tokens(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one two\n\nthree's é ñ_ 9x ''\t\r\n \n x", "\u00a1 \u00ad\u024f \u00ff", " ", ""]
    want = [np.array(tokens.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]

    class Unused:
        def __getattr__(self, name):
            raise AssertionError(name)

    tokens.tokenizer = Unused()
    assert list(tokens.each(texts)) == want


def test_sketch_holds_the_sets_of_few_texts(monkeypatch):
    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, f, schema):  # noqa: N802
            raise LookupError(f)

    monkeypatch.setattr(similar.common, "identified", lambda docs: Docs())
    with pytest.raises(LookupError) as told:
        similar.levels(None, 5)
    (count,) = told.value.args
    texts = [" ".join(f"{i}x{k}" for k in range(200)) for i in range(10_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    del texts
    tracemalloc.start()
    total = sum(int(common.unpack(b)[1].sum()) for out in count(iter([batch])) for b in out["blob"].to_pylist())
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert total == 10_000 * 196 and most < 70  # counters take 48, all sets 16 more for each copy
