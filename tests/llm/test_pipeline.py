"""The pipeline's run() against a plain version of all five stages, document by document."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def fold(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def grams(text):
    t = " " + re.sub(r"\s+", " ", "".join(c if c.isalpha() else " " for c in text.lower())).strip() + " "
    out = []
    for n in (2, 3, 4):
        for i in range(len(t) - n + 1):
            g = t[i : i + n]
            if g.strip() and " " not in g[1:-1]:
                out.append(g)
    return out


def plain_language(docs):
    counts = defaultdict(Counter)
    for d in docs:
        if d["lang"] is not None and d["text"] is not None and fold(d["doc_id"], 3) != 1:
            counts[d["lang"]].update(grams(d["text"]))
    known = {k: {g for g, n in c.items() if n >= 2e-5 * sum(c.values())} for k, c in counts.items()}
    out = []
    for d in docs:
        if d["text"] is not None and any(c.isalpha() for c in d["text"]):
            g = grams(d["text"])
            if g and max(sum(x in k for x in g) / len(g) for k in known.values()) >= 0.3:
                out.append(d)
    return out


def plain_lines(docs):
    key = lambda x: x.encode().strip(b" \t\n\x0b\x0c\r").lower().decode()
    owner = {}
    for d in docs:
        for line in d["text"].split("\n"):
            owner[key(line)] = min(owner.get(key(line), d["doc_id"]), d["doc_id"])
    return [d | {"text": "\n".join(x for x in d["text"].split("\n") if len(key(x)) < 10 or owner[key(x)] == d["doc_id"])} for d in docs]


def plain_simhash(docs):
    def fingerprint(text):
        w = text.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 5]), 42) for i in range(max(1, len(w) - 4))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fingerprint(d["text"]) for d in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    best = {}
    for i, d in enumerate(docs):
        best[find(i)] = min(best.get(find(i), d["doc_id"]), d["doc_id"])
    kept = {}
    for i, d in enumerate(docs):
        if d["doc_id"] == best[find(i)]:
            kept.setdefault((d["doc_id"], d["text"]), d)
    return list(kept.values())


def coverage(item, doc):
    """Share of the item's words that the greedy tiles of five words or more cover."""
    doc, free = list(doc), [True] * len(item)
    size = len(item)
    least = min(5, len(item))
    covered = 0
    while size >= least:
        hit = False
        where = defaultdict(list)
        for i in range(len(item) - size + 1):
            if all(free[i : i + size]):
                where[tuple(item[i : i + size])].append(i)
        for d in range(len(doc) - size + 1) if where else ():
            for i in where.get(tuple(doc[d : d + size]), ()):
                if all(free[i : i + size]):
                    free[i : i + size], doc[d : d + size] = [False] * size, [None] * size
                    covered, hit = covered + size, True
                    break
        size -= 0 if hit else 1
    return covered / len(item)


def plain_decontamination(docs, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    tests = [w for w in map(words, items) if w]
    seeds = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in tests]
    out = []
    for d in docs:
        w = words(d["text"])
        own = {tuple(w[i : i + n]) for n in {min(5, len(t)) for t in tests} for i in range(len(w) - n + 1)}
        if not any(own & s and coverage(t, w) >= 0.8 for t, s in zip(tests, seeds)):
            out.append(d)
    return out


def plain_pieces(docs):
    tokenizer, out = Tokenizer.from_file(TOKENIZER), Counter()
    for d in docs:
        ids = np.array([*tokenizer.encode(d["text"], add_special_tokens=False).ids, 0], "<u4")
        at, k = 0, 0
        while at < len(ids):
            n = (len(ids) - at) % 2048 or 2048
            out[d["doc_id"], k, at, n, zlib.crc32(ids[at : at + n].tobytes())] += 1
            at, k = at + n, k + 1
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(900001, None, "en", None, None), (900002, "", None, "x", 0), (900003, "123 !?", "en", None, 6), (900004, "once more " * 3000, None, None, None)], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    again = docs.where("doc_id % 50 = 0").limit(3)
    docs.unionByName(odd).unionByName(again).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_run_equals_plain_stages(spark, folder):
    docs = [r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = plain_language(docs)
    assert 0 < len(want) < len(docs)
    want = plain_lines(want)
    once = plain_simhash(want)
    assert 0 < len(once) < len(want)
    want = plain_decontamination(once, items)
    assert 0 < len(want) < len(once)
    rows = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == plain_pieces(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 2048
    tokens = sum(r["length"] for r in rows)
    assert len(bins) <= 1.1 * tokens / 2048 + 1


def test_stages_keep_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_run_on_an_empty_table(spark, folder, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
