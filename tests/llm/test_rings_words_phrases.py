"""SimHash ring, spelling variants, phrases: brute force on small tables and edge cases."""

import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from margincast.llm import phrases, simhash_ring, spelling
from margincast.llm.queries import REGISTRY, TYPO_DIVISOR

SF0001 = "/root/testdata/sf0.001"
LONG = "word" + " filler" * 60_000
EDGE = [(0, None), (1, ""), (2, " \t\n "), (3, "a"), (4, "same text"), (4, "same text"), (5, LONG), (6, "\n\n\n"),
        (7, "naïve 𝄞 text\n" * 5), (None, "no id")]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, **extra):
    """Documents with columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    extra = {"lang": F.lit("en"), "fp": F.lit(7), "c": F.lit("x"), "word": F.lit(1), "n": F.lit(2), "phrase": F.lit(3),
             "shard": F.lit("s")} | extra
    return df.withColumns(extra)


# ---- SimHash ring ----

def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, near):
    least = {i: i for i in ids}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i
    for a, b in near:
        x, y = sorted((root(a), root(b)))
        least[y] = x
    return {i: root(i) for i in ids}


def plain_ring(rows):
    fps = [(d, plain_fingerprint(t)) for d, t in rows]
    near = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a][1] ^ fps[b][1]).bit_count() <= 4]
    group = plain_components(range(len(fps)), near)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[group[i]] = min(least.get(group[i], d), d)
    return sorted(((d, f"{f:016x}", least.get(group[i])) for i, (d, f) in enumerate(fps)), key=repr)


def test_ring_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = list(EDGE)
    for g in range(12):  # groups of near copies, so that distances of 1 to 10 bits occur
        base = [rng.choice(vocabulary) for _ in range(rng.choice([40, 120, 300]))]
        for c in range(rng.choice([2, 5, 25])):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((100 * g + c + 10, " ".join(text).title() if c % 3 else "\n".join(text)))
    got = sorted((tuple(r) for r in simhash_ring.near_duplicates(frame(spark, rows)).collect()), key=repr)
    want = plain_ring(rows)
    assert got == want
    assert len({r[2] for r in want}) < len(want) - 30


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=4, unique=True), st.integers(1, 6))
def test_every_close_pair_has_a_chain(x, flips, budget):
    y = x
    for b in flips[:budget]:
        y ^= 1 << b
    d = x ^ y
    starts = [i for i in range(budget + 1)
              if all((d & simhash_ring.chain_masks(budget, k)[i]).bit_count() < k for k in range(1, budget + 1))]
    assert starts
    assert sum(simhash_ring.segments(budget)) == 2**64 - 1


def test_ring_links_planted_fingerprints(spark):
    """Vertices given as bits: a path of 4-bit steps, a dense ball, and a stranger 5 bits away."""
    rng = random.Random(1)
    start = rng.getrandbits(64)
    path = [start]
    for i in range(6):
        bits = rng.sample(range(64), 4)
        path.append(path[-1] ^ sum(1 << b for b in bits))
    centre = rng.getrandbits(64)
    ball = {centre ^ sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(200)}
    far = centre ^ sum(1 << b for b in range(0, 64, 8))
    fps = sorted({*path, *ball, far})
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = {(r.a % 2**64, r.b % 2**64) for r in simhash_ring.links(spark.createDataFrame(signed, "fp long")).collect()}
    near = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4]
    assert all((a ^ b).bit_count() <= 4 or {a, b} <= ball for a, b in edges)  # later links name components
    assert plain_components(fps, edges) == plain_components(fps, near)
    assert len(edges) < len(near) / 4


def test_ring_broadcasts_no_table_that_grows(spark, monkeypatch):
    from margincast.llm import common, graph
    plans = {}

    def written(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return common.written(df, name)

    for module in (simhash_ring, graph):
        monkeypatch.setattr(module, "written", written)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0, raising=False)       # so no table counts as small
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefghij", k=400)) for _ in range(12)]
    rows = list(enumerate(texts + [t + " end" for t in texts]))
    last = simhash_ring.near_duplicates(frame(spark, rows))
    assert sorted((tuple(r) for r in last.collect()), key=repr) == (want := plain_ring(rows))
    assert len({c for _, _, c in want}) < len(want)        # some are linked
    plans["last"] = [last._jdf.queryExecution().executedPlan().toString()]
    assert not any("BroadcastHashJoin" in p for name in plans for p in plans[name])


def test_ring_of_an_empty_table(spark):
    assert simhash_ring.near_duplicates(frame(spark, [])).collect() == []


# ---- spelling variants ----

def plain_words(rows, divisor, min_chars=6, min_count=5):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if divisor and h % divisor == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1:] or (len(a) == len(b) and a[i + 1:] == b[i + 1:])


def plain_variants(words):
    out, form = [], {}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("divisor", [None, 7])
def test_variants_equal_brute_force(spark, divisor):
    rng = random.Random(3)
    stems = ["colour", "naïveté", "theatre", "harbour", "aaaaaa", "banana", "ananas", "übungen", "organise", "xyxyxyxy", "ÿÀ×÷éè"]
    rows = list(EDGE)
    for d in range(60):
        text = []
        for s in stems:
            for _ in range(rng.randrange(6)):
                w = list(s)
                for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                    at = rng.randrange(len(w))
                    w[at:at + rng.randrange(2)] = rng.choice(["", "a", "x", "é"])
                text.append("".join(w).capitalize() + rng.choice([" ", "-", "9", "'"]))
        rows.append((d, "".join(text)))
    rows.append((99, "chaina " * 5 + "chainab " * 25 + "chainabc " * 125 + "chainabcd " * 700))
    words = spelling.word_counts(frame(spark, rows), typo_divisor=divisor)
    got = sorted((tuple(r) for r in spelling.group_variants(words).collect()), key=repr)
    want = plain_variants(plain_words(rows, divisor))
    assert got == want
    assert max(r[4] for r in want) >= 2 and any(r[2] != r[1] is not None for r in want)
    if divisor is None:
        assert ("chaina", "chainab", "chainabcd", 5, 1, 25) in want


def test_variants_of_an_empty_table(spark):
    assert spelling.group_variants(spelling.word_counts(frame(spark, EDGE[:4]))).collect() == []


# ---- phrases ----

def plain_phrases(rows, rules):
    out = {}
    counts, totals = {}, Counter()
    for _, lang, t in rows:
        c = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            for k in range(1, rules.max_words + 1):
                c.update(" ".join(w[i:i + k]) for i in range(len(w) - k + 1))
    for lang, c in counts.items():
        cand = {p: a for p, a in c.items() if a >= rules.min_count and " " in p}
        best = []
        for p, a in cand.items():
            w = p.split(" ")
            score, _, left, right = min((int(Fraction(1000 * a * totals[lang], c[" ".join(w[:k])] * c[" ".join(w[k:])]) // 1), k,
                                         c[" ".join(w[:k])], c[" ".join(w[k:])]) for k in range(1, len(w)))
            if not any(f" {p} " in f" {q} " and 100 * b >= rules.percent * a for q, b in cand.items() if q.count(" ") > p.count(" ")):
                best.append((-score, -a, p.encode(), left, right))
        for i, (s, a, p, left, right) in enumerate(sorted(best)[:rules.top]):
            out[lang, i + 1] = (p.decode(), -a, left, right, totals[lang], -s)
    return out


def phrase_rows():
    rng = random.Random(9)
    vocabulary = ["the", "of", "quick", "Brown", "fox", "naïve", "𝄞", "a-b", "\x00", "x y"]
    rows = [(d, "en", t) for d, t in EDGE]
    for d in range(80):
        words = []
        for _ in range(rng.randrange(60)):
            words += rng.choice([[rng.choice(vocabulary)], ["kick", "the", "bucket"], ["a", "a"], ["new", "york", "city", "hall", "roof"]])
            if rng.random() < .2:
                words[-1] += rng.choice([".", ",", "\n", "\r", ";x", "!?"])
        rows.append((d if d % 9 else None, rng.choice(["en", "de", None]), rng.choice([" ", "\t", "  "]).join(words)))
    return rows


@pytest.mark.parametrize("rules", [phrases.PhraseRules(min_count=12, shards=3, top=40),
                                   phrases.PhraseRules(min_count=5, shards=7, range_bytes=500),
                                   phrases.PhraseRules(min_count=12, shards=1, percent=70, max_words=3)])
def test_phrases_equal_brute_force(spark, rules, monkeypatch):
    monkeypatch.setattr(phrases, "RUN", 300)
    rows = phrase_rows()
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumns({"n": F.lit(1), "t": F.lit(2), "shard": F.lit(3)})
    got = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(df, rules).collect()}
    assert got == plain_phrases(rows, rules)
    assert len(got) > 20


def test_phrase_runs_end_with_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "RUN", 10)
    toks = phrases.tokens("a b c, " * 20 + "d " * 30)
    parts = list(phrases.runs_of(toks))
    assert [t for p in parts for t in p] == toks and len(parts) > 3
    assert all(p[0] == b"," for p in parts[1:])


def test_bit_filter_holds_all_its_hashes(spark):
    h = [(xxhash.xxh3_64_intdigest(str(i)) - 2**63,) for i in range(5000)]
    f = phrases.bit_filter(spark.createDataFrame(h, "h long"), phrases.PhraseRules())
    ours = np.array([x % 2**64 for x, in h], np.uint64)
    assert f.holds(ours).all()
    assert f.holds(np.array([xxhash.xxh3_64_intdigest(f"n{i}") for i in range(5000)], np.uint64)).sum() < 250
    small = phrases.bit_filter(spark.createDataFrame(h, "h long"), phrases.PhraseRules(max_filter_bits=1 << 16))
    assert len(small.bits) == 1 << 13 and small.holds(ours).all()


def test_phrases_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert phrases.collocations(df).collect() == []


# ---- the queries ----

def test_ring_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in REGISTRY["op11_simhash_ring"][0](spark, SF0001).collect()), key=repr)
    assert got == plain_ring(rows)


@pytest.mark.parametrize("name", ["op12_spelling_variants", "op13_son_phrases"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF0001}/documents.parquet'")
    fn, sql = REGISTRY[name]
    df = fn(spark, SF0001)
    want = con.execute(sql)
    cols = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(cols)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_typo_words_of_the_table(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {r.word: r.n for r in spelling.word_counts(docs, typo_divisor=TYPO_DIVISOR).collect()}
    assert got == plain_words(rows, TYPO_DIVISOR)
