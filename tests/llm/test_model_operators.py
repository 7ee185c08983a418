"""Packing, toxicity, nearest neighbours, Jaccard join, language model, mixing, pipeline."""

import collections
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from margincast.llm import brown_lm, collision_ann, mixing, ngram_join, packing, toxicity

SF0001 = "/root/testdata/sf0.001"
LONG = "word " * 20_000


def frame(spark, rows, **extra):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"n": F.lit(1), "block": F.lit(2), "row": F.lit(3), "_id": F.lit(4)} | extra)


# ---- packing ----

def pieces_ok(pieces, texts, window=2048):
    """Round trip: every id lies in exactly one piece, sequences are gapless."""
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    want = collections.Counter()
    by_doc = collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    for d, ts in texts.items():
        ids = [tok.encode(t or "", add_special_tokens=False).ids + [1] for t in ts]
        assert sum(map(len, ids)) == sum(p.length for p in by_doc[d])
        if len(ts) == 1:
            at = 0
            for p in sorted(by_doc[d], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids[0]) and p.length > 0
                assert p.ids_crc32 == zlib.crc32(np.array(ids[0][at:at + p.length], "<u4").tobytes())
                at += p.length
            assert at == len(ids[0])
    by_seq = collections.defaultdict(list)
    for p in pieces:
        by_seq[p.sequence_id].append(p)
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        want[at == window] += 1
    return want


def test_packing_round_trip(spark):
    rows = [(0, None), (1, ""), (2, LONG), (3, "a  b \n c"), (3, "a  b \n c"), (4, "<|endoftext|> é 𝄞")]
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").where("doc_id >= 10").select("doc_id", "text")
    rows += [tuple(r) for r in docs.collect()]
    texts = collections.defaultdict(list)
    for d, t in rows:
        texts[d].append(t)
    got = packing.pack(frame(spark, rows)).collect()
    full = pieces_ok(got, texts)
    assert full[False] <= 1                       # one shard: one short window


def test_packing_prefers_lexical_neighbours():
    idf = np.ones(100)
    docs = [np.array([5, 6, 7, 8] * 5, "<u2"), np.array([50, 51, 52] * 10, "<u2"), np.array([5, 6, 7, 9] * 5, "<u2"),
            np.array([60, 61] * 10, "<u2")]
    out = packing.pack_shard(docs, idf, 20.0, packing.PackRules(window=40))
    first = [r[0] for r in out if r[3] == 0]
    assert first == [0, 2]


def test_packing_keeps_the_order_of_files(spark, tmp_path):
    """Shards are runs of the files' rows, numbered along the files."""
    rows = [(i, f"w{i} common words of row {i} " * (1 + i % 40)) for i in range(600)]
    path = str(tmp_path / "docs")
    frame(spark, rows).repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    docs = spark.read.parquet(path)
    rules = packing.PackRules(window=256, shard_tokens=6_000)
    got = packing.pack(docs, rules, in_order=True).collect()
    plain = {r.doc_id: r.doc_tokens for r in packing.pack(docs, rules).collect()}
    length, shards = collections.Counter(), collections.defaultdict(set)
    for r in got:
        length[r.doc_id] += r.length
        shards[r.sequence_id >> 32].add(r.doc_id)
    assert length == plain
    edges = [(min(d), max(d)) for _, d in sorted(shards.items())]
    assert len(edges) >= 7 and all(a[1] < b[0] for a, b in zip(edges, edges[1:]))
    empty = packing.pack(spark.read.schema("doc_id long, text string").parquet(path).where("doc_id < 0"), rules, in_order=True)
    assert empty.count() == 0


def test_packing_finds_neighbours_in_any_number_of_shards(spark):
    """Planted pairs share a window about as often in many shards as in one."""
    rnd = np.random.default_rng(5)
    vocabulary = ["".join(rnd.choice(list("bcdfglmnprst")) + rnd.choice(list("aeiou")) for _ in range(3)) for _ in range(3000)]
    rows = []
    for pair in range(300):
        own = rnd.choice(3000, 40)
        for half in range(2):
            w = np.concatenate([own, rnd.choice(3000, 20)])
            rnd.shuffle(w)
            rows.append((half * 300 + pair, " ".join(vocabulary[i] for i in w)))
    share = {}
    for tokens in (1_000_000, 4_000):
        rules = packing.PackRules(shard_tokens=tokens, task_tokens=3 * tokens)
        got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rules).collect()
        windows = collections.defaultdict(set)
        for r in got:
            windows[r.doc_id].add(r.sequence_id)
        share[tokens] = sum(bool(windows[i] & windows[i + 300]) for i in range(300)) / 300
        at = collections.defaultdict(int)
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):        # no gap, nothing twice
            assert r.offset == at[r.sequence_id]
            at[r.sequence_id] += r.length
        assert sum(at.values()) == sum(r.doc_tokens for r in got if r.start == 0)
    n_shards = sum(at.values()) / 4_000
    assert n_shards > 8 and share[4_000] > 4 / n_shards and share[4_000] > 0.6 * share[1_000_000]


def test_packing_keys_of_long_documents_spread(spark):
    """Short documents agree on keys where they are alike; long ones do not pile up."""
    rnd = np.random.default_rng(1)
    order = packing.key_order(np.full(2000, 9), np.ones(2000), 4.0)
    order[1999] = np.inf                                       # no key
    texts = [np.arange(5, 25)] * 4 + [rnd.permutation(1900) for _ in range(40)] + [np.full(3, 1999)]
    rows = [(i, i, bytearray(np.asarray(t, "<u2").tobytes())) for i, t in enumerate(texts)]
    tokens = spark.createDataFrame(rows, "row long, doc_id long, ids binary")
    got = {r["row"]: (r["k0"], r["k1"], r["k2"]) for r in packing.lexical_keys(tokens, order, "<u2", 1000).collect()}
    assert {got[i] for i in range(4)} == {tuple(5 + np.argsort(order[5:25])[:3])}
    assert len({got[i][0] for i in range(4, 44)}) > 30 and got[44] == (-1, -1, -1)


def test_bm25_scores_match_definition():
    rules = packing.PackRules()
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 30, rng.integers(5, 60)).astype("<u2") for _ in range(12)]
    idf = rng.random(30)
    idf[:5] = 0
    index = packing.ShardIndex(docs, idf, 25.0, rules)
    for q in range(12):
        want = []
        for d in docs:
            s = 0.0
            for t in set(docs[q].tolist()):
                tf = int((d == t).sum())
                s += idf[t] * tf * (rules.k1 + 1) / (tf + rules.k1 * (1 - rules.b + rules.b * len(d) / 25.0)) if tf else 0.0
            want.append(s)
        assert np.allclose(index.scores(q), want)


def test_packing_empty_table(spark):
    assert packing.pack(frame(spark, [])).count() == 0


# ---- toxicity ----

def test_toxicity_learns_pairs(spark):
    """The label is an interaction: both words together, neither alone."""
    rng = random.Random(1)
    filler = [f"f{i}" for i in range(30)]
    rows, labels = [], []
    for i in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = rng.sample(filler, 8) + ["insult"] * a + ["group"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(a and b)))
    docs = frame(spark, rows + [(5000, None), (5001, ""), (5002, "INSULT, group! " + LONG), (5002, "INSULT, group! " + LONG)])
    lab = spark.createDataFrame(labels + [(9999, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, lab)
    got = collections.defaultdict(list)
    for r in toxicity.score_toxicity(docs, model).collect():
        got[r.doc_id].append(r)
    held = [(got[i][0].predicted, y) for i, y in labels if got[i][0].held_out]
    assert len(held) > 100 and sum(p == y for p, y in held) / len(held) > 0.97
    assert got[5000][0].score == got[5001][0].score and got[5000][0].predicted == 0
    assert [r.predicted for r in got[5002]] == [1, 1]
    for i, _ in labels:
        assert got[i][0].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_factorization_machine_equals_pair_sum():
    rng = np.random.default_rng(0)
    model = toxicity.Model(np.arange(20), 0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    sets = [[0, 3, 7], [], [1, 2, 5, 19]]
    rows = np.array([i for i, s in enumerate(sets) for _ in s])
    cols = np.array([c for s in sets for c in s])
    want = [0.3 + sum(model.linear[c] for c in s) + sum(model.factors[a] @ model.factors[b] for a in s for b in s if a < b) for s in sets]
    assert np.allclose(toxicity.raw_scores(model, rows, cols, 3), want)


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "a b"), (2, None)])
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score_toxicity(docs, model).collect()} == {0.5}
    assert toxicity.score_toxicity(frame(spark, []), model).count() == 0


# ---- nearest neighbours ----

def test_ann_recall_and_exact_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    pdf = rows.toPandas()
    x, ids = np.array(pdf.embedding.tolist(), float), pdf.vec_id.to_numpy()
    got = collections.defaultdict(list)
    for r in collision_ann.nearest(rows, collision_ann.AnnRules(shard_rows=200, query_rows=10)).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        mine = got[ids[q]]
        assert [r.rank for r in mine] == list(range(1, 21))
        for r in mine:
            assert r.score == pytest.approx(float(x[ids == r.vec_id][0] @ x[q]), abs=1e-12)
        assert all((a.score, -a.vec_id) >= (b.score, -b.vec_id) for a, b in zip(mine, mine[1:]))
        hit, total = hit + len({r.vec_id for r in mine} & set(best.tolist())), total + 20
    assert hit / total >= 0.9


def test_ann_verifies_few_and_fewer_with_size():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((12_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rules, share = collision_ann.AnnRules(), []
    for n in (1_500, 12_000):
        index = collision_ann.ShardIndex(np.arange(n), x[:n], 1.0 + 1e-12, rules)
        start = collision_ann.start_radius(x[:n], x[:64], 1.0, rules.k)
        found = index.search(np.arange(64), x[:64], start)
        hit = sum(len(set(ids) & set(np.argsort(-np.where(np.arange(n) == i, -9.0, x[:n] @ x[i]))[:20])) for i, (ids, _) in enumerate(found))
        assert hit >= 0.9 * 64 * 20
        share.append(index.verified / 64 / n)
    assert share[1] < 0.2 and share[1] < 0.7 * share[0]


def test_ann_copies_of_a_row_spread_over_shards(spark):
    rows = [(i if i % 3 else 20, [1.0 + (i % 3) * (i % 7), float(i % 5)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collision_ann.nearest(df, collision_ann.AnnRules(shard_rows=50, query_rows=4)).where("query_id = 40").collect()
    want = sorted((-(v[0] * rows[40][1][0] + v[1] * rows[40][1][1]), i) for i, v in rows if i != 40)[:20]
    assert [(round(r.score, 9), r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(round(-s, 9), i) for s, i in want]


def test_ann_edge_cases(spark):
    v = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [-1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]),
         (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (20, [float("inf"), 0.0]), (40, [0.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("v", F.lit(2))
    got = [tuple(r) for r in collision_ann.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 40, 0.0), (0, 4, 3, -1.0),
                   (40, 1, 0, 0.0), (40, 2, 1, 0.0), (40, 3, 2, 0.0), (40, 4, 3, 0.0)]
    assert collision_ann.nearest(df.where("vec_id is null")).count() == 0


# ---- n-gram Jaccard join ----

def brute_components(rows, percent=75, n=5):
    sets = collections.defaultdict(set)
    for d, t in rows:
        w = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets[d] |= {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_jaccard_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    shared = " ".join(rng.choices(vocab, k=60))
    rows = [(0, None), (1, ""), (2, "one two"), (3, "One  TWO\n"), (4, "one two three"), (5, "a b c d e"), (6, "A b c d E")]
    base = [rng.choices(vocab, k=80) for _ in range(12)]
    i = 10
    for b in base:                                   # near copies of growing distance, and chains
        words = list(b)
        for _ in range(9):
            rows.append((i, " ".join(words)))
            i += 1
            words[rng.randrange(len(words))] = rng.choice(vocab)
            if rng.random() < 0.5:
                words = words[1:] + [rng.choice(vocab)]
    big = rng.choices(vocab, k=120)
    for _ in range(60):                              # a large group around one text
        words = list(big)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i, " ".join(words)))
        i += 1
    for _ in range(20):                              # one passage in otherwise different texts
        rows.append((i, " ".join(rng.choices(vocab, k=150)) + " " + shared))
        i += 1
    rows.append((i, LONG))
    want = brute_components(rows)
    for rules in (ngram_join.JaccardRules(), ngram_join.JaccardRules(star_rounds=0), ngram_join.JaccardRules(block_bytes=3000, shard_bytes=2000)):
        got = {r[0]: (r[1], r[2]) for r in ngram_join.near_duplicates(frame(spark, rows, h=F.lit(1), elems=F.lit(2)), rules).collect()}
        assert got == want


def test_jaccard_repeats_null_ids_and_empty(spark):
    text = " ".join(f"t{i}" for i in range(30))
    got = [tuple(r) for r in ngram_join.near_duplicates(frame(spark, [(5, text), (5, text), (3, text), (None, text)])).collect()]
    assert sorted(got, key=str) == sorted([(5, 26, 3), (5, 26, 3), (3, 26, 3), (None, 26, None)], key=str)
    assert ngram_join.near_duplicates(frame(spark, [])).count() == 0


# ---- language model ----

def tokens(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + ["\n"]


def test_lm_base_scores_and_held_out_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(5000, None), (5001, ""), (5002, LONG), (5002, LONG)]
    train = collections.Counter()
    for d, t in rows:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            train.update(tokens(t))
    n, v = sum(train.values()), len(train)
    texts = dict(rows)
    got = brown_lm.score_lm(frame(spark, rows), brown_lm.BrownRules(block_words=5000)).collect()
    assert len(got) == len(rows)
    base = score = 0.0
    for r in got:
        ts = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            zlib.crc32(str(r.doc_id).encode()) % 7 == 2, len(ts), sum(train[t] > 0 for t in ts), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[t] + 1) / (n + v + 1)) for t in ts), rel=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
        if r.held_out:
            base, score = base + r.base_score, score + r.score
    assert score > base                              # better than add-one unigrams on unseen texts


def test_lm_probabilities_sum_to_one():
    """Over all known words and the unseen band, after any item."""
    rng = np.random.default_rng(2)
    names = np.sort(np.append(rng.integers(1, 2 ** 62, 9).astype(np.uint64), brown_lm.END))
    counts = rng.integers(20, 60, 10)
    band_tokens = np.zeros(brown_lm.BANDS, np.int64)
    band_tokens[1:4] = [7, 10, 11]
    vocab = brown_lm.Vocabulary(int(counts.sum() + 28), 10 + 14, names, counts, band_tokens)
    size = vocab.n_items
    bigrams = rng.integers(0, 5, (size, size))
    model = brown_lm.fit_classes(bigrams, vocab, brown_lm.BrownRules(classes=3))
    per_item = np.concatenate([band_tokens, counts]).astype(float)
    per_item[0] = 1.0                                # the unseen band emits itself
    emission = per_item / 10 ** model.mass[model.cls]
    used = (per_item > 0)
    for prev in range(size):
        step = 10 ** model.step[model.cls[prev], model.cls]
        empty = np.isin(np.arange(int(model.cls.max()) + 1), model.cls[used], invert=True)
        total = (step * emission)[used].sum() + (10 ** model.step[model.cls[prev]])[empty].sum()
        assert total == pytest.approx(1.0)


def test_exchange_groups_words_used_alike():
    """Two kinds of words alternate: the classes find them."""
    size = brown_lm.BANDS + 9
    names = np.append(np.arange(1, 9, dtype=np.uint64), brown_lm.END)
    order = np.argsort(names)
    bigrams = np.zeros((size, size), np.int64)
    for a in range(8):
        for b in range(8):
            if a % 2 != b % 2:
                bigrams[brown_lm.BANDS + a, brown_lm.BANDS + b] = 10 + (a * b) % 3
    vocab = brown_lm.Vocabulary(1000, 9, names[order], np.full(9, 50), np.zeros(brown_lm.BANDS, np.int64))
    cls = brown_lm.exchange(bigrams, vocab, brown_lm.BrownRules(classes=2, sweeps=20))
    word = cls[brown_lm.BANDS:brown_lm.BANDS + 8]
    assert len(set(word[::2])) == 1 and len(set(word[1::2])) == 1 and word[0] != word[1]


def test_lm_words_beyond_the_clustered_ones_get_classes(spark):
    """Two kinds of 60 words alternate; only a few words are clustered by
    exchange, yet after one kind only the words of the other are expected."""
    rng = random.Random(5)
    kinds = [[f"{k}{i}" for i in range(60)] for k in "ab"]
    rows = [(d, " ".join(rng.choice(kinds[i % 2]) for i in range(100))) for d in range(300)]
    rules = brown_lm.BrownRules(clustered=15, classes=2, sweeps=20)
    got = [r for r in brown_lm.score_lm(frame(spark, rows), rules).collect() if r.held_out]
    assert 10 ** (-sum(r.score for r in got) / sum(r.n_tokens for r in got)) < 75       # 60, and 120 for unsorted words


def test_lm_empty_table(spark):
    assert brown_lm.score_lm(frame(spark, [])).count() == 0


# ---- mixing ----

def brute_schedule(blocks, weights):
    """Slot by slot: every phase schedules the sources that have blocks left."""
    left, out = dict(blocks), []
    while any(left.values()):
        live = [s for s, n in left.items() if n]
        total = sum(Fraction(weights[s]) for s in live)
        share, done = {s: Fraction(weights[s]) / total for s in live}, dict.fromkeys(live, 0)
        t = 0
        while all(left[s] for s in live):
            ready = [(math.ceil((done[s] + 1) / w), -w, s is None, str(s), s) for s, w in share.items()
                     if math.floor(done[s] / w) <= t]
            s = min(ready, key=lambda r: r[:4])[4]
            done[s] += 1
            left[s] -= 1
            out.append(s)
            t += 1
    return out


def test_mixing_matches_slot_by_slot(spark):
    sizes = {"a": 700, "b": 90, "c": 33, None: 17}
    rows = [(i, f"t{i}", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("slot", F.lit("x")).withColumn("s", F.lit(1))
    rules = mixing.MixRules(block_rows=4, bucket_rows=50, piece_blocks=7)
    weights = {"a": 0.5, "b": 0.3, "c": 0.15, None: 0.05}
    got = mixing.mixed(df, weights, rules).select("_row.doc_id", "_source", "block", "slot", "place").collect()
    assert sorted(r.doc_id for r in got) == list(range(840))
    order = brute_schedule({s: -(-n // 4) for s, n in sizes.items()}, weights)
    at = collections.defaultdict(set)
    for r in got:
        at[r.slot].add((r._source, r.block))
    assert [next(iter(at[t]))[0] for t in range(len(order))] == order and all(len(x) == 1 for x in at.values())
    for s in sizes:
        by = sorted((r.slot, r.block, r.place) for r in got if r._source == s)
        assert [(b, p) for _, b, p in by] == [(i // 4, i % 4) for i in range(sizes[s])]
    other = mixing.mixed(df, weights, mixing.MixRules(block_rows=4, bucket_rows=50, broadcast_blocks=0, broadcast_sources=0))
    assert sorted(other.select("_row.doc_id", "slot", "place").collect()) == sorted((r.doc_id, r.slot, r.place) for r in got)
    mixed_rows = mixing.mix_order(df, weights, rules)
    assert mixed_rows.columns == df.columns and mixed_rows.count() == 840


@pytest.mark.parametrize("weights", [
    {"a": 1 / 3, "b": 2 / 3}, {"a": 0.1234567, "b": 1 - 0.1234567}, {f"s{i}": (i * i + 1) ** 0.5 for i in range(12)},
    {"big": 499.0} | {f"s{i}": 1.0 for i in range(999)}], ids=["thirds", "odd", "roots", "many"])
def test_mixing_deviation_below_one_block(weights):
    slots = 1_000_000 if len(weights) == 2 else 100_000
    total = sum(map(Fraction, weights.values()))
    blocks = {s: int(slots * Fraction(w) / total) + 2 for s, w in weights.items()}
    for s, at in mixing.schedule(blocks, weights).items():
        at = np.array(at)
        at = at[at < slots]
        w, n = float(Fraction(weights[s]) / total), np.arange(len(at))
        # before its k-th block runs a source has k blocks, after it k + 1
        assert (np.abs(n - w * at) < 1 + 1e-9).all() and (np.abs(n + 1 - w * (at + 1)) < 1 + 1e-9).all()


def test_mixing_of_many_sources():
    blocks = {f"s{i}": 1 + i % 7 for i in range(5_000)}
    plan = mixing.schedule(blocks, {s: 1.0 + i % 3 for i, s in enumerate(blocks)})
    assert {s: len(at) for s, at in plan.items()} == blocks
    assert sorted(t for at in plan.values() for t in at) == list(range(sum(blocks.values())))


def test_mixing_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, source string")
    assert mixing.mixed(empty).count() == 0
    same = spark.createDataFrame([(1, "a")] * 40 + [(None, "b")] * 3, "doc_id long, source string")
    assert mixing.mixed(same).count() == 43
    with pytest.raises(ValueError):
        mixing.mixed(same, {"a": 1.0})


# ---- pipeline ----

def test_pipeline_stages(spark):
    import corpus_pipeline as p
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    rows = docs.collect()
    at, out = docs, {}
    for name, stage in p.STAGES:
        at = p.written(stage(spark, at, SF0001), "test-stage")
        out[name] = at.collect()
        if name != p.STAGES[-1][0]:
            assert at.columns == docs.columns and dict(at.dtypes) == dict(docs.dtypes)
    kept = out["quality rules"]
    from test_text_operators import base_counts
    for r in kept:
        n, _, _, _, rep = base_counts(r.text)
        assert n >= 50 and 100 * rep <= 50 * n
    assert {tuple(r) for r in kept} <= {tuple(r) for r in rows}
    lined = out["line dedup"]
    assert [r.doc_id for r in sorted(lined)] == [r.doc_id for r in sorted(kept)]
    assert all(r.n_chars == len(r.text) for r in lined)
    groups = brute_components([(r.doc_id, r.text) for r in lined])
    once = out["n-gram Jaccard join"]
    assert sorted(r.doc_id for r in once) == sorted({c for _, c in groups.values()})
    assert sorted(map(tuple, out["mixing to target weights"])) == sorted(map(tuple, once))
    full = pieces_ok(out["packing"], {r.doc_id: [r.text] for r in once})
    assert full[False] <= 1
    assert p.run(spark, SF0001).count() == len(out["packing"])


@pytest.mark.parametrize("case", ["rows", "empty"])
def test_pipeline_stages_on_odd_tables(spark, case):
    """Nulls in any column, repeated rows, a long text, clashing columns; no rows."""
    import corpus_pipeline as p
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    if case == "empty":
        docs = docs.limit(0)
    else:
        odd = docs.orderBy("doc_id").limit(12)
        nulls = [odd.withColumn(c, F.lit(None).cast(docs.schema[c].dataType)) for c in docs.columns]
        docs = docs.unionByName(odd).unionByName(odd.withColumn("text", F.repeat("text", 60)))
        for n in nulls:
            docs = docs.unionByName(n)
    clash = ["_copy", "_metadata", "_row", "slot", "block", "component_id", "kept", "shard", "row", "file", "s", "v"]
    docs = p.written(docs.withColumns({c: F.lit(c) for c in clash}), "test-odd")
    columns = docs.columns
    for name, stage in p.STAGES:
        before = docs.count()
        docs = p.written(stage(spark, docs, SF0001), "test-odd-stage")
        if name != p.STAGES[-1][0]:
            assert docs.columns == columns and docs.count() <= before
            assert docs.count() == before or name in ("quality rules", "n-gram Jaccard join")
            assert all(r[c] == c for r in docs.collect() for c in clash)
            assert case == "empty" or docs.count() > 0
    assert (docs.count() == 0) == (case == "empty")


def test_mixed_order_reaches_the_sequences(spark):
    """Prefixes of the packed sequences hold the sources by their weights."""
    import corpus_pipeline as p
    sizes = {"a": 3_000, "b": 750}
    rows = [(i, " ".join(f"{s}{i} word {j}" for j in range(8)), s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = p.written(mixing.mix_order(docs, {"a": 0.8, "b": 0.2}), "test-mixed")
    source = {r[0]: r[2] for r in rows}
    got = sorted(packing.pack(mixed, packing.PackRules(window=512, shard_tokens=20_000), in_order=True).collect(),
                 key=lambda r: (r.sequence_id, r.offset))
    ends = [i for i, (a, b) in enumerate(zip(got, got[1:])) if a.sequence_id >> 32 != b.sequence_id >> 32]
    assert len(ends) >= 4
    for i in ends:
        share = sum(source[r.doc_id] == "b" for r in got[:i + 1] if r.start == 0) / sum(r.start == 0 for r in got[:i + 1])
        assert abs(share - 0.2) < 0.03


def test_merged_labels_follow_links_between_components(spark):
    from margincast.llm.ngram_join import merged
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5)], "v long, c long")
    links = spark.createDataFrame([(2, 6), (2, 6), (1, 2), (6, 9), (7, 8)], "a long, b long")
    got = dict(merged(labels, links).collect())
    assert got == {1: 1, 2: 1, 5: 1, 6: 1, 9: 1, 7: 7, 8: 7}


@pytest.mark.parametrize("size", [1e200, 1.5e308, 1e-200])
def test_ann_of_vectors_of_any_finite_size(spark, size):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 8))
    x[7, 2] = size
    x[20] *= size
    rows = [(i, [float(c) for c in np.nan_to_num(v, posinf=1.7e308, neginf=-1.7e308)]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in collision_ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {0, 20, 40} and all(len(v) == 20 for v in got.values())
    given = np.array([v for _, v in rows])
    hits = 0
    for q, found in got.items():
        with np.errstate(over="ignore", invalid="ignore"):
            s = (given * given[q]).sum(axis=1)
        s[q] = -np.inf
        assert all(f == s[i] for i, f in found if np.isfinite(s[i]))
        best = [i for i in np.lexsort((np.arange(60), -np.nan_to_num(s, nan=-np.inf, posinf=np.inf, neginf=-np.inf)))[:20]]
        hits += len({i for i, _ in found} & set(best))
    assert hits >= 0.9 * 60
