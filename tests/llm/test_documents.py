"""Operators on documents against brute-force versions, with nulls, empty and long texts, ties and empty tables."""

import collections
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loamgraph.llm import brown, minhash, packing, pieces, secrets, shards, toxicity

DOCS = "doc_id long, text string, spans string, ids string, label int"


def docs_of(spark, rows):
    """Documents with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "s", "i", 1) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    make = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base = make(200)
    edited = base.split()
    edited[50] = "changed"
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, base), (4, base), (5, " ".join(edited)), (6, base.upper()), (7, "one"), (8, "ONE"), (9, "one two"), (10, make(30_000))]
    rows += [(20 + i, make(rng.randint(1, 120))) for i in range(60)]
    for i in range(30):  # a chain and stars of edited copies
        w = base.split()
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((100 + i, " ".join(w)))
    return rows


def shingle_sets(rows, k):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    return out


def brute_components(sets, percent=80):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, texts, k):
    got = minhash.near_duplicates(docs_of(spark, texts), words=k).collect()
    sets = shingle_sets(texts, k)
    want = brute_components(sets)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_near_duplicates_edges(spark):
    assert minhash.near_duplicates(docs_of(spark, [])).count() == 0
    got = minhash.near_duplicates(docs_of(spark, [(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, "a b c d e f")])).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.component_id, r.kept) for r in got if r.doc_id) == [(False, 2, 2, True), (False, 2, 2, True), (False, 3, 2, False)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(2, False)]
    # rows that share an id and differ in text are documents of their own
    got = minhash.near_duplicates(docs_of(spark, [(1, "a b c d e f"), (1, "u v w x y z"), (0, "u v w x y z"), (None, "k l m n o p")])).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == [(0, 0, True), (1, 0, False), (1, 1, True), (None, None, True)]


def test_deduplicate_keeps_one_row_of_each_component(spark, texts):
    rows = [*texts, *texts[3:6], (3, "another text that shares the id of a copy"), (None, texts[3][1]), (None, "a text of its own without any id"), (None, None), (1, "")]
    df = docs_of(spark, rows).withColumn("_lm_row", F.lit(1)).withColumn("row", F.lit("x"))
    got = minhash.deduplicate(df).collect()
    sets = shingle_sets(list(enumerate(t for _, t in rows)), 5)
    component = brute_components(sets)
    want = {(i, t) for i, t in rows if not (t or "").split()}
    for c in {component[k] for k in sets if sets[k]}:
        members = [rows[k] for k in sets if sets[k] and component[k] == c]
        least = min(members, key=lambda r: (r[0] is None, r[0]))[0]
        kept = [(r.doc_id, r.text) for r in got if (r.doc_id, r.text) in members]
        assert len(kept) == 1 and kept[0][0] == least
        want.add(kept[0])
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)
    assert all(r._lm_row == 1 and r.row == "x" and r.label == 1 for r in got)


def test_large_mixed_buckets_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(500)]
    rows, n = [], 0
    for family in range(2):  # members share most of a text, so buckets are large, and hold many components
        base = rng.choices(vocabulary, k=120)
        for _ in range(60):
            w = base.copy()
            at = rng.randrange(100)
            w[at : at + 14] = rng.choices(vocabulary, k=14)
            rows.append((n, " ".join(w)))
            n += 1
            if rng.random() < 0.4:
                w[rng.randrange(120)] = "edited"
                rows.append((n, " ".join(w)))
                n += 1
    want = brute_components(shingle_sets(rows, 5))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == want and 10 < len(set(want.values())) < len(rows)


def test_blocks_find_what_pairs_find():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 300 - k], rng.integers(0, 2**63, k).astype(np.uint64)])) for k in range(0, 160, 8)]
    mins = minhash.minima(sets)
    sig, bands = minhash.packed_bits(mins).view(np.uint64), minhash.band_keys(mins)
    n = np.array([len(x) for x in sets])
    a, b = minhash.candidates(np.arange(len(sets)) // 2, np.zeros(len(sets), bool), list(bands), sig, n, 80)
    found = set(zip(a.tolist(), b.tolist(), strict=True))
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            likely = minhash.lane_estimate(sig[[i]], sig[[j]])[0] >= 0.8 - minhash.SLACK
            assert ((i, j) in found) == bool(i // 2 != j // 2 and likely and (bands[i] == bands[j]).any() and min(n[i], n[j]) * 100 >= max(n[i], n[j]) * 80)
    common = minhash.intersections([s.view(np.int64) for s in sets], a, b)
    assert common.tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)]


def test_estimate_follows_similarity(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for share in (0.5, 0.8, 0.95):
        n = int(4000 * share)
        b = np.concatenate([a[:n], rng.integers(0, 2**63, 4000 - n).astype(np.uint64)])
        bits = minhash.packed_bits(minhash.minima([a, b])).tolist()
        got = spark.createDataFrame([(bits[0], bits[1])], "a array<long>, b array<long>").select(minhash.estimate("a", "b")).first()[0]
        assert abs(got - n / (8000 - n)) < 0.12


def base_spans(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_secrets(spark, texts):
    rng = random.Random(3)
    noise = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=40))
    more = [
        (500, 'é PassWord = "abcd.efgh" then secret:token: abcdefghij and token=short'),
        (501, "xAKIAABCDEFGHIJKL AKIASHORT " + "0123456789abcdef" * 2 + "g"),
        (502, f"ünder the key {noise} and get_customer_account_balance_for_transaction"),
        (503, "getCustomerAccountBalanceForTransaction = equipment-management-configuration 2024-01-01-000000000123"),
        (504, "ſecret=abcdefghijkl toKen=abcdefghijkl"),
        (505, "z" * 5000 + " " + "=" * 3000),
    ]
    got = {r.doc_id: [(s.start, secrets.KINDS.index(s.kind), s.end) for s in r.spans] for r in secrets.find_secrets(docs_of(spark, texts + more)).collect()}
    for i, t in texts + more:
        assert [s for s in got[i] if s[1] < 3] == base_spans(t or "")
        assert got[i] == sorted(got[i])
    assert [s for s in got[502] if s[1] == 3] == [(14, 3, 54)]
    assert not [s for i in (503, 505) for s in got[i]]
    assert not [s for i, _ in texts for s in got[i]]
    redacted = {r.doc_id: r for r in secrets.redact_secrets(docs_of(spark, texts + more)).collect()}
    assert noise not in redacted[502].text and redacted[502].spans == "s"
    assert all(redacted[i].text == t for i, t in texts)
    assert secrets.find_secrets(docs_of(spark, [])).count() == 0


def test_markov_held_out():
    import random as r

    samples = secrets.labelled_samples(12_000, seed=1)
    r.Random(0).shuffle(samples)
    model = secrets.train(samples[:9000])
    flagged = lambda t: secrets.ratio(model, t) >= max(secrets.MIN_TOTAL, secrets.MIN_PER_CHAR * len(t))
    held = [(t, y) for t, y in samples[9000:] if len(t) >= 20]
    assert np.mean([flagged(t) for t, y in held if y]) > 0.85
    assert np.mean([flagged(t) for t, y in held if not y]) < 0.01


def test_shards(spark, texts):
    rows = texts + [texts[3]] * 40
    got = shards.shard(docs_of(spark, rows), 7, bucket_rows=16).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(rows)
    sizes = collections.Counter(r._ls_shard for r in got)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(7):
        assert sorted(r._ls_slot for r in got if r._ls_shard == s) == list(range(sizes[s]))
    again = shards.shard(docs_of(spark, rows), 7, bucket_rows=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    order = [r.doc_id for r in sorted(got, key=lambda r: (r._ls_shard, r._ls_slot))]
    assert order != sorted(order)
    assert shards.shard(docs_of(spark, []), 7).count() == 0
    few = shards.shard(docs_of(spark, [(None, None), (1, "a")]), 24).collect()
    assert len(few) == 2 and all(r._ls_slot == 0 for r in few)


def test_fisher_yates_steps(spark):
    import xxhash

    n, seed, bucket = 9, 11, 3
    got = spark.createDataFrame([(bucket, n)], "b long, n int").select(shards._fisher_yates("b", "n", seed).alias("o")).first().o
    want = list(range(n))

    def hash64(*parts):
        h = 42
        for p, size in parts:
            h = xxhash.xxh64(int(p).to_bytes(size, "little"), seed=h).intdigest()
        return h - (1 << 64) if h >> 63 else h

    for i in range(n - 1, 0, -1):
        j = hash64((seed, 4), (bucket, 8), (i, 4)) % (i + 1)
        want[i], want[j] = want[j], want[i]
    assert got == want


def test_packing(spark, texts, monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    odd = [(700, "a  b \n c "), (701, " \n\n x"), (702, "日本 語　x"), (703, "it's  <|endoftext|> don't"), (704, " " * 300_000 + "x" * 50_000), (705, "naïve ½ ² café " * 2000), (None, "no id"), (None, "no id"), (3, texts[3][1])]
    rows = [(i, x) for i, x in texts] + odd
    got = packing.pack_documents(docs_of(spark, rows)).collect()
    want = collections.Counter()
    for i, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or min(len(ids), 1024)
        cuts = [(0, first), *[(s, 1024) for s in range(first, len(ids), 1024)]]
        want.update((i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cuts))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert 50256 in t.encode(odd[3][1], add_special_tokens=False).ids
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(bins) <= 1.1 * total / 1024 + 1
    assert packing.pack_documents(docs_of(spark, [])).count() == 0
    whole = packing.tokenize(docs_of(spark, rows)).agg(F.sum(F.size("ids")).alias("n")).first()
    assert whole.n == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in rows)
    monkeypatch.setattr(packing, "BROADCAST_FIRSTS", 0)
    monkeypatch.setattr(packing, "SEND", 100)
    again = packing.pack_documents(docs_of(spark, rows)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_packed_sequences_hold_their_ids(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.pack_documents(docs_of(spark, texts)).collect()
    sequences = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert len(sequences[r.sequence_id]) == r.offset
        sequences[r.sequence_id] += r.ids
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    documents = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        documents[r.doc_id] += sequences[r.sequence_id][r.offset : r.offset + r.length]
    assert documents == {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in texts}


def test_best_two_fit():
    assert packing._tightest_pair(np.array([0, 1, 0, 2, 1, 1, 0, 0, 0]), 8) == [5, 3]
    assert packing._tightest_pair(np.array([0, 0, 1, 0, 0]), 4) is None
    plan = packing.plan_patterns({6: 2, 5: 1, 3: 2, 2: 2}, 10)  # 6+3 leaves 1; 3 gives way to nothing tighter than 2+2
    assert collections.Counter(n for lengths, times in plan for n in lengths for _ in range(times)) == {6: 2, 5: 1, 3: 2, 2: 2}
    assert any(sorted(lengths) == [2, 2, 6] for lengths, _ in plan)
    assert all(sum(lengths) <= 10 for lengths, _ in plan)


def test_pieces(spark, texts):
    vocabulary = pieces.read_model(packing.tokenizer_path("piece_bpe_32k.model"))
    rows = texts + [(800, "  two  spaces "), (801, "日本☃\n\tx"), (802, " "), (803, "naïve café"), (None, "no id"), (None, "no id"), (804, "x" * 100_000)]
    coded = pieces.encode(docs_of(spark, rows), vocabulary)
    back = pieces.decode(coded, vocabulary).collect()
    assert all(r.decoded == (r.text or "") and r.label == 1 for r in back)
    assert len(back) == len(rows)
    assert pieces.decode(pieces.encode(docs_of(spark, []), vocabulary), vocabulary).count() == 0
    crossing = [("▁a", -1.0, pieces.NORMAL), ("▁b", -1.0, pieces.NORMAL), ("▁a▁b", -1.5, pieces.NORMAL), ("▁", -3.0, pieces.NORMAL)]
    assert [crossing[i][0] for i in pieces.Segmenter(crossing).encode("b a b a")] == ["▁b", "▁a▁b", "▁a"]
    assert "".join(crossing[i][0] for i in pieces.Segmenter(crossing[:2] + crossing[3:]).encode("b a b a")) == "▁b▁a▁b▁a"
    s = pieces.Segmenter(vocabulary)
    scores = {p: x for p, x, k in vocabulary if k == pieces.NORMAL}
    for text in ("▁hello", "▁unbelievable", "▁x☃y", "▁▁▁ab", "▁internationalization"):
        best = [0.0] + [float("-inf")] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(end):
                p = text[start:end]
                if p in scores:
                    best[end] = max(best[end], best[start] + scores[p])
                elif end - start == 1:
                    best[end] = max(best[end], best[start] + s.unknown)
        ids = s.best_path(text)
        total = sum(vocabulary[i][1] for i in ids if vocabulary[i][2] == pieces.NORMAL)
        unknown = sum(c not in s.single for c in text)
        assert abs(total + unknown * s.unknown - best[-1]) < 1e-9


def test_brown(spark, texts, monkeypatch):
    monkeypatch.setattr(brown, "COMMON", 150)  # so that some words are not common
    monkeypatch.setattr(brown, "HELD", 250)
    monkeypatch.setattr(brown, "FLUSH", 500)
    texts = [*texts, texts[20], (None, texts[21][1]), (None, None)]
    out, model, placed = brown.class_scores(docs_of(spark, texts))
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(r)
    key = lambda i: "" if i is None else str(i)
    hashes = lambda t: [int(h) for h in minhash.Shingler(1).words_of([(t or "").encode()])[0]]
    train, around, plain = collections.Counter(), collections.defaultdict(list), collections.Counter()
    known = {int(model.held[at]): model.classes[at] for at in model.common}
    for i, t in texts:
        if zlib.crc32(key(i).encode()) % 10:
            row = hashes(t)
            train.update(row)
            plain.update([*(t or "").encode().lower().split(), None])
            c = [model.k + 1, *(known.get(h, model.k) for h in row), model.k + 1]
            for at, h in enumerate(row, 1):
                around[h].append((c[at - 1], c[at + 1]))
    assert sorted(train.values())[-150] <= min(train[h] for h in known) and len(known) == 150
    table = {int(np.int64(r.h).view(np.uint64)): r for r in placed.collect()}
    assert len(table) > 20 and set(table) == set(train) - set(known)
    after, before = (model.pairs / model.pairs.sum(axis=a, keepdims=True) for a in (1, 0))
    for h, r in table.items():
        gain = [sum(np.log(before[b, c]) + np.log(after[c, a]) for b, a in around[h]) for c in range(model.k)]
        assert r.c == train[h] and gain[r["class"]] >= max(gain) - 1e-9
    classes = known | {h: r["class"] for h, r in table.items()}
    assert len(model.held) == 250 and all(classes[int(h)] == c for h, c in zip(model.held, model.classes, strict=True))
    sizes, k = collections.Counter(), model.k + 2
    for h, c in train.items():
        sizes[classes[h]] += c
    assert [sizes[c] for c in range(model.k)] == list(model.sizes)
    pairs, rows = np.full((k, k), brown.ADD_CLASS), []
    for i, t in texts:
        rows.append([k - 1, *(classes.get(h, k - 2) for h in hashes(t)), k - 1])
        if zlib.crc32(key(i).encode()) % 10:
            np.add.at(pairs, (rows[-1][:-1], rows[-1][1:]), 1)
    steps = np.log10(pairs / pairs.sum(axis=1, keepdims=True))
    n, v = sum(plain.values()), len(plain)
    want = collections.defaultdict(list)
    for (i, t), row in zip(texts, rows, strict=True):
        own = sum(np.log10(train[h] / sizes[classes[h]]) for h in hashes(t) if h in train)
        w = [*(t or "").encode().lower().split(), None]
        base = sum(np.log10((plain[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want[i].append((own + steps[row[:-1], row[1:]].sum(), base, len(w), sum(plain[x] > 0 for x in w)))
    for i, rows in want.items():
        mine = sorted((r.score, r.base_score, r.n_tokens, r.n_known) for r in got[i])
        assert len(mine) == len(rows)
        for a, b in zip(mine, sorted(rows), strict=True):
            assert a[2:] == b[2:] and abs(a[0] - b[0]) < 1e-6 * a[2] and abs(a[1] - b[1]) < 1e-6 * a[2]
        assert all(r.train_tokens == n and r.held_out == (zlib.crc32(key(i).encode()) % 10 == 0) for r in got[i])
    assert brown.class_scores(docs_of(spark, []))[0].count() == 0
    assert brown.class_scores(docs_of(spark, [(None, "a b"), (None, None)]))[0].count() == 2


def test_classes_help_held_out_texts(spark):
    rng = random.Random(12)
    left, right = [f"l{i}" for i in range(40)], [f"r{i}" for i in range(40)]
    rows = [(i, " ".join(w for _ in range(60) for w in (rng.choice(left), rng.choice(right)))) for i in range(200)]
    out, model, _ = brown.class_scores(docs_of(spark, rows))
    held = [r for r in out.collect() if r.held_out]
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held) and 2 <= model.rounds <= brown.ROUNDS


def test_exchange_finds_alternation():
    rng = np.random.default_rng(0)
    words = np.arange(20)  # even words follow odd ones
    text = np.array([rng.choice(words[words % 2 == i % 2]) for i in range(20_000)])
    k = brown.CLASSES + 2
    classes = rng.integers(0, 2, 20)
    for _ in range(4):
        contexts = np.zeros((20, 2 * k))
        np.add.at(contexts, (text[1:], classes[text[:-1]]), 1)
        np.add.at(contexts, (text[:-1], k + classes[text[1:]]), 1)
        bigrams = np.zeros((k, k))
        np.add.at(bigrams, (classes[text[:-1]], classes[text[1:]]), 1)
        classes = brown.exchange(classes, np.bincount(text, minlength=20), contexts, bigrams)
    assert not set(classes[::2]) & set(classes[1::2])


def test_toxicity(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(200)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 8 == 0
        lang = ("en", "de")[i % 16 // 8]
        text = rng.choices(words, k=rng.randint(5, 60))
        if toxic:
            for _ in range(3):
                text[rng.randrange(len(text))] = {"en": "zzidiot", "de": "quark" + rng.choice("abc")}[lang]
        rows.append((i, " ".join(text), lang, "extra"))
        if i < 300:
            labels.append((i, 1, int(toxic)))
    rows += [(900, None, None, "x"), (901, "", "en", "x"), (None, "plain " + " ".join(words), "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic string")
    known = spark.createDataFrame([*labels, (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, known)
    got = {r.doc_id: r for r in toxicity.predict(docs, chain).collect()}
    held = [i for i in range(300, 400)]
    assert np.mean([(got[i].p_toxic >= toxicity.THRESHOLD) == (i % 8 == 0) for i in held]) > 0.97
    assert all(got[i].p_toxic < toxicity.THRESHOLD for i in (900, 901, None))
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, chain).collect()}
    assert kept == {i for i, r in got.items() if r.p_toxic < toxicity.THRESHOLD}
    nothing = toxicity.train(docs, known.where("false"))
    assert all(r.p_toxic < 0.01 for r in toxicity.predict(docs, nothing).collect())
    assert toxicity.predict(docs.where("false"), chain).count() == 0


def test_chain_uses_earlier_categories():
    rng = np.random.default_rng(2)
    n = 600
    f = rng.integers(0, 2, (n, 3))
    first = f[:, 0] & f[:, 1]
    y = np.stack([first, first & f[:, 2]], axis=1)
    text_of, feature = np.nonzero(f)
    chain = toxicity.fit_chain(["a", "b"], np.arange(3, dtype=np.uint64), text_of, feature, y)
    p = chain.predict(text_of, feature, n)
    assert ((p > 0.5) == y).mean() > 0.98 and chain.links[1][0] > 0.5


def test_models_learn_from_a_table_of_samples(spark):
    rows = [(t, y) for t, y in secrets.labelled_samples(3000, seed=2)] + [(None, 1), ("x", None)]
    model = secrets.train_from(spark.createDataFrame(rows, "token string, label int"))
    assert np.allclose(model, secrets.train([(t, y) for t, y in rows if t is not None and y is not None]))
    noise = "".join(random.Random(4).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=40))
    got = secrets.find_secrets(docs_of(spark, [(None, noise), (None, noise), (1, "get_customer_account_balance_for_transaction")]), model=model).collect()
    assert sorted(len(r.spans) for r in got) == [0, 1, 1]
    assert secrets.train_from(spark.createDataFrame([], "token string, label int")).any() == False  # noqa: E712


def test_features_of_a_fold_are_chosen_without_it(spark):
    told = [(1, 9, 0, 0, 9, 0, 0), (2, 5, 5, 5, 5, 5, 5), (3, 5, 5, 5, 0, 0, 0)]
    df = spark.createDataFrame(told, "h long, n_0 int, n_1 int, n_2 int, hits_0 int, hits_1 int, hits_2 int")
    chosen, masks = toxicity.choose_features(df, np.array([50.0, 50.0, 50.0]), np.array([14.0, 5.0, 5.0]))
    assert chosen.tolist() == [1, 2] and masks.tolist() == [[False, True], [True, True], [True, True], [True, True]]


def test_order_of_files_does_not_follow_their_splits(spark, texts, tmp_path):
    docs_of(spark, texts + [texts[3]] * 30).repartition(3).write.parquet(str(tmp_path / "d"))
    spark.read.parquet(str(tmp_path / "d"))
    key = "spark.sql.files.maxPartitionBytes"
    got = []
    for size in ("128m", "20k"):
        spark.conf.set(key, size)
        got.append(sorted(map(str, shards.shard(spark.read.parquet(str(tmp_path / "d")), 5, bucket_rows=16).collect())))
    spark.conf.unset(key)
    assert got[0] == got[1]


def test_buckets_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(shards, "BUCKET_BYTES", 4000)
    df = docs_of(spark, [(i, "x" * 900) for i in range(200)])
    taken = []
    scatter = shards.scatter
    monkeypatch.setattr(shards, "scatter", lambda rows, seed, buckets: taken.append(buckets) or scatter(rows, seed, buckets))
    assert shards.shard(df, 3).count() == 200 and taken[0] >= 45


def test_toxicity_features_need_little_memory(monkeypatch):
    rng = random.Random(6)
    make = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(1, 12))) for _ in range(n)).encode()
    batch = pa.RecordBatch.from_pydict({"_text": [make(400) for _ in range(1000)], "_fold": [i % 3 for i in range(1000)], "_c0": [i % 2 for i in range(1000)]})
    long = b"\t".join([make(300), "ä".encode() * 400, b" " * 900, make(300)])
    texts = [long, b"", make(40), long[:300], long, b"x" * 700, b" " * 800, make(9)]
    chosen = np.unique(toxicity.features_of(minhash.Shingler(1), [long])[1])[::3]

    def found(places):
        out = []
        for first, run in minhash.slices(pa.array(texts, pa.binary()), toxicity.RUN_BYTES):
            t, f = toxicity.features_of(minhash.Shingler(1), run, places)
            out += zip((first + t).tolist(), f.tolist())
        return out

    def counted():
        table = pa.Table.from_batches(toxicity.tell(iter([batch]))).group_by("h").aggregate([(c, "sum") for c in toxicity.COUNTED])
        return table.sort_by("h").to_pydict()

    once = [found(None), found(chosen)]
    tracemalloc.start()
    for work in (lambda: toxicity.features_of(minhash.Shingler(1), [long * 1500]), lambda: collections.deque(toxicity.tell(iter([batch])), 0)):
        tracemalloc.reset_peak()
        work()
        assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()
    whole = counted()
    for size in (16, 64, 1 << 11):  # the cuts change nothing
        monkeypatch.setattr(toxicity, "RUN_BYTES", size)
        assert [found(None), found(chosen)] == once
    monkeypatch.setattr(toxicity, "RUN_BYTES", 1 << 15)
    assert counted() == whole and sum(whole[f"n_{k}_sum"][0] for k in range(3)) > 0
