"""The operators that run Python on the executors, against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import hmm, jaccard, pieces, repeats, topk, toxicity
from graphloom.llm.common import words_of

DOCS = "doc_id long, text string, extra string, score double, held_out boolean, digest string, id long"


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t, "e", 0.5, True, "d", 7) for i, t in enumerate(texts)], DOCS)


def prose(n, seed=0, words=40):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ba", "Ko", "é", "zu", "mi") for b in ("ta", "lu.", "re", "n", "so,")]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, words))) for _ in range(n)]


# ---- language model


def test_forward_is_the_sum_over_all_paths():
    rng = np.random.default_rng(0)
    frequency = rng.random(hmm.SYMBOLS)
    model = hmm.Model.first(frequency / frequency.sum(), 3)
    symbols = rng.integers(0, hmm.SYMBOLS, 900).astype(np.int32)
    offsets = np.array([0, 4, 5, 300, 900])
    got = hmm.Segments(symbols, offsets).scores(model)

    def total(xs):
        p = model.start
        for x in xs:
            p = (p @ model.move) * model.emit[x]
        return p.sum()

    assert got[0] == pytest.approx(math.log(total(symbols[:4])))
    state, log = model.start, 0.0
    for x in symbols[300:]:
        state = (state @ model.move) * model.emit[x]
        log += math.log(state.sum())
        state = state / state.sum()
    assert got[3] == pytest.approx(log)


def test_baum_welch_climbs(spark):
    texts = [" ".join(random.Random(i).choices(["der", "die", "das"] if i % 2 else ["the", "a", "of"], k=30)) for i in range(80)]
    lists, _, _ = hmm.encoded_texts([t.encode() for t in texts], {w: i for i, w in enumerate([b"der", b"die", b"das", b"the", b"a", b"of"])})
    n = np.bincount(lists.values.to_numpy(), minlength=hmm.SYMBOLS) + 0.1
    df = spark.createDataFrame([(x.as_py(),) for x in lists], "ids array<int>").repartition(3)
    model, scores = hmm.train(df, n / n.sum(), states=2, iterations=6)
    assert all(b > a for a, b in zip(scores, scores[1:]))
    assert scores[-1] > float((np.log10(n / n.sum())[lists.values.to_numpy()]).sum())
    assert model.move.sum() == pytest.approx(2) and model.emit.sum() == pytest.approx(2)


def test_scores_and_base(spark):
    texts = [*prose(120, 4), None, "", "rareword " * 50, "x" * 3000, "unseen", "very long " * 60_000]
    ids = list(range(len(texts)))
    got = {r["doc_id"]: r for r in hmm.score_documents(docs_of(spark, texts), states=2, iterations=2).collect()}
    counts, ends = Counter(), 0
    for i, t in zip(ids, texts, strict=True):
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(words_of(t))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    for i, t in zip(ids, texts, strict=True):
        words, r = words_of(t), got[i]
        want = sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in [*(counts[w] for w in words), ends])
        assert r["base_score"] == pytest.approx(want)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words) + 1, sum(w in counts for w in words) + 1, n)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0) and r["score"] < 0


def test_words_outside_the_head_keep_exact_counts(spark, monkeypatch):
    texts = prose(60, 9)
    whole = {r["doc_id"]: r["base_score"] for r in hmm.score_documents(docs_of(spark, texts), 2, 1).collect()}
    monkeypatch.setattr(hmm, "head_words", lambda counts: hmm_head(counts))
    part = {r["doc_id"]: r["base_score"] for r in hmm.score_documents(docs_of(spark, texts), 2, 1).collect()}
    assert part == pytest.approx(whole)


def hmm_head(counts):
    top = counts.agg(F.max("c")).first()[0]
    return counts.filter(F.col("c") >= top), counts.filter(F.col("c") < top)


def test_the_head_is_filled(spark):
    counts = spark.createDataFrame([(f"w{i}", 1 + (i % 7) * (i % 3)) for i in range(900)], "word string, c long")
    for most in (1, 40, 300, 700, 899, 900, 5000):
        head, tail = hmm.head_words(counts, most)
        top, rest = head.collect(), tail.collect()
        assert len(top) + len(rest) == 900 and min(most, 900) - 3 <= len(top) <= most
        assert not top or not rest or min(r["c"] for r in top) >= max(r["c"] for r in rest)
    # one class that is larger than the head: it is cut by hash, not left out
    head, tail = hmm.head_words(spark.createDataFrame([(f"w{i}", 1) for i in range(900)], "word string, c long"), 500)
    assert 480 <= head.count() <= 500 and tail.count() == 900 - head.count()


def plain_pass(model, texts):
    """Expected counts by the textbook: forward and backward over whole texts, without segments or scaling."""
    k = len(model.start)
    emitted, moved, started = np.zeros((hmm.SYMBOLS, k)), np.zeros((k, k)), np.zeros(k)
    for xs in texts:
        n = len(xs)
        alpha, beta = np.zeros((n + 1, k)), np.ones((n + 1, k))
        alpha[0] = model.start
        for t, x in enumerate(xs):
            alpha[t + 1] = (alpha[t] @ model.move) * model.emit[x]
        for t in range(n - 1, -1, -1):
            beta[t] = model.move @ (model.emit[xs[t]] * beta[t + 1])
        total = alpha[n].sum()
        started += alpha[0] * beta[0] / total
        for t, x in enumerate(xs):
            emitted[x] += alpha[t + 1] * beta[t + 1] / total
            moved += alpha[t][:, None] * model.move * (model.emit[x] * beta[t + 1])[None, :] / total
    return emitted, moved, started


def test_expected_counts_against_brute_force(monkeypatch):
    monkeypatch.setattr(hmm, "SEGMENT", 7)
    rng = np.random.default_rng(4)
    frequency = rng.random(hmm.SYMBOLS)
    model = hmm.Model.first(frequency / frequency.sum() * 1000, 3)  # short texts: plain products do not underflow
    model.move[:] = rng.dirichlet(np.ones(3), 3)
    texts = [rng.integers(0, hmm.SYMBOLS, n) for n in (1, 6, 7, 8, 30)]
    symbols = np.concatenate(texts).astype(np.int32)
    got = np.zeros((hmm.SYMBOLS, 3)), np.zeros((3, 3)), np.zeros(3)
    hmm.Segments(symbols, np.cumsum([0, *map(len, texts)])).counts(model, *got)
    for a, b in zip(got, plain_pass(model, texts), strict=True):
        assert np.allclose(a, b)


def test_trained_scores_against_brute_force(spark):
    """Two passes of plain Baum-Welch on whole texts, and log10 of the plain sum over paths."""
    texts = [" ".join(random.Random(i).choices(["der", "die", "das"] if i % 2 else ["the", "a", "of"], k=6)) for i in range(40)] + ["", "the new word"]
    got = {r["doc_id"]: r["score"] for r in hmm.score_documents(docs_of(spark, texts), states=2, iterations=2).collect()}
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for i in train for w in texts[i].split())
    place = {w: i for i, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0])))}
    n = np.zeros(hmm.SYMBOLS)
    for w, c in counts.items():
        n[place[w]] = c
    n[hmm.END] = len(train)
    frequency = (n + 0.1) / (n + 0.1).sum()
    encode = lambda t: [place[w] if w in place else hmm.HEAD + zlib.crc32(w.encode()) % hmm.TAIL for w in t.split()] + [hmm.END]
    model = hmm.Model.first(frequency, 2)
    for _ in range(2):
        emitted, moved, started = plain_pass(model, [encode(texts[i]) for i in train])
        emit = emitted + hmm.BORROWED * frequency[:, None]
        model = hmm.Model((started + 0.1) / (started + 0.1).sum(), (moved + 0.1) / (moved + 0.1).sum(axis=1)[:, None], emit / emit.sum(axis=0))
    for i, t in enumerate(texts):
        state = model.start
        for x in encode(t):
            state = (state @ model.move) * model.emit[x]
        # an unseen word has all of the empty share of its bucket: 0.1 of the 0.1 that the bucket has
        assert got[i] == pytest.approx(math.log10(state.sum()))


def test_ids_of_any_type_and_clashing_columns(spark):
    df = spark.createDataFrame([("a7", "x y", 1, "b"), (None, None, 2, "c"), ("a7", "x y", 1, "b")], "doc_id string, text string, row int, ids string")
    got = hmm.score_documents(df, 2, 1).collect()
    assert sorted((r["doc_id"] or "", r["n_tokens"]) for r in got) == [("", 1), ("a7", 3), ("a7", 3)]


def test_probabilities_of_one_word_texts_sum_to_one(spark):
    """All known words, and the unseen word of each bucket, as first tokens: their probabilities add up."""
    model = hmm.Model.first(np.full(hmm.SYMBOLS, 1 / hmm.SYMBOLS), 2)
    first = (model.start @ model.move) @ model.emit.T
    assert first.sum() == pytest.approx(1)


def test_no_documents(spark):
    assert hmm.score_documents(docs_of(spark, []), 2, 1).count() == 0


# ---- toxicity


def labelled(spark, n=700):
    rng = random.Random(5)
    texts, labels = [], []
    for i, t in enumerate(prose(n, 6)):
        toxic = rng.random() < 0.3
        words = t.split()
        if toxic:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(["vile", "nasty", "foul"]))
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    return texts, labels


def test_toxicity_holds_out(spark):
    texts, labels = labelled(spark)
    texts += [None, "", "vile " * 9000]
    found = spark.createDataFrame([*labels, (9999, 1), (3, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs_of(spark, texts), found).collect()}
    assert len(got) == len(texts)
    held = [(got[i]["predicted"], y) for i, y in labels if got[i]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert sum(p == y for p, y in held) > 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert got[702]["predicted"] == 1 and got[700]["score"] == got[701]["score"]


def test_toxicity_without_labels_and_clean_stage(spark):
    docs = docs_of(spark, ["a", None])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score_documents(docs, none).collect()} == {0.5}
    kept = toxicity.keep_clean(docs, none)
    assert kept.columns == docs.columns and kept.count() == 2


def test_ftrl_is_sparse():
    rng = np.random.default_rng(1)
    model = toxicity.Ftrl(l1=5.0, size=1000)
    for _ in range(400):
        y = int(rng.random() < 0.5)
        model.learn(np.unique(np.append(rng.integers(1, 1000, 20), 0 if y else 1)), y)
    w = model.weights(slice(None))
    assert w[0] > 0 > w[1] and np.count_nonzero(w) < 100


def test_ftrl_against_the_plain_rule():
    """Coordinate by coordinate: w from z and n, the gradient, then z and n, as published."""
    rng = np.random.default_rng(2)
    rows = [(np.unique(rng.integers(0, 12, 4)), int(rng.random() < 0.4)) for _ in range(60)]
    model = toxicity.Ftrl(l1=0.3, size=12)
    z, n, zb, nb = [0.0] * 12, [0.0] * 12, 0.0, 0.0

    def weight(i):
        if abs(z[i]) <= 0.3:
            return 0.0
        return -(z[i] - math.copysign(0.3, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for at, y in rows:
        model.learn(at, y)
        w = {int(i): weight(i) for i in at}
        b = -zb * toxicity.ALPHA / (toxicity.BETA + math.sqrt(nb))
        g = 1 / (1 + math.exp(-(sum(w.values()) + b))) - y
        for i in w:
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
            z[i] += g - sigma * w[i]
            n[i] += g * g
        sigma = (math.sqrt(nb + g * g) - math.sqrt(nb)) / toxicity.ALPHA
        zb += g - sigma * b
        nb += g * g
        assert np.allclose(model.weights(slice(None)), [weight(i) for i in range(12)])
        assert model.intercept() == pytest.approx(-zb * toxicity.ALPHA / (toxicity.BETA + math.sqrt(nb)))


def test_the_sample_is_bounded_in_features(spark, monkeypatch):
    texts, labels = labelled(spark, 300)
    rows = spark.createDataFrame([(i, t, y) for (i, y), t in zip(labels, texts, strict=True)], "doc_id long, text string, label int")
    whole = toxicity.fit(rows)
    monkeypatch.setattr(toxicity, "SAMPLE_FEATURES", 2000)
    part = toxicity.fit(rows)
    assert len(part[0]) < len(whole[0]) and len(whole[0])
    assert all(np.array_equal(a, b) for a, b in zip(part, toxicity.fit(rows.repartition(7)), strict=True))  # the same again


def test_toxicity_of_no_documents_and_ids_as_text(spark):
    labels = spark.createDataFrame([("7", 1)], "doc_id string, toxic int")
    assert toxicity.score_documents(spark.createDataFrame([], "doc_id string, text string"), labels).count() == 0
    got = toxicity.score_documents(spark.createDataFrame([("7", "x", 1.0)] * 2, "doc_id string, text string, score double"), labels).collect()
    assert len(got) == 2 and got[0] == got[1]


# ---- pieces


def test_pieces_equal_the_library(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(2)
    parts = [" ", "  ", "▁", "a", "the", "\n", "é", "☃", "\U0001f600", "\x00", ".", "ing", "\t", "\xa0", "日本", "<s>", "​", "x" * 90]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 15))) for _ in range(400)] + [None, "", " ", "long " * 20000, "y" * 50000]
    model = pieces.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
    digests = {r["doc_id"]: r for r in pieces.encoding_digests(docs_of(spark, texts), model).collect()}
    whole = {r["doc_id"]: r for r in pieces.encode_documents(docs_of(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert whole[i]["ids"] == ids and whole[i]["decoded"] == sp.decode(ids)
        assert digests[i]["n_tokens"] == len(ids)
        assert digests[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert digests[i]["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert pieces.encode_documents(docs_of(spark, []), model).count() == 0


@pytest.mark.parametrize("block", [40, 4 << 20])
def test_one_table_for_all_tasks_gives_the_same_rows(spark, monkeypatch, block):
    pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(pieces, "BLOCK", block)
    rng = random.Random(4)
    parts = [" ", "  ", "▁", "the", "\n", "é", "\U0001f600", "\x00", ".", "日本", "<s>", "x" * 90, "ﬁ"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 15))) for _ in range(150)] + [None, "", " ", "long " * 5000, "y" * 9000]
    model = pieces.default_model()
    for docs in (docs_of(spark, texts).union(docs_of(spark, texts[:20])).repartition(3), docs_of(spark, [])):
        table, plain = pieces.encoded_by_table(docs, model), pieces.encode_documents(docs, model)
        assert table.schema == plain.schema
        assert sorted(map(str, table.collect())) == sorted(map(str, plain.collect()))


def test_table_is_emptied_when_full(monkeypatch):
    pytest.importorskip("public_tokenizers")
    table = pieces.ChunkTable(pieces.default_model())
    monkeypatch.setattr(pieces, "TABLE", 12)
    for texts in (["a b c d", "e f"], ["g h i", None, "a  b e"], ["j k l m n o p q", "r s " + "y" * 70]):
        assert table.encode(texts) == [table._whole(t or "") for t in texts]
    assert len(table.ids) <= 12 and "y" * 70 not in table.ids


# ---- repeats


def by_hand(texts):
    seen, out = set(), {}
    for i, t in texts:
        b = (t or "").encode()
        covered = bytearray(len(b))
        for s in range(len(b) - 99):
            k = b[s : s + 100]
            if k in seen:
                covered[s : s + 100] = b"\1" * 100
            seen.add(k)
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        spans = sum(1 for j in range(len(b)) if covered[j] and (not j or not covered[j - 1]))
        out[i] = (len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeating(seed):
    rng = random.Random(seed)
    passages = [p * 6 for p in prose(6, seed, 30)]
    texts = []
    for _ in range(60):
        t = " ".join(rng.choice([*passages, *prose(3, rng.random())]) for _ in range(rng.randint(0, 4)))
        if texts and rng.random() < 0.4:
            t = rng.choice(texts) or ""
            if rng.random() < 0.6 and t:
                at = rng.randrange(len(t))
                t = t[:at] + "é" + t[at + 1 :]
        texts.append(t)
    return texts + [None, "", "a" * 99, "a" * 100, "a" * 500, "ab" * 300, "ß" * 120]


@pytest.mark.parametrize("limit", [2, 2048])
def test_repeats_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(repeats, "CLASS", limit)
    texts = list(enumerate(repeating(limit)))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.repeated_spans(docs_of(spark, [t for _, t in texts]).repartition(5)).collect()}
    assert got == by_hand(texts)


def test_plain_doubling_finds_the_same(spark, monkeypatch):
    monkeypatch.setattr(repeats, "WORK", 3000)
    docs = docs_of(spark, repeating(9))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(repeats.doubled_spans(docs)) == rows(repeats.repeated_spans(docs))


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(repeats, "WORK", 1000)
    monkeypatch.setattr(repeats, "_KNOWN", {})
    base = "".join(prose(40, 12))
    texts = list(enumerate([base * 2, "x" + base, base[500:] + "é" * 900, *repeating(5)]))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.repeated_spans(docs_of(spark, [t for _, t in texts])).collect()}
    assert got == by_hand(texts)


def test_hot_strings_are_spread_without_loss(spark, monkeypatch):
    line = "the same line that stands in many different places of all "
    texts = [f"{i * 7919} {line}{i * i} {line * (i % 3)}" + prose(1, i)[0] * 3 for i in range(120)]
    keyed = docs_of(spark, texts).select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("tag"), "text")
    monkeypatch.setattr(repeats, "HOT", 64)
    assert len(repeats.hot_grams(keyed))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.repeated_spans(docs_of(spark, texts).repartition(3)).collect()}
    assert got == by_hand(list(enumerate(texts)))


def test_repeated_rows_are_one_document(spark):
    t = "q" + prose(1, 3, 200)[0] * 2
    df = spark.createDataFrame([(1, t), (1, t), (2, t)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_removed"]) for r in repeats.repeated_spans(df).collect())
    want = by_hand([(1, t), (2, t)])
    assert got == [(1, want[1][1]), (1, want[1][1]), (2, len(t.encode()))]
    assert repeats.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- n-gram join


def similar_by_hand(texts):
    sets = []
    for t in texts:
        w = words_of(t)
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root, links = list(range(len(sets))), [0] * len(sets)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(sets))], links


def near_texts(seed):
    rng = random.Random(seed)
    base = [" ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randint(1, 90))) for _ in range(25)]
    texts = []
    for _ in range(160):
        words = rng.choice(base[:4] if rng.random() < 0.5 else base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            words[rng.randrange(len(words))] = f"n{rng.randrange(9999)}"
        texts.append(" ".join(words).upper() if rng.random() < 0.1 else " ".join(words))
    return [*texts, None, "", "  ", "one", "one", "One two"]


@pytest.mark.parametrize("block", [4, 128])
def test_join_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = near_texts(block)
    got = {r["doc_id"]: r for r in jaccard.similar_classes(docs_of(spark, texts).repartition(4)).collect()}
    classes, links = similar_by_hand(texts)
    assert [got[i]["class_id"] for i in range(len(texts))] == classes
    assert [got[i]["n_links"] for i in range(len(texts))] == links
    sizes = Counter(classes)
    assert all(got[i]["class_size"] == sizes[c] and got[i]["first"] == (i == c) for i, c in enumerate(classes))


def test_keep_one_each(spark):
    texts = near_texts(1)
    classes, _ = similar_by_hand(texts)
    docs = docs_of(spark, texts)
    kept = jaccard.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(classes))
    assert jaccard.keep_one_each(docs_of(spark, [])).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words")], "doc_id long, text string")
    assert sorted(r["text"] for r in jaccard.keep_one_each(twice).collect()) == ["a b c d e f", "other words"]


def test_pruning_follows_the_posterior():
    least = jaccard.fewest_matches()
    for n, m in least.items():
        tail = sum(math.comb(n + 1, x) * 0.8**x * 0.2 ** (n + 1 - x) for x in range(m))
        assert tail < jaccard.TOLERANCE <= tail + math.comb(n + 1, m) * 0.8**m * 0.2 ** (n + 1 - m)


# ---- top k


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "VECTORS", 64)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 256], 0) for i in range(300)]
    rows += [(350, None, 0), (400, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0], 0), (401, [float("inf")] + [0.0] * 5, 0), (402, [None] + [0.0] * 5, 0), (450, [0.5, 0.5], 0), (500, [], 0), (50, rows[50][1], 0)]
    got = {}
    for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    v = {i: np.floor(256 * np.float32(x).astype(float)).astype(int) for i, x, _ in rows[:300]}
    assert set(got) == set(range(0, 300, 50))
    for q in got:
        want = sorted((-int(v[q] @ v[i]), i) for i in v if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_top_k_keeps_all_vectors_of_an_id(spark, monkeypatch):
    monkeypatch.setattr(topk, "VECTORS", 16)
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = np.random.default_rng(5)
    rows = [(i % 60, [float(x) for x in rng.integers(-90, 91, 4) / 256]) for i in range(180)]
    rows += [(7, [0.5, 0.5, 0.5, j / 256]) for j in range(3)] + [rows[5]] * 4 + [rows[50]] * 2  # repeats are candidates too
    got = {}
    for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    v = [(i, np.floor(256 * np.float32(x).astype(float)).astype(int)) for i, x in rows]
    assert set(got) == {0, 50}
    for q in got:
        asks = {tuple(a): a for j, a in v if j == q}.values()
        want = sorted((-int(a @ b), i) for a in asks for i, b in v if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_top_k_stops_early():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(4000, 3))
    v[7] = [50, 50, 50]
    v[8] = [49, 50, 50]
    v = np.floor(v * 10).astype(np.int64)
    a, b, c, scored = topk.cell_top(np.array([[1, 1, 1]]), np.array([-1]), v, np.arange(4000), 2)
    assert sorted(b.tolist()) == [7, 8] and sorted(c.tolist()) == [1490, 1500] and scored[0] < 400
    # a kth score that is known already stops the search before it begins, or leaves what reaches it
    *none, scored = topk.cell_top(np.array([[1, 1, 1]]), np.array([-1]), v, np.arange(4000), 2, np.array([5000]))
    assert not len(none[1]) and scored[0] == 0
    a, b, c, scored = topk.cell_top(np.array([[1, 1, 1]]), np.array([-1]), v, np.arange(4000), 2, np.array([1500]))
    assert b.tolist() == [7] and scored[0] < 400


def test_the_bound_runs_on_over_cells(spark, monkeypatch):
    """Vectors with few large components: most are never scored, and fewer still with the bound of the first cell."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.exponential(0.05, 8) ** 3 * 200]) for i in range(1, 3001)]
    monkeypatch.setattr(topk, "VECTORS", 500)
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=100).collect()
    v = {i: np.floor(256 * np.float32(x).astype(float)).astype(int) for i, x in rows}
    for q in range(100, 3001, 100):
        want = sorted((-int(v[q] @ v[i]), i) for i in v if i != q)[:5]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q) == [(k + 1, i, -x) for k, (x, i) in enumerate(want)]
    assert sum(r["scored"] for r in got if r["rank"] == 1) < 0.8 * 30 * 3000


def test_top_k_of_no_vectors_and_clashing_columns(spark):
    schema = "vec_id long, embedding array<float>, id long, x string, n int, low int"
    assert topk.search(spark.createDataFrame([], schema)).count() == 0
    got = topk.search(spark.createDataFrame([(0, [1.0], 5, "a", 1, 1), (1, [2.0], 5, "a", 1, 1), (2, None, 5, "a", 1, 1)], schema)).collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 131072)]


def test_top_k_beyond_doubles():
    big = 2**28
    a, b, c, _ = topk.cell_top(np.array([[big, 1]]), np.array([0]), np.array([[big, 1], [big, 2], [big, 3]]), np.array([0, 1, 2]), 5)
    assert dict(zip(b.tolist(), c.tolist())) == {1: big * big + 2, 2: big * big + 3}


def test_cells_of_near_copies_stay_small():
    """All pairs of two full blocks survive: their signatures are compared some at a time."""
    import tracemalloc

    import pyarrow as pa

    n = 2 * jaccard.BLOCK
    sig = np.tile(np.arange(jaccard.HASHES, dtype=np.uint32), (n, 1))
    sig[:, -1] = np.arange(n)  # the last band differs
    columns = {"cell": np.full(n, 5), "band": np.zeros(n, np.int32), "block": np.arange(n, dtype=np.int32) % 2, "diagonal": np.zeros(n, bool), "uid": np.arange(n), "sig": [x.tobytes() for x in sig]}
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], list(columns))
    tracemalloc.start()
    (out,) = jaccard._survivors([batch])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    partners = dict(zip(out.column("uid").to_pylist(), out.column("partners").to_pylist()))
    assert all(sorted(partners[u]) == list(range(1, n, 2)) for u in range(0, n, 2)) and not any(partners[u] for u in range(1, n, 2))
    assert peak < 100e6  # before: over 300 MB


def test_all_but_first_of_a_pair_joins_nothing(spark):
    from graphloom.operators.scratch import written

    rows = [((1, 1), (i, 0, 0), i * 31) for i in range(500)] + [((2, 1), (7, 0, 3), 5), ((3, 1), (9, 0, 1), 6), ((3, 1), (8, 0, 2), 7), ((3, 1), (8, 0, 1), 8)]
    df = written(spark.createDataFrame(rows, "ranks struct<left:long,right:long>, place struct<id:long,tag:long,first:int>, row long"), "open")
    out = repeats.all_but_first(df)
    assert sorted(tuple(r["place"]) for r in out.collect()) == sorted([(i, 0, 0) for i in range(1, 500)] + [(9, 0, 1), (8, 0, 2)])
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
