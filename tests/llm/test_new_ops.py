"""Language-model scores, vector codes and spelling groups against brute force, and on odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("larkspur.llm.queries")
public_tokenizers = pytest.importorskip("public_tokenizers")
from larkspur.llm import attention_lm, ngram_jaccard, sharding, spelling, suffix_dedup, vector_codes  # noqa: E402
from larkspur.session import Scope, restaged, scoped, staged  # noqa: E402

SMALL = "/root/testdata/sf0.001"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
DOCS = "doc_id long, text string, word string, n int, `block` string"


# ------------------------------------------------ mended: see the operators' own tests


def test_op3_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROW_BITS", 2)
    monkeypatch.setattr(sharding, "BITS", sharding.ID_BITS + sharding.TEXT_BITS + 2)
    table = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("equal text of a row").alias("text"))
    got = sharding.extendible_shards(table, 100).collect()
    sums = collections.Counter((r["shard_depth"], r["shard_prefix"], r["shard_part"]) for r in got)
    assert len(got) == 3000 and max(sums.values()) * 19 <= 100 and all(r["shard_rows"] == sums[r["shard_depth"], r["shard_prefix"], r["shard_part"]] for r in got)


def test_op2_rows_are_documents(spark):
    """Any two rows without an id, or of one id, are told apart, whatever their texts hash to."""
    rng = random.Random(1)
    block = "".join(rng.choice("abcdefgh ") for _ in range(450))
    texts = ["x" * 30 + block + "y" * 40, "z" * 50 + block, "".join(rng.choice("ijkl ") for _ in range(300)) + block]
    for ids in ([None, None, 7], [3, 3, 3], [1, 2, 3]):
        got = suffix_dedup.suffix_dedup(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")).collect()
        assert sorted(sum(x["end"] - x["start"] for x in r["spans"]) for r in got) == [450, 450, 450], ids


def test_op1_keys_of_filled_fragments_only():
    rng = np.random.default_rng(0)
    for num, den in ((8, 10), (90, 100)):
        for n in (3, 6, 10, 25, 60, 200, 1000):
            for _ in range(40):
                most = n * (den - num) // num
                grams = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
                gone = rng.integers(0, most + 1)
                other = np.unique(np.concatenate([grams[gone:], rng.integers(0, 1 << 63, rng.integers(0, most + 1)).astype(np.uint64)]))
                common = len(np.intersect1d(grams, other))
                if len(grams) != len(other) and den * common >= num * (len(grams) + len(other) - common):
                    assert len(np.intersect1d(ngram_jaccard.fragment_keys(grams, num, den), ngram_jaccard.fragment_keys(other, num, den))), (n, num)
    # Documents without a common n-gram have no common key.
    keys = np.concatenate([ngram_jaccard.fragment_keys(np.unique(rng.integers(0, 1 << 63, 40).astype(np.uint64)), 8, 10) for _ in range(500)])
    assert len(np.unique(keys)) == len(keys)


def test_staged_tables_of_others_stay(spark):
    with Scope():
        other = staged(spark.range(5).toDF("x"), "other")

    @scoped
    def run():
        first = staged(spark.range(3).toDF("x"), "first")
        return first, restaged(first.withColumn("y", F.lit(1)), "second")

    first, second = run()
    assert other.count() == 5 and second.count() == 3
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
        first.collect()


# ------------------------------------------------------------ vector codes


def plain_codes(vectors, rounds=6, parts=8, entries=16):
    """(codes, errors, books) of whole-number vectors in the order of their ids."""
    pieces = np.split(np.array(vectors, dtype=object), parts, 1)
    books = [p[:entries].copy() for p in pieces]
    near = lambda: [((p[:, None] - b[None]) ** 2).sum(2) for p, b in zip(pieces, books, strict=True)]
    for _ in range(rounds):
        for p, b, d in zip(pieces, books, near(), strict=True):
            who = np.array([list(row).index(min(row)) for row in d])
            for e in range(len(b)):
                if (who == e).any():
                    b[e] = [sum(col) // int((who == e).sum()) for col in p[who == e].T]
    last = near()
    codes = [[list(d[i]).index(min(d[i])) for d in last] for i in range(len(vectors))]
    return codes, [sum(min(d[i]) for d in last) for i in range(len(vectors))], books


@pytest.mark.parametrize("block", [7, 4096])
def test_op12_is_brute_force(spark, block):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 0.5, -0.25, rng.gauss(0, 1)]) for _ in range(16)], rng.choice(["a", "b", None])) for i in range(90)]
    rows += [(100 + i, rows[i % 5][1], "a") for i in range(40)]  # equal vectors, and ties
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(3)
    got = {r["vec_id"]: r for r in vector_codes.vector_codes(table, block_rows=block).collect()}
    whole = [[math.floor(4096 * x) for x in v] for _, v, _ in rows]
    codes, errors, books = plain_codes(whole)
    by_label = collections.Counter()
    for (_, _, label), e in zip(rows, errors, strict=True):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for row in b for x in row).encode()).hexdigest()
    for (i, _, label), c, e in zip(rows, codes, errors, strict=True):
        r = got[i]
        assert (r["code"], r["error"], r["label_error"], r["codebooks_sha256"], r["label"]) == ("".join(f"{x:02x}" for x in c), e, by_label[label], digest, label)


def test_op12_tree():
    rng = np.random.default_rng(0)
    x = rng.integers(-50, 50, (800, 8))
    x[100:300] = x[0]
    tree = vector_codes.cover_tree(x)
    placed = x[tree["order"]]
    for node in range(len(tree["start"])):
        inside = placed[tree["start"][node] : tree["end"][node]]
        assert np.sqrt(((inside - placed[tree["center"][node]]) ** 2).sum(1)).max() <= tree["radius"][node] + 1e-9
        first, n = tree["child"][node], tree["children"][node]
        assert (n > 0) == (tree["radius"][node] > 0)
        if n:
            assert tree["start"][first] == tree["start"][node] and tree["end"][first + n - 1] == tree["end"][node]
            centers = placed[tree["center"][first : first + n]]
            apart = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(2)) + np.eye(n) * 1e9
            assert apart.min() > tree["radius"][node] / 2
    # Two far clusters and an entry in each: only the root and its children are looked at.
    far = np.concatenate([rng.integers(0, 9, (500, 8)), rng.integers(9000, 9009, (500, 8))])
    tree = vector_codes.cover_tree(far)
    nodes, entry, seen = vector_codes.descend(tree, far[tree["order"]], np.array([[4] * 8, [9004] * 8]))
    assert seen <= 3 and sorted((tree["end"] - tree["start"])[nodes].tolist()) == [500, 500] and len(set(entry.tolist())) == 2


def test_op12_odd_rows(spark):
    kinds = "vec_id long, embedding array<float>, label int, code string, v int"
    rows = [(5, [1.0] * 8, 1), (5, [0.0] * 8, 1), (None, [1.0] * 8, None), (7, None, 1), (8, [], 1), (9, [None] * 8, 1), (10, [float("nan")] * 8, 1), (11, [float("inf")] * 8, 1), (12, [1.0] * 16, 1), (13, [1e30] * 8, None)]
    table = spark.createDataFrame([(*r, "x", 0) for r in rows], kinds)
    got = vector_codes.vector_codes(table).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["13", "5", "5", "None"]
    assert {r["label"] for r in got} == {1, None} and len({r["codebooks_sha256"] for r in got}) == 1
    assert vector_codes.vector_codes(table.limit(0)).collect() == [] and vector_codes.vector_codes(table.where("vec_id = 7")).collect() == []
    with pytest.raises(ValueError):
        vector_codes.vector_codes(spark.createDataFrame([(1, [1.0] * 9, 1, "x", 0)], kinds))


# ---------------------------------------------------------- spelling groups


def plain_groups(words):
    def edits(w):
        letters = {c for x in words for c in x}
        for i in range(len(w) + 1):
            yield from (w[:i] + c + w[i:] for c in letters)
            if i < len(w):
                yield w[:i] + w[i + 1 :]
                yield from (w[:i] + c + w[i + 1 :] for c in letters)

    out = {}
    for w, n in words.items():
        near = {x for x in edits(w) if x in words and x != w}
        best = min(near, key=lambda x: (-words[x], x), default=None)
        out[w] = (best if best is not None and words[best] >= 2 * n else None, n, len(near))
    return out


@pytest.mark.parametrize("chars", [40, 2_000_000])
def test_op13_is_brute_force(spark, monkeypatch, chars):
    monkeypatch.setattr(spelling, "RANGE_CHARS", chars)
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))): rng.randint(1, 40) for _ in range(160)} | {"a" * 300: 2, "a" * 301: 9, "a" * 302: 30, "": 4}
    got = {r["word"]: r for r in spelling.spelling_groups(spark.createDataFrame([*words.items(), (None, 3)], "word string, n long")).collect()}
    want = plain_groups(words)
    assert got.keys() == want.keys()
    for w, (form, n, near) in want.items():
        root = w
        while want[root][0] is not None:
            root = want[root][0]
        r = got[w]
        assert (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) == (form, root, n, near, None if form is None else words[form]), w


def test_op13_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CHUNK_BYTES", 40)
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["Häuser", "ÀÉÎ", "house", "HOUSES", "naïve1naïve", "x×÷ÿy", "мир", "abcde", "abcdé"]) for _ in range(60)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (None, texts[0]), (50, None), (51, ""), (52, "k" * 5000 + " ")]
    want = collections.Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate({i: i + 32 for i in range(65, 91)})
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 7 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                want[w] += 1
    table = spark.createDataFrame([(*r, "w", 1, "b") for r in rows], DOCS)
    got = {r["word"]: r["n"] for r in spelling.word_counts(table, every=7).collect()}
    assert got == {w: n for w, n in want.items() if n >= 3} and len(got) > 5
    assert spelling.spelling_groups(spelling.word_counts(table.limit(0))).collect() == []


# --------------------------------------------------------- language model


def plain_base(rows):
    tokens = {k: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})), None] for k, (_, t) in enumerate(rows)}
    held = {k: zlib.crc32(str(d).encode()) % 5 == 1 if d is not None else False for k, (d, _) in enumerate(rows)}
    c = collections.Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
    n = sum(c.values())
    return [(held[k], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (len(c) + 1))) for w in ws)) for k, ws in tokens.items()]


def test_op11_counts_and_base(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rows += [(None, "a null id"), (900, None), (901, ""), (902, " \n"), (903, "word " * 3000), (904, "日本語 🙂 naïve x"), (904, "Q" * 3000), rows[0], rows[0]]
    table = spark.createDataFrame([(*r, "w", 1, "b") for r in rows], DOCS).repartition(3)
    got = attention_lm.attention_lm(table, RANKS, PATTERN).collect()
    key = lambda r: (str(r[0]), r[1], r[2], r[3], r[4], round(r[5], 6))
    assert sorted(key(r) for r in got) == sorted(key((d, *x)) for (d, _), x in zip(rows, plain_base(rows), strict=True))
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_op11_without_training_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    assert attention_lm.attention_lm(empty, RANKS, PATTERN).collect() == []
    one = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    (r,) = attention_lm.attention_lm(spark.createDataFrame([(one, "never learnt", "w", 1, "b")], DOCS), RANKS, PATTERN).collect()
    assert r["held_out"] and (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0) and math.isfinite(r["score"])


def small_model(seed=1):
    rng = np.random.default_rng(seed)
    end = 3000
    leaf, within = attention_lm.leaves_of(rng.integers(0, 50, end + 1).astype(float))
    model = attention_lm.model_of(rng.integers(0, 50, end + 1).astype(float), end, leaf, within, rng.integers(0, 3, (attention_lm.LEAVES, attention_lm.LEAVES)).astype(float))
    model.weights = {k: (v + rng.normal(size=v.shape) * 0.1).astype(np.float32) for k, v in model.weights.items()}
    attention_lm._fixed(model.weights)
    return model


def test_op11_windows_score_each_position_once(monkeypatch):
    monkeypatch.setattr(attention_lm, "SLICE", 2)
    for sizes in ([1], [16], [17, 1, 40], [5, 33]):
        sizes = np.array(sizes)
        stream = np.arange(sizes.sum()) + 5
        x, y, position = (np.concatenate(c) for c in zip(*attention_lm.windows(stream, sizes, 3), strict=True))
        assert sorted(position[position >= 0].tolist()) == list(range(sizes.sum()))
        starts = set((np.cumsum(sizes) - sizes).tolist())
        for row in range(len(x)):
            for k in np.flatnonzero(position[row] >= 0):
                p = position[row, k]
                assert y[row, k] == stream[p] and x[row, attention_lm.CONTEXT + k] == (3 if p in starts else stream[p - 1])


def test_op11_probabilities_sum_to_one():
    model = small_model()
    x = np.random.default_rng(2).integers(0, attention_lm.LEAVES, (1, attention_lm.LENGTH))
    x[0, :5] = attention_lm.PAD
    total = np.zeros(attention_lm.STRIDE)
    for y in range(attention_lm.LEAVES):
        total += np.exp(model.log_probability(x, np.full((1, attention_lm.STRIDE), y)).astype(float))
    assert np.allclose(total, 1, atol=1e-3)
    assert np.allclose(np.bincount(model.leaf, np.exp(model.within), attention_lm.LEAVES), 1)
    # A position does not see what follows it, nor what stands before the text.
    y = np.zeros((1, attention_lm.STRIDE), int)
    later = x.copy()
    later[0, attention_lm.CONTEXT + 6 :] = 7
    assert np.allclose(model.log_probability(x, y)[:6], model.log_probability(later, y)[:6], atol=1e-5)


def test_op11_scores_by_tables(monkeypatch):
    """The forward pass of training gives the same; a position and a key cost no exponential, whatever the weights the result is finite."""
    lm = attention_lm
    model, rng = small_model(), np.random.default_rng(5)
    x, y = rng.integers(0, lm.LEAVES, (300, lm.LENGTH)), rng.integers(0, lm.LEAVES, (300, lm.STRIDE))
    x[::3, :11] = lm.PAD
    hidden, ask = model.forward(x)["hidden"], x[:, lm.CONTEXT :].ravel()
    rows, group, inner = np.arange(y.size), y.ravel() // lm.PER_GROUP, y.ravel() % lm.PER_GROUP
    share = lambda logits: logits - np.log(np.exp(logits.astype(float)).sum(1, keepdims=True))
    want = share(hidden @ model.weights["group"] + model.groups[ask])[rows, group]
    want += share(np.einsum("nh,nhl->nl", hidden, model.weights["leaf"][group]) + model.leaves[ask, group])[rows, inner]
    taken, exp = [], np.exp
    monkeypatch.setattr(np, "exp", lambda v, *a, **k: taken.append(np.size(v)) or exp(v, *a, **k))
    scorer = lm.Scorer(model)
    taken.clear()
    assert np.allclose(scorer.log_probability(x, y), want, atol=1e-4)
    assert sum(taken) == y.size * (lm.GROUPS + lm.PER_GROUP)
    for name in ("query", "key", "near"):
        model.weights[name] *= 100
    lm._fixed(model.weights)
    assert np.isfinite(lm.Scorer(model).log_probability(x, y)).all()


def test_op11_gradients():
    model = small_model()
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, attention_lm.LEAVES, (3, attention_lm.LENGTH)), rng.integers(0, attention_lm.LEAVES, (3, attention_lm.STRIDE))
    x[0, :9] = attention_lm.PAD
    y[2, 10:] = -1
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    loss = lambda: -model.log_probability(x, y)[y.ravel() >= 0].mean()
    grad = model.gradients(x, y)
    for name, at in (("query", (x[1, 20], 2)), ("key", (x[1, 18], 3)), ("value", (x[1, 18], 1)), ("own", (x[1, 20], 5)), ("near", (2,)), ("out", (3, 4)), ("group", (2, y[1, 4] // attention_lm.PER_GROUP)), ("leaf", (y[1, 4] // attention_lm.PER_GROUP, 3, 1))):
        held, step = model.weights[name][at], 1e-4
        model.weights[name][at] = held + step
        up = loss()
        model.weights[name][at] = held - step
        down = loss()
        model.weights[name][at] = held
        assert abs((up - down) / (2 * step) - grad[name][at]) < 1e-5 + 0.02 * abs(grad[name][at]), name


def test_op11_learns(spark):
    """Held-out texts of two invented languages are likelier under the model than under word counts."""
    rng = random.Random(9)
    tongues = [["ka", "lo", "mi", "tu"], ["shre", "blon", "gri", "pav"]]
    text = lambda t: " ".join("".join(rng.choice(t) for _ in range(rng.randint(1, 4))) for _ in range(120))
    table = spark.createDataFrame([(i, text(tongues[i % 2]), "w", 1, "b") for i in range(300)], DOCS)
    got = attention_lm.attention_lm(table, RANKS, PATTERN).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count_if(F.col("score") > F.col("base_score")) / F.count("*")).first()
    assert got[0] > got[1] + 1 and got[2] > 0.9


def test_op11_tasks_hold_few_blocks(spark, tmp_path, monkeypatch):
    """Blocks are megabytes each: row groups, which a task holds when it writes or reads, stay small however many a task has."""
    import glob

    import pyarrow.parquet as pq

    monkeypatch.setattr(attention_lm, "BLOCK_BYTES", 1 << 20)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{w:x}" for w in rng.integers(0, 1 << 40, 8000)) for _ in range(250)]
    kept = []
    monkeypatch.setattr(attention_lm, "staged", lambda df, name, **o: kept.append((name, staged(df, name, **o))) or kept[-1][1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    attention_lm.attention_lm(docs, RANKS, PATTERN)
    (file,) = (f.removeprefix("file://") for f in dict(kept)["blocks"].inputFiles())
    meta = pq.ParquetFile(glob.glob(file)[0]).metadata
    assert meta.num_rows >= 10 and max(meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)) < 16 << 20


def test_op11_head_holds_the_most_frequent_words(spark, monkeypatch):
    counts = spark.createDataFrame([(k, 1 + k // 3) for k in range(30)], "hash long, c long")
    # Three words of each count from 10 down; seven words fit, so those of 10 and 9 do, though none has a seventh of all tokens.
    monkeypatch.setattr(attention_lm, "HEAD", 7)
    assert attention_lm._least_of_head(counts) == 9
    monkeypatch.setattr(attention_lm, "HEAD", 2)
    assert attention_lm._least_of_head(counts) == 11
    assert attention_lm._least_of_head(counts.limit(0)) == 1


def test_op11_learns_from_every_window(spark, monkeypatch):
    """Also where there are more than LEAST_WINDOWS, each window of a training text is in one round."""
    monkeypatch.setattr(attention_lm, "LEAST_WINDOWS", 1)
    made, put = {}, attention_lm.staged
    monkeypatch.setattr(attention_lm, "staged", lambda df, name, **options: made.setdefault(name, put(df, name, **options)))
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 37}" for j in range(1 + 40 * (i % 7)))) for i in range(60)], "doc_id long, text string")
    attention_lm.attention_lm(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count()
    end, expected = attention_lm.subwords(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).end, 0
    for batch in made["blocks"].toArrow().to_batches():
        for row in range(len(batch)):
            block = attention_lm.Block(batch, row)
            sizes = block.stream(np.flatnonzero(block.trained), end)[2]
            expected += int((-(-sizes // attention_lm.STRIDE)).sum())
    rounds = {r["round"]: r["n"] for r in made["material"].where("round >= 0").groupBy("round").agg(F.sum("n").alias("n")).collect()}
    assert sum(rounds.values()) == expected > 300 and len(rounds) == attention_lm.ROUNDS
