"""Every operator against brute force, and on nulls, empty and long texts, repeated rows, empty tables and odd columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("larkspur.llm.queries")
from larkspur.llm import byte_bpe, decontaminate, embedding_dedup, html_text, license_scan, ngram_jaccard, quality, sharding, suffix_dedup, unit_dedup  # noqa: E402
from larkspur.llm.common import shingles, text_bytes, word_hashes, words_of  # noqa: E402
from larkspur.llm.graph import components  # noqa: E402

DOCS = "doc_id long, text string, `select` string, `key` int"
rng = random.Random(11)
WORDS = [f"w{k}" for k in range(400)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


BASE = prose(120)
LONG = prose(9000)
ROWS = [
    (1, BASE), (2, BASE), (3, BASE.replace(BASE.split()[60], "other", 1)), (4, None), (5, ""), (6, " \n\t "), (7, "one two"),
    (8, "one two"), (9, LONG), (10, LONG + " tail"), (11, prose(40) + "\n" + prose(80)), (12, "Ünï cødé — 日本語 🙂 " * 30), (None, prose(50)), (13, BASE), (13, BASE),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def grams(text, n):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def closure(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            least = min(label[a], label[b])
            if label[a] != least or label[b] != least:
                label[a] = label[b] = least
                changed = True
    return label


def test_components(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 300), (5, 5), (None, 3), (100, 200)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_word_and_shingle_hashes():
    data, offsets = text_bytes(["A b\vC", None, "a  B c d", "x"])
    start, end, bounds = words_of(data, offsets)
    hashes = word_hashes(data, start, end)
    assert bounds.tolist() == [0, 3, 3, 7, 8] and hashes[0] == hashes[3] and hashes[1] == hashes[4] and hashes[2] == hashes[5]
    found, cuts = shingles(hashes, bounds, 3)
    assert cuts.tolist() == [0, 1, 1, 3, 4] and found[0] == found[1]


def test_op1(spark, docs, empty):
    edits = []
    for k in range(60):
        w = (BASE if k % 2 else LONG[:700]).split()
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = f"edit{rng.random()}"
        edits.append((100 + k, " ".join(w), "y", 2))
    table = docs.where("doc_id is not null and doc_id <> 13").unionByName(spark.createDataFrame(edits, DOCS))
    rows = {r["doc_id"]: r["text"] for r in table.collect()}
    for size, num, den in ((3, 90, 100), (5, 8, 10)):
        sets = {i: grams(t, size) for i, t in rows.items()}
        linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
        want = closure(sets, linked)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.ngram_jaccard_join(table, size, num, den).collect()}
        assert got == {i: (len(sets[i]), want[i]) for i in sets}
    odd = {(r["doc_id"], r["component_id"]) for r in ngram_jaccard.ngram_jaccard_join(docs).collect()}
    assert (None, None) in odd and (13, 1) in odd and (5, 5) in odd
    assert ngram_jaccard.ngram_jaccard_join(empty).collect() == []
    assert ngram_jaccard.one_of_each(docs).columns == docs.columns


def test_op1_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BLOCK_DOCS", 7)
    monkeypatch.setattr(ngram_jaccard, "BUCKET_DOCS", 5)
    rows = []
    for k in range(50):
        w = BASE.split()
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = f"edit{rng.random()}"
        rows.append((k, " ".join(w)))
    sets = {i: grams(t, 3) for i, t in rows}
    want = closure(sets, [(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 9 * len(sets[a] | sets[b])])
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 9, 10).collect()}
    assert got == want


def removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        out.append((len(b), sum(gone), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("limit", [2000, 6, 2])
def test_op2(spark, docs, empty, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "GROUP_LIMIT", limit)
    extra = [(50 + k, prose(20) + BASE[k * 7 : k * 7 + 200] + prose(15), "x", 1) for k in range(12)] + [(80, "ab" * 300, "x", 1), (81, "x" * 401, "x", 1)]
    table = docs.unionByName(spark.createDataFrame(extra, DOCS))
    rows = table.collect()
    got = sorted(((r["doc_id"] or -1, r["n_bytes"], bytes(r["kept"])) for r in suffix_dedup.suffix_dedup(table, length=80, seed=20).collect()), key=str)
    want = removed([r["text"] for r in rows], 80)
    assert got == sorted(((r["doc_id"] or -1, n, kept) for r, (n, _, kept) in zip(rows, want, strict=True)), key=str)
    assert suffix_dedup.suffix_dedup(empty).collect() == []


def test_op2_order():
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 90))) for _ in range(300)] + [b"", b"", b"a" * 60, b"a" * 61]
    assert [strings[k] for k in suffix_dedup.deep_shallow_order(strings)] == sorted(strings)
    assert [strings[k] for k in suffix_dedup.blind_trie_order(strings, list(range(len(strings))))] == sorted(strings)


def test_op3(spark, docs, empty, tmp_path):
    rows = sharding.extendible_shards(docs, 2000).collect()
    assert sorted((r["doc_id"] or -1, r["n_bytes"]) for r in rows) == sorted((i or -1, len((t or "").encode())) for i, t in ROWS)
    for r in rows:
        same = [x for x in rows if (x["shard_depth"], x["shard_prefix"]) == (r["shard_depth"], r["shard_prefix"])]
        assert r["shard_rows"] == len(same) and r["shard_bytes"] == sum(x["n_bytes"] for x in same)
        assert r["shard_bytes"] <= 2000 or r["shard_rows"] == 1 or len({x["doc_id"] for x in same}) == 1
    assert sharding.extendible_shards(empty, 10).collect() == []
    odd = docs.withColumn("shard", F.lit("x")).withColumn("_id", F.lit(7)).withColumn("row", F.lit("y"))
    shards = sharding.write_shards(odd, f"file://{tmp_path}/out", 2000).collect()
    back = spark.read.parquet(f"file://{tmp_path}/out").select("row.*")
    assert back.columns == odd.columns and back.count() == len(ROWS) == sum(r["rows"] for r in shards)
    hot = spark.createDataFrame([(None, BASE)] * 300 + [(7, prose(30)) for _ in range(300)], "doc_id long, text string")  # one id, one text
    assert all(r["shard_bytes"] <= 5000 or r["shard_rows"] == 1 for r in sharding.extendible_shards(hot, 5000).collect())
    assert sharding.write_shards(empty, f"file://{tmp_path}/none", 10).collect() == []


def test_op4(spark):
    model = html_text.trained()
    wrong = total = 0
    for page, labels in html_text.labelled_pages(80, 1234):
        blocks = html_text.leaf_blocks(page)
        assert len(blocks) == len(labels)
        got = model.decode(html_text.block_features(blocks))
        wrong += sum(a != b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert wrong < 0.01 * total
    page = "<html><head><title>t</title></head><body><nav><a href=/a>Home</a></nav><article><h1>A &amp; B</h1><p>First\n  line <b>bold</b>&nbsp;x.<p>Second one here.<script>var a='</p>';</script></article><footer>&copy; example.com all rights reserved</footer>"
    rows = [(1, "u", page, 0), (2, None, None, 0), (3, "u", "", 0), (None, "u", page, 0), (4, "u", "<<<p", 0), (5, "u", "<p " + "x" * 5000, 0)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert got[0]["text"] == "A & B\nFirst line bold x.\nSecond one here." and got[0]["n_chars"] == len(got[0]["text"])
    assert got[1]["text"] == "" and got[1]["url"] is None and len(got) == 6


def test_op4_labels_are_the_likeliest():
    model = html_text.Crf(np.random.default_rng(1).standard_normal((5, 2)), np.array([[0.3, -0.7], [0.2, 0.9]]))
    feats = [[0, 3], [1], [2, 4], [0], [1, 2]]
    e = model.emissions(feats)
    score = lambda p: sum(e[t, y] for t, y in enumerate(p)) + sum(model.moves[a, b] for a, b in zip(p[:-1], p[1:], strict=True))
    best = max(([int(c) for c in f"{k:05b}"] for k in range(32)), key=score)
    assert model.decode(feats) == best


def test_op5(spark, empty):
    items = [(k, prose(30), 1) for k in range(12)] + [(None, prose(30), 1), (50, None, 1), (51, "too short", 1)]
    bench = spark.createDataFrame(items, "item_id long, text string, score int")
    rows = [(100 + k, f"{prose(60)} {items[k][1]} {prose(60)}") for k in range(6)]
    for k in range(6, 12):
        w = items[k][1].split()
        for p in (4, 13, 22):
            w[p] = "edited"
        rows.append((100 + k, f"{prose(60)} {' '.join(w).upper()}. {prose(60)}"))
    rows += [(200 + k, prose(150)) for k in range(30)] + [(300, None), (301, "")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)
    got = decontaminate.contaminated(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(100 + k, k) for k in range(12)}
    for r in got:
        text = dict(rows)[r["doc_id"]]
        if r["item_id"] < 6:
            assert r["score"] == 1.0 and text.encode()[r["start"] : r["end"]].decode() == items[r["item_id"]][1]
    assert decontaminate.contaminated(empty, bench).collect() == [] and decontaminate.contaminated(docs, bench.limit(0)).collect() == []
    assert decontaminate.without_contaminated(docs, bench).count() == 32


def test_op5_odd_rows(spark):
    item, short = prose(30), "alpha beta"
    bench = spark.createDataFrame([(1, item), (1, item), (2, short), (3, "..."), (4, ""), (None, item)], "item_id long, text string")
    rows = [(1, f"{prose(9000)} {item} {prose(9000)}"), (None, item), (None, prose(40)), (2, f"x {short.upper()}, y"), (3, "alpha gamma beta"), (4, None), (5, ""), (6, item), (6, item), (6, prose(30))]
    docs = spark.createDataFrame([(i, t, "r", "c") for i, t in rows], "doc_id long, text string, `row` string, `copy` string")
    got = sorted((r["doc_id"] or -1, r["item_id"], r["score"]) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == sorted([(i, 1, 1.0) for i in (1, -1, 6, 6) for _ in range(2)] + [(2, 2, 1.0)])
    left = decontaminate.without_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted((r["doc_id"] or -1, r["text"]) for r in left.collect() if r["text"]) == sorted((i or -1, t) for i, t in [rows[2], rows[4], rows[9]])


def test_op5_large_benchmark():
    words = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(20)) for _ in range(20_000)]
    items = decontaminate.Items.of(list(range(20_000)), words, 4)[0]
    seen = np.random.default_rng(1).integers(0, 9, len(items.grams))
    rare = decontaminate.rare_grams(items, seen)
    for k in range(0, 20_000, 4001):
        own = items.owner == k
        assert (rare[own] == (seen[own] <= 2 * np.median(seen[own]))).all()


def test_op5_alignment():
    a, b = np.array([1, 2, 3, 4, 5, 6], np.uint64), np.array([9, 1, 2, 7, 4, 5, 6, 8], np.uint64)
    score, start, end = decontaminate.aligned_span(a, b)
    assert (score, start, end) == (pytest.approx(4.5 / 6), 1, 7)


def test_op6(spark, docs, empty):
    rows = [(1, "Alpha beta gamma\nkeep this line\nshort"), (2, "alpha   BETA gamma \nshort\nnew line here"), (3, None), (4, ""), (5, "new line here\nnew line here"), (None, "alpha beta gamma")]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)
    got = {r["doc_id"]: (r["text"], r["n_units"], [(x["start"], x["end"]) for x in r["removed"]]) for r in unit_dedup.unit_dedup(table).collect()}
    assert got == {
        None: ("alpha beta gamma", 1, []), 1: ("keep this line\nshort", 3, [(0, 16)]), 2: ("new line here", 3, [(0, 19), (20, 25)]),
        3: (None, 0, []), 4: ("", 0, []), 5: ("", 2, [(0, 13), (14, 27)]),
    }
    kept = {r["doc_id"]: r["text"] for r in unit_dedup.unit_dedup(table, min_words=3).collect()}
    assert kept[2] == "short\nnew line here"
    assert unit_dedup.unit_dedup(empty).collect() == [] and unit_dedup.cut_repeats(empty).collect() == []
    assert unit_dedup.unit_dedup(docs, "paragraph").count() == len(ROWS)


def test_op6_clashing_columns(spark, docs):
    odd = docs
    for name in ("_id", "_copy", "_gone", "_kept", "row", "units", "runs", "copy", "n_units", "removed", "list", "a.b", "x`y"):
        odd = odd.withColumn(name, F.lit(name))
    out = unit_dedup.cut_repeats(odd, passage=20)
    assert out.columns == odd.columns and out.count() == len(ROWS)
    assert {r["a.b"] for r in out.collect()} == {"a.b"} and {r["_kept"] for r in out.collect()} == {"_kept"}


def cut_by_brute_force(rows, size):
    """What stays of rows (id, text) of one line each, by runs of words only."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    seen, out = {}, {}
    for k in order:
        tokens = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", rows[k][1] or "")
        w = [re.sub(r"[\x20\x09-\x0D]+$", "", t).lower() for t in tokens]
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            run = tuple(w[p : p + size])
            if seen.setdefault(run, (k, p)) != (k, p):
                gone[p : p + size] = [True] * size
        out[rows[k][0]] = "".join(t for t, g in zip(tokens, gone, strict=True) if not g)
    return out


def test_op6_runs(spark):
    shared = prose(400).split()
    rows = [(1, prose(40)), (2, "a " * 300), (3, "b  a " + "a " * 100 + "c"), (4, None), (5, ""), (6, " ".join(shared)), (None, " ".join(shared[30:90]).upper())]
    for k in range(40):
        at = rng.randrange(330)
        rows.append((10 + k, f"{prose(rng.randint(0, 30))} {' '.join(shared[at : at + rng.randint(12, 60)])}  {prose(rng.randint(0, 30))}".strip()))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (15, 5):
        got = {r["doc_id"]: r["text"] or "" for r in unit_dedup.unit_dedup(table, min_words=10**6, passage=size).collect()}
        assert got == cut_by_brute_force(rows, size)
    twice = table.unionByName(table)  # equal rows are one document
    assert {r["doc_id"]: r["text"] or "" for r in unit_dedup.unit_dedup(twice, min_words=10**6, passage=15).collect()} == cut_by_brute_force(rows, 15)


def test_op7(spark, docs, empty):
    notices = license_scan.NOTICES
    rows = [(k, f"{prose(37 + k)} {text.upper()} {prose(20)}") for k, (_, text) in enumerate(notices)] + [(90 + k, prose(200)) for k in range(10)] + [(120, None), (121, ""), (122, "All rights reserved."), (None, notices[0][1])]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)
    got = {(r["doc_id"], r["license_id"]): r["containment"] for r in license_scan.license_scan(table, license_scan.notices(spark)).collect()}
    for k, (name, _) in enumerate(notices):
        assert got[k, name] == 1.0
    assert got[122, "all-rights-reserved"] == 1.0 and got[None, "mit"] == 1.0
    assert not [i for i, _ in got if i is not None and 90 <= i <= 121]
    assert license_scan.license_scan(empty, license_scan.notices(spark)).collect() == []


def test_op7_large_templates(spark, monkeypatch):
    notices = license_scan.NOTICES
    rows = [(k, f"{prose(30)} {text} {prose(20)}") for k, (_, text) in enumerate(notices)] * 2 + [(None, notices[3][1]), (500, " ".join([prose(3000), notices[4][1], prose(3000)])), (501, "All rights reserved. " * 30)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    scan = lambda: sorted(map(str, license_scan.license_scan(table, license_scan.notices(spark)).collect()))
    small = scan()
    monkeypatch.setattr(license_scan, "TEMPLATE_BYTES", 10)
    assert scan() == small and len(small) == len(set(small)) > len(notices) // 2


def test_op8(spark, docs, empty):
    rows, labels = [], []
    for k in range(400):
        good = k % 3 > 0
        rows.append((k, prose(rng.randint(30, 200)).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in prose(rng.randint(30, 200)).split()), "x", 1))
        labels.append((k, int(good), 9))
    labels += [(1, None, 0), (None, 1, 0), (9999, 1, 0)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: (r["held_out"], r["score"]) for r in quality.quality_scores(spark.createDataFrame(rows, DOCS), known).collect()}
    assert all(got[k][0] == (zlib.crc32(str(k).encode()) % 5 == 0) for k in range(400))
    held = [(got[k][1] >= quality.CUT) == bool(labels[k][1]) for k in range(400) if got[k][0]]
    assert np.mean(held) > 0.97
    odd = quality.quality_scores(docs, known).collect()
    assert len(odd) == len(ROWS) and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.quality_scores(empty, known).collect() == []
    assert {r["score"] for r in quality.quality_scores(docs, known.limit(0)).collect()} == {0.5}
    clash = docs.withColumn("row", F.lit(1)).withColumn("copy", F.lit(2)).withColumn("x", F.lit(3)).withColumn("score", F.lit(0.0))
    assert quality.of_quality(clash, known).columns == clash.columns
    # Each row is judged by its own text, whatever its id.
    bad, good = " ".join(w.upper() + "!!" for w in prose(90).split()), prose(90).capitalize() + "."
    rows += [(None, bad, "x", 1), (None, good, "x", 1), (4000, bad, "x", 1), (4000, good, "x", 1)]
    kept = {(r["doc_id"], r["text"]) for r in quality.of_quality(spark.createDataFrame(rows, DOCS), known).collect()}
    assert {(None, good), (4000, good)} <= kept and not {(None, bad), (4000, bad)} & kept


@pytest.mark.parametrize("labels", [[(1, 1)], [(k, 1) for k in range(1, 41)], [(k, k % 2) for k in range(1, 41)]])
def test_op8_one_text(spark, labels):
    rows = [(k, BASE) for k in range(1, 41)] + [(50, None), (51, ""), (52, "x" * 300_000)]
    got = quality.quality_scores(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == 43 and all(0 <= r["score"] <= 1 for r in got)


def test_op8_matches_plain_discriminant(spark):
    rows, labels = [], []
    for k in range(300):
        rows.append((k, prose(rng.randint(5, 120)) + "." * (k % 4) if k % 3 else prose(40).upper()))
        labels.append((k, int(k % 3 > 0 or k % 7 == 0)))
    x = quality.statistics(*text_bytes([t for _, t in rows]))
    train = np.array([zlib.crc32(str(k).encode()) % 5 != 0 for k in range(300)])
    y = np.array([v for _, v in labels])
    scale = x[train].std(0)
    scale[scale <= 1e-6 * np.sqrt(1 + x[train].mean(0) ** 2)] = 1
    z = x / scale
    cov = [np.cov(z[train & (y == c)].T, bias=True) for c in (0, 1)]
    n = [(train & (y == c)).sum() for c in (0, 1)]
    pooled = np.diag(np.diag((n[0] * cov[0] + n[1] * cov[1]) / sum(n)))
    logs = []
    for c in (0, 1):
        s = (1 - quality.SHRINKAGE) * cov[c] + quality.SHRINKAGE * pooled + quality.FLOOR * np.eye(len(scale))
        d = z - z[train & (y == c)].mean(0)
        logs.append(np.log((n[c] + 1) / (sum(n) + 2)) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
    got = {r["doc_id"]: r["score"] for r in quality.quality_scores(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert np.allclose([got[k] for k in range(300)], want, atol=1e-6)


def test_op9(spark):
    g = np.random.default_rng(5)
    centres = g.standard_normal((12, 32))
    x = np.concatenate([c + 0.25 * g.standard_normal((20, 32)) for c in centres] + [g.standard_normal((60, 32))]).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900 + k, x[3].tolist()) for k in range(4)] + [(950, (x[3] * 7).tolist())]
    odd = [(960, None), (961, [0.0] * 32), (962, [float("nan")] + [1.0] * 31), (963, [None] + [1.0] * 31), (964, [float("inf")] * 32), (965, []), (966, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows + odd], "vec_id long, embedding array<float>, label int")
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= 0.9
    ids = [r[0] for r in rows]
    want = closure(ids + [o[0] for o in odd], [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True) if a != b])
    for chunk in (8192, 40):
        embedding_dedup.CHUNK = chunk
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_links(table).collect()}
        links = dict(zip(ids, near.sum(1) - 1, strict=True))
        assert got == {i: (links.get(i, 0), c, i == c) for i, c in want.items()}
    embedding_dedup.CHUNK = 8192
    # A vector of a row without an id, far from all but near two others, is a bridge and no component.
    turn = lambda degrees: [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees))), *[0.0] * 30]
    bridge = spark.createDataFrame([(7, turn(0)), (5, turn(40)), (None, turn(20)), (None, turn(100)), (9, turn(120))], "vec_id long, embedding array<double>")
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_links(bridge).collect()}
    assert got == {(7, 1, 5, False), (5, 1, 5, True), (None, 2, None, False), (None, 1, None, False), (9, 1, 9, True)}
    assert embedding_dedup.embedding_links(table.limit(0)).collect() == []


def test_op10(spark, docs, empty):
    tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    bpe = byte_bpe.coder(path, tokenizers.PATTERN)
    real = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    letters = "ab \n\t  é'sdtre1 9.,!*ñ  日本\x1c　🙂\x85"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(800)] + ["a" * 3000, "!" * 700, " " * 300 + "x", "\n" * 400, "It's <|endoftext|> we're"]
    for text, ids in zip(texts, bpe.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == real.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in byte_bpe.encoded(docs).collect())
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((i or -1, len(real.encode_ordinary(t or "")), digest(np.array(real.encode_ordinary(t or ""), "<u4").tobytes()), digest((t or "").encode())) for i, t in ROWS)
    assert got == want
    assert byte_bpe.encoded(empty).collect() == []


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, sf)
        if name != "tokenize":
            assert out.columns == docs.columns
        if name == "near_duplicates":
            rows = {r["doc_id"]: grams(r["text"], 5) for r in seen.collect()}
            ids = sorted(rows)
            linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if rows[a] and rows[b] and 10 * len(rows[a] & rows[b]) >= 8 * len(rows[a] | rows[b])]
            assert {r["doc_id"] for r in out.collect()} == {i for i, c in closure(rows, linked).items() if i == c}
        if name == "tokenize":
            assert {r["doc_id"]: r["decoded_sha256"] for r in out.collect()} == {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in seen.collect()}
        seen = corpus_pipeline.staged(out, name)
    assert 0 < seen.count() < docs.count()


@pytest.mark.parametrize("name", ["op1_ngram_jaccard", "op3_sharding", "op6_substring_dedup", "op9_embedding_dedup"])
def test_queries_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from larkspur.llm.queries import ORACLE, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    mine, theirs = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLE[name]).df()
    cols = sorted(mine.columns)
    assert cols == sorted(theirs.columns)
    assert sorted(map(str, mine[cols].itertuples(index=False))) == sorted(map(str, theirs[cols].itertuples(index=False)))


def test_op5_common_half(spark):
    head = prose(18).split()
    items = [(k, head + prose(22).split()) for k in range(2)] + [(2, prose(40).split())]
    rows = [(k, prose(20).split() + head + prose(40).split()) for k in range(70)]  # the head alone scores 18 of 40
    for k, (_, w) in enumerate(items):
        w = w.copy()
        for p in (18, 22, 26, 30, 34, 38):
            w[p] = f"edit{p}"
        rows.append((100 + k, prose(30).split() + w + prose(30).split()))  # no four words in a row outside the head
    rows.append((200, head[:10] + prose(5).split() + head[9:] + items[0][1][18:21] + ["edit"] + items[0][1][22:25]))

    def brute(a, b):
        table, best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)], 0.0
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = max(0.0, table[i][j] + (1.0 if x == y else -0.5), table[i][j + 1] - 0.5, table[i + 1][j] - 0.5)
                best = max(best, table[i + 1][j + 1])
        return best / len(a)

    scores = {(i, k): brute(w, t) for i, t in rows for k, w in items}
    want = {pair: round(s, 6) for pair, s in scores.items() if s >= 0.5}
    assert {(100, 0), (101, 1)} <= set(want) and not any(i < 70 for i, _ in want)
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(table, bench).collect()}
    assert got == want


@pytest.mark.parametrize("limit", [2000, 4])
def test_op2_null_ids(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "GROUP_LIMIT", limit)
    hot, only = prose(60), prose(20)
    rows = [(None if k % 3 == 0 else k, prose(10) + hot[k * 5 : k * 5 + 160] + prose(10)) for k in range(12)]
    rows += [(None, prose(10) + hot[:120] + only), (50, prose(10) + hot[:120] + only), (None, hot[200:300]), (None, hot[200:300]), (None, prose(40))]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), length=80, seed=20).collect()
    want = removed([t for _, t in rows], 80)
    assert sorted(((r["doc_id"] or -1, r["n_bytes"], bytes(r["kept"])) for r in got), key=str) == sorted(((i or -1, n, kept) for (i, _), (n, _, kept) in zip(rows, want, strict=True)), key=str)


def test_op6_unspaced(spark):
    long = ["春眠暁を覚えず処処啼鳥を聞く", "https://example.com/a/long/path/that/has/no/blanks", "aGVsbG8gd29ybGQgaGVsbG8gd29ybGQgaGVsbG8="]
    rows = [(1, "\n".join([*long, "two words", "短い行"])), (2, "\n".join(["two words", "other", *long]))]
    got = {r["doc_id"]: r["text"] for r in unit_dedup.unit_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "other"}


SMALL = "/root/testdata/sf0.001"


def test_op2_query_is_brute_force(spark):
    from larkspur.llm.queries import QUERIES

    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r, (n, gone, kept) in zip(rows, removed([r["text"] for r in rows], 400), strict=True):
        want[r["doc_id"]] = (n, gone, hashlib.sha256(kept).hexdigest())
    got = QUERIES["op2_suffix_dedup"](spark, SMALL).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in got} == want and len(got) == len(rows)
    assert all(len(r["text"].encode()) >= r["n_bytes"] - r["n_removed"] for r in got)


def test_op5_query_is_brute_force(spark):
    from larkspur.llm.queries import QUERIES

    def score(a, b):
        best, row = 0.0, np.zeros(len(b) + 1)
        for x in a:
            new = np.maximum(0, row - 0.5)
            new[1:] = np.maximum(new[1:], row[:-1] + np.where(b == x, 1.0, -0.5))
            for _ in range(len(a)):  # gaps, one word after another
                more = np.maximum(new[1:], new[:-1] - 0.5)
                if (more == new[1:]).all():
                    break
                new[1:] = more
            row = new
            best = max(best, row.max())
        return best / len(a)

    split = lambda t: re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    docs = {r["doc_id"]: split(r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    items = {r["item_id"]: split(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    known = {w: k for k, w in enumerate({w for t in items.values() for w in t})}
    coded = {i: np.array([known.get(w, -1) for w in t]) for i, t in docs.items()}
    want = set()
    for k, item in items.items():
        grams_ = {tuple(item[p : p + 4]) for p in range(len(item) - 3)}
        for i, t in docs.items():
            if any(tuple(t[p : p + 4]) in grams_ for p in range(len(t) - 3)) and score(np.array([known[w] for w in item]), coded[i]) >= 0.5:
                want.add((i, k))
    assert {(r["doc_id"], r["item_id"]) for r in QUERIES["op5_decontaminate"](spark, SMALL).collect()} == want and want


def test_op7_query_is_brute_force(spark):
    import regex

    from larkspur.llm.queries import QUERIES

    def pairs(text):
        w = regex.sub(r"[^\p{L}\p{N}]+", " ", (text or "").lower()).strip().split(" ")
        return list(zip(w[:-1], w[1:], strict=True))

    parts = [(name, pairs(text)) for name, text in license_scan.NOTICES]
    want = {}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        own = pairs(r["text"])
        for name, part in parts:
            known = set(part)
            for at in range(0, max(len(own) - 2, 0) + 1, 2):
                if len(known & set(own[at : at + 4])) >= min(2, len(known)):
                    share = round(len(known & set(own[max(at - len(part), 0) : max(at - len(part), 0) + 2 * len(part) + 4])) / len(known), 6)
                    if share >= 0.8 and share > want.get((r["doc_id"], name), (0,))[0]:
                        want[r["doc_id"], name] = (share, at)
    got = {(r["doc_id"], r["license_id"]): (r["containment"], r["word"]) for r in QUERIES["op7_license_scan"](spark, SMALL).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and want


def test_pipeline_on_odd_rows(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    extra = "row string, copy long, id long, n long, units int, _id long"
    rows = [(i, t, "en", "s", len(t or ""), "r", 1, 2, 3, 4, 5) for i, t in [*ROWS, (None, None), (None, prose(50)), (77, prose(300)), (77, prose(300)), (78, "x" * 100_000)]]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    for name, part in (("all", docs), ("none", docs.limit(0))):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, prose(40)), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        seen = part
        for stage_name, function in corpus_pipeline.STAGES:
            out = function(spark, seen, folder)
            assert stage_name == "tokenize" or out.columns == docs.columns
            out.write.parquet(f"{folder}/{stage_name}")
            seen = spark.read.parquet(f"{folder}/{stage_name}")
        assert name == "all" or seen.count() == 0
