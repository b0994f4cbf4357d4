"""Tokenisers, hashing, trimming and previews on small inputs."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text, vectors


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("Hello World", ["hello", "world"]),
        ("the quick brown fox", ["quick", "brown", "fox"]),
        ("Kubernetes Pod OOM", ["kubernetes", "pod", "oom", "oomkilled"]),
        ("OOMKilled OOMKilled", ["oomkilled", "oom", "oomkilled"]),
        ("drain evict node-502", ["drain", "evict", "evict", "eviction", "node", "502"]),
        ("", []),
        ("a", []),
        ("İstanbul", ["istanbul"]),
        ("élève", ["ve"]),
    ],
)
def test_tokenize(spark, given, wanted):
    assert value(spark, text.tokenize(F.lit(given))) == wanted


def test_tokenize_raw_keeps_synonyms_out(spark):
    assert value(spark, text.tokenize_raw(F.lit("OOMKilled CrashLoopBackOff"))) == ["oomkilled", "crashloopbackoff"]
    assert value(spark, text.tokenize_raw(F.lit(None).cast("string"))) is None


def test_index_terms_fold_all_scripts(spark):
    assert value(spark, text.index_terms(F.lit("Élève, STRASSE über; Ёлка 日本 9a the"))) == ["eleve", "strasse", "uber", "ёлка", "日本", "9a", "the"]


@pytest.mark.parametrize("term, h, dim, sign", [("oom", 2787719434, 133, 1), ("kubernetes", 1957673309, 174, -1), ("oomkilled", 2348451135, 671, -1), ("pod", 1160989932, 630, 1), ("evict", 3036387366, 19, 1)])
def test_fnv_and_dims(spark, term, h, dim, sign):
    assert value(spark, text.fnv1a32(F.lit(term))) == h
    d, s = text.hashed_dim(F.lit(term), 1024)
    assert (value(spark, d), value(spark, s)) == (dim, sign)


def test_trim_takes_unicode_space(spark):
    assert value(spark, text.trim_space(F.lit(" \t x y  \n"))) == "x y"


def test_preview_cuts_at_a_blank_and_never_inside_a_character(spark):
    assert value(spark, text.preview(F.lit("short"))) == "short"
    words = "word " * 400
    cut = value(spark, text.preview(F.lit(words)))
    assert words.startswith(cut) and 1440 < len(cut) <= 1500 and not cut.endswith(" ")
    wide = value(spark, text.preview(F.lit("é" * 1001 + "日" * 500)))
    assert wide == "é" * 750
    assert value(spark, text.preview(F.lit("x" + "é" * 1000))) == "x" + "é" * 749


@pytest.mark.parametrize("score, label", [(4.0 / 100, "strong match"), (4.0 / 101, "relevant"), (0.5 / 61, "weak match"), (0.015, "relevant")])
def test_labels(spark, score, label):
    assert value(spark, text.score_label(F.lit(score))) == label


def test_vectors(spark):
    v = value(spark, vectors.normalize(F.array(F.lit(3.0), F.lit(4.0))))
    assert v == [0.6, 0.8]
    assert value(spark, vectors.normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert value(spark, vectors.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(0.0)))) == 0.0
    assert vectors.from_bytes(vectors.to_bytes([1.0, -2.5])) == [1.0, -2.5]
    assert vectors.from_bytes(b"") is None and vectors.from_bytes(b"abc") is None
    assert abs(value(spark, vectors.smoothed_idf(F.lit(248), F.lit(0))) - 6.517453) < 1e-6
