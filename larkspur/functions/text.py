"""Text functions as column expressions: tokenisers, folding, trimming, previews.

Nothing here runs Python on the executors.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning for search.
STOP_WORDS = """
a about above after although an and are as at be because been before being below between but by could did do does during
for from had has have he how i if in into is it its may might must no nor not of on onto or shall she should since so than
that the then these they this those though through to unless until upon was we were what when where which while who why
will with within without would yet you
""".split()

#: Terms of cluster operations that stand for each other, in this direction.
SYNONYMS = {
    "crashloop": ["crashloopbackoff"],
    "crashloopbackoff": ["crashloop"],
    "deadline": ["timeout"],
    "diskpressure": ["disk"],
    "drain": ["evict"],
    "errimagepull": ["imagepull"],
    "evict": ["eviction"],
    "eviction": ["evict"],
    "imagepull": ["imagepullbackoff"],
    "imagepullbackoff": ["imagepull"],
    "notready": ["unreachable"],
    "oom": ["oomkilled"],
    "oomkilled": ["oom"],
    "timeout": ["deadline"],
    "unreachable": ["notready"],
}


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lower(c: Column | str) -> Column:
    """Lower case; a dotted capital I becomes a plain i and not an i with a combining dot."""
    return F.lower(F.replace(col(c), F.lit("İ"), F.lit("i")))


def tokenize_raw(c: Column | str) -> Column:
    """ASCII words of two characters or more that are no stop words, in order. Null gives null."""
    words = F.split(lower(c), "[^a-z0-9]+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))


def tokenize(c: Column | str) -> Column:
    """tokenize_raw with the synonyms of each word after its first occurrence. Synonyms are not expanded again."""
    table = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), strings(v))])
    rare = lambda words: F.when(F.arrays_overlap(words, strings(list(SYNONYMS))), expand(words)).otherwise(words)
    # The outer transform holds the words, so that they are made once and not for each element.
    expand = lambda words: F.flatten(F.transform(words, lambda w, i: F.when(w.isin(list(SYNONYMS)) & (F.array_position(words, w) == i + 1), F.concat(F.array(w), F.coalesce(F.element_at(table, w), strings([])))).otherwise(F.array(w))))
    return F.get(F.transform(F.array(tokenize_raw(c)), rare), 0)


def _diacritics() -> tuple[str, str]:
    """Latin letters with marks, in lower case, and their base letters, by canonical decomposition."""
    marked, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base.isalpha() and all(unicodedata.combining(m) for m in marks) and chr(code) == chr(code).lower():
            marked.append(chr(code))
            plain.append(base)
    return "".join(marked), "".join(plain)


MARKED, PLAIN = _diacritics()


def fold(c: Column | str) -> Column:
    """Lower case without diacritics, as the full-text index folds."""
    return F.translate(F.regexp_replace(lower(c), "[\u0300-\u036f]", ""), MARKED, PLAIN)


def index_terms(c: Column | str) -> Column:
    """Terms of the full-text index: runs of letters and digits of any script, folded; stop words stay. ASCII texts, which have nothing to fold, are cut by a plainer pattern."""
    c = col(c)
    words = F.when(F.octet_length(c) == F.length(c), F.split(F.lower(c), "[^a-z0-9]+")).otherwise(F.split(fold(c), r"[^\p{L}\p{N}\p{Co}]+"))
    return F.filter(words, lambda w: F.length(w) > 0)


def trim_space(c: Column | str) -> Column:
    """Trim all Unicode white space; Spark's own trim takes blanks only. Texts that neither begin nor end with any are not searched for it."""
    c = col(c)
    ends = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1)).rlike(r"(?U)\s")
    return F.when(ends, F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")).otherwise(c)


def fnv1a32(c: Column | str) -> Column:
    """FNV-1a, 32 bits, of a string of ASCII characters, as a long."""
    c = col(c)
    step = lambda h, b: ((h.bitwiseXOR(b)) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long"))
    codes = F.when(F.length(c) > 0, F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), step)


def hashed_dim(c: Column | str, dims: int) -> tuple[Column, Column]:
    """Dimension and sign of a term by feature hashing."""
    h = fnv1a32(c)
    return F.pmod(F.shiftright(h, 1), F.lit(dims)).cast("int"), F.when(h.bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))


def is_heading(c: Column | str) -> Column:
    """One or more # and then a blank, at the start of a line."""
    return col(c).rlike("^#+ ")


PREVIEW_BYTES = 1500


def preview(c: Column | str, limit: int = PREVIEW_BYTES) -> Column:
    """At most `limit` bytes, cut at a blank of the last 60 if there is one, never inside a character."""
    c = col(c)
    head = F.substring(F.encode(c, "UTF-8"), 1, limit)
    # An incomplete last character becomes a replacement character, which goes.
    whole = F.regexp_replace(F.make_valid_utf8(head.cast("string")), "\ufffd+$", "")
    last = F.length(whole) - F.locate(" ", F.reverse(whole))
    near = F.octet_length(F.substring(whole, F.lit(1), last)) > limit - 60
    cut = F.when(F.contains(whole, F.lit(" ")) & near, F.substring(whole, F.lit(1), last)).otherwise(whole)
    return F.when(F.octet_length(c) > limit, cut).otherwise(c)


STRONG, RELEVANT = 0.04, 0.015


def score_label(c: Column | str) -> Column:
    c = col(c)
    return F.when(c >= STRONG, "strong match").when(c >= RELEVANT, "relevant").otherwise("weak match")
