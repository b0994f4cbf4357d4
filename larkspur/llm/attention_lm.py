"""Language-model scores of whole texts by causal self-attention over subword ids, trained in numpy.

Texts are tokenised once, into blocks: word numbers for each token, and for each
distinct word of a block its hash and its subword ids. Counts of words, of
subwords and of neighbouring subwords are made over all training texts by Spark.

Subwords of a text form one stream. Frequent subwords are leaves of their own,
the rest shares leaves by count; leaves lie in groups of similar predecessors. A
window has STRIDE positions that are scored and the CONTEXT positions before
them, so windows overlap and each position is scored once. Attention over the
window corrects the corpus's counts of neighbours: the group and then the leaf
have a softmax over log count + network. The weights are trained in rounds: each
task trains on its windows from the same start, and Spark averages the results.
A word's probability is that of its subwords, mixed with its share of all words.
The counts of the most frequent words are known to every task, those of rarer
ones come by a join on the words' hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import LOWER, lean, quoted, staged, text_chunks, word_hashes, words_of
from larkspur.session import LARGE_ROWS

HELD_OUT = 1  # crc32(doc_id) mod 5 of the texts that are not learnt from
BLOCK_BYTES = 8 << 20  # text bytes of a block; a longer text is a block of its own
HEAD = 200_000  # most frequent words, at most, whose counts are sent to every task
LEAVES, GROUPS = 1024, 32
PER_GROUP = LEAVES // GROUPS
STRIDE, CONTEXT = 16, 16
LENGTH = STRIDE + CONTEXT
PAD = LEAVES  # stands before a text begins
KEY, HIDDEN = 12, 24
ROUNDS = 6
LEAST_WINDOWS = 300_000  # windows of a small corpus are taken several times, up to as many
BATCH = 256  # windows of a training step; up to four times as many where a task has very many
HELD = 128  # windows that one step of scoring looks at
FLOOR = -40.0  # least logarithm of a factor of attention, beside a greatest of 0
SLICE = 8 * BATCH  # windows that are held as numbers at once
RATE = 0.01
PRIOR = 80.0  # counts that a leaf's neighbours are smoothed by
DISCOUNT = 0.75
WORD_SHARE = 0.2  # of a word's probability that is its share of all words
CODED_WORDS = 20_000  # words that are coded in one call
SEGMENTS = 16
_SUBWORD = "<u2"


class Subwords:
    """Subword ids of words by a file of ranks; the number after the last rank ends a text."""

    def __init__(self, path: str, pattern: str):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.end = max(ranks.values()) + 1
        if self.end > 65_535:
            raise ValueError("subword ids have to fit 16 bits")
        self._coding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._break = self._coding.encode_ordinary("\n")

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(16-bit ids one after another, number of ids of each word); each word as it stands after a space."""
        ids, sizes = [], []
        for i in range(0, len(words), CODED_WORDS):
            part = [w.decode() for w in words[i : i + CODED_WORDS]]
            whole = "\n ".join(part)
            # Lines are coded apart from each other, unless a word holds white space of another kind.
            if len(self._break) == 1 and len(whole.split()) == len(part):
                found = np.array(self._coding.encode_ordinary(" " + whole), np.int64)
                cut = np.append(np.flatnonzero(found == self._break[0]), len(found))
                ids.append(found[found != self._break[0]])
                sizes.append(np.diff(cut, prepend=-1) - 1)
            else:
                each = [self._coding.encode_ordinary(" " + w) for w in part]
                ids.append(np.array([x for e in each for x in e], np.int64))
                sizes.append(np.array([len(e) for e in each], np.int64))
        return np.concatenate(ids).astype(_SUBWORD) if ids else np.zeros(0, _SUBWORD), np.concatenate(sizes) if sizes else np.zeros(0, np.int64)


_made: dict[tuple[str, str], Subwords] = {}


def subwords(path: str, pattern: str) -> Subwords:
    """One a Python worker."""
    if (path, pattern) not in _made:
        _made[path, pattern] = Subwords(path, pattern)
    return _made[path, pattern]


_BLOCK = "block long, first long, ids array<bigint>, trained binary, sizes binary, low binary, high binary, hashes array<bigint>, learnt array<int>, pieces binary, lengths binary"


def _blocks(path: str, pattern: str, held_out: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = subwords(path, pattern)
        block, done = TaskContext.get().partitionId() << 32, TaskContext.get().partitionId() << 40
        ids, hashes, starts, ends, sizes, texts, held = [], [], [], [], [], [], 0

        def made() -> pa.RecordBatch:
            h, size = np.concatenate(hashes), np.concatenate(sizes)
            words, distinct = pd.factorize(h)
            first = np.empty(len(distinct), np.int64)
            first[words[::-1]] = np.arange(len(h))[::-1]  # the first of each word is written last
            # The most frequent word has number 0, so that numbers are small.
            count = np.bincount(words, minlength=len(distinct))
            by = np.argsort(-count, kind="stable")
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            words, first = place[words], first[by]
            data, start, stop = b"".join(texts), np.concatenate(starts)[first].tolist(), np.concatenate(ends)[first].tolist()
            pieces, lengths = coder.ids([data[a:b] for a, b in zip(start, stop, strict=True)])
            trained = np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 5 != held_out for i in ids])
            learnt = np.bincount(words[np.repeat(trained, size)], minlength=len(by))
            cells = [ids, trained.tobytes(), size.astype(np.int32).tobytes(), (words & 0xFFFF).astype("<u2").tobytes(), (words >> 16).astype("<u2").tobytes()]
            row = [pa.array([block]), pa.array([done]), *(pa.array([c], pa.list_(pa.int64()) if k == 0 else pa.binary()) for k, c in enumerate(cells))]
            row += [pa.array([distinct[by].view(np.int64)], pa.list_(pa.int64())), pa.array([learnt.astype(np.int32)], pa.list_(pa.int32()))]
            row += [pa.array([c], pa.binary()) for c in (pieces.tobytes(), lengths.astype(np.int32).tobytes())]
            return pa.RecordBatch.from_arrays(row, names=[c.split()[0] for c in _BLOCK.split(", ")])

        for batch in batches:
            known = batch.column(0).to_pylist()
            for i, j, data, offsets in text_chunks(batch, "text"):
                if ids and held + len(data) > BLOCK_BYTES:
                    yield made()
                    block, done = block + 1, done + len(ids)
                    ids, hashes, starts, ends, sizes, texts, held = [], [], [], [], [], [], 0
                start, end, bounds = words_of(data, offsets)
                ids += known[i:j]
                hashes.append(word_hashes(data, start, end))
                starts.append(start + held)
                ends.append(end + held)
                sizes.append(np.diff(bounds))
                texts.append(LOWER[data].tobytes())
                held += len(data)
        if ids:
            yield made()

    return run


class Block:
    """A row of the stored blocks, as arrays."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        cell = lambda name: batch.column(batch.schema.get_field_index(name))[row]
        raw = lambda name, kind: np.frombuffer(cell(name).as_py(), kind)
        self.ids, self.first = cell("ids").values, cell("first").as_py()
        self.trained, self.sizes = raw("trained", bool), raw("sizes", np.int32).astype(np.int64)
        self.words = raw("low", "<u2").astype(np.int64) | raw("high", "<u2").astype(np.int64) << 16
        self.pieces, self.lengths = raw("pieces", _SUBWORD), raw("lengths", np.int32).astype(np.int64)
        self._cell = cell

    @property
    def hashes(self) -> np.ndarray:
        return self._cell("hashes").values.to_numpy()

    @property
    def learnt(self) -> np.ndarray:
        return self._cell("learnt").values.to_numpy()

    def stream(self, docs: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(subwords, subwords of each word, subwords of each text) of these texts; each text has `end` after its words, which counts as a word."""
        bounds = np.concatenate([[0], np.cumsum(self.sizes)])
        take = np.repeat(bounds[docs] - np.cumsum(self.sizes[docs]) + self.sizes[docs], self.sizes[docs]) + np.arange(self.sizes[docs].sum())
        # Word number -1 is the end.
        words = np.insert(self.words[take], np.cumsum(self.sizes[docs]), -1)
        lengths, pieces = np.append(self.lengths, 1), np.append(self.pieces, np.uint16(end))
        first = np.cumsum(lengths) - lengths
        n = lengths[words]
        at = np.repeat(first[words] - np.cumsum(n) + n, n) + np.arange(n.sum())
        ends = np.cumsum(self.sizes[docs] + 1)
        return pieces[at], n, np.diff(np.concatenate([[0], np.cumsum(n)[ends - 1]])) if len(docs) else np.zeros(0, np.int64)


def windows(stream: np.ndarray, sizes: np.ndarray, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(inputs, targets, positions) of SLICE windows at a time: a row for each STRIDE positions of a text; what stands before a text is PAD, and what goes beyond its end has position -1.

    The input of a position is the subword before it, that of a text's first the end of another.
    """
    count = -(-sizes // STRIDE)
    first, before = np.cumsum(sizes) - sizes, np.cumsum(count) - count
    for low in range(0, int(count.sum()), SLICE):
        number = np.arange(low, min(low + SLICE, int(count.sum())))
        text = np.searchsorted(before + count, number, side="right")
        start, row = first[text][:, None], ((number - before[text]) * STRIDE)[:, None]
        within = row + np.arange(STRIDE)
        position = np.where(within < sizes[text][:, None], within + start, -1)
        back = row + np.arange(-CONTEXT, STRIDE) - 1
        inputs = np.where(back < 0, np.where(back == -1, end, PAD), stream[np.clip(back + start, 0, len(stream) - 1)])
        inputs[:, CONTEXT:][position < 0] = PAD
        yield inputs, stream[position], position


@dataclass
class Model:
    """What scores a window: leaves of subwords, log counts, and the network's weights."""

    end: int
    leaf: np.ndarray  # of each subword
    within: np.ndarray  # log of a subword's share of its leaf
    groups: np.ndarray  # log share of each group after each leaf
    leaves: np.ndarray  # log share of each leaf after each leaf, by group
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Attention of the scored positions of windows x and the hidden state after it."""
        w, ask = self.weights, x[:, CONTEXT:]
        q, k, v = (w[name].take(at, 0, mode="clip") for name, at in (("query", ask), ("key", x), ("value", x)))
        a = np.matmul(q, k.transpose(0, 2, 1))
        a += _distance(w["near"])
        _even(a, np.ones(LENGTH, a.dtype))
        o = np.matmul(a, v).reshape(-1, KEY)
        hidden = o @ w["out"]
        hidden += w["own"].take(ask.ravel(), 0, mode="clip")
        np.maximum(hidden, 0, out=hidden)
        return {"q": q, "k": k, "v": v, "a": a, "o": o, "hidden": hidden, "ask": ask.ravel()}

    def log_probability(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """See Scorer."""
        return Scorer(self).log_probability(x, y)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean loss over the positions with y >= 0."""
        state, w = self.forward(x), self.weights
        hidden, ask, y = state["hidden"], state["ask"], y.ravel()
        live = np.flatnonzero(y >= 0)
        scale = np.float32(1 / max(1, len(live)))
        group, inner = y[live] // PER_GROUP, y[live] % PER_GROUP
        down = np.zeros_like(hidden)

        def softmax(at: np.ndarray, logits: np.ndarray, target: np.ndarray) -> np.ndarray:
            _even(logits, np.ones(logits.shape[1], logits.dtype))
            logits[np.arange(len(at)), target] -= 1
            logits *= scale
            return logits

        step = softmax(live, hidden[live] @ w["group"] + self.groups[ask[live]], group)
        grad = {"group": hidden[live].T @ step, "leaf": np.zeros_like(w["leaf"])}
        down[live] = step @ w["group"].T
        by = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[by], np.arange(GROUPS + 1))
        for g in range(GROUPS):
            own = by[cuts[g] : cuts[g + 1]]
            if len(own):
                at = live[own]
                step = softmax(at, hidden[at] @ w["leaf"][g] + self.leaves[ask[at], g], inner[own])
                grad["leaf"][g] = hidden[at].T @ step
                down[at] += step @ w["leaf"][g].T
        down *= hidden > 0
        grad["out"] = state["o"].T @ down
        to = (down @ w["out"].T).reshape(len(x), STRIDE, KEY)
        a = state["a"]
        da = np.matmul(to, state["v"].transpose(0, 2, 1))
        dv = np.matmul(a.transpose(0, 2, 1), to)
        da -= (da * a).sum(-1, keepdims=True)
        da *= a
        dq, dk = np.matmul(da, state["k"]), np.matmul(da.transpose(0, 2, 1), state["q"])
        grad["near"] = np.bincount(_BEHIND.ravel(), da.sum(0).ravel(), LENGTH + 1)[:LENGTH].astype(np.float32)
        asked = _scattered(ask, np.concatenate([dq.reshape(-1, KEY), down], 1))
        grad["query"], grad["own"] = asked[:, :KEY], asked[:, KEY:]
        seen = _scattered(x.ravel(), np.concatenate([dk.reshape(-1, KEY), dv.reshape(-1, KEY)], 1))
        grad["key"], grad["value"] = seen[:, :KEY], seen[:, KEY:]
        return grad

    def train(self, x: np.ndarray, y: np.ndarray, rate: float, times: int, seed: int) -> None:
        """Adam steps over the windows, in random order each time."""
        self.weights = {k: v.copy() for k, v in self.weights.items()}
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        rng, n = np.random.default_rng(seed), 0
        size = BATCH * max(1, min(4, len(x) // (64 * BATCH)))
        for _ in range(times):
            order = rng.permutation(len(x))
            for i in range(0, len(x), size):
                at = order[i : i + size]
                n += 1
                for k, g in self.gradients(x[at].astype(np.int64), y[at].astype(np.int64)).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    self.weights[k] -= rate * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-6)
                _fixed(self.weights)


#: How far a key stands behind each scored position; LENGTH where it stands after it.
_BEHIND = np.arange(STRIDE)[:, None] + CONTEXT - np.arange(LENGTH)[None]
_BEHIND = np.where(_BEHIND < 0, LENGTH, _BEHIND)


def _distance(near: np.ndarray) -> np.ndarray:
    """What is added for the distance of a key; keys after the position are masked."""
    return np.append(near, np.float32(-1e9))[_BEHIND]


class Scorer:
    """A model's weights as tables over leaves, made once in a task.

    What a key weighs for a query depends on their two leaves and their distance only, so both factors are looked up; no
    exponential is taken for a position and a key. Each factor is bounded from below by that of FLOOR, so that their sum is never 0.
    """

    def __init__(self, model: Model):
        w = self.weights = model.weights
        logits = w["query"] @ w["key"].T
        logits -= logits[:, :PAD].max(1, keepdims=True)
        self.pair = np.exp(np.maximum(logits, FLOOR))
        self.pair[:, PAD] = 0
        near = np.exp(np.maximum(w["near"] - w["near"].max(), FLOOR))
        self.near = np.append(near, near.dtype.type(0))[_BEHIND]  # keys after the position are masked
        value = w["value"] @ w["out"]
        self.value = np.concatenate([value, np.ones_like(value[:, :1])], 1)  # the last cell sums what the keys weigh
        self.groups, self.leaves = model.groups, np.ascontiguousarray(model.leaves.transpose(1, 0, 2))
        self.ones = np.ones(PER_GROUP, value.dtype), np.ones(GROUPS, value.dtype)

    def log_probability(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log of the probability of the leaf y at each scored position, in order; y < 0 gives anything."""
        ask, y = x[:, CONTEXT:].ravel(), np.maximum(y.ravel(), 0)
        group, inner = y // PER_GROUP, y % PER_GROUP
        hidden, out = np.empty((len(y), HIDDEN), self.value.dtype), np.empty(len(y), self.value.dtype)
        # Few windows at a time, which a core's cache holds; groups of leaves over all.
        for i in range(0, len(x), HELD):
            seen = x[i : i + HELD].astype(np.int32)
            a = self.pair.take(seen[:, CONTEXT:, None] * np.int32(LEAVES + 1) + seen[:, None], mode="clip")
            a *= self.near
            o = np.matmul(a, self.value.take(seen, 0, mode="clip")).reshape(-1, HIDDEN + 1)
            at = slice(i * STRIDE, (i + len(seen)) * STRIDE)
            h = hidden[at]
            np.divide(o[:, :HIDDEN], o[:, HIDDEN:], out=h)
            h += self.weights["own"].take(ask[at], 0, mode="clip")
            np.maximum(h, 0, out=h)
            logits = h @ self.weights["group"]
            logits += self.groups.take(ask[at], 0, mode="clip")
            own = logits[np.arange(len(h)), group[at]]
            out[at] = own - np.log(np.exp(logits, out=logits) @ self.ones[1])
        by = np.argsort(group.astype(np.int8), kind="stable")
        cuts = np.searchsorted(group[by], np.arange(GROUPS + 1))
        for g in range(GROUPS):
            at = by[cuts[g] : cuts[g + 1]]
            if len(at):
                logits = hidden.take(at, 0) @ self.weights["leaf"][g]
                logits += self.leaves[g].take(ask[at], 0, mode="clip")
                own = logits[np.arange(len(at)), inner[at]]
                out[at] += own - np.log(np.exp(logits, out=logits) @ self.ones[0])
        return out


def _even(logits: np.ndarray, ones: np.ndarray) -> None:
    """Softmax of the last axis in place; logits are bounded, so that no sum is 0 or infinite."""
    np.clip(logits, -80, 80, out=logits)
    np.exp(logits, out=logits)
    logits /= (logits @ ones)[..., None]


def _scattered(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the values' rows by number."""
    return np.stack([np.bincount(rows, c, LEAVES + 1) for c in values.T], 1).astype(np.float32)


def _fixed(weights: dict[str, np.ndarray]) -> None:
    """The last cell of a query is 1 and that of a key its own weight, by which PAD is masked."""
    weights["query"][:, -1] = 1
    weights["key"][PAD] = 0
    weights["key"][PAD, -1] = -1e4


def fresh_weights(seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    made = lambda *shape: (rng.normal(size=shape) * 0.2).astype(np.float32)
    zero = lambda *shape: np.zeros(shape, np.float32)
    out = {"query": made(LEAVES + 1, KEY), "key": made(LEAVES + 1, KEY), "value": made(LEAVES + 1, KEY), "own": made(LEAVES + 1, HIDDEN), "near": zero(LENGTH), "out": made(KEY, HIDDEN), "group": zero(HIDDEN, GROUPS), "leaf": zero(GROUPS, HIDDEN, PER_GROUP)}
    _fixed(out)
    return out


def leaves_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, log share of its leaf) of each subword: the most frequent have leaves of their own, the rest share GROUPS leaves."""
    by = np.argsort(-counts, kind="stable")
    single = LEAVES - GROUPS
    leaf = np.empty(len(counts), np.int64)
    leaf[by] = np.minimum(np.arange(len(counts)), single + np.arange(len(counts)) % GROUPS)
    mass = counts + 0.5
    return leaf, np.log(mass / np.bincount(leaf, mass, LEAVES)[leaf])


def grouped_leaves(pairs: np.ndarray) -> np.ndarray:
    """A place for each leaf so that runs of PER_GROUP leaves have similar predecessors: halved again and again by the leading direction of log counts."""
    share = np.log1p(pairs)
    runs = [np.arange(LEAVES)]
    while len(runs) < GROUPS:
        cut = []
        for run in runs:
            m = share[:, run] - share[:, run].mean(1, keepdims=True)
            v = np.ones(len(run)) + np.arange(len(run)) / len(run)
            for _ in range(30):
                v = m.T @ (m @ v)
                v /= np.sqrt((v * v).sum()) or 1
            by = run[np.argsort(v, kind="stable")]
            cut += [by[: len(by) // 2], by[len(by) // 2 :]]
        runs = cut
    place = np.empty(LEAVES, np.int64)
    place[np.concatenate(runs)] = np.arange(LEAVES)
    return place


def model_of(counts: np.ndarray, end: int, leaf: np.ndarray, within: np.ndarray, pairs: np.ndarray) -> Model:
    """An untrained model from the counts of leaf pairs; leaves are renumbered by groups."""
    place = grouped_leaves(pairs)
    moved = np.zeros_like(pairs)
    moved[np.ix_(place, place)] = pairs
    single = np.bincount(place[leaf], counts + 0.5, LEAVES)
    share = single / single.sum()
    log = (moved + PRIOR * share) / (moved.sum(1, keepdims=True) + PRIOR)
    log = np.concatenate([log, share[None]]).reshape(LEAVES + 1, GROUPS, PER_GROUP)  # PAD is never asked
    return Model(end, place[leaf], within, np.log(log.sum(2)).astype(np.float32), np.log(log).astype(np.float32), fresh_weights())


def _subword_counts(end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(end + 1)
        for batch in batches:
            for row in range(len(batch)):
                pieces, lengths = (np.frombuffer(batch.column(k)[row].as_py(), kind) for k, kind in ((0, _SUBWORD), (1, np.int32)))
                total += np.bincount(pieces, np.repeat(batch.column(2)[row].values.to_numpy(), lengths), end + 1)
                total[end] += np.frombuffer(batch.column(3)[row].as_py(), bool).sum()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at].astype(np.int64))], names=["k", "n"])

    return run


def _material(end: int, leaf: np.ndarray):
    """Counts of leaf pairs (round -1) and the windows of each round; each window has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(LEAVES * LEAVES, np.int64)

        def batch_of(n: int, part: np.ndarray, k: np.ndarray, count: np.ndarray, x: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(k, pa.int64()), pa.array(count, pa.int64()), pa.array(x, pa.binary())], names=["round", "k", "n", "x"])

        for batch in batches:
            for row in range(len(batch)):
                block = Block(batch, row)
                docs = np.flatnonzero(block.trained)
                stream, _, sizes = block.stream(docs, end)
                leaves = leaf[stream]
                before = np.concatenate([[leaf[end]], leaves[:-1]])  # each text ends with `end`
                counts += np.bincount(before * LEAVES + leaves, minlength=LEAVES * LEAVES)
                # A window's round depends on the block's number and the window's place in it only.
                number = batch.column(0)[row].as_py()
                rng = np.random.default_rng([number >> 32, number & 0xFFFFFFFF])
                for x, y, _ in windows(leaves, sizes, int(leaf[end])):
                    y[x[:, CONTEXT:] == PAD] = -1
                    draw = rng.integers(0, ROUNDS, len(x))
                    for r in range(ROUNDS):
                        at = np.flatnonzero(draw == r)
                        if len(at):
                            yield batch_of(1, [r], [0], [len(at)], [np.concatenate([x[at], y[at]], 1).astype(np.int16).tobytes()])
        at = np.flatnonzero(counts)
        yield batch_of(len(at), np.full(len(at), -1), at, counts[at], [None] * len(at))

    return run


def _train(shared, round_: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.frombuffer(x.as_py(), np.int16).reshape(-1, LENGTH + STRIDE) for batch in batches for x in batch.column(0)]
        if rows:
            both = np.concatenate(rows)
            model = shared.value
            model = Model(model.end, model.leaf, model.within, model.groups, model.leaves, model.weights)
            task = TaskContext.get().partitionId()
            model.train(both[:, :LENGTH], both[:, LENGTH:], RATE * (1 - round_ / ROUNDS) + 1e-3, times, 1000 * round_ + task)
            flat = np.concatenate([model.weights[k].ravel() for k in sorted(model.weights)]).astype(np.float64) * len(both)
            parts = np.array_split(flat, SEGMENTS)
            yield pa.RecordBatch.from_arrays([pa.array(range(SEGMENTS), pa.int32()), pa.array([task] * SEGMENTS, pa.int64()), pa.array([float(len(both))] * SEGMENTS), pa.array([p.tobytes() for p in parts], pa.binary())], names=["segment", "task", "n", "flat"])

    return run


def _added(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x, np.float64) for x in table.column("flat").to_pylist()], 0)
    return pa.table({"segment": table.column("segment")[:1], "task": pa.array([table.column("task")[0].as_py() // 64], pa.int64()), "n": pa.array([float(np.sum(table.column("n").to_numpy()))]), "flat": pa.array([total.tobytes()], pa.binary())})


def _averaged(rows: DataFrame, weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The mean of the tasks' weights, summed by segment for 64 tasks at a time and then for all."""
    kinds = "segment int, task long, n double, flat binary"
    few = rows.groupBy("segment", F.floor(F.col("task") / 64).alias("some")).applyInArrow(_added, kinds)
    whole = few.groupBy("segment").applyInArrow(_added, kinds).orderBy("segment").collect()  # SEGMENTS rows
    if not whole:
        return weights
    flat = np.concatenate([np.frombuffer(r["flat"], np.float64) for r in whole]) / whole[0]["n"]
    out, at = {}, 0
    for k in sorted(weights):
        out[k] = flat[at : at + weights[k].size].reshape(weights[k].shape).astype(np.float32)
        at += weights[k].size
    _fixed(out)
    return out


def trained(blocks: DataFrame, end: int) -> Model:
    """A model of the training texts of the stored blocks, which has learnt from every window of them."""
    spark = blocks.sparkSession
    found = blocks.select("pieces", "lengths", "learnt", "trained").mapInArrow(_subword_counts(end), "k long, n long")
    counts = np.zeros(end + 1)
    for r in found.groupBy("k").agg(F.sum("n").alias("n")).collect():  # the vocabulary at most
        counts[r["k"]] = r["n"]
    leaf, within = leaves_of(counts)
    about = max(1.0, counts.sum() / STRIDE)
    times = max(1, round(min(LEAST_WINDOWS / about, 20)))
    material = staged(blocks.mapInArrow(_material(end, leaf), "round int, k long, n long, x binary"), "material", compression="zstd", **LARGE_ROWS)  # windows overlap
    pairs = np.zeros(LEAVES * LEAVES)
    cells = material.where("round = -1").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # LEAVES * LEAVES rows at most
    pairs[cells.column("k").to_numpy()] = cells.column("n").to_numpy()
    model = model_of(counts, end, leaf, within, pairs.reshape(LEAVES, LEAVES))
    place = np.empty(LEAVES + 1, np.int16)
    place[PAD] = PAD
    place[leaf] = model.leaf
    for r in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)
        rows = material.where(F.col("round") == r).select("x").mapInArrow(_renumbered(place, _train(shared, r, times)), "segment int, task long, n double, flat binary")
        weights = _averaged(rows, model.weights)
        model = Model(model.end, model.leaf, model.within, model.groups, model.leaves, weights)
    return model


def _renumbered(place: np.ndarray, then):
    """Windows of leaves by count become windows of leaves by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def moved() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for x in batch.column(0):
                    old = np.frombuffer(x.as_py(), np.int16)
                    out.append(np.where(old < 0, np.int16(-1), place[old]).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["x"])

        yield from then(moved())

    return run


def _head_counts(hashes: np.ndarray, head: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of those hashes that are in the sorted head, 0 for the rest."""
    if not len(head):
        return np.zeros(len(hashes))
    at = np.minimum(np.searchsorted(head, hashes), len(head) - 1)
    return np.where(head[at] == hashes, counts[at], 0).astype(float)


def _least_of_head(counts: DataFrame) -> int:
    """The least count of the head's words: as low as leaves HEAD words at most."""
    by = counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(HEAD).toPandas()
    fits = by["c"][by["n"].cumsum() <= HEAD]
    return int(fits.min()) if len(fits) else int(by["c"].max() if len(by) else 0) + 1


_SCORED = "hash long, row long, log float, doc_id long, held_out boolean, n_tokens long, known long, base double, score double"


def _scores(shared, shared_head, end_count: int, total: int, distinct: int, word_share: float):
    """A row for each text, with what the head and the end give it, and one (hash, row, log) for each other word: the natural log of its subwords' probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (head, head_counts) = shared.value, shared_head.value
        scorer = Scorer(model)
        names, kinds = zip(*(c.split() for c in _SCORED.split(", ")), strict=True)
        kinds = [{"long": pa.int64(), "float": pa.float32(), "boolean": pa.bool_(), "double": pa.float64()}[k] for k in kinds]

        def rows_of(n: int, **cells: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(cells[c], k) if c in cells else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names=list(names))

        for batch in batches:
            for row in range(len(batch)):
                block = Block(batch, row)
                hashes = block.hashes
                counts = np.append(_head_counts(hashes, head, head_counts), end_count)
                docs = np.arange(len(block.sizes))
                stream, per_word, sizes = block.stream(docs, model.end)
                each = model.within[stream]
                for x, y, position in windows(model.leaf[stream], sizes, int(model.leaf[model.end])):
                    live = position.ravel() >= 0
                    each[position.ravel()[live]] += scorer.log_probability(x, y)[live]
                words = np.insert(block.words, np.cumsum(block.sizes), -1)
                by_word = np.add.reduceat(each, np.cumsum(per_word) - per_word)
                share = np.maximum(counts - DISCOUNT, 0) / max(1.0, total - DISCOUNT * distinct)
                # Logarithms are added, as a long word is too unlikely for a float.
                score = np.logaddexp(np.log(word_share * share + 1e-300)[words], np.log(1 - word_share) + by_word) / np.log(10)
                base = np.log10((counts + 0.5) / (total + 0.5 * (distinct + 1)))
                rare = np.append(counts[:-1] == 0, False)
                first = np.cumsum(block.sizes + 1) - block.sizes - 1
                known, base, score = (np.add.reduceat(v, first) for v in ((counts > 0).astype(np.int64)[words], np.where(rare, 0, base)[words], np.where(rare[words], 0, score)))
                number = block.first + docs
                ids = block.ids.to_numpy(zero_copy_only=False) if not block.ids.null_count else block.ids
                # The hash of a text's own row only deals it out.
                yield rows_of(len(docs), hash=number, row=number, doc_id=ids, held_out=~block.trained, n_tokens=block.sizes + 1, known=known, base=base, score=score)
                at = np.flatnonzero(rare[words])
                text = np.repeat(number, block.sizes + 1)
                for i in range(0, len(at), 100_000):
                    own = at[i : i + 100_000]
                    yield rows_of(len(own), hash=hashes[words[own]], row=text[own], log=by_word[own].astype(np.float32))

    return run


def attention_lm(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", held_out: int = HELD_OUT, word_share: float = WORD_SHARE) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    Rows whose crc32(doc_id as text) mod 5 is `held_out` are scored, but not
    learnt from; a null id counts as an empty text. Null and empty texts are the
    end of a text only. Repeated rows are learnt from and scored each; texts of
    any length are scored whole; an empty table gives an empty one; other
    columns are ignored. Without training rows the base gives every token
    probability 1 and the model even shares. Words are equal if their 64-bit
    hashes are. The counts are exact whatever the layout of the table; the
    weights, and with them `score`, vary a little with it, as tasks train on
    what they hold.
    """
    spark = docs.sparkSession
    lean(spark)
    end = subwords(ranks_path, pattern).end
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").cast("binary").alias("text"))
    blocks = staged(rows.mapInArrow(_blocks(ranks_path, pattern, held_out), _BLOCK), "blocks", **LARGE_ROWS)

    counts = blocks.select(F.inline(F.arrays_zip(F.col("hashes").alias("hash"), F.col("learnt").alias("c")))).where("c > 0")
    counts = staged(counts.groupBy("hash").agg(F.sum("c").alias("c")), "counts")
    texts = F.length(F.replace(F.hex("trained"), F.lit("0"), F.lit("")))
    learnt = blocks.agg(F.coalesce(F.sum(texts), F.lit(0)).alias("texts")).first()["texts"]
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count("*").alias("v")).first()
    total, distinct = sums["c"] + learnt, sums["v"] + (learnt > 0)
    most = _least_of_head(counts)
    head = counts.where(F.col("c") >= most).toArrow()  # HEAD rows at most
    by = np.argsort(head.column("hash").to_numpy())
    shared_head = spark.sparkContext.broadcast((head.column("hash").to_numpy()[by], head.column("c").to_numpy()[by]))
    shared = spark.sparkContext.broadcast(trained(blocks, end))

    needed = blocks.select("first", "ids", "trained", "sizes", "low", "high", "hashes", "pieces", "lengths")
    rows = needed.mapInArrow(_scores(shared, shared_head, learnt, total, distinct, word_share), _SCORED)
    rows = rows.join(counts.where(F.col("c") < most), "hash", "left")
    c, word = F.coalesce("c", F.lit(0)), F.col("log").isNotNull()
    base = F.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
    network = F.col("log") / np.log(10) + float(np.log10(1 - word_share))
    share = word_share * (c - DISCOUNT) / max(1.0, total - DISCOUNT * distinct)
    both = F.when(c > DISCOUNT, F.log10(share + (1 - word_share) * F.exp(F.col("log").cast("double")))).otherwise(network)
    known = F.when(word, F.when(c > 0, 1).otherwise(0)).otherwise(F.col("known"))
    own = [F.max(k).alias(k) for k in ("doc_id", "held_out", "n_tokens")]  # one row of each text has them
    sums = [F.sum(known).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), F.sum(F.when(word, base).otherwise(F.col("base"))).alias("base_score"), F.sum(F.when(word, both).otherwise(F.col("score"))).alias("score")]
    return rows.groupBy("row").agg(*own, *sums).drop("row")


def op11_attention_lm(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents on the ids of the multilingual vocabulary."""
    import public_tokenizers

    return attention_lm(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
