"""LM scoring: a log-bilinear neural model trained by noise-contrastive estimation, over whole-corpus counts.

Counts. Every training document's words are counted (pre-aggregated per batch, summed by word); totals, the
vocabulary and the add-one base model come from these counts.

Model. The most frequent words, CLASSES of them at most, are *symbols* of their own; all others share one symbol, and
the end is one more. The prediction for a position is the sum of its context symbols' vectors, each scaled by a
vector of its distance. Symbols are grouped by frequency rank into about the square root of their number of groups,
and a symbol's probability is its group's, after the context, times its own within the group, after the context:
both are softmaxes of the prediction's products with vectors plus biases, so the whole is normalised at the cost of
two square roots. Within the shared symbol a word has its add-one share of the symbol's counts, so the result is a
distribution over the vocabulary and one unseen word, like the base model.

Training. Each document's symbols are staged once. Documents are dealt by a hash of id and text to *streams*, and
streams to *rounds*, whose numbers follow from the tokens alone. In a round each stream goes once over its documents in the
order of their hashes, in minibatches, from the model of the round before (first: the unigram distribution). A
parameter, and what AdaGrad has seen of it, then becomes its start plus the mean change in the streams that touched it.
Each round learns from documents of its own, so rounds cost no further pass; what they add up to is that a parameter sees
DEPTH tokens of learning in sequence instead of a stream's. Means are taken in the order of streams, so partitions don't
change the model.

Lookup. The counts of the most frequent words, as many as fit a fixed bound, are broadcast; occurrences of any
other word are matched with its count by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.frequent import most_frequent
from fieldloom.llm.labels import id_crc32
from fieldloom.llm.text import word_hashes, words
from fieldloom.staging import stage

#: Words that the network tells apart at most (two bytes a symbol), context words, size of vectors.
CLASSES, CONTEXT, DIM = 16_384, 4, 16
#: Groups drawn as noise for a minibatch of so many words, words drawn for each word, and the rate of AdaGrad.
NOISE, OWN_NOISE, BATCH, RATE = 32, 2, 3072, 0.6
#: Consecutive words that go into a minibatch together: the vectors of their contexts are looked up once.
CHUNK = 64
#: Tokens of a stream on average, and documents' tokens that are learned from at a time.
STREAM, LEARN = 1 << 20, 1 << 16
#: Tokens that are learned from one after the other, over all rounds: streams of a round run beside each other.
DEPTH = 1 << 23
#: Words whose counts are broadcast, at most.
HEAD = 1 << 18
_SLICE = 1 << 19
#: Parameters in one row of a sum.
_BLOCK = 1 << 13
END = xxhash.xxh64_intdigest(b"", 1) - (1 << 64 if xxhash.xxh64_intdigest(b"", 1) >> 63 else 0)


def _slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, hashes of the different words and of the end, their place for each token, and tokens per row, of some rows at a time."""
    first, held, lengths = 0, [], []
    for k in range(len(texts)):
        text = texts[k].as_py()
        own = words(text and text.lower())
        held += own
        held.append(b"")  # the end: no word is empty
        lengths.append(len(own) + 1)
        if len(held) >= _SLICE or k == len(texts) - 1:
            coded = pa.array(held, pa.binary()).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            h = word_hashes(distinct).view(np.int64)
            h[distinct.index(b"")] = END
            yield first, h, coded.indices.to_numpy(), np.array(lengths, np.int64)
            first, held, lengths = k + 1, [], []


# --------------------------------------------------------------------------------------------------- counts


def count_words(docs: DataFrame) -> DataFrame:
    """``(word, n)``: occurrences of each word (as XXH64) and of the end in ``docs(text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, w, at, _ in _slices(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(np.bincount(at, minlength=len(w)))], ["word", "n"])

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Totals of the counts, and the most frequent words by hash with their counts and symbols (``classes``)."""

    tokens: int
    size: int
    ends: int
    words: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    n_classes: int

    @property
    def other(self) -> int:
        """The symbol of words without one of their own; the end's is the next, and what is before a text the one after."""
        return self.n_classes

    @property
    def other_total(self) -> int:
        """Denominator of a word's share in that symbol."""
        own = self.classes < self.n_classes
        return self.tokens - int(self.counts[own].sum()) - self.ends + self.size - int(own.sum()) - (self.ends > 0) + 1

    def noise(self) -> np.ndarray:
        """Add-one unigram distribution over the symbols."""
        n = np.zeros(self.n_classes + 2)
        own = self.classes < self.n_classes
        n[self.classes[own]] = self.counts[own]
        n[-2:] = self.tokens - n.sum() - self.ends, self.ends
        return (n + 1) / (n + 1).sum()

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word in the tables, and whether it is there."""
        if not len(self.words):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return at, self.words[at] == h

    def class_of(self, h: np.ndarray, at: np.ndarray, known: np.ndarray) -> np.ndarray:
        c = np.full(len(h), self.other, np.uint16)
        c[known] = self.classes[at[known]]
        c[h == END] = self.n_classes + 1
        return c


def vocabulary(counts: DataFrame, classes: int | None = None, head: int = HEAD) -> Vocabulary:
    """The vocabulary of a table of counts; words as frequent as the bound allows are collected."""
    classes = CLASSES if classes is None else classes
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.max(F.when(F.col("word") == END, F.col("n"))), F.lit(0)).alias("e")).first()
    w, n = most_frequent(counts, "word", head, F.col("word") == END)
    own = np.lexsort((w, -n))
    own = own[w[own] != END][:classes]
    of = np.full(len(w), len(own), np.int32)
    of[own] = np.arange(len(own))
    of[w == END] = len(own) + 1
    return Vocabulary(total["n"], total["v"], total["e"], w, n, of, len(own))


# ---------------------------------------------------------------------------------------------------- model


@dataclass
class LogBilinear:
    """Context vectors of symbols (one more, for before the text), distance vectors, group vectors and biases, and
    vectors and biases of the words within their groups of ``width`` consecutive words."""

    context: np.ndarray
    distance: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    word: np.ndarray
    word_bias: np.ndarray
    width: int

    @classmethod
    def start(cls, noise: np.ndarray, dim: int = DIM, context: int = CONTEXT, seed: int = 42) -> LogBilinear:
        """The unigram distribution ``noise`` over words, the shared symbol and the end, and small random vectors."""
        r = np.random.default_rng(seed)
        draw = lambda *shape: r.normal(0, 0.1, shape).astype(np.float32)
        words = len(noise) - 2
        width = max(1, int(np.ceil(np.sqrt(words))))
        groups = _group_noise(noise, width)
        own = noise[:words] / np.repeat(groups[:-2], width)[:words]
        return cls(draw(len(noise) + 1, dim), np.full((context, dim), 1 / context, np.float32), draw(len(groups), dim), np.log(groups).astype(np.float32), draw(words, dim), np.log(own).astype(np.float32), width)

    @property
    def tables(self) -> tuple[np.ndarray, ...]:
        return self.context, self.distance, self.target, self.bias, self.word, self.word_bias

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.tables])

    def like(self, flat: np.ndarray) -> LogBilinear:
        parts, at = [], 0
        for x in self.tables:
            parts.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return LogBilinear(*parts, self.width)

    def group_of(self, c: np.ndarray) -> np.ndarray:
        words = len(self.word)
        c = c.astype(np.int64)
        return np.where(c < words, c // self.width, c - words + len(self.bias) - 2)

    def predict(self, before: np.ndarray) -> np.ndarray:
        """The vector predicted for each position from the symbols before it."""
        q = self.context[before[:, 0]] * self.distance[0]
        for d in range(1, before.shape[1]):
            q += self.context[before[:, d]] * self.distance[d]
        return q

    def log_probs(self, c: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Natural log-probability of each symbol in ``c`` after its context, normalised over all symbols."""
        return self._log_probs(c, self.predict(before))

    def text_log_probs(self, row: np.ndarray, real: np.ndarray) -> np.ndarray:
        """The same for the ``real`` places of a row of texts as ``laid_out`` gives it."""
        vectors, q = self.context[row], np.zeros((len(row), self.context.shape[1]), np.float32)
        for d, scale in enumerate(self.distance, 1):
            q[d:] += vectors[:-d] * scale
        return self._log_probs(row[real], q[real])

    def _log_probs(self, c: np.ndarray, q: np.ndarray, step: int = 1024) -> np.ndarray:
        out, group = np.empty(len(c), np.float64), self.group_of(c)
        far = np.sqrt(np.einsum("nd,nd->n", q, q).max(initial=0))
        target = np.ascontiguousarray(self.target.T)
        tame = _tame(far, target, self.bias)
        for k in range(0, len(c), step):
            out[k : k + step] = _log_softmax(q[k : k + step], target, self.bias, group[k : k + step], tame)
        order = np.argsort(group.astype(np.uint16), kind="stable")
        cuts = np.searchsorted(group[order], np.arange(len(self.bias) - 1))
        for g in range(len(self.bias) - 2):
            first = g * self.width
            target, bias = np.ascontiguousarray(self.word[first : first + self.width].T), self.word_bias[first : first + self.width]
            tame = _tame(far, target, bias)
            for k in range(cuts[g], cuts[g + 1], step):
                at = order[k : min(k + step, cuts[g + 1])]
                out[at] += _log_softmax(q.take(at, axis=0), target, bias, c[at].astype(np.int64) - first, tame)
        return out


def _group_noise(noise: np.ndarray, width: int) -> np.ndarray:
    """Probabilities of the groups of words, the shared symbol and the end."""
    words = len(noise) - 2
    return np.append(np.add.reduceat(noise[:words], np.arange(0, words, width)), noise[-2:]) if words else noise[-2:]


def _tame(far: float, target: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no exponential of a product with ``target`` plus ``bias`` can overflow or vanish, for vectors up to ``far`` long."""
    return bool(far * np.sqrt(np.einsum("dn,dn->n", target, target).max(initial=0)) + np.abs(bias).max(initial=0) < 60)


def _log_softmax(q: np.ndarray, target: np.ndarray, bias: np.ndarray, own: np.ndarray, tame: bool = False) -> np.ndarray:
    """Log-softmax at ``own`` of each row; if ``tame``, without the shift by a row's greatest value."""
    s = q @ target
    s += bias
    value = s.ravel().take(np.arange(len(s)) * s.shape[1] + own)
    if not tame:
        top = s.max(axis=1)
        s -= top[:, None]
        value = value - top
    np.exp(s, out=s)
    return value - np.log(s @ np.ones(s.shape[1], s.dtype))


def contexts(c: np.ndarray, lengths: np.ndarray, start: int, context: int = CONTEXT) -> np.ndarray:
    """The symbols before each position of each text, nearest first; ``start`` before the text."""
    place = np.arange(len(c)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.full((len(c), context), start, np.uint16)
    for d in range(1, context + 1):
        inside = np.flatnonzero(place >= d)
        out[inside, d - 1] = c[inside - d]
    return out


def laid_out(texts: list[np.ndarray], start: int, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray]:
    """Texts in one row, before each as many ``start`` symbols as a context has, and which places are a text's own."""
    before = np.full(context, start, np.uint16)
    row = np.concatenate([x for t in texts for x in (before, t)])
    real = np.ones(len(row), bool)
    ends = np.cumsum([len(t) + context for t in texts])
    real[(np.r_[0, ends[:-1]][:, None] + np.arange(context)).ravel()] = False
    return row, real


def _sigmoid(x: np.ndarray) -> np.ndarray:
    y = np.minimum(np.maximum(np.negative(x), -30), 30)
    np.exp(y, out=y)
    y += 1
    return np.reciprocal(y, out=y)


class Trainer:
    """AdaGrad on the noise-contrastive objective: of groups, with noise shared by a minibatch, and of words within
    their group, with noise of their own."""

    def __init__(self, model: LogBilinear, noise: np.ndarray, seed: int, seen: np.ndarray | None = None, unigram: np.ndarray | None = None):
        """``seen`` is AdaGrad's state, ``unigram`` the log share of each word in its group; both as of a first round if not given."""
        self.m = model.like(model.flat().copy())
        self.groups = _group_noise(noise, model.width)
        self.log_kq = np.log(NOISE * self.groups).astype(np.float32)
        self.own_log_kq = (np.log(OWN_NOISE) + (model.word_bias if unigram is None else unigram)).astype(np.float32)
        self.ends = np.concatenate([[0.0], np.cumsum(noise[:-2])])
        self.r = np.random.default_rng(seed)
        self.seen = list(self.m.like(seen.copy()).tables) if seen is not None else [np.full_like(x, 1e-3) for x in self.m.tables]
        self.words = 0

    def learn(self, c: np.ndarray, before: np.ndarray) -> None:
        """One pass over positions with contexts of their own, in random order."""
        windows = np.concatenate([before[:, ::-1], c[:, None]], axis=1)
        self._pass(windows, np.ones((len(c), 1), bool))

    def learn_texts(self, row: np.ndarray, real: np.ndarray) -> None:
        """One pass over the ``real`` places of a row of texts as ``laid_out`` gives it, its chunks in random order."""
        context = len(self.m.distance)
        chunks = -(-(len(row) - context) // CHUNK)
        short = context + chunks * CHUNK - len(row)
        row, real = np.pad(row, (0, short)), np.pad(real, (0, short))
        at = np.arange(chunks)[:, None] * CHUNK
        self._pass(row[at + np.arange(context + CHUNK)], real[at + context + np.arange(CHUNK)])

    def _pass(self, windows: np.ndarray, real: np.ndarray) -> None:
        size = max(1, min(BATCH // real.shape[1], -(-len(windows) // 4)))  # few windows are four minibatches still
        order = self.r.permutation(len(windows))
        drawn = self.r.choice(len(self.groups), (-(-len(windows) // size), NOISE), p=self.groups)
        for k in range(0, len(windows), size):
            own = order[k : k + size]
            if real[own].any():
                self._step(windows[own], real[own], drawn[k // size])
        self.words += int(real.sum())

    def _step(self, windows: np.ndarray, real: np.ndarray, x: np.ndarray) -> None:
        """A minibatch: each window is a context and the words after it, of which the ``real`` ones are learned."""
        m, span, length = self.m, len(self.m.distance), real.shape[1]
        shifted = [slice(span - d, span - d + length) for d in range(1, span + 1)]
        vectors = m.context.take(windows, axis=0)
        dim, places = vectors.shape[-1], np.flatnonzero(real)
        q = vectors[:, shifted[0]] * m.distance[0]
        for at, scale in zip(shifted[1:], m.distance[1:]):
            q += vectors[:, at] * scale
        q = q.reshape(-1, dim).take(places, axis=0)
        c = windows[:, span:].ravel().take(places)
        n, g = len(c), m.group_of(c)
        target, noise = m.target.take(g, axis=0), m.target[x]
        true = np.einsum("nd,nd->n", q, target) + m.bias[g] - self.log_kq[g]
        false = q @ noise.T + m.bias[x] - self.log_kq[x]
        up, down = _sigmoid(-true) / n, -_sigmoid(false) / n
        g_q = up[:, None] * target
        g_q += down @ noise
        changes = [(np.concatenate([g, x]), {2: np.concatenate([up[:, None] * q, down.T @ q]), 3: np.concatenate([up, down.sum(axis=0)])})]
        inside = np.flatnonzero(c < len(m.word))
        if len(inside):
            w, own = c[inside].astype(np.int64), q.take(inside, axis=0)
            first = g[inside] * m.width
            last = np.minimum(first + m.width, len(m.word))
            low, high = self.ends[first], self.ends[last]
            z = np.searchsorted(self.ends, low + self.r.random((OWN_NOISE, len(w))) * (high - low), side="right") - 1
            z = np.clip(z, first, last - 1)
            u = m.word.take(w, axis=0)
            up = _sigmoid(self.own_log_kq[w] - np.einsum("nd,nd->n", own, u) - m.word_bias[w]) / n
            at, rows, sums, back = [w], [up[:, None] * own], [up], up[:, None] * u
            for z in z:
                v = m.word.take(z, axis=0)
                down = -_sigmoid(np.einsum("nd,nd->n", own, v) + m.word_bias[z] - self.own_log_kq[z]) / n
                back += down[:, None] * v
                at.append(z)
                rows.append(down[:, None] * own)
                sums.append(down)
            g_q[inside] += back
            changes.append((np.concatenate(at), {4: np.concatenate(rows), 5: np.concatenate(sums)}))
        spread, g_vectors = np.zeros((*real.shape, dim), np.float32), np.zeros_like(vectors)
        spread.reshape(-1, dim)[places] = g_q
        for at, scale in zip(shifted, m.distance):
            g_vectors[:, at] += spread * scale
        distance = np.stack([np.einsum("mld,mld->d", spread, vectors[:, at]) for at in shifted])
        changes += [(windows.ravel(), {0: g_vectors.reshape(-1, g_q.shape[1])}), (np.arange(span), {1: distance})]
        for at, rows in changes:
            self._add(at.astype(np.uint16), rows)

    def _add(self, at: np.ndarray, rows: dict[int, np.ndarray]) -> None:
        """An AdaGrad step on the rows of some tables that the gradients, summed by row, go to."""
        order = np.argsort(at, kind="stable")
        at = at[order]
        new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        own = at[new]
        for table, each in rows.items():
            value, seen = self.m.tables[table], self.seen[table]
            g = np.add.reduceat(each.take(order, axis=0), new, axis=0)
            total = seen.take(own, axis=0)
            total += g * g
            seen[own] = total
            g *= RATE
            g /= np.sqrt(total, out=total)
            g += value.take(own, axis=0)
            value[own] = g


def streams_of(vocab: Vocabulary) -> int:
    """Number of streams: from the training tokens alone."""
    return max(1, round(vocab.tokens / STREAM))


def rounds_of(streams: int) -> int:
    """Number of rounds that the streams are dealt to."""
    return max(1, min(streams, DEPTH // STREAM))


def round_of(mix: Column, held_out: Column, streams: int) -> Column:
    """The round in which a document is learned from; -1 if it is held out."""
    return F.when(held_out, -1).otherwise(F.pmod(F.pmod(mix, F.lit(streams)), F.lit(rounds_of(streams)))).cast("int")


def _trained(part: DataFrame, vocab: Vocabulary, model: LogBilinear, seen: np.ndarray, unigram: np.ndarray, streams: int, seed: int) -> tuple[LogBilinear, np.ndarray]:
    """The model and AdaGrad's state after a round over ``part(stream, mix, symbols)``."""
    noise, size = vocab.noise(), len(seen)
    shared = part.sparkSession.sparkContext.broadcast((vocab.n_classes, noise, model, seen, unigram))

    def blocks(x: np.ndarray) -> pa.Array:
        return pa.array([r.tobytes() for r in np.pad(x, (0, -size % _BLOCK)).reshape(-1, _BLOCK)], pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_classes, noise, model, seen, unigram = shared.value
        begun = model.flat()
        name, own, held, waiting = None, None, [], 0

        def learn() -> None:
            own.learn_texts(*laid_out(held, n_classes + 2))

        def close() -> pa.RecordBatch:
            if held:
                learn()
            change, more = own.m.flat() - begun, np.concatenate([x.ravel() for x in own.seen]) - seen
            n = -(-size // _BLOCK)
            return pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.full(n, name, np.int32)), blocks(change), blocks(more)], ["block", "stream", "change", "more"])

        for b in batches:
            for stream, symbols in zip(b.column(0).to_pylist(), b.column(1)):
                if stream != name:
                    if own:
                        yield close()
                    name, own, held, waiting = stream, Trainer(model, noise, seed + stream, seen, unigram), [], 0
                held.append(np.frombuffer(symbols.as_py(), "<u2"))
                waiting += len(held[-1])
                if waiting >= LEARN:
                    learn()
                    held, waiting = [], 0
        if own:
            yield close()

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block, whose rows come in the order of streams."""
        sums: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for block, *parts in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                change, more = (np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in parts)
                total = sums.setdefault(block, [np.zeros(_BLOCK), np.zeros(_BLOCK), np.zeros(_BLOCK, np.int64)])
                for x, y in zip(total, (change, more, change != 0)):
                    x += y
        each = [[(x / np.maximum(n, 1)).astype(np.float32).tobytes() for x in (change, more)] for change, more, n in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), *(pa.array([x[k] for x in each], pa.binary()) for k in range(2))], ["block", "change", "more"])

    dealt = part.repartitionByRange(min(streams, 10_000), "stream").sortWithinPartitions("stream", "mix", "symbols").select("stream", "symbols")
    parts = dealt.mapInArrow(run, "block long, stream int, change binary, more binary")
    parts = parts.repartition(min(-(-size // _BLOCK), 64), "block").sortWithinPartitions("block", "stream").drop("stream")
    means = parts.mapInArrow(mean, "block long, change binary, more binary").orderBy("block").toArrow()
    if not means.num_rows:
        return model, seen
    flat = lambda k: np.concatenate([np.frombuffer(x, np.float32) for x in means[k].to_pylist()])[:size]
    return model.like(model.flat() + flat("change")), seen + flat("more")


def train(encoded: DataFrame, vocab: Vocabulary, seed: int = 42) -> LogBilinear:
    """A model from all of ``encoded(round, mix, symbols)``: a stream trains on the documents whose hash deals them to it."""
    streams = streams_of(vocab)
    rounds = rounds_of(streams)
    model = LogBilinear.start(vocab.noise(), seed=seed)
    seen, unigram = np.full(model.flat().size, 1e-3, np.float32), model.word_bias.copy()
    dealt = encoded.select("round", F.pmod("mix", F.lit(streams)).cast("int").alias("stream"), "mix", "symbols")
    for k in range(rounds):
        of = len(range(k, streams, rounds))
        model, seen = _trained(dealt.where(F.col("round") == k).drop("round"), vocab, model, seen, unigram, of, seed)
    return model


# -------------------------------------------------------------------------------------------------- scoring


def _encoded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Per row: its symbols, what the broadcast tables give, and the words to be looked up (``word``, ``times``)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    names = ["rid", "doc_id", "held_out", "mix", "n_tokens", "n_known", "base", "n_other", "shares", "symbols", "word", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        rid = TaskContext.get().partitionId() << 33
        log_count = np.log10(vocab.counts + 1.0)
        for b in batches:
            for first, distinct, place, lengths in _slices(b.column("text")):
                n = len(lengths)
                at, known = vocab.find(distinct)
                c = vocab.class_of(distinct, at, known)
                logs = np.where(known, log_count[at] if len(log_count) else 0.0, 0.0)
                c, known, logs = c[place], known[place], logs[place]
                other = c == vocab.other
                starts = np.cumsum(lengths) - lengths
                total = lambda x: np.add.reduceat(x, starts)
                lost = np.flatnonzero(~known)
                row, h = np.repeat(np.arange(n), lengths)[lost], distinct[place[lost]]
                order = np.lexsort((h, row))
                w, r = h[order], row[order]
                new = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (r[1:] != r[:-1])]) if len(w) else np.empty(0, np.int64)
                times = np.diff(np.r_[new, len(w)])
                offsets = pa.array(np.searchsorted(r[new], np.arange(n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (w[new], times.astype(np.int32))]
                part = b.slice(first, n)
                texts = [c[a : a + k].astype("<u2").tobytes() for a, k in zip(starts.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rid + np.arange(n)),
                        *(part.column(x) for x in ("doc_id", "held_out", "mix")),
                        pa.array(lengths),
                        pa.array(total(known.astype(np.int64))),
                        pa.array(total(logs)),
                        pa.array(total(other.astype(np.int64))),
                        pa.array(total(np.where(other, logs, 0.0))),
                        pa.array(texts, pa.binary()),
                        *lists,
                    ],
                    names,
                )
                rid += n

    schema = "rid long, doc_id long, held_out boolean, mix long, n_tokens long, n_known long, base double, n_other long, shares double, symbols binary, word array<long>, times array<int>"
    return docs.mapInArrow(run, schema)


def _scored(encoded: DataFrame, vocab: Vocabulary, model: LogBilinear) -> DataFrame:
    """``encoded`` without its symbols and words, and with ``lm``: their log10 probability under the network."""
    shared = encoded.sparkSession.sparkContext.broadcast((vocab.n_classes, model))
    rows = encoded.drop("mix", "word", "times", "round")
    kept = [c for c in rows.columns if c != "symbols"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_classes, model = shared.value
        for b in batches:
            lm, held, first, size = [], [], 0, 0
            for k in range(b.num_rows):
                held.append(np.frombuffer(b.column("symbols")[k].as_py(), "<u2"))
                size += len(held[-1])
                if size >= _SLICE or k == b.num_rows - 1:
                    lengths = np.fromiter(map(len, held), np.int64, len(held))
                    p = model.text_log_probs(*laid_out(held, n_classes + 2)) / np.log(10)
                    lm.append(np.add.reduceat(p, np.cumsum(lengths) - lengths))
                    held, size = [], 0
            if lm:
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(np.concatenate(lm))], [*kept, "lm"])

    return rows.mapInArrow(run, ", ".join(f"{c} {encoded.schema[c].dataType.simpleString()}" for c in kept) + ", lm double")


def score(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row of ``docs(doc_id, text)``.

    Learned from the rows whose crc32(doc_id as text) mod 7 isn't 2. Scores are log10 probabilities of the whole
    text with its end. Words are told apart by 64 hash bits.

    Null or empty texts: the end alone. A null doc_id counts as the empty text for ``held_out``. Repeated rows are
    kept and count each. Empty table: no rows. Nothing to learn from: every token is the one unseen word. The scores
    don't depend on how the rows are partitioned; rows alike in id and text go to one stream.
    """
    held_out = (id_crc32(F.col("doc_id")) % 7 == 2).alias("held_out")
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("binary")
    rows = docs.select(doc_id.alias("doc_id"), held_out, F.xxhash64(F.lit(42), doc_id, text).alias("mix"), text.alias("text"))
    counts = stage(count_words(rows.where("not held_out")), "counts")
    vocab = vocabulary(counts)
    encoded = _encoded(rows, vocab).withColumn("round", round_of(F.col("mix"), F.col("held_out"), streams_of(vocab)))
    encoded = stage(encoded, "symbols", "round")
    model = train(encoded, vocab)
    rest = encoded.select("rid", F.explode(F.arrays_zip("word", "times")).alias("w")).select("rid", "w.word", "w.times")
    rest = rest.join(counts, "word").groupBy("rid").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
    whole = _scored(encoded, vocab, model).join(rest, "rid", "left")
    more, logs = F.coalesce("more", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    base = F.col("base") + logs - F.col("n_tokens") * float(np.log10(vocab.tokens + vocab.size + 1))
    lm = F.col("lm") + F.col("shares") + logs - F.col("n_other") * float(np.log10(vocab.other_total))
    return whole.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + more).alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), lm.alias("score"))
