"""Language-model scores by masked pseudo-likelihood.

A small network reads the two words on either side of a place and predicts the masked word in between: context embeddings, one tanh layer, and a
softmax in two steps (class, then word in its class). A document's score is the sum of the log-probabilities of all its words, each
given both sides.

The vocabulary comes from the word counts of the whole corpus, and it and the network grow with the corpus. Words outside of it share buckets; such a
word's probability is its bucket's times its own share of the bucket's count. The counts of all words stay a Spark table: the most frequent ones are
broadcast, the others joined. Every text is read once, into ids and its rare words; equal texts are one row of that table, for training and for scoring. Training is data-parallel: texts are dealt by their content to groups of nearly equal numbers of words; in each round a copy
of the network is trained in numpy on each group, and the copies are averaged, weighted by the places seen. Groups and their order depend on the texts alone, so
the scores don't depend on how rows lie in partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, settle, word_lists

#: Words of the smallest vocabulary (the border and buckets for rare words included), buckets, width of a layer, classes of the smallest vocabulary.
VOCAB, RARE, WIDTH, CLASSES = 1024, 64, 32, 32
#: Rounds, which share the places of every text, so that each place is trained on once; places of a step; step size.
ROUNDS, STEP, RATE = 2, 8192, 0.1
#: Words of a group, for the smallest vocabulary; copies that are averaged at once.
GROUP, FAN = 2 << 20, 8
_SIDES = (-2, -1, 1, 2)
#: Longest run of rows that are added along with all runs of that length.
_SHORT = 8
#: Distinct words that a task counts before it passes them on.
_COUNTED = 400_000
#: Bytes of text that are split into words at once.
_PIECE = 8 << 20
#: Bytes of freed arrays that a task keeps, instead of getting new pages in each step.
_KEPT = 24 << 20
#: Words whose counts are broadcast, those of the vocabulary included; counts of the others are joined.
HEAD = 65_536


def _doublings(n_words: int) -> int:
    """Of the vocabulary: one for eight times as many words."""
    return max(0, (n_words >> 20).bit_length() - 1) // 3


def _shapes(size: int) -> tuple[tuple[int, ...], ...]:
    classes = CLASSES << (size // VOCAB).bit_length() // 2
    return (len(_SIDES), size, WIDTH), (WIDTH,), (WIDTH, classes), (classes,), (classes, WIDTH, size // classes), (classes, size // classes)


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int, Iterator[pa.Array]]]:
    """Texts in runs of about ``_PIECE`` bytes: begin, end, and their texts as one array. A longer text is a run of its own, in several arrays that are cut between words."""
    texts = pc.fill_null(texts, "")
    ends, at = np.cumsum(pc.binary_length(texts).to_numpy()), 0
    while at < len(texts):
        begin = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, begin + _PIECE, "right")))
        if ends[end - 1] - begin > _PIECE:
            yield at, end, (pa.array([b" ".join(ws)], pa.binary()).view(pa.string()) for ws in word_lists(texts[at].as_buffer().to_pybytes(), _PIECE))
        else:
            yield at, end, iter([texts.slice(at, end - at)])
        at = end


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of texts in lower case, and for each word of the texts the index of it and of its text. A blank at an end of a text leaves an empty word there."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = found.flatten().dictionary_encode()
    return words.dictionary.cast(pa.binary()), words.indices.to_numpy(), np.repeat(np.arange(len(texts)), pc.list_value_length(found).to_numpy())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, n_seen = [], 0
    total = lambda: pa.concat_tables(seen).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])
    for batch in batches:
        for _, _, parts in _pieces(batch.column(0)):
            for part in parts:
                words, which, _ = _split(part)
                counts = pa.table({"word": words, "n": np.bincount(which, minlength=len(words))})
                seen.append(counts.filter(pc.greater(pc.binary_length(words), 0)))
                n_seen += len(words)
                if n_seen > 2 * _COUNTED:
                    seen = [total()]
                    n_seen = len(seen[0])
                    if n_seen > _COUNTED:
                        yield from seen.pop().to_batches()
                        n_seen = 0
    if seen:
        yield from total().to_batches()


class _Read(NamedTuple):
    """Of texts: the network's ids of all their words, the number of each one's words, what the counts of words with codes and of buckets say, and
    the words without a code, how often each text has each, and their number by text."""

    ids: np.ndarray
    n: np.ndarray
    known: np.ndarray
    tail: pa.Array
    tail_n: np.ndarray
    n_tail: np.ndarray


class _Vocabulary:
    """Frequent words and their codes. 0 is the border, then come the buckets of rare words, then the words of the network's vocabulary, up to ``size``; codes from there on are those of
    rare words whose counts are known. ``ids`` has the network's id for each code (a bucket for rare words) and ``shares`` the logarithm of a rare word's count."""

    def __init__(self, known: list[bytes], rare: list[bytes], counts: np.ndarray, size: int = VOCAB):
        codes = np.r_[RARE + 1 : RARE + 1 + len(known), size : size + len(rare)]
        self.words, self.codes = pa.array([*known, *rare], pa.binary()), codes.astype(np.int64)
        self.size = size
        self.ids = np.concatenate([np.arange(size), np.array([_bucket(w) for w in rare], np.int64)]).astype(_id_kind(size))
        self.shares = np.concatenate([np.zeros(size), np.log(counts)])

    def read(self, texts: pa.Array, buckets: np.ndarray) -> _Read:
        words, which, row = _split(texts)
        at = pc.index_in(words, value_set=self.words)
        rare = at.is_null().to_numpy(zero_copy_only=False)
        codes = np.empty(len(words), np.int64)
        codes[~rare] = self.codes[at.drop_null().to_numpy()]
        codes[rare] = np.fromiter(map(_bucket, words.filter(pa.array(rare)).to_pylist()), np.int64, int(rare.sum()))
        filled = pc.binary_length(words).to_numpy() > 0
        if not filled.all():
            which, row = (x[filled[which]] for x in (which, row))
        ids = self.ids[codes]
        worth = self.shares[codes] - np.where(ids <= RARE, buckets[np.minimum(ids, RARE)], 0)
        odd = rare[which]
        tails, tail_n = np.unique(row[odd] * len(words) + which[odd], return_counts=True)
        n, known, n_tail = np.bincount(row, minlength=len(texts)), np.bincount(row, worth[which], len(texts)), np.bincount(tails // max(1, len(words)), minlength=len(texts))
        return _Read(ids[which], n, known, words.take(pa.array(tails % max(1, len(words)))), tail_n, n_tail)

    def read_all(self, texts: pa.Array, buckets: np.ndarray) -> Iterator[tuple[int, int, _Read]]:
        """Runs of texts: begin, end, and what is read of them."""
        for begin, end, parts in _pieces(texts):
            parts = [self.read(part, buckets) for part in parts]
            if len(parts) > 1:  # of one text
                ids, n, known, tail, tail_n, n_tail = zip(*parts, strict=True)
                parts = [_Read(np.concatenate(ids), sum(n), sum(known), pa.concat_arrays(tail), np.concatenate(tail_n), sum(n_tail))]
            yield begin, end, parts[0]


def _bucket(word: bytes) -> int:
    return 1 + zlib.crc32(word) % RARE


class Model(NamedTuple):
    """The vocabulary, the parameters, the logarithms of the counts of buckets by id, and the counts above one of all words without a code."""

    words: _Vocabulary
    weights: np.ndarray
    buckets: np.ndarray
    tail: DataFrame


def vocabulary(docs: DataFrame, text: str = "text") -> tuple[_Vocabulary, np.ndarray, DataFrame, int]:
    """The most frequent words of all texts (ties by bytes), the counts of buckets and of all other words as in ``Model``, and the number of all.

    Every bucket's count has one more for all words that no text has; a word found once is worth as much as they."""
    counts = settle(docs.select(text).mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    alike = sorted(((r.n, r.k) for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    cut, found = 1, 0
    for n, k in alike:
        found += k
        if found >= HEAD:
            cut = n
            break
    top = counts.where(F.col("n") >= cut).orderBy(F.col("n").desc(), "word").limit(HEAD).toArrow().to_pydict()
    size = VOCAB << _doublings(sum(n * k for n, k in alike))
    known = size - RARE - 1
    words = _Vocabulary(top["word"][:known], top["word"][known:], np.array(top["n"][known:]), size)
    total = np.ones(RARE + 1)
    for r in counts.groupBy((F.crc32("word") % RARE).alias("b")).agg(F.sum("n").alias("n")).collect():
        total[1 + r.b] += r.n
    for w, n in zip(top["word"][:known], top["n"][:known], strict=True):
        total[_bucket(w)] -= n
    return words, np.log(total), counts.where((F.col("n") > 1) & (F.col("n") <= cut)), sum(n * k for n, k in alike)


def initial(size: int = VOCAB) -> np.ndarray:
    draw, shapes = np.random.default_rng(3), _shapes(size)
    return np.concatenate([(draw.standard_normal(s) * (0.1 if len(s) > 1 else 0)).astype(np.float32).ravel() for s in shapes[:-1]] + [np.zeros(shapes[-1], np.float32).ravel()])


def _unpack(flat: np.ndarray, size: int) -> list[np.ndarray]:
    out, at = [], 0
    for s in _shapes(size):
        n = int(np.prod(s))
        out.append(flat[at : at + n].reshape(s))
        at += n
    return out


def _contexts(ids: np.ndarray) -> list[np.ndarray]:
    """Ids at each side of all places, the border beyond the ends."""
    wide = np.zeros(len(ids) + 4, np.int64)
    wide[2:-2] = ids
    return [wide[2 + side : len(ids) + 2 + side] for side in _SIDES]


def _exp(x: np.ndarray) -> tuple[np.ndarray, np.ndarray | int]:
    """Turns ``x`` into exponentials, each row up to a factor; their sums by row, and the logarithms of the factors (0 where all rows are safe without)."""
    top = 0
    if max(x.max(), -x.min()) > 60:
        top = x.max(axis=1)
        x -= top[:, None]
    np.exp(x, out=x)
    return x @ np.ones(x.shape[1], x.dtype), top


def _hidden(p: list[np.ndarray], context: np.ndarray) -> np.ndarray:
    h = p[0][0].take(context[:, 0], axis=0)
    for k in range(1, len(_SIDES)):
        h += p[0][k].take(context[:, k], axis=0)
    h += p[1]
    return np.tanh(h, out=h)


def _classes(p: list[np.ndarray], target: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """The classes of sorted targets: class, begin and end."""
    classes, inner = p[5].shape
    ends = np.searchsorted(target, np.arange(classes + 1) * inner).tolist()
    return ((c, ends[c], ends[c + 1]) for c in range(classes) if ends[c] < ends[c + 1])


def _order(ids: np.ndarray, size: int) -> np.ndarray:
    """The stable order of ids below ``size``; 16 bits are sorted by digits."""
    return np.argsort(ids.astype(np.uint16) if size <= 1 << 16 else ids, kind="stable")


def _logits(p: list[np.ndarray], h: np.ndarray, target: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The classes of sorted targets and the words in them: the logits of all, and the target's index among them."""
    inner = p[5].shape[1]
    x = h @ p[2]
    x += p[3]
    yield x, target // inner
    x = np.empty((len(h), inner), h.dtype)
    for c, a, b in _classes(p, target):
        np.matmul(h[a:b], p[4][c], out=x[a:b])
        x[a:b] += p[5][c]
    yield x, target % inner


def log_probs(p: list[np.ndarray], context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-probability of each target between its context."""
    order = _order(target, p[0].shape[1])
    context, target, at = context.take(order, axis=0), target[order], np.arange(len(target))
    h = _hidden(p, context)
    each = np.zeros(len(h), h.dtype)
    for x, own in _logits(p, h, target):
        each += x[at, own]
        total, top = _exp(x)
        each -= np.log(total) + top
    out = np.empty_like(each)
    out[order] = each
    return out


def _run_sums(x: np.ndarray, at: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of runs, the rows ``at[first : first + n]`` of ``x``, and the run that each is of: short ones with all others of their length, long ones as sums of short ones."""
    run = np.argsort(np.minimum(n, _SHORT + 1).astype(np.uint8), kind="stable")
    ends = np.searchsorted(n[run], np.arange(1, _SHORT + 1), "right").tolist()
    out = np.empty((len(first), x.shape[1]), x.dtype)
    for length, a, b in zip(range(1, _SHORT + 1), [0, *ends], ends, strict=False):
        begin = first[run[a:b]]
        x.take(at[begin], axis=0, out=out[a:b], mode="clip")
        for k in range(1, length):
            out[a:b] += x.take(at[begin + k], axis=0)
    long = run[ends[-1] :]
    if len(long):
        parts = -(-n[long] // _SHORT)
        begin = np.cumsum(parts) - parts
        start = np.repeat(first[long] - _SHORT * begin, parts) + _SHORT * np.arange(parts.sum())
        sums, of = _run_sums(x, at, start, np.minimum(_SHORT, np.repeat(first[long] + n[long], parts) - start))
        where = np.empty_like(of)
        where[of] = np.arange(len(of))
        out[ends[-1] :], of = _run_sums(sums, where, begin, parts)
        run[ends[-1] :] = long[of]
    return out, run


def _gradient(p: list[np.ndarray], context: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of the summed negative log-probability: rows of the embeddings (side * size + id) and their gradients, and the gradients of all others.

    Places are put in the order of their targets, so that each class is a slice."""
    size = p[0].shape[1]
    order = _order(target, size)
    context, target, at = context.take(order, axis=0), target[order], np.arange(len(target))
    h, errors = _hidden(p, context), []
    for x, own in _logits(p, h, target):
        x *= (1 / _exp(x)[0])[:, None]
        x[at, own] -= 1
        errors.append(x)
    d, e = errors
    ones = np.ones(len(h), h.dtype)
    g = [(d.T @ h).T, ones @ d, np.zeros_like(p[4]), np.zeros_like(p[5])]
    dh = d @ p[2].T
    for c, a, b in _classes(p, target):
        np.matmul(h[a:b].T, e[a:b], out=g[2][c])
        np.matmul(ones[a:b], e[a:b], out=g[3][c])
        dh[a:b] += e[a:b] @ p[4][c].T
    h *= h
    dh *= np.subtract(1, h, out=h)
    flat = (context + np.arange(len(_SIDES)) * size).ravel()
    order = _order(flat, len(_SIDES) * size)
    flat = flat[order]
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    sums, run = _run_sums(dh, order // len(_SIDES), first, np.diff(first, append=len(flat)))
    return flat[first[run]], sums, [ones @ dh, *g]


def _learn(w: np.ndarray, past: np.ndarray, g: np.ndarray, rows=...) -> None:
    """A step of ``w`` (or rows of it) against ``g``, which is overwritten, by the squares of all ``past`` gradients."""
    s = g * g
    s += past[rows]
    past[rows] = s
    g *= RATE
    g /= np.sqrt(s, out=s)
    w[rows] -= g


def _trainer(size: int, start, turn: int):
    """Trains a copy of the network on each group of rows (group, ids), which come sorted; a row (group, seen, weights) for each."""
    kind, first = np.dtype(_id_kind(size)), _first(turn)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = None

        def begin() -> None:
            nonlocal flat, p, past, seen
            flat, seen = start.value.copy(), 0
            waiting.clear()
            p, past = _unpack(flat, size), [np.full(s, 1e-8, np.float32) for s in _shapes(size)]

        def step() -> None:
            nonlocal seen
            context, target = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            wide, wide_past = p[0].reshape(-1, WIDTH), past[0].reshape(-1, WIDTH)
            for part in _parts(len(target)):
                n = part.stop - part.start
                rows, g, others = _gradient(p, context[part], target[part])
                g /= n
                _learn(wide, wide_past, g, rows)
                for w, s, g in zip(p[1:], past[1:], others, strict=True):
                    g /= n
                    _learn(w, s, g)
            seen += len(target)

        def copy() -> pa.RecordBatch:
            if waiting:
                step()
            return pa.RecordBatch.from_arrays([pa.array([group] * bool(seen), pa.int64()), pa.array([seen] * bool(seen), pa.int64()), pa.array([flat.tobytes()] * bool(seen), pa.binary())], ["group", "seen", "weights"])

        np.empty(_KEPT, np.uint8)  # freed at once, upon which malloc keeps as much for later arrays
        flat, p, past, seen, waiting, n_waiting = None, [], [], 0, [], 0
        for batch in batches:
            for g, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if g != group:
                    if group is not None:
                        yield copy()
                    group, n_waiting = g, 0
                    begin()
                ids = np.frombuffer(ids.as_buffer(), kind).astype(np.int64)
                places = slice(first(ids), None, ROUNDS)
                target = ids[places]
                if len(target):
                    waiting.append((np.stack([x[places] for x in _contexts(ids)], axis=1), target))
                    n_waiting += len(target)
                if n_waiting >= STEP:
                    step()
                    n_waiting = 0
        if group is not None:
            yield copy()

    return train


def _parts(n: int) -> Iterator[slice]:
    """Nearly equal parts of n places, of STEP at least (but for a single part) and less than 2 STEP."""
    ends = np.linspace(0, n, max(1, n // STEP) + 1).astype(int).tolist()
    return (slice(a, b) for a, b in zip(ends, ends[1:], strict=False))


def _id_kind(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _first(turn: int):
    """The first place of a text in a round; over the rounds all of 0 to ROUNDS - 1."""
    return lambda ids: (turn + zlib.crc32(ids[:8].tobytes())) % ROUNDS


def _encoder(sent):
    """Rows (key, text) as rows (key, ids, known, tail): the network's ids, what the counts of words with codes and of buckets say, and the words without a code."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, buckets = sent.value
        for batch in batches:
            for begin, end, read in words.read_all(batch.column(1), buckets):
                offsets = np.r_[0, np.cumsum(read.n)] * read.ids.itemsize
                ids = pa.Array.from_buffers(pa.binary(), end - begin, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(read.ids)])
                tail = pa.StructArray.from_arrays([read.tail, pa.array(read.tail_n)], ["word", "n"])
                tails = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(read.n_tail)].astype(np.int32)), tail)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), ids, pa.array(read.known), tails], ["key", "ids", "known", "tail"])

    return encode


def _key(text: str):
    return F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256))


def encode(docs: DataFrame, words: _Vocabulary, buckets: np.ndarray, text: str = "text") -> DataFrame:
    """A settled row (key, copies, ids, known, tail) for each different text of ``docs``; null and empty are one text."""
    sent = docs.sparkSession.sparkContext.broadcast((words, buckets))
    read = docs.select(_key(text).alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(_encoder(sent), "key binary, ids binary, known double, tail array<struct<word:binary,n:long>>")
    return settle(read.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("ids", "known", "tail")]), "encoded")


def _mean(rows: list[tuple[int, bytes]]) -> tuple[int, bytes]:
    """The mean of weights, in the order given."""
    seen = sum(n for n, _ in rows)
    total = sum(np.frombuffer(w, np.float32) * np.float64(n) for n, w in rows)
    return seen, (total / seen).astype(np.float32).tobytes()


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (to, group): a row for each ``to``."""
    rows, now = [], None
    one = lambda: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((now, *_mean(rows)), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["group", "seen", "weights"])
    for batch in batches:
        for to, seen, weights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if to != now:
                if rows:
                    yield one()
                rows, now = [], to
            rows.append((seen, weights))
    if rows:
        yield one()


def average(copies: DataFrame, groups: int) -> bytes | None:
    """The mean of ``copies`` (group, seen, weights) of group 0 to ``groups`` - 1, by a tree of FAN copies a node; None without any."""
    while groups > FAN:
        up = copies.select(F.floor(F.col("group") / FAN).alias("to"), "group", "seen", "weights")
        copies = up.repartition("to").sortWithinPartitions("to", "group").select("to", "seen", "weights").mapInArrow(_averaged, "group long, seen long, weights binary")
        groups = -(-groups // FAN)
    rows = sorted((r.group, r.seen, bytes(r.weights)) for r in copies.collect())
    return _mean([r[1:] for r in rows])[1] if rows else None


def train(docs: DataFrame, text: str = "text") -> Model:
    """The vocabulary, the parameters and the word counts for the texts of ``docs``."""
    model, encoded = _learned(docs, text)
    discard(encoded)
    return model


def _learned(docs: DataFrame, text: str) -> tuple[Model, DataFrame]:
    """The model of ``docs`` and the table of their encoded texts.

    A round trains on every ROUNDS-th place of every text, each round from another start, so that all rounds together take every place of every text once.
    Equal texts are numbered, so that many copies of one are spread over the groups."""
    words, buckets, tail, n_words = vocabulary(docs, text)
    spark, now, size = docs.sparkSession, initial(words.size), words.size
    groups = max(1, n_words // (GROUP * size // VOCAB))
    encoded = encode(docs, words, buckets, text)
    copies = encoded.select("ids", F.xxhash64("key").alias("at"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).withColumn("group", F.pmod(F.xxhash64("at", "copy"), F.lit(groups)))
    dealt = copies.repartitionByRange(groups, "group").sortWithinPartitions("group", "at", "copy").select("group", "ids")
    for turn in range(ROUNDS):
        mean = average(dealt.mapInArrow(_trainer(size, spark.sparkContext.broadcast(now), turn), "group long, seen long, weights binary"), groups)
        if mean:
            now = np.frombuffer(mean, np.float32).copy()
    return Model(words, now, buckets, tail), encoded


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, log_prob (the sum over all words, each given both sides) and mean_log_prob; columns of these names are replaced.

    A null, empty or blank text has no word: 0, 0.0 and a null mean. Equal texts get equal scores, as scores are found by the text's digest; keys and
    other columns don't matter. An empty table gives an empty result, and a model trained on one is the initial network."""
    return _scored(docs, encode(docs, model.words, model.buckets, text), model, text)


def train_and_score(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` scored, as by ``score``, with a model trained on themselves; each text is read into ids once for both."""
    model, encoded = _learned(docs, text)
    return _scored(docs, encoded, model, text)


def _scored(docs: DataFrame, encoded: DataFrame, model: Model, text: str) -> DataFrame:
    """The scores of ``docs`` by their encoded texts, which are deleted."""
    size = model.words.size
    sent, kind = docs.sparkSession.sparkContext.broadcast(model.weights), np.dtype(_id_kind(size))

    @F.arrow_udf("double")
    def network(texts: pa.Array) -> pa.Array:
        p, total, waiting, n_waiting = _unpack(sent.value, size), np.zeros(len(texts)), [], 0

        def flush() -> None:
            """Adds what the network says of the waiting texts."""
            rows, contexts, targets = zip(*waiting, strict=True)
            waiting.clear()
            context, target = np.concatenate(contexts), np.concatenate(targets)
            each = np.concatenate([log_probs(p, context[part], target[part]) for part in _parts(len(target))])
            for row, part in zip(rows, np.split(each, np.cumsum([len(x) for x in targets])[:-1]), strict=True):
                total[row] += float(part.sum(dtype=np.float64))

        for row, t in enumerate(texts):
            ids = np.frombuffer(t.as_buffer(), kind).astype(np.int64)
            sides = _contexts(ids)
            for at in range(0, len(ids), 1 << 16):
                places = slice(at, at + (1 << 16))
                waiting.append((row, np.stack([x[places] for x in sides], axis=1), ids[places]))
                n_waiting += len(ids[places])
                if n_waiting >= 2 * STEP:
                    flush()
                    n_waiting = 0
        if waiting:
            flush()
        return pa.array(total)

    each = encoded.select("key", F.expr(f"octet_length(ids) div {kind.itemsize}").alias("n_tokens"), (F.col("known") + network("ids")).alias("net"))
    rare = encoded.select("key", F.explode("tail").alias("t")).select("key", "t.word", F.col("t.n").alias("k")).join(model.tail, "word")
    shares = rare.groupBy("key").agg(F.sum(F.col("k") * F.log("n")).alias("shares"))
    by_text = each.join(shares, "key", "left").select(F.col("key").alias("_key"), "n_tokens", (F.col("net") + F.coalesce("shares", F.lit(0.0))).alias("log_prob"))
    by_text = settle(by_text, "scored")
    discard(encoded)
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_tokens", "log_prob", "mean_log_prob")]
    out = docs.select(F.struct(*own).alias("_row"), _key(text).alias("_key")).join(by_text, "_key").select("_row.*", "n_tokens", "log_prob")
    return out.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))
