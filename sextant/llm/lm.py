"""Language-model scoring by a log-bilinear model trained with noise-contrastive estimation.

Counting: tokens of all training documents are counted on the executors and
summed by token. The commonest tokens go to the workers; documents' other tokens
meet their counts by a join, so no part of the vocabulary is cut off.

Classes: the number of classes grows with the square root of the number of
distinct training tokens. The commonest tokens are classes of their own; the rest
share classes by their last bytes, and are told apart within them by smoothed
counts. Classes are dealt to groups of equal size in order of counts.

Model: the context vectors of the two classes before, each scaled by its position's
weights, add up to a prediction. Its products with the group vectors, plus biases,
give the group's probability by softmax, its products with the class vectors of
that group the class's, so probabilities add up to one at a cost of the square
root of the number of classes. Both levels are trained in numpy by noise-
contrastive estimation, with the unigram distribution as noise.

Training: each document is written once as class numbers, and dealt by a hash of
its id and text to a shard and a round. In a round every shard starts from the same
parameters and goes through its documents of that round in order of the hash; then
parameters and step sizes are averaged, weighted by tokens. Shards depend on the
number of tokens alone, so scores do not depend on how the table is split.

Tokens are the words of the text, A-Z in lower case, and one end token each. Null
text counts as empty and has the end token alone. Without any training document
counts are zero and the model is its start. Rows that repeat a document are
scored each for itself. Only doc_id and text are read; an empty table gives none.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import bounded_batches, id_remainder, stored

#: Classes of one token, and classes that other tokens share, for each square root of the distinct tokens.
OWN_CLASSES = 2.0
SHARED_CLASSES = 1.0
#: Last bytes of a token that decide which class it shares.
ENDING = 3
DIMENSIONS = 12
CONTEXT = 2
#: Tokens whose counts are sent to the workers; more only if more are classes of their own.
HEAD_TOKENS = 65_536
#: Steps of a count's logarithm to the base 2 by which the head is cut off.
COUNT_STEPS = 16
#: Distinct tokens that a counting task holds before it passes them on.
FLUSH_TOKENS = 200_000
#: Rounds of training, tokens of a shard, and the most shards (which then are larger).
ROUNDS = 4
SHARD_TOKENS = 4_000_000
MOST_SHARDS = 512
#: Training positions of a step; noise groups shared by them, noise classes of each.
STEP = 2048
NOISE = 32
NOISE_WITHIN = 1
RATE = 0.1
#: Numbers of a row in which parameters travel.
CHUNK = 16_384
#: Tokens scored together.
PORTION_TOKENS = 200_000
SMOOTH = 0.1
#: The end token; no word is empty.
END = b""


def words_of(raw: bytes) -> list[bytes]:
    return raw.lower().split()


def _as_bytes(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter[bytes] = Counter()

    def frame() -> pd.DataFrame:
        return pd.DataFrame({"token": list(counts), "n": np.fromiter(counts.values(), np.int64, len(counts))})

    for pdf in batches:
        for raw in pdf["raw"]:
            counts.update(words_of(raw))
            counts[END] += 1
            if len(counts) >= FLUSH_TOKENS:
                yield frame()
                counts.clear()
    if counts:
        yield frame()


def token_counts(docs: DataFrame) -> DataFrame:
    """token (binary) and n over all documents given, stored."""
    bounded_batches(docs.sparkSession)
    found = docs.select(_as_bytes(F.col("text")).alias("raw")).mapInPandas(_count, "token binary, n long")
    return stored(found.groupBy("token").agg(F.sum("n").alias("n")), "lm-counts")


class _Shared(dict):
    """The class that tokens share, by their last bytes."""

    def __init__(self, own: int, shared: int):
        super().__init__()
        self.own, self.shared = own, shared

    def __missing__(self, ending: bytes) -> int:
        self[ending] = found = self.own + zlib.crc32(ending) % self.shared
        return found


@dataclass
class Vocabulary:
    """The head of the vocabulary, the end token first, then by falling count; and all classes."""

    tokens: list[bytes]
    counts: np.ndarray
    total: int  # N
    distinct: int  # V
    own: int  # classes of one token
    shared_total: np.ndarray  # training tokens of each shared class
    shared_distinct: np.ndarray
    class_of: np.ndarray = field(init=False)  # of each head token

    def __post_init__(self) -> None:
        self.classes = self.own + len(self.shared_total)
        self.base_norm = self.total + SMOOTH * (self.distinct + 1)
        self.shared_norm = self.shared_total + SMOOTH * (self.shared_distinct + 1)
        shared = self.sharing()
        rest = [shared[t[-ENDING:]] for t in self.tokens[self.own :]]
        self.class_of = np.concatenate([np.arange(self.own), np.array(rest, dtype=np.int64)])
        self.group = max(1, math.isqrt(self.classes - 1) + 1)  # classes of a group
        self.groups = -(-self.classes // self.group)

    def sharing(self) -> _Shared:
        return _Shared(self.own, len(self.shared_total))

    def class_odds(self) -> np.ndarray:
        """Smoothed unigram distribution over classes, with zeros up to whole groups."""
        n = np.concatenate([self.counts[: self.own] + SMOOTH, self.shared_norm])
        return np.append(n / n.sum(), np.zeros(self.groups * self.group - self.classes))

    def base_log(self) -> np.ndarray:
        return np.log10((self.counts + SMOOTH) / self.base_norm)

    def within_log(self) -> np.ndarray:
        """log10 of a head token within its class: 0 for classes of one token."""
        out = np.zeros(len(self.tokens))
        rest = self.class_of[self.own :] - self.own
        out[self.own :] = np.log10((self.counts[self.own :] + SMOOTH) / self.shared_norm[rest])
        return out


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The head and the totals of classes; all other counts stay in the table.

    Tokens are counted by steps of their count's logarithm, some hundred at most;
    the head takes as many whole steps from above as fit, and always the end token.
    What comes to the driver grows with the square root of the distinct tokens.
    """
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    root = math.isqrt(int(v)) + 1
    own, shared = math.ceil(OWN_CLASSES * root), math.ceil(SHARED_CLASSES * root)
    step = F.floor(F.log2("n") * COUNT_STEPS)
    least, held = None, 1
    for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("tokens")).orderBy(F.desc("step")).collect():
        held += r["tokens"]
        if held > max(HEAD_TOKENS, own):
            break
        least = r["step"]
    is_end = F.col("token") == F.lit(END)
    rows = counts.where(is_end if least is None else is_end | (step >= F.lit(least))).collect()
    rows.sort(key=lambda r: (r["token"] != END, -r["n"], bytes(r["token"])))
    tokens, sizes = [bytes(r["token"]) for r in rows], [r["n"] for r in rows]
    if not tokens:
        tokens, sizes = [END], [0]
    own = min(own, len(tokens))
    ending = F.pmod(F.crc32(F.substring("token", -ENDING, ENDING)), F.lit(shared)).cast("int")
    totals, distinct = np.zeros(shared), np.zeros(shared)
    for r in counts.groupBy(ending.alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        totals[r["c"]], distinct[r["c"]] = r["n"], r["v"]
    for token, size in zip(tokens[:own], sizes[:own]):
        if size:
            totals[zlib.crc32(token[-ENDING:]) % shared] -= size
            distinct[zlib.crc32(token[-ENDING:]) % shared] -= 1
    return Vocabulary(tokens, np.array(sizes, dtype=np.float64), int(n), int(v), own, totals, distinct)


class Encoder:
    """Texts as class numbers, with what their tokens add to the scores besides."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.index = {t: i for i, t in enumerate(vocab.tokens)}
        self.shared = vocab.sharing()
        self.base, self.within = vocab.base_log(), vocab.within_log()
        self.norm_log = np.log10(vocab.shared_norm)

    def encode(self, texts: list[bytes]) -> pd.DataFrame:
        rows, get = [], self.index.get
        if len(self.shared) > 1_000_000:
            self.shared.clear()
        for raw in texts:
            words = words_of(raw)
            at = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
            at = np.append(at, 0)
            cls = self.vocab.class_of[at]
            within, base = self.within[at], self.base[at]
            gone = np.flatnonzero(at < 0)
            tail: Counter[bytes] = Counter()
            if len(gone):
                missing = [words[i] for i in gone.tolist()]
                tail.update(missing)
                cls[gone] = [self.shared[w[-ENDING:]] for w in missing]
                within[gone], base[gone] = -self.norm_log[cls[gone] - self.vocab.own], 0
            n_head = int((self.vocab.counts[at] > 0).sum()) - int((self.vocab.counts[at[gone]] > 0).sum())
            rows.append((len(at), n_head, base.sum(), within.sum(), list(tail), list(tail.values()), cls.astype("<u4").tobytes()))
        return pd.DataFrame(rows, columns=["n_tokens", "n_head", "base_head", "within", "tail", "tail_n", "ids"])


_ENCODED = "n_tokens long, n_head long, base_head double, within double, tail array<binary>, tail_n array<long>, ids binary"


def encode_column(text: Column, shared) -> Column:
    encoder: list[Encoder] = []

    @F.pandas_udf(_ENCODED)
    def encoded(raw: pd.Series) -> pd.DataFrame:
        if not encoder:
            encoder.append(Encoder(shared.value))
        return encoder[0].encode(raw.tolist())

    return encoded(_as_bytes(text))


Parameters = dict[str, np.ndarray]


def start(vocab: Vocabulary, seed: int = 11) -> Parameters:
    """Parameters at which the model is close to the unigram distribution.

    The last column of groups' and classes' vectors is their bias.
    """
    rng = np.random.default_rng(seed)
    odds = vocab.class_odds()
    by_group = odds.reshape(vocab.groups, vocab.group)
    share = by_group.sum(axis=1)
    with np.errstate(divide="ignore"):
        bias = np.log(by_group / share[:, None]).ravel()
    normal = lambda n: rng.normal(0, 0.1, (n, DIMENSIONS)).astype(np.float32)
    with_bias = lambda b: np.column_stack([normal(len(b)), b]).astype(np.float32)
    return {
        "context": normal(vocab.classes),
        "target": with_bias(np.maximum(bias, -1e9)),  # classes that only fill up a group have no share
        "group": with_bias(np.log(share)),
        "weights": np.ones((CONTEXT, DIMENSIONS), np.float32),
    }


def guesses(params: Parameters, before: list[np.ndarray]) -> np.ndarray:
    """The prediction after each context, with a 1 behind for the biases."""
    out = np.ones((len(before[0]), DIMENSIONS + 1), np.float32)
    out[:, :DIMENSIONS] = sum(params["context"][b] * w for b, w in zip(before, params["weights"]))
    return out


def flat(params: Parameters) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in sorted(params)])


def shaped(values: np.ndarray, like: Parameters) -> Parameters:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


class Trainer:
    """Steps of Adagrad on the noise-contrastive objectives of groups and of classes within them."""

    def __init__(self, vocab: Vocabulary, params: Parameters, squares: Parameters, seed: int):
        self.params = {k: v.copy() for k, v in params.items()}
        self.squares = {k: v.copy() for k, v in squares.items()}
        self.size = vocab.group
        odds = vocab.class_odds()
        self.cumulative = np.append(0, np.cumsum(odds))
        share = odds.reshape(vocab.groups, vocab.group).sum(axis=1)
        self.group_cumulative = np.cumsum(share)
        self.group_offset = np.log(NOISE * share).astype(np.float32)
        with np.errstate(divide="ignore"):
            within = np.log(NOISE_WITHIN * odds / np.repeat(share, vocab.group))
        self.offset = np.maximum(within, -1e9).astype(np.float32)
        self.rng = np.random.default_rng(seed)

    def _add(self, name: str, ids: np.ndarray, values: np.ndarray) -> None:
        """Move the rows named by ids along the sums of their values."""
        # numpy sorts short integers by their digits
        order = np.argsort(ids.astype(np.uint16) if len(self.params[name]) < 1 << 16 else ids, kind="stable")
        ranked = ids[order]
        starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        rows, sums = ranked[starts], np.add.reduceat(values.take(order, axis=0), starts, axis=0)
        squares = self.squares[name][rows] + sums * sums
        self.squares[name][rows] = squares
        self.params[name][rows] += RATE * sums / np.sqrt(squares)

    def step(self, before: list[np.ndarray], word: np.ndarray) -> None:
        """before: the class 1, 2, ... places back of each position."""
        p, n = self.params, len(word)
        guess = guesses(p, before)
        sigmoid = lambda x: 1 / (1 + np.exp(np.clip(-x, -30, 30)))

        group = word // self.size
        noise = np.searchsorted(self.group_cumulative, self.rng.random(NOISE) * self.group_cumulative[-1]).clip(0, len(self.group_offset) - 1)
        vectors, sampled = p["group"].take(group, axis=0), p["group"][noise]
        true = 1 - sigmoid(np.einsum("nd,nd->n", guess, vectors) - self.group_offset[group])
        false = -sigmoid(guess @ sampled.T - self.group_offset[noise])
        back = true[:, None] * vectors + false @ sampled

        low, high = self.cumulative[group * self.size], self.cumulative[(group + 1) * self.size]
        spot = low[:, None] + self.rng.random((n, NOISE_WITHIN)) * (high - low)[:, None]
        first = group[:, None] * self.size
        other = (np.searchsorted(self.cumulative, spot, side="right") - 1).clip(first, first + self.size - 1)
        both = np.concatenate([word[:, None], other], axis=1)
        targets = p["target"].take(both, axis=0)
        pull = -sigmoid(np.einsum("nkd,nd->nk", targets, guess) - self.offset.take(both))
        pull[:, 0] += 1
        back += np.einsum("nk,nkd->nd", pull, targets)

        back = back[:, :DIMENSIONS]
        context = [p["context"][b] for b in before]
        weights = np.stack([np.einsum("nd,nd->d", back, c) for c in context])
        self._add("group", np.r_[group, noise], np.concatenate([true[:, None] * guess, false.T @ guess]))
        self._add("target", both.ravel(), (pull[:, :, None] * guess[:, None, :]).reshape(-1, DIMENSIONS + 1))
        self._add("context", np.concatenate(before), np.concatenate([back * w for w in p["weights"]]))
        self._add("weights", np.arange(CONTEXT), weights)

    def read(self, texts: list[np.ndarray]) -> None:
        before, word, _ = positions(texts)
        for at in range(0, len(word), STEP):
            self.step([b[at : at + STEP] for b in before], word[at : at + STEP])


def positions(ids: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For texts given by classes (end included): classes before, classes, text of each position.

    Before a text stand end tokens, whose class is 0.
    """
    pad = np.zeros(CONTEXT, np.int64)
    line = np.concatenate([x for i in ids for x in (pad, i)])
    lengths = np.array([len(i) for i in ids])
    text = np.repeat(np.arange(len(ids)), lengths)
    at = np.arange(len(text)) + CONTEXT * (text + 1)
    return [line[at - k] for k in range(1, CONTEXT + 1)], line[at], text


def _train(vocabulary_, state, round_: int):
    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by shard; what is read together depends on the rows of the shard alone."""
        shard, trainer, seen, waiting, n = None, None, 0, [], 0

        def close() -> pd.DataFrame:
            if waiting:
                trainer.read(waiting)
            values = np.concatenate([flat(trainer.params), flat(trainer.squares)])
            parts = [values[i : i + CHUNK].astype("<f4").tobytes() for i in range(0, len(values), CHUNK)]
            return pd.DataFrame({"chunk": range(len(parts)), "shard": shard, "seen": seen, "part": parts})

        for pdf in batches:
            for at, raw in zip(pdf["shard"].tolist(), pdf["ids"]):
                if at != shard:
                    if trainer:
                        yield close()
                    shard, seen, waiting, n = at, 0, [], 0
                    trainer = Trainer(vocabulary_.value, *state.value, seed=1000 * round_ + at)
                waiting.append(np.frombuffer(raw, "<u4").astype(np.int64))
                n += len(waiting[-1])
                seen += len(waiting[-1])
                if n >= 32 * STEP:
                    trainer.read(waiting)
                    waiting, n = [], 0
        if trainer:
            yield close()

    return train


def _mean(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("shard")
    parts = np.stack([np.frombuffer(x, "<f4") for x in pdf["part"]]).astype(np.float64)
    mean = np.average(parts, axis=0, weights=pdf["seen"]).astype("<f4")
    return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "part": [mean.tobytes()]})


def fit(rows: DataFrame, vocab: Vocabulary, shared) -> Parameters:
    """Train on all ``rows`` (mix, ids), in ROUNDS rounds of averaged shards."""
    context = rows.sparkSession.sparkContext
    params = start(vocab)
    squares = {k: np.full_like(v, 1e-6) for k, v in params.items()}
    shards = min(MOST_SHARDS, max(1, -(-vocab.total // SHARD_TOKENS)))
    dealt = rows.select(
        F.pmod("mix", F.lit(shards)).cast("int").alias("shard"),
        F.pmod(F.shiftrightunsigned("mix", 40), F.lit(ROUNDS)).alias("round"),
        "mix",
        "ids",
    )
    for r in range(ROUNDS):
        state = context.broadcast((params, squares))
        mine = dealt.where(F.col("round") == r).drop("round").repartition(shards, "shard").sortWithinPartitions("shard", "mix", "ids")
        trained = mine.mapInPandas(_train(shared, state, r), "chunk int, shard int, seen long, part binary")
        found = trained.groupBy("chunk").applyInPandas(_mean, "chunk int, part binary").collect()
        if found:
            values = np.concatenate([np.frombuffer(x["part"], "<f4") for x in sorted(found, key=lambda x: x["chunk"])])
            size = len(values) // 2
            params, squares = shaped(values[:size], params), shaped(values[size:], squares)
        state.unpersist()
    return params


class Scorer:
    """log10 probabilities of classes, normalised by matrix products over groups and within them."""

    def __init__(self, vocab: Vocabulary, params: Parameters):
        self.vocab, self.params = vocab, params

    def logs(self, before: list[np.ndarray], word: np.ndarray) -> np.ndarray:
        """Natural log-probability of each class after those before it."""
        p, size = self.params, self.vocab.group
        guess = guesses(p, before)
        group = word // size
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(self.vocab.groups + 1))
        out = np.empty(len(word), dtype=np.float64)
        for g in np.flatnonzero(np.diff(cuts)).tolist():
            for at in range(cuts[g], cuts[g + 1], 8192):
                rows = order[at : min(at + 8192, cuts[g + 1])]
                mine, each = guess[rows], np.arange(len(rows))
                over = mine @ p["group"].T
                inside = mine @ p["target"][g * size : (g + 1) * size].T
                out[rows] = over[:, g] - _log_sum(over) + inside[each, word[rows] - g * size] - _log_sum(inside)
        return out

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """The sum of each text's log10 probabilities."""
        before, word, text = positions(texts)
        return np.bincount(text, weights=self.logs(before, word), minlength=len(texts)) / np.log(10)


def _log_sum(s: np.ndarray) -> np.ndarray:
    top = s.max(axis=1)
    return top + np.log(np.exp(s - top[:, None]).sum(axis=1))


def score_column(ids: Column, shared, params) -> Column:
    scorer: list[Scorer] = []

    @F.pandas_udf("double")
    def scored(column: pd.Series) -> pd.Series:
        if not scorer:
            scorer.append(Scorer(shared.value, params.value))
        done, waiting, n = [], [], 0
        for raw in column:
            waiting.append(np.frombuffer(raw, "<u4").astype(np.int64))
            n += len(waiting[-1])
            if n >= PORTION_TOKENS:
                done.append(scorer[0].score(waiting))
                waiting, n = [], 0
        if waiting:
            done.append(scorer[0].score(waiting))
        return pd.Series(np.concatenate(done))

    return scored(ids)


def score(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    if held_out is None:
        held_out = id_remainder(10) == 0
    bounded_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    counts = token_counts(docs.where(~held_out))
    vocab = vocabulary(counts)
    shared = context.broadcast(vocab)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out.alias("held_out"),
        F.xxhash64(F.col("doc_id").cast("string"), "text").alias("mix"),
        encode_column(F.col("text"), shared).alias("s"),
    )
    rows = stored(rows.select("row", "doc_id", "held_out", "mix", "s.*"), "lm-encoded")
    params = context.broadcast(fit(rows.where("NOT held_out").select("mix", "ids"), vocab, shared))

    each = rows.select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("row", F.col("t.tail").alias("token"), F.col("t.tail_n").alias("tf"))
    met = each.join(counts, "token", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    times = lambda norm: F.sum(F.col("tf") * F.log10((F.col("c") + F.lit(SMOOTH)) / F.lit(norm)))
    tails = met.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(F.lit(0))).alias("n_tail"),
        times(float(vocab.base_norm)).alias("base_tail"),
        times(1.0).alias("score_tail"),
    )
    heads = rows.select("row", "doc_id", "held_out", "n_tokens", "n_head", "base_head", (F.col("within") + score_column(F.col("ids"), shared, params)).alias("score_head"))
    add = lambda head, tail: F.col(head) + F.coalesce(tail, F.lit(0))
    return heads.join(tails, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        add("n_head", "n_tail").alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        add("base_head", "base_tail").alias("base_score"),
        add("score_head", "score_tail").alias("score"),
    )
