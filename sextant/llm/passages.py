"""Passages that recur anywhere in a collection, found in its Burrows-Wheeler transform.

A byte is removed if a string of MIN_BYTES that covers it also starts anywhere else,
in the same document or in another one.

**Who meets whom.** Of the byte grams in a window of MIN_BYTES, the one of smallest
hash (the last of equals) is its anchor. Equal windows have equal anchors, so the
windows of one anchor place, with the bytes they span, are a *piece*, and only pieces
whose anchor's hash recurs are looked at. Equal texts are one text; of two or more,
every byte recurs. Where a text repeats itself at a distance below a window, a piece
equal to the one before it is dropped and its bytes are noted.

**What recurs.** Pieces of whole hash groups make a collection of about
COLLECTION_BYTES. Its transform is built column by column: each round puts the next
symbol, from the end on, in front of the latest suffix of every string; the suffix's
new place is the number of smaller symbols plus those of its own before the old place,
and its common prefix with the neighbours is one more than the least common prefix
between their old places. The transform, the common prefixes and the suffixes' starts
lie in files that each round reads from front to end and writes anew. A symbol stands
for some bytes, 50 if MIN_BYTES is 400 (a WINDOW_SYMBOLS-th at most, and a divisor),
and each piece is entered once for every remainder of its places, so that the suffixes
of all places are in the transform and a common prefix of 8 symbols is one of 400 bytes.

Before, each piece is cut to the bytes around its anchor that some other piece of the
group has as well, as far to each side as any of them; less than MIN_BYTES can hold no
recurring window and is left out.

**Hot groups.** A group of more than GROUP_PIECES pieces is dealt over several parts.
Each says which windows recur within it, and sends on one window of each content, as
pieces with anchors by another hash, which meet those of the other parts in smaller
groups. What is in groups that hot at LEVELS hashes meets window by window, by digests.

Null text counts as empty. Texts shorter than MIN_BYTES stay whole. Repeated rows and
copies are texts that recur. Rows without doc_id are treated like any other. Very long
texts are scanned in slices. Other columns are not read. An empty table gives none.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import bounded_batches, joined, stored

MIN_BYTES = 400
#: Bytes of the grams that anchors are chosen from.
GRAM_BYTES = 96
#: Text scanned at a time; pieces that a transform is built of at a time.
SLICE_BYTES = 1 << 20
COLLECTION_BYTES = 1 << 20
#: Pieces of one anchor hash that are looked at together, and hashes that hot groups are dealt by in turn.
GROUP_PIECES = 4096
LEVELS = 3
#: Symbols of a window, at least (if it has as many bytes).
WINDOW_SYMBOLS = 8
#: Places in a block of common prefixes whose least is kept.
BLOCK = 16

#: An odd multiplier whose powers weigh the bytes of a gram, and one that mixes the sum.
BASE = 0x9E3779B97F4A7C15
MIX = 0xBF58476D1CE4E5B9

_SPANS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
_SCANNED = pa.schema([("doc_id", pa.int64()), ("sha", pa.binary()), ("n_bytes", pa.int64()), ("anchors", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("at", pa.int64()), ("hash", pa.int64())]))), ("own", _SPANS)])
_SCANNED_SQL = "doc_id long, sha binary, n_bytes long, anchors array<struct<lo: long, hi: long, at: long, hash: long>>, own array<struct<lo: long, hi: long>>"
#: What a search gives: a span that recurs; or a window with its content's digest; or a piece of the next level.
_FOUND = pa.schema([("kind", pa.string()), ("sha", pa.binary()), ("lo", pa.int64()), ("hi", pa.int64()), ("at", pa.int64()), ("hash", pa.int64()), ("content", pa.binary())])
_FOUND_SQL = "kind string, sha binary, lo long, hi long, at long, hash long, content binary"


# --- anchors -------------------------------------------------------------------------------------


@functools.lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(data: np.ndarray, size: int, level: int = 0) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each place on: the bytes weighed by powers, summed, and the place's power divided out."""
    n = len(data)
    room = 1 << n.bit_length()
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(BASE, room)[:n], out=sums[1:])
    x = (sums[size:] - sums[:-size]) * _powers(pow(BASE, -1, 1 << 64), room)[: n - size + 1]
    x ^= np.uint64(level * MIX & (1 << 64) - 1)
    x ^= x >> np.uint64(31)
    x *= np.uint64(MIX)
    return x ^ (x >> np.uint64(29))


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` keys in a row."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(keys.dtype).max, keys.dtype)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchored(data: np.ndarray, ends: np.ndarray, min_bytes: int, gram: int, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, at, hash) of runs of windows, from start ``lo`` to ``hi``, that have their anchor at ``at``.

    Windows lie within one of the texts that end at ``ends``. Equal windows have equal hashes.
    """
    if len(data) < min_bytes:
        return (np.zeros(0, np.int64),) * 4
    hashes = gram_hashes(data, gram, level)
    place = np.arange(len(hashes), dtype=np.uint64)
    low = np.uint64((1 << 24) - 1)
    anchor = (low - (window_minima((hashes & ~low) | (low - place), min_bytes - gram + 1) & low)).astype(np.int64)
    start = np.arange(len(anchor))
    text = np.searchsorted(ends, start, side="right")
    fits = start + min_bytes <= ends[text]
    new = fits.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~fits[:-1]
    last = fits.copy()
    last[:-1] &= new[1:] | ~fits[1:]
    lo = np.flatnonzero(new)
    return lo, np.flatnonzero(last), anchor[lo], hashes[anchor[lo]].view(np.int64)


def _without_repeats(data: bytes, lo: np.ndarray, hi: np.ndarray, hashes: np.ndarray, min_bytes: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which pieces stay, and spans of bytes that recur because a piece equals the one before it."""
    stay, spans = np.ones(len(lo), bool), []
    like = (hashes[1:] == hashes[:-1]) & (hi[1:] - lo[1:] <= hi[:-1] - lo[:-1]) & (lo[1:] - lo[:-1] < min_bytes)
    for i in np.flatnonzero(like) + 1:
        a, b, n = int(lo[i - 1]), int(lo[i]), int(hi[i] - lo[i]) + min_bytes
        if data[a : a + n] == data[b : b + n]:
            stay[i] = False
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], b + n))
            else:
                spans.append((a, b + n))
    return stay, spans


def _scan_long(raw: bytes, min_bytes: int, gram: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    anchors, own = [], []
    for at in range(0, max(1, len(raw) - min_bytes + 1), SLICE_BYTES):
        part = raw[at : at + SLICE_BYTES + min_bytes - 1]
        lo, hi, place, hashes = anchored(np.frombuffer(part, np.uint8), np.array([len(part)]), min_bytes, gram)
        stay, spans = _without_repeats(part, lo, hi, hashes, min_bytes)
        anchors += zip(*((x[stay] + at).tolist() for x in (lo, hi, place)), hashes[stay].tolist())
        own += [(a + at, b + at) for a, b in spans]
    return anchors, own


def _scan(batches: Iterator[pa.RecordBatch], min_bytes: int, gram: int) -> Iterator[pa.RecordBatch]:
    def out(ids: list, texts: list[bytes], found: list) -> pa.RecordBatch:
        anchors = [[{"lo": a, "hi": b, "at": c, "hash": h} for a, b, c, h in x] for x, _ in found]
        own = [[{"lo": a, "hi": b} for a, b in x] for _, x in found]
        columns = [ids, [hashlib.sha256(t).digest() for t in texts], [len(t) for t in texts], anchors, own]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCANNED)], schema=_SCANNED)

    def together(texts: list[bytes]) -> list:
        data = b"".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        lo, hi, place, hashes = anchored(np.frombuffer(data, np.uint8), ends, min_bytes, gram)
        text = np.searchsorted(ends, lo, side="right")
        border = np.searchsorted(text, np.arange(len(texts) + 1))
        found = []
        for i in range(len(texts)):
            one = slice(border[i], border[i + 1])
            at = int(ends[i]) - len(texts[i])
            stay, spans = _without_repeats(data, lo[one], hi[one], hashes[one], min_bytes)
            own = zip(*((x[one][stay] - at).tolist() for x in (lo, hi, place)), hashes[one][stay].tolist())
            found.append((list(own), [(a - at, b - at) for a, b in spans]))
        return found

    ids, texts, held = [], [], 0
    for batch in batches:
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
            raw = text.as_buffer().to_pybytes()
            if len(raw) > SLICE_BYTES:
                yield out([doc], [raw], [_scan_long(raw, min_bytes, gram)])
                continue
            ids.append(doc), texts.append(raw)
            held += len(raw)
            if held >= SLICE_BYTES:
                yield out(ids, texts, together(texts))
                ids, texts, held = [], [], 0
    if texts:
        yield out(ids, texts, together(texts))


# --- the transform -------------------------------------------------------------------------------


class _Files:
    """Columns in files of a temporary folder of the task; each has two, read and written in turn."""

    def __init__(self, folder: str, room: int):
        self.turn = 0
        self.held = {
            name: [np.memmap(f"{folder}/{name}-{i}", dtype=kind, mode="w+", shape=max(room, 1)) for i in range(2)]
            for name, kind in (("before", np.uint32), ("common", np.uint8), ("start", np.uint32))
        }

    def new(self, name: str, n: int) -> np.ndarray:
        return self.held[name][self.turn][:n]


class _Least:
    """The least number of any range of an array, from the least of blocks."""

    def __init__(self, numbers: np.ndarray):
        blocks = np.full((-(-len(numbers) // BLOCK), BLOCK), 255, np.uint8)
        blocks.ravel()[: len(numbers)] = numbers
        self.blocks = blocks
        self.ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        self.behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [blocks.min(axis=1)]
        while len(self.levels[-1]) > 1 << len(self.levels) - 1:
            level, step = self.levels[-1], 1 << len(self.levels) - 1
            longer = level.copy()
            longer[:-step] = np.minimum(level[:-step], level[step:])
            self.levels.append(longer)
        self.table = np.stack(self.levels)

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of the ranges from ``first`` to ``last``, both included."""
        a, b = first // BLOCK, last // BLOCK
        out = np.minimum(self.behind[first], self.ahead[last])
        between = b - a - 1
        far = np.flatnonzero(between > 0)
        level = np.frexp(between[far].astype(float))[1] - 1
        whole = np.minimum(self.table[level, a[far] + 1], self.table[level, b[far] - (1 << level)])
        out[far] = np.minimum(out[far], whole)
        near = np.flatnonzero(between < 0)
        at = np.arange(BLOCK)
        inside = (at >= (first[near] % BLOCK)[:, None]) & (at <= (last[near] % BLOCK)[:, None])
        out[near] = np.where(inside, self.blocks[a[near]], 255).min(axis=1)
        return out


def symbols(data: np.ndarray, size: int) -> np.ndarray:
    """A number for the ``size`` bytes from each place on: equal for equal bytes, larger for larger ones."""

    def paired(code: np.ndarray, away: int, bits: int) -> np.ndarray:
        follow = np.zeros_like(code)
        follow[: max(0, len(code) - away)] = code[away:]
        return (code << np.uint64(bits)) | follow

    def numbered(code: np.ndarray) -> np.ndarray:
        return np.unique(code, return_inverse=True)[1].astype(np.uint64)

    code, width = data.astype(np.uint64), 1  # up to 8 bytes as they are, from then on numbers for them
    while width < size:
        away = min(width, size - width)  # the last two may overlap
        code = paired(code, away, 8 * width if width < 8 else 32)
        width += away
        if width >= 8 or width == size:
            code = numbered(code)
    return code.astype(np.uint32)


def transform(code: np.ndarray, first: np.ndarray, count: np.ndarray, step: int, most: int, files: _Files) -> tuple[np.ndarray, np.ndarray]:
    """(start, common) of all suffixes in order: where each starts, and symbols it has in common with the one before (up to ``most``).

    String i has the ``count[i]`` symbols ``code[first[i]], code[first[i] + step]...``.
    """
    n_strings, n_codes = len(first), int(code.max(initial=0)) + 1
    open_ = n_codes  # nothing stands before the suffix yet
    before, common, start = (files.new(name, n_strings) for name in ("before", "common", "start"))
    before[:], common[:], start[:] = open_, 0, first + step * count
    at = np.arange(n_strings)
    totals = np.zeros(n_codes, np.int64)
    for nth in range(1, int(count.max(initial=0)) + 1):
        own = np.flatnonzero(count >= nth)
        place = first[own] + step * (count[own] - nth)
        symbol = code[place]
        before[at[own]] = symbol
        wanted = np.zeros(n_codes + 1, bool)
        wanted[symbol] = True
        old = np.flatnonzero(wanted[before])
        old = old[np.argsort(before[old], kind="stable")]
        like = before[old]
        of_symbol = np.concatenate([[True], like[1:] != like[:-1]])
        run = np.flatnonzero(of_symbol)
        nth_of_symbol = np.arange(len(old)) - np.repeat(run, np.diff(np.append(run, len(old))))
        totals += np.bincount(symbol, minlength=n_codes)
        to = n_strings + (np.cumsum(totals) - totals)[like] + nth_of_symbol
        fresh = np.zeros(len(before), bool)
        fresh[at[own]] = True
        fresh = fresh[old]
        touched = ~of_symbol & (fresh | np.concatenate([[False], fresh[:-1]]))
        k = np.flatnonzero(touched)
        value = np.minimum(_Least(common)(old[k - 1] + 1, old[k]).astype(np.int64) + 1, most)

        files.turn ^= 1
        n = len(before) + len(own)
        came = to[fresh]
        stays = np.ones(n, bool)
        stays[came] = False
        order = np.argsort(at[own])
        string = own[order]  # fresh entries lie in order of symbol and old place; find their strings by place
        string = string[np.searchsorted(at[string], old[fresh])]
        columns = []
        for name, column, new in (("before", before, open_), ("common", common, 0), ("start", start, first[string] + step * (count[string] - nth))):
            out = files.new(name, n)
            out[stays] = column
            out[came] = new
            columns.append(out)
        before, common, start = columns
        common[to[k]] = value
        at[string] = came
    return start, common


def recurring(pieces: list[bytes], min_bytes: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each piece, whether the window from each place recurs in the pieces; then (piece, place) of one window of each content."""
    step = max(d for d in range(1, max(1, min_bytes // WINDOW_SYMBOLS) + 1) if min_bytes % d == 0)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    length = np.array([len(p) for p in pieces])
    base = np.cumsum(length) - length
    first = (base[:, None] + np.arange(step)).ravel()
    count = (np.maximum(length[:, None] - np.arange(step), 0) // step).ravel()
    with tempfile.TemporaryDirectory(prefix="passages-") as folder:
        start, common = transform(symbols(data, step), first, count, step, min_bytes // step, _Files(folder, len(first) + int(count.sum())))
        start, common = np.array(start[len(first) :]), np.array(common[len(first) :])  # the empty suffixes come first
    window = np.zeros(len(data) + 1, bool)
    for b, n in zip(base, length):
        window[b : b + n - min_bytes + 1] = True
    is_window = window[start]
    start, same = start[is_window], common[is_window] >= min_bytes // step
    again = same.copy()
    again[:-1] |= same[1:]
    flags = np.zeros(len(data), bool)
    flags[start[again]] = True
    one = start[~same]
    piece = np.searchsorted(base, one, side="right") - 1
    return [flags[b : b + n - min_bytes + 1] for b, n in zip(base, length)], piece, one - base[piece]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _alike(a: bytes, b: bytes) -> int:
    """Bytes that two strings have in common from the front on."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def _most_alike(strings: list[bytes]) -> list[int]:
    """For each string, the most bytes it has in common with any other from the front on: with a neighbour in order."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    out = [0] * len(strings)
    for i, j in itertools.pairwise(order):
        n = _alike(strings[i], strings[j])
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def _in_common(group: list[tuple[bytes, int, int, bytes]], min_bytes: int) -> list[tuple[bytes, int, bytes]]:
    """(sha, lo, piece) of a group, cut to the bytes around the anchor that some other piece has as well."""
    right = _most_alike([piece[at - lo :] for _, lo, at, piece in group])
    left = _most_alike([piece[: at - lo][::-1] for _, lo, at, piece in group])
    cut = ((sha, at - a, piece[at - lo - a : at - lo + b]) for (sha, lo, at, piece), a, b in zip(group, left, right))
    return [x for x in cut if len(x[2]) >= min_bytes]


def _search(batches: Iterator[pa.RecordBatch], min_bytes: int, gram: int, level: int) -> Iterator[pa.RecordBatch]:
    """Spans that recur; of parts of hot groups one window of each content, as pieces of the next level or digests."""
    held: list[tuple[bytes, int, bytes]] = []
    dealt: list[bool] = []
    group: list[tuple[bytes, int, int, bytes]] = []
    size = 0  # bytes held

    def found() -> pa.RecordBatch:
        flags, piece, place = recurring([x[2] for x in held], min_bytes)
        rows: list[tuple] = []
        for (sha, lo, _), own in zip(held, flags):
            rows += [("span", sha, lo + a, lo + b + min_bytes, None, None, None) for a, b in zip(*(x.tolist() for x in _runs(own)))]
        open_ = np.flatnonzero(np.array(dealt)[piece])
        for i in np.unique(piece[open_]).tolist():
            sha, lo, raw = held[i]
            ones = np.zeros(len(raw) - min_bytes + 1, bool)
            ones[place[open_][piece[open_] == i]] = True
            for a, b in zip(*(x.tolist() for x in _runs(ones))):
                own = raw[a : b + min_bytes]
                if level + 1 == LEVELS:
                    rows += [("window", sha, lo + a + k, lo + a + k + min_bytes, None, None, hashlib.sha256(own[k : k + min_bytes]).digest()) for k in range(b - a + 1)]
                    continue
                for c, d, at, key in zip(*(x.tolist() for x in anchored(np.frombuffer(own, np.uint8), np.array([len(own)]), min_bytes, gram, level + 1))):
                    rows.append(("piece", sha, lo + a + c, lo + a + d, lo + a + at, key, own[c : d + min_bytes]))
        held.clear(), dealt.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_FOUND), _FOUND)], schema=_FOUND)

    def close(split: bool) -> int:
        own = [(sha, lo, piece) for sha, lo, _, piece in group] if split else _in_common(group, min_bytes)
        held.extend(own)
        dealt.extend([split] * len(own))
        group.clear()
        return sum(len(x[2]) for x in own)

    last, last_split = None, False
    for batch in batches:
        columns = (batch[c].to_pylist() for c in ("hash", "part", "split", "sha", "lo", "at", "piece"))
        for key, part, split, sha, lo, at, piece in zip(*columns):
            if (key, part) != last:
                size += close(last_split)
                last, last_split = (key, part), split
                if size >= COLLECTION_BYTES:
                    yield found()
                    size = 0
            group.append((sha, lo, at, piece))
    close(last_split)
    if held:
        yield found()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts without their spans, which are sorted: bytes removed, maximal runs, digest of what is left."""
    for batch in batches:
        rows = []
        for sha, text, spans in zip(batch["sha"].to_pylist(), batch["text"], batch["spans"].to_pylist()):
            raw, kept, at, runs = text.as_buffer().to_pybytes(), hashlib.sha256(), 0, []
            for s in spans:
                if runs and s["lo"] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s["hi"])
                else:
                    runs.append([s["lo"], s["hi"]])
            for a, b in runs:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            rows.append((sha, sum(b - a for a, b in runs), len(runs), kept.digest(), [{"lo": a, "hi": b} for a, b in runs]))
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), _SPANS]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["sha", "n_removed", "n_spans", "kept", "runs"])


# --- the operator --------------------------------------------------------------------------------


def _met(pieces: DataFrame) -> DataFrame:
    """The rows of stored ``pieces`` whose hash recurs, with ``n``, its number."""
    counts = stored(pieces.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "passages-hashes")
    return joined(pieces, counts, "hash", "n")


def spans(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """doc_id, sha, n_bytes, n_removed, n_spans, kept (digest of what is left), runs [lo, hi) of each document."""
    if min_bytes < 2:
        raise ValueError("min_bytes must be at least 2")
    gram = min(GRAM_BYTES, max(1, min_bytes // 2))
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(lambda b: _scan(b, min_bytes, gram), _SCANNED_SQL)
    rows = stored(rows, "passages-rows", compression="zstd")
    texts = rows.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.first("n_bytes").alias("n_bytes"), F.first("anchors").alias("anchors"), F.first("own").alias("own"))
    texts = stored(texts, "passages-texts", compression="zstd")

    anchors = texts.select("sha", F.explode("anchors").alias("a")).select("sha", "a.*")
    wanted = _met(anchors).groupBy("sha").agg(F.collect_list(F.struct("lo", "hi", "at", "hash", "n")).alias("wanted"))
    wanted = wanted.join(texts.where(F.size("own") > 0).select("sha", "own"), "sha", "full_outer")
    contents = docs.select(text).where(F.octet_length("text") >= min_bytes).select(F.unhex(F.sha2("text", 256)).alias("sha"), "text")
    contents = stored(contents.groupBy("sha").agg(F.first("text").alias("text")).join(wanted, "sha"), "passages-contents", compression="zstd")

    piece = F.substring(F.col("text").cast("binary"), (F.col("w.lo") + F.lit(1)).cast("int"), (F.col("w.hi") - F.col("w.lo") + F.lit(min_bytes)).cast("int"))
    pieces = contents.select("sha", "text", F.explode("wanted").alias("w")).select("sha", "w.*", piece.alias("piece"))
    found = []
    for level in range(LEVELS):
        parts = F.ceil(F.col("n") / F.lit(GROUP_PIECES)).cast("long")
        dealt = pieces.select("*", (parts > 1).alias("split"), F.pmod(F.xxhash64("sha", "lo"), parts).alias("part"))
        dealt = dealt.repartition("hash", "part").sortWithinPartitions("hash", "part")
        found.append(stored(dealt.mapInArrow(lambda b, i=level: _search(b, min_bytes, gram, i), _FOUND_SQL), "passages-found", compression="zstd"))
        again = found[-1].where("kind = 'piece'").select("sha", "lo", "hi", "at", "hash", F.col("content").alias("piece"))
        if again.isEmpty():
            break
        pieces = _met(again)

    span = F.struct("lo", "hi")
    found = functools.reduce(DataFrame.unionByName, found)
    met = found.where("kind = 'window'").groupBy("content").agg(F.collect_list(F.struct("sha", "lo", "hi")).alias("met")).where(F.size("met") > 1)
    met = met.select(F.explode("met").alias("m")).select("m.*")
    own = texts.select("sha", F.explode("own").alias("o")).select("sha", "o.*")
    covered = found.where("kind = 'span'").select("sha", "lo", "hi").unionByName(met).unionByName(own)
    covered = covered.groupBy("sha").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    once = texts.where("copies = 1").select("sha")
    cut = contents.select("sha", "text").join(covered, "sha").join(once, "sha", "left_semi")
    cut = cut.mapInArrow(_cut, "sha binary, n_removed long, n_spans long, kept binary, runs array<struct<lo: long, hi: long>>")

    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= min_bytes)
    everything = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n_bytes").alias("hi")))
    nothing = F.expr("CAST(array() AS array<struct<lo: long, hi: long>>)")
    choose = lambda a, b, c: F.when(whole, a).otherwise(F.coalesce(b, c))
    facts = texts.join(cut, "sha", "left").select(
        "sha",
        "copies",
        choose(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"),
        choose(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
        choose(F.lit(hashlib.sha256(b"").digest()), F.col("kept"), F.col("sha")).alias("kept"),
        choose(everything, F.col("runs"), nothing).alias("runs"),
    )
    return joined(rows.select("doc_id", "sha", "n_bytes"), stored(facts, "passages-facts", compression="zstd"), "sha", "copies").drop("copies")


def report(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    return spans(docs, min_bytes).select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))
