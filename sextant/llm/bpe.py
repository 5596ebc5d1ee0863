"""Byte-pair encoding by speculation, and decoding back.

A text is cut into words by the tokenizer's pattern. Words not seen before are
first encoded greedily, longest token first. Such a proposal is the true encoding
exactly if every adjacent pair of its tokens is compatible, that is, if merging
the pair's bytes alone gives the pair again. All distinct pairs of a batch are
tested at once in numpy, by undoing merges from the later to the earlier and
looking whether a merge across the border would have come first. Only words with
a failing pair go through exact merging, lowest rank first: those of a batch in
step, as rows of numpy arrays; very long ones each with a heap.

The word pattern never crosses a space that a visible character follows, so texts
are first cut there, and the pattern runs only on cuts that were not seen before.

Ids equal those of the tokenizers library on the same file with
``add_special_tokens=False``; the strings of added tokens in a text are cut out
as that library does. Null text counts as empty and gives no ids. Texts are
processed whole, whatever their length; a worker keeps a cache of CACHE_WORDS cuts and
CACHE_BYTES of their bytes at most, found by a hash and compared byte for byte.
Other columns pass through untouched; where one has the name of a new column, the
new one gets underscores behind it. Repeated rows are encoded alike. An empty table
gives none.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import bounded_batches, fresh

#: Fixed value: the byte-level tokenizer's word pattern, letters first as they are commonest.
WORD_PATTERN = r" ?\p{L}++|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
#: Cuts of text that a worker remembers before it starts afresh, their bytes, and the longest of them.
CACHE_WORDS = 500_000
CACHE_BYTES = 16 << 20
CACHED_CUT = 256
#: Characters of text whose new words are encoded together.
BATCH_CHARS = 1_000_000

#: Bytes of a word beyond which merging keeps a heap.
LONG_WORD = 64
#: Longest words of the groups that are merged in step.
MERGE_WIDTHS = (7, 10, 14, 24, LONG_WORD)

_NEVER = np.int64(1) << 40
_FACTOR = 0x9E3779B97F4A7C15
#: The end of a run of letters is the end of a word wherever it is.
_LETTERS_END = regex.compile(r"\p{L}(?!\p{L})")
#: Bytes that begin a visible character for certain: ASCII, and lead bytes that no white space has.
_CUTS_BEFORE = np.array([33 <= b <= 126 or (b >= 0xC3 and b not in (0xE1, 0xE2, 0xE3)) for b in range(256)])


def byte_alphabet() -> dict[str, int]:
    """Character to byte: printable bytes stand for themselves, others move up from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class Lookup:
    """A hash table from whole numbers (not negative) to whole numbers, filled and read by arrays."""

    def __init__(self, room: int, missing: int = -1, kind: type = np.int64):
        self.missing, self.mask = missing, (1 << (3 * room).bit_length()) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.values = np.full(self.mask + 1, missing, kind)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not in the table yet."""
        at, waiting = self._home(keys), np.arange(len(keys))
        while len(waiting):
            free = waiting[self.keys[at[waiting]] < 0]
            won = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[won]], self.values[at[won]] = keys[won], values[won]
            waiting = np.setdiff1d(waiting, won)
            at[waiting] = (at[waiting] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(32))) & np.uint64(self.mask)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        held, out = self.keys[at], self.values[at]
        other = np.flatnonzero(held != keys)
        out[other] = self.missing
        other = other[held[other] >= 0]
        while len(other):
            at[other] = place = (at[other] + 1) & self.mask
            held = self.keys[place]
            hit = held == keys[other]
            out[other[hit]] = self.values[place[hit]]
            other = other[~hit & (held >= 0)]
        return out


class Tokenizer:
    """Tables of one byte-level tokenizer file, and the encoder on them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"]
        plain = cut["type"] == "ByteLevel" and not cut["add_prefix_space"] and cut["use_regex"]
        if model["type"] != "BPE" or not plain or spec["normalizer"] is not None or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        letters = byte_alphabet()
        self.ids = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take neighbouring text")
        size = max([*self.ids.values(), *added.values()]) + 1
        self.bytes = [b""] * size
        for token, i in self.ids.items():
            self.bytes[i] = token
        for token, i in added.items():
            self.bytes[i] = token.encode()
        self.added = {token: np.array([i], dtype="<u4").tobytes() for token, i in added.items()}
        self.added_pattern = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        # how far a token can reach that begins with these three bytes
        self.reach: dict[bytes, int] = {}
        for token in self.ids:
            self.reach[token[:3]] = max(len(token), self.reach.get(token[:3], 0))
        self.words = regex.compile(WORD_PATTERN)
        self.release()

        self.merges: dict[int, int] = {}  # left * size + right -> rank
        made_by: list[int] = []  # by rank
        self.rank = np.full(size, -1, dtype=np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        for rank, pair in enumerate(model["merges"]):
            a, b = (bytes(letters[c] for c in part) for part in (pair if isinstance(pair, list) else pair.split(" ")))
            one, two, made = self.ids[a], self.ids[b], self.ids[a + b]
            self.merges.setdefault(one * size + two, rank)
            made_by.append(made)
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = rank, one, two
        self._grow_trie()
        self.size = size
        self.made = np.array(made_by, dtype=np.int64)
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int64)
        n = len(self.merges)
        self.ranks = Lookup(n, int(_NEVER))
        self.ranks.add(np.fromiter(self.merges, np.int64, n), np.fromiter(self.merges.values(), np.int64, n))
        self.byte_ranks = self.pair_rank(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))
        # a token is sound if its own bytes encode to it: its last merge came in its turn
        self.sound = np.ones(size, dtype=bool)
        made = np.flatnonzero(self.rank >= 0)
        self.sound[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for token in made[np.argsort(self.rank[made])]:
            self.sound[token] &= self.sound[self.left[token]] & self.sound[self.right[token]]

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.ranks(a * self.size + b)

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | int = _NEVER) -> np.ndarray:
        """Whether no merge across the border of a and b comes before rank ``until``.

        The later of the two last merges is undone (of equal merges the right
        one, as the left is done first); the pieces then at the border stood
        there until that merge, so a merge of theirs must not be earlier.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        until = np.broadcast_to(np.asarray(until, dtype=np.int64), a.shape).copy()
        good = np.ones(len(a), dtype=bool)
        open_ = np.arange(len(a))
        while len(open_):
            x, y = a[open_], b[open_]
            fails = self.pair_rank(x, y) < until[open_]
            good[open_[fails]] = False
            whole = (self.rank[x] < 0) & (self.rank[y] < 0)
            open_ = open_[~fails & ~whole]
            x, y = a[open_], b[open_]
            undo_left = self.rank[x] > self.rank[y]
            until[open_] = np.where(undo_left, self.rank[x], self.rank[y] + 1)
            a[open_] = np.where(undo_left, self.right[x], x)
            b[open_] = np.where(undo_left, y, self.left[y])
        return good

    def _grow_trie(self) -> None:
        """The byte strings of all tokens as a tree: node * 256 + byte -> child."""
        nodes: dict[bytes, int] = {b"": 0}
        keys, children = [], []
        for token in self.ids:
            for end in range(1, len(token) + 1):
                if token[:end] not in nodes:
                    keys.append(nodes[token[: end - 1]] * 256 + token[end - 1])
                    children.append(len(nodes))
                    nodes[token[:end]] = len(nodes)
        self.child = Lookup(len(keys))
        self.child.add(np.array(keys, np.int64), np.array(children, np.int64))
        self.token_at = np.fromiter((self.ids.get(x, -1) for x in nodes), np.int64, len(nodes))

    def propose(self, word: bytes) -> list[int]:
        """The longest token at each place."""
        found, at, ids, reach, n = [], 0, self.ids, self.reach, len(word)
        while at < n:
            end = min(n, at + reach.get(word[at : at + 3], 2))
            while word[at:end] not in ids:
                end -= 1
            found.append(ids[word[at:end]])
            at = end
        return found

    def propose_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the word, token) of the longest token at each place of all words, in order.

        All words but the very long walk down the tree in step; where one gets
        stuck, it takes the last token passed and goes on behind it.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        at_word, tokens = [], []
        for i in np.flatnonzero(lengths > LONG_WORD).tolist():
            tokens.append(np.array(self.propose(words[i]), np.int64))
            at_word.append(np.full(len(tokens[-1]), i))
        flat = np.frombuffer(b"".join(words) + b"\0", np.uint8).astype(np.int64)
        ends = np.cumsum(lengths)
        who = np.flatnonzero((lengths <= LONG_WORD) & (lengths > 0))
        at, end = (ends - lengths)[who], ends[who]
        node, best, behind = np.zeros(len(who), np.int64), np.zeros(len(who), np.int64), at.copy()
        while len(who):
            child = self.child(node * 256 + flat[at])
            moves = (child >= 0) & (at < end)
            node = np.where(moves, child, 0)
            at = np.where(moves, at + 1, behind)
            token = np.where(moves, self.token_at[node], -1)
            best, behind = np.where(token >= 0, token, best), np.where(token >= 0, at, behind)
            stuck = np.flatnonzero(~moves)
            if len(stuck):
                at_word.append(who[stuck])
                tokens.append(best[stuck])
                done = ~moves & (behind == end)
                if done.any():
                    who, at, end, node, best, behind = (x[~done] for x in (who, at, end, node, best, behind))
        if not tokens:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word_of, flat_tokens = np.concatenate(at_word), np.concatenate(tokens)
        order = np.argsort(word_of, kind="stable")
        return word_of[order], flat_tokens[order]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the word, token) by exact merging: the lowest rank first, of equal ranks the leftmost."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        at_word, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in np.flatnonzero(lengths > LONG_WORD).tolist():
            tokens.append(np.array(self._merge_long(self.byte_ids[np.frombuffer(words[i], np.uint8)].tolist()), np.int64))
            at_word.append(np.full(len(tokens[-1]), i))
        least = 0
        for most in MERGE_WIDTHS:
            group = np.flatnonzero((lengths > least) & (lengths <= most))
            least = most
            if len(group):
                padded = b"".join([words[i].ljust(most, b"\0") for i in group.tolist()])
                raw = np.frombuffer(padded, np.uint8).reshape(len(group), most).astype(np.int64)
                for row, found in self._merge_rows(raw, lengths[group]):
                    at_word.append(group[row])
                    tokens.append(found)
        word_of, flat = np.concatenate(at_word), np.concatenate(tokens)
        order = np.argsort(word_of, kind="stable")
        return word_of[order], flat[order]

    def _merge_rows(self, raw: np.ndarray, lengths: np.ndarray) -> Iterable[tuple[np.ndarray, np.ndarray]]:
        """Words of similar length in step: each pass makes the lowest merge of every row."""
        n, width = raw.shape
        parts, row_of = self.byte_ids[raw], np.arange(n)
        ranks = np.full((n, width), _NEVER)  # of each part with the next; the last has none
        ranks[:, :-1] = self.byte_ranks[raw[:, :-1] * 256 + raw[:, 1:]]
        ranks[np.arange(width) >= lengths[:, None] - 1] = _NEVER
        lengths = lengths.copy()
        while len(parts):
            at = ranks.argmin(axis=1)
            low = ranks[np.arange(len(parts)), at]
            ends = low == _NEVER
            if ends.any():
                held = np.arange(width) < lengths[ends][:, None]
                yield np.repeat(row_of[ends], lengths[ends]), parts[ends][held]
                parts, ranks, row_of, at, low, lengths = (x[~ends] for x in (parts, ranks, row_of, at, low, lengths))
            rows = np.arange(len(parts))
            parts[rows, at] = self.made[low]
            # all behind the pair move up by one place
            width, lengths = width - 1, lengths - 1
            places = np.arange(width)
            parts = np.take_along_axis(parts, places + (places > at[:, None]), axis=1)
            ranks = np.take_along_axis(ranks, places + (places >= at[:, None]), axis=1)
            for side, known in ((at, at + 1 < lengths), (at - 1, at > 0)):
                i = np.flatnonzero(known)
                ranks[i, side[i]] = self.pair_rank(parts[i, side[i]], parts[i, side[i] + 1])
        return

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap and links, whose time does not grow with the square."""
        after = [*range(1, len(parts)), -1]
        before = [*range(-1, len(parts) - 1)]
        queue: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            a, b = parts[i], parts[after[i]]
            if (rank := self.merges.get(a * self.size + b)) is not None:
                heapq.heappush(queue, (rank, i, a, b))

        for i in range(len(parts) - 1):
            offer(i)
        while queue:
            rank, i, a, b = heapq.heappop(queue)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = int(self.made[rank]), -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the word, token): propose, test all pairs, merge the rest."""
        word_of, flat = self.propose_all(words)
        fails = np.zeros(len(words), dtype=bool)
        fails[word_of[~self.sound[flat]]] = True
        inner = np.flatnonzero(word_of[1:] == word_of[:-1])
        if len(inner):
            pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
            bad = ~self.compatible(pairs // self.size, pairs % self.size)
            fails[word_of[inner[bad[back]]]] = True
        again = np.flatnonzero(fails)
        merged_of, merged = self.merge([words[i] for i in again.tolist()])
        kept = ~fails[word_of]
        word_of, flat = np.concatenate([word_of[kept], again[merged_of]]), np.concatenate([flat[kept], merged])
        order = np.argsort(word_of, kind="stable")
        return word_of[order], flat[order]

    def forget(self) -> None:
        """Start the cache of cuts afresh: by hash its number; by number the places of its bytes and tokens."""
        self.known, self.n_known = Lookup(CACHE_WORDS, kind=np.int32), 0
        self.starts, self.byte_starts = np.zeros(CACHE_WORDS + 1, np.int64), np.zeros(CACHE_WORDS + 1, np.int64)
        self.tokens, self.cut_bytes = np.zeros(1 << 20, np.uint32), np.zeros(CACHE_BYTES, np.uint8)

    def release(self) -> None:
        """Give the cache's memory back, until texts come again."""
        self.known = self.tokens = self.cut_bytes = self.starts = self.byte_starts = None

    def _encode_cuts(self, cuts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, number of them for each cut)."""
        words, of = [], []
        for i, raw in enumerate(cuts):
            cut = raw.decode()
            if cut[1:].isalpha() and (cut[0] == " " or cut[0].isalpha()):  # letters, or a space and letters, are one word
                words.append(raw)
                of.append(i)
            else:
                found = self.words.findall(cut)
                words += [w.encode() for w in found]
                of += [i] * len(found)
        word_of, flat = self.encode_words(words)
        return flat, np.bincount(np.array(of, np.int64)[word_of], minlength=len(cuts))

    def _put(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        """Put cuts with distinct hashes, which are not in the cache yet, into it."""
        flat, lengths = self._encode_cuts([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
        first, last = self.n_known, self.n_known + len(starts)
        for places, sizes, held, new in (("starts", lengths, "tokens", flat), ("byte_starts", ends - starts, "cut_bytes", b"".join(raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())))):
            at = getattr(self, places)
            at[first + 1 : last + 1] = at[first] + np.cumsum(sizes)
            while at[last] > len(getattr(self, held)):  # tokens are no more than bytes
                setattr(self, held, np.concatenate([getattr(self, held)] * 2))
            getattr(self, held)[at[first] : at[last]] = np.frombuffer(new, np.uint8) if isinstance(new, bytes) else new
        self.known.add(hashes, np.arange(first, last))
        self.n_known = last

    def _numbers(self, raw: bytes, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each cut in the cache, new ones put in; -1 for long cuts and where another cut has the hash."""
        short = ends - starts <= CACHED_CUT
        at = np.where(short, self.known(hashes), -1)
        new = np.flatnonzero(short & (at < 0))
        if len(new):
            new = new[np.unique(hashes[new], return_index=True)[1]]
            if self.n_known + len(new) > CACHE_WORDS or self.byte_starts[self.n_known] + (ends - starts)[new].sum() > CACHE_BYTES:
                self.forget()
                new = np.flatnonzero(short)
                new = new[np.unique(hashes[new], return_index=True)[1]][:CACHE_WORDS]
                new = new[np.cumsum((ends - starts)[new]) <= CACHE_BYTES]
            self._put(raw, starts[new], ends[new], hashes[new])
            at = np.where(short, self.known(hashes), -1)
        # equal in length, and then in each byte
        at[self.byte_starts[at + 1] - self.byte_starts[at] != ends - starts] = -1
        has = np.flatnonzero(at >= 0)
        if len(has):
            size = (ends - starts)[has]
            before = np.cumsum(size) - size
            inner = np.arange(int(size.sum())) - np.repeat(before, size)
            like = self.cut_bytes[np.repeat(self.byte_starts[at[has]], size) + inner] == buffer[np.repeat(starts[has], size) + inner]
            at[has[~np.logical_and.reduceat(like, before)]] = -1
        return at

    def _encode_buffer(self, raw: bytes, firsts: np.ndarray) -> list[bytes]:
        """The ids of each part of a buffer, given where the parts begin; none is empty.

        A cut begins at each part, and at each space before a visible character,
        as no word crosses there. (Some visible characters beyond ASCII share a
        lead byte with white space and do not cut; that makes longer cuts only.)
        """
        buffer = np.frombuffer(raw, np.uint8)
        begins = np.zeros(len(buffer), dtype=bool)
        begins[:-1] = (buffer[:-1] == 32) & _CUTS_BEFORE[buffer[1:]]
        begins[firsts] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(buffer))
        place = np.arange(len(buffer)) - np.repeat(starts, ends - starts)
        powers = np.multiply.accumulate(np.full(int((ends - starts).max()), _FACTOR, np.uint64))
        hashes = np.add.reduceat((buffer.astype(np.uint64) + np.uint64(1)) * powers[place], starts)
        at = self._numbers(raw, buffer, starts, ends, (hashes & np.uint64((1 << 63) - 1)).astype(np.int64))
        lengths = np.where(at >= 0, self.starts[at + 1] - self.starts[at], 0)
        # cuts that the cache does not hold are encoded for this buffer alone
        other = np.flatnonzero(at < 0)
        fresh, lengths[other] = self._encode_cuts([raw[a:b] for a, b in zip(starts[other].tolist(), ends[other].tolist())]) if len(other) else (np.zeros(0, np.uint32), 0)
        before = np.cumsum(lengths) - lengths
        held = np.repeat(at >= 0, lengths)
        ids = np.zeros(int(lengths.sum()), np.uint32)
        ids[held] = self.tokens[(np.repeat(self.starts[at] - before, lengths) + np.arange(len(ids)))[held]]
        ids[~held] = fresh
        flat = ids.tobytes()
        part_of = np.searchsorted(firsts, starts, side="right") - 1
        sizes = 4 * np.cumsum(np.bincount(part_of, weights=lengths, minlength=len(firsts)).astype(np.int64))
        return [flat[a:b] for a, b in zip([0, *sizes.tolist()], sizes.tolist())]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if self.known is None:
            self.forget()
        pieces = [self._pieces(t) for t in texts]
        coded: list[bytes] = []
        for parts in _portions([x for found in pieces for x, _ in found if x]):
            raw = [x.encode() for x in parts]
            ends = np.cumsum([len(x) for x in raw])
            coded += self._encode_buffer(b"".join(raw), np.r_[0, ends[:-1]])
        ids = iter(coded)
        return [b"".join([x for part, added in found for x in (next(ids) if part else b"", added)]) for found in pieces]

    def _pieces(self, text: str) -> list[tuple[str, bytes]]:
        """The parts between added tokens, each with the id of the added token that follows.

        A long text is also parted at spaces, or else behind letters, so that a buffer
        stays small; one run of letters is one word and stays together.
        """
        hits = [m.span() for m in self.added_pattern.finditer(text)] if self.added_pattern else []
        out, at = [], 0
        for a, b in [*hits, (len(text), len(text))]:
            while a - at > BATCH_CHARS:
                cut = text.find(" ", at + BATCH_CHARS, a - 1)
                while cut >= 0 and not "!" <= text[cut + 1] <= "~":
                    cut = text.find(" ", cut + 1, a - 1)
                if cut < 0:
                    end = _LETTERS_END.search(text, at + BATCH_CHARS, a)
                    cut = end.end() if end else a
                if cut >= a:
                    break
                out.append((text[at:cut], b""))
                at = cut
            out.append((text[at:a], self.added[text[a:b]] if a < b else b""))
            at = b
        return out

    def decode(self, ids: bytes) -> str:
        table = self.bytes
        return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """The tables of a file, loaded once in each worker process."""
    return Tokenizer(path)


def _portions(texts: list[str]) -> Iterable[list[str]]:
    part, chars = [], 0
    for text in texts:
        if part and chars + len(text) > BATCH_CHARS:
            yield part
            part, chars = [], 0
        part.append(text)
        chars += len(text)
    if part:
        yield part


def released(batches: Iterator[pd.Series], path: str) -> Iterator[pd.Series]:
    """The ids of batches of texts; at their end the worker's cache of cuts is given back.

    Spark keeps idle workers and takes them in turn, so more of them than tasks at
    once would each hold a cache, through stages of other work too.
    """
    coder = tokenizer(path)
    try:
        for texts in batches:
            yield _encoded(coder, texts)
    finally:
        coder.release()


def _encoded(coder: Tokenizer, texts: pd.Series) -> pd.Series:
    return pd.Series([ids for part in _portions(texts.fillna("").tolist()) for ids in coder.encode_all(part)], dtype=object)


def encode_column(text: Column, path: str, chained: bool = False) -> Column:
    """Ids of the text as binary: little-endian unsigned 32-bit integers.

    ``chained`` is for ids that another function of the same worker takes; the cache then stays.
    """

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        return _encoded(tokenizer(path), texts)

    @F.pandas_udf("binary")
    def encode_alone(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return released(batches, path)

    return encode(text) if chained else encode_alone(text)


def decode_column(ids: Column, path: str) -> Column:
    """The text of ids given as binary; null ids give the empty text."""

    @F.pandas_udf("string")
    def decode(column: pd.Series) -> pd.Series:
        coder = tokenizer(path)
        return pd.Series([coder.decode(x or b"") for x in column], dtype=object)

    return decode(ids)


def encode(docs: DataFrame, path: str, ids: str = "token_ids", count: str = "n_tokens", chained: bool = False) -> DataFrame:
    """``docs`` with the ids of ``text`` (binary) and their number; ``chained`` as for ``encode_column``."""
    bounded_batches(docs.sparkSession)
    ids, count = fresh(docs, ids), fresh(docs, count)
    out = docs.withColumn(ids, encode_column(F.col("text"), path, chained))
    return out.withColumn(count, (F.octet_length(ids) / F.lit(4)).cast("long"))


def decode(docs: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text that the ids stand for."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(fresh(docs, text), decode_column(F.col(ids), path))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of the text decoded from them."""
    coded = decode(encode(docs.select("doc_id", "text"), path, chained=True), path)
    return coded.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
