"""Source divergence audit: how far the term distributions of a language's sources lie apart.

Terms are counted in length buckets. The bytes of a run of letters fit into one
uint64 word up to 8 bytes and into two up to 16, packed from the front and filled
with zeros, which no term holds; such words are sorted by a radix sort over their
16-bit digits, and runs of equal words are counted. Longer terms lie in buckets of
32, 64, 128 ... bytes, each sorted as byte strings of that width. Python counts
about CHUNK_BYTES of text at a time, so one chunk's arrays are what a task holds;
Spark adds the counts up, by (lang, source, term) before anything of a key meets.

A language keeps the terms that at least MIN_DOCS of its documents have. Each group
(lang, source), and each language, gives every kept term
``1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V))``, N being its count of kept
terms and V their number: whole numbers throughout, in decimals where products
would leave 64 bits. The report has two parts: ``pair``, each other source of the
language with the sum of absolute differences over all kept terms, and ``term``, the
terms that a group has more of than its language, up to TOP_TERMS of them.

Null text, lang and source count as ''. A language without kept terms has all pairs
at 0, a language of one source no pair, a group without terms is at the prior. Equal
values go by item in UTF-8 order. Rows that are repeated are documents of their own.
Other columns are not read. An empty table gives none. Very long texts are cut
between terms and counted piece by piece. A kept term's row carries one number for
each source of its language, so sources are meant to be some thousands at most, as
is a report of all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import bounded_batches, joined, stored

#: Documents of a language that a kept term is in, at least.
MIN_DOCS = 30
#: Parts that a probability is written in, and what is added to each count.
SCALE = 1_000_000_000
PRIOR = 5
#: Terms reported of a group.
TOP_TERMS = 50
#: Text bytes that are counted at a time.
CHUNK_BYTES = 8 << 20
#: Numbers of a block of kept terms that are compared at a time.
BLOCK_CELLS = 1 << 22

#: ASCII letters and all bytes of longer UTF-8 sequences make up terms.
IS_TERM = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)

_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def term_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and length of each term of texts that lie one after the other and end at ``ends``."""
    inside = IS_TERM[data]
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    cut = ends[(ends > 0) & (ends < len(data))]
    before[cut] = False
    after[cut - 1] = False
    first = np.flatnonzero(inside & ~before)
    return first, np.flatnonzero(inside & ~after) + 1 - first


def packed(data: np.ndarray, first: np.ndarray, length: np.ndarray, words: int) -> np.ndarray:
    """(n, words) of uint64: the terms' bytes from the front, zeros behind. ``data`` has 8 * words bytes to spare."""
    width = 8 * words
    rows = np.lib.stride_tricks.sliding_window_view(data, width)[first]
    rows = np.where(np.arange(width) < length[:, None], rows, 0).astype(np.uint8)
    return rows.view(">u8").astype(np.uint64)


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """The stable order by the given unsigned arrays, the last one first in rank, digit by digit of 16 bits."""
    order = np.arange(len(keys[0]))
    for key in keys:
        for shift in range(0, 8 * key.dtype.itemsize, 16):
            digit = (key >> key.dtype.type(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                # numpy sorts 16-bit numbers by counting them
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _runs(keys: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first of each run, its rows, its different documents) of sorted rows."""
    new = np.ones(len(doc), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    new_doc = new.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]
    return first, np.diff(np.append(first, len(doc))), np.add.reduceat(new_doc.astype(np.int64), first)


def count_terms(data: np.ndarray, ends: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length bucket: group, bytes (n, width), length, count and documents of each (group, term).

    ``group`` has a number for each text; terms are lower-cased where they are A-Z.
    """
    first, length = term_spans(data, ends)
    doc = np.searchsorted(ends, first, side="right")
    longest = int(length.max(initial=0))
    data = np.concatenate([LOWER[data], np.zeros(max(16, 1 << longest.bit_length()), np.uint8)])
    width, least = 8, 1
    while least <= longest:
        own = (length >= least) & (length <= width)
        if own.any():
            at, size, of = first[own], length[own], doc[own]
            g = group[of].astype(np.uint32)
            if width <= 16:
                words = packed(data, at, size, width // 8)
                keys = [*words.T[::-1], g]
                order = radix_order(keys)
                run, n, docs = _runs([k[order] for k in keys], of[order])
                chosen = order[run]
                rows = words[chosen].astype(">u8").view(np.uint8).reshape(-1, width)
            else:
                terms = np.array([data[a : a + k].tobytes() for a, k in zip(at, size)], dtype=f"S{width}")
                order = np.argsort(terms, kind="stable")
                order = order[radix_order([g[order]])]
                run, n, docs = _runs([terms[order], g[order]], of[order])
                chosen = order[run]
                rows = terms[chosen].view(np.uint8).reshape(-1, width)
            yield g[chosen], rows, size[chosen], n, docs
        width, least = 2 * width, width + 1


def _strings(rows: np.ndarray, length: np.ndarray) -> pa.Array:
    data = rows[np.arange(rows.shape[1]) < length[:, None]]
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(length), pa.py_buffer(offsets), pa.py_buffer(data))


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces of about CHUNK_BYTES that end behind a term (or at the end of one that is longer)."""
    at = 0
    while at < len(text):
        to = min(at + CHUNK_BYTES, len(text))
        while to < len(text) and IS_TERM[text[to]]:
            to += 1
        yield text[at:to]
        at = to


def _count_long(text: bytes, lang: str, source: str) -> Iterator[pa.RecordBatch]:
    """One text of more than CHUNK_BYTES: its pieces are added up, so that it counts as one document."""
    sums: dict[bytes, int] = {}
    for piece in _pieces(text):
        for _, rows, length, n, _ in count_terms(np.frombuffer(piece, np.uint8), np.array([len(piece)]), np.zeros(1, int)):
            for row, size, k in zip(rows, length, n):
                term = row[:size].tobytes()
                sums[term] = sums.get(term, 0) + int(k)
    terms = [t.decode() for t in sums]
    for i in range(0, len(terms), 65_536):
        own = terms[i : i + 65_536]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array([source] * len(own)), pa.array(own), pa.array([sums[t.encode()] for t in own], pa.int64()), pa.array([1] * len(own), pa.int64())], schema=_COUNTED)


def _count_chunk(texts: list[bytes], langs: list[str], sources: list[str]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple[str, str], int] = {}
    group = np.array([known.setdefault(x, len(known)) for x in zip(langs, sources)], dtype=np.int64)
    lang, source = (pa.array([x[i] for x in known], pa.string()) for i in (0, 1))
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return
    for g, rows, length, n, docs in count_terms(data, np.cumsum([len(t) for t in texts]), group):
        at = pa.array(g.astype(np.int64))
        yield pa.RecordBatch.from_arrays([lang.take(at), source.take(at), _strings(rows, length), pa.array(n), pa.array(docs)], schema=_COUNTED)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, langs, sources, held = [], [], [], 0
    for batch in batches:
        for text, lang, source in zip(batch["text"], batch["lang"].to_pylist(), batch["source"].to_pylist()):
            raw = text.as_buffer().to_pybytes()
            if len(raw) > CHUNK_BYTES:
                yield from _count_long(raw, lang, source)
                continue
            texts.append(raw), langs.append(lang), sources.append(source)
            held += len(raw)
            if held >= CHUNK_BYTES:
                yield from _count_chunk(texts, langs, sources)
                texts, langs, sources, held = [], [], [], 0
    if texts:
        yield from _count_chunk(texts, langs, sources)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term, of each group."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    return rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def scaled(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept))`` as an exact long; null without kept terms."""
    over, under = count + F.lit(PRIOR), total + F.lit(PRIOR) * kept
    wide = F.lit(SCALE).cast("decimal(10,0)") * over.cast("decimal(20,0)")
    least = F.lit((1 << 62) // SCALE)
    whole = F.when(over < least, F.call_function("div", F.lit(SCALE).cast("long") * over, under)).otherwise(F.call_function("div", wide, under.cast("decimal(20,0)")))
    return F.when(kept > 0, F.lit(1).cast("long") + whole)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of absolute differences of each two sources over the terms of a batch, for each language in it."""
    for batch in batches:
        langs = batch["lang"].to_pylist()
        zeros, found = batch["zeros"], batch["found"]
        at, p = (np.asarray(x) for x in found.values.flatten())
        first = found.offsets.to_numpy()
        for lang in dict.fromkeys(langs):
            own = np.flatnonzero([x == lang for x in langs])
            zero = np.array(zeros[own[0]].as_py(), dtype=np.int64)
            n = len(zero)
            if n < 2:
                continue
            sums = [np.zeros(n - 1 - a, np.int64) for a in range(n)]
            step = max(1, BLOCK_CELLS // n)
            for i in range(0, len(own), step):
                block = own[i : i + step]
                rows = np.tile(zero, (len(block), 1))
                size = first[block + 1] - first[block]
                of = np.repeat(np.arange(len(block)), size)
                entry = np.repeat(first[block] - np.cumsum(size) + size, size) + np.arange(size.sum())
                rows[of, at[entry]] = p[entry]
                for a in range(n - 1):
                    sums[a] += np.abs(rows[:, a + 1 :] - rows[:, a : a + 1]).sum(axis=0)
            for a in range(n - 1):
                b = np.arange(a + 1, n, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(b), pa.string()), pa.array(np.full(len(b), a, np.int32)), pa.array(b), pa.array(sums[a])], names=["lang", "a", "b", "value"])


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: the report described above."""
    kept = (
        term_counts(docs)
        .groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("found"))
        .where(F.col("docs") >= min_docs)
        .drop("docs")
    )
    kept = stored(kept, "divergence-kept")  # entries of a term are as many as its language's sources at most
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    groups = docs.select(empty("lang"), empty("source")).distinct()
    sums = kept.select("lang", F.explode("found").alias("f")).groupBy("lang", F.col("f.source").alias("source")).agg(F.sum("f.n").alias("n"))
    groups = groups.join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_n"))
    langs = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("sources")).join(sizes, "lang", "left").fillna(0, ["kept", "lang_n"])
    part = lambda name: F.transform("sources", lambda s: s[name]).alias(f"{name}s")
    zeros = F.transform("sources", lambda s: scaled(F.lit(0), s["n"], F.col("kept"))).alias("zeros")
    langs = stored(langs.select("lang", "kept", "lang_n", part("source"), part("n"), zeros), "divergence-langs")  # a row of each language

    rows = joined(kept, langs, "lang", "kept")
    placed = F.transform("found", lambda f: F.struct((F.array_position("sources", f["source"]) - F.lit(1)).cast("int").alias("at"), f["n"].alias("n")))
    valued = F.transform(placed, lambda f: F.struct(f["at"].alias("at"), scaled(f["n"], F.col("ns")[f["at"]], F.col("kept")).alias("p")))
    valued = rows.select("lang", "term", "zeros", "sources", scaled(F.col("total"), F.col("lang_n"), F.col("kept")).alias("q"), valued.alias("found"))
    compared = valued.select("lang", "zeros", "found").mapInArrow(_compare, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = langs.select("lang", "sources", F.posexplode("sources").alias("i", "source")).select("lang", "i", "source", F.posexplode("sources").alias("j", "item")).where("i <> j")
    pairs = pairs.select("lang", "source", "item", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).join(compared, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    own = valued.select("lang", F.col("term").alias("item"), "q", "sources", F.explode("found").alias("f"))
    above = own.select("lang", F.col("sources")[F.col("f.at")].alias("source"), F.lit("term").alias("part"), "item", (F.col("f.p") - F.col("q")).alias("value"))
    return _ranked(pairs).unionByName(_ranked(above.where("value > 0")).where(F.col("rank") <= top_terms))
