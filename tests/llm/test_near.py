import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sextant.llm import bpe, fingerprint, mixing, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, range string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", "y") for i, t in rows], DOCS)


def corpus(n=120, seed=9):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        base = rng.choices(words, k=rng.randint(1, 120))
        rows.append(" ".join(base))
        if i % 4 == 0:
            rows += [" ".join(base[:-1] + [rng.choice(words)]), " ".join(base).upper() + "\n"]
    return [*enumerate(rows), (9000, None), (9001, ""), (9002, " \t"), (9003, "w1 w2"), (9004, "w1  w2"), (3, rows[3])]


def brute_print(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits=4):
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= bits:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


def test_simhash_by_brute_force(spark):
    rows = corpus()
    prints = {i: brute_print(t) for i, t in rows}
    want = brute_components(prints)
    got = simhash.components(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id])
    assert simhash.components(docs(spark, [])).count() == 0


def test_golay_code():
    messages = np.arange(1 << 12)
    code = messages << 11
    code ^= simhash._remainders(code)
    rng = np.random.default_rng(0)
    for n in range(4):
        errors = np.array([sum(1 << int(b) for b in rng.choice(23, n, replace=False)) for _ in messages])
        assert np.array_equal(simhash.codeword_index(code ^ errors), messages)
    _, _, errors = simhash._golay()
    assert len(np.unique(errors)) == 2048 and np.bitwise_count(errors.astype(np.uint64)).max() == 3


@pytest.mark.parametrize("errors", range(5))
def test_keys_reach_four_bits(errors):
    rng = np.random.default_rng(errors)
    base = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    other = base.copy()
    for i in range(len(other)):
        for b in rng.choice(64, errors, replace=False):
            other[i] ^= np.uint64(1) << np.uint64(b)
    seen = set(zip(*(x.tolist() for x in simhash.fuzzy_keys(base.view(np.int64)))))
    rows, keys = simhash.fuzzy_keys(other.view(np.int64))
    assert len({r for r, k in zip(rows.tolist(), keys.tolist()) if (r, k) in seen}) == len(base)


def test_chain_of_links(spark):
    """Fingerprints one to four bits apart in a row are one component, whatever their number."""
    value, line = 0, [0]
    rng = random.Random(1)
    for _ in range(300):
        for b in rng.sample(range(64), 4):
            value ^= 1 << b
        line.append(value)
    ids = {i: v for i, v in enumerate(line)}
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in set(line)]
    roots = simhash.stars(simhash.links(spark.createDataFrame(signed, "fp long")))
    assert roots.select("v").distinct().count() == len(set(brute_components(ids).values()))


def test_dense_group_gives_a_forest(spark):
    base = 0x0123456789ABCDEF
    near = sorted({base ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)})
    assert len(simhash.forest(np.array(near), 4)[0]) == len(near) - 1
    edges = simhash.links(spark.createDataFrame([(v,) for v in near], "fp long"))
    assert edges.count() < 40 * len(near)
    assert simhash.stars(edges).select("v").distinct().count() == 1


def parts(text):
    """The paragraphs of a text as a set, repeats numbered."""
    whole = [p.strip(" ") for p in re.split(fingerprint.PARAGRAPH_END, text or "") if p.strip(" ")]
    pieces = [p[i : i + fingerprint.PIECE_CHARS] for p in whole for i in range(0, len(p), fingerprint.PIECE_CHARS)]
    return {(p, j) for p, n in Counter(pieces).items() for j in range(n)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def listed(spark, prints):
    """The digests of fingerprints, recovered from their strings alone by peeling in plain Python."""
    cells = {}
    for text in prints:
        body = text[26:]
        cells[text] = {int(c[:8], 16): [int(c[8:12], 16), int(c[12:28], 16), int(c[28:], 16)] for c in (body[i : i + 36] for i in range(0, len(body), 36))}
    found = {text: set() for text in prints}
    for _ in range(200):
        pure = sorted({(text, k, h) for text, held in cells.items() for n, k, h in held.values() if n == 1})
        if not pure:
            break
        frame = spark.createDataFrame([(i, k - 2**64 if k >= 2**63 else k) for i, (_, k, _) in enumerate(pure)], "i long, k long")
        frame = frame.select("i", fingerprint._check(F.col("k")).alias("h"), *[F.xxhash64("k", F.lit(j)).alias(f"p{j}") for j in range(3)])
        for r in frame.collect():
            text, k, h = pure[r.i]
            places = 1 << int(text[8:10], 16)
            at = [j * places + r[f"p{j}"] % places for j in range(3)]
            if r.h != h or k in found[text] or not all(c in cells[text] for c in at):
                continue
            found[text].add(k)
            for c in at:
                cell = cells[text][c]
                cell[:] = [cell[0] - 1, cell[1] ^ k, cell[2] ^ h]
                if cell == [0, 0, 0]:
                    del cells[text][c]
    assert not any(cells.values())
    return found


def prose(n=60, seed=2):
    rng = random.Random(seed)
    sentence = lambda: " ".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) + rng.choice([". ", "! ", "\n", "\n\n", "; "])
    rows = [(10 * i, "".join(sentence() for _ in range(rng.choice([0, 1, 3, 20, 150])))) for i in range(n)]
    return rows + [(5, None), (7, ""), (15, rows[3][1]), (15, rows[3][1]), (1001, "é€𝄞. " * 50), (1002, "no end at all " * 3000), (1003, "same line\n" * 40)]


@pytest.mark.parametrize("range_rows", [3, 2000])
def test_fingerprints_by_brute_force(spark, monkeypatch, range_rows):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", range_rows)
    rows = sorted(((i, t or "") for i, t in prose()), key=lambda x: x[0])
    want, following, edits = Counter(), {}, {}
    for k, (i, t) in enumerate(rows):
        following[i] = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + following[i][:q]
        edits[hashlib.sha256(edited.encode()).hexdigest()] = edited
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(jaccard(parts(t), parts(edited)), 9), round(jaccard(parts(t), parts(following[i])), 9)] += 1
    got = fingerprint.compare_edits(docs(spark, prose())).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want
    prints, texts = {}, dict(rows)
    for r in got:
        prints.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
        prints.setdefault(edits[r.edited_sha256], set()).add(r.edited_fingerprint)
    # equal texts have equal fingerprints, different texts different ones
    assert all(len(v) == 1 for v in prints.values()) and len({x for v in prints.values() for x in v}) == len(prints)
    # the likenesses are those of the strings returned
    digests = listed(spark, sorted({x for v in prints.values() for x in v}))
    assert all(len(found) == int(text[:8], 16) for text, found in digests.items())
    for r in got:
        own = digests[r.fingerprint]
        assert r.near_edited == pytest.approx(jaccard(own, digests[r.edited_fingerprint]))
        if r.doc_id != 15:
            assert r.near_next == pytest.approx(jaccard(own, digests[next(iter(prints[following[r.doc_id]]))]))
    if range_rows == 2000:  # and a comparison of the strings gives the same
        pairs = [(i, a.fingerprint, b.edited_fingerprint) for i, (a, b) in enumerate(zip(got, [*got[20:], *got[:20]]))]
        differing = {r.rid: r.d for r in fingerprint.compare(spark.createDataFrame(pairs, "rid long, a string, b string")).collect()}
        assert [differing.get(i, 0) for i, _, _ in pairs] == [len(digests[a] ^ digests[b]) for _, a, b in pairs]


def test_fingerprint_edges(spark):
    assert fingerprint.compare_edits(docs(spark, [])).count() == 0
    one = fingerprint.compare_edits(docs(spark, [(None, "a. b. c. d.")])).first()
    assert one.near_next == 1.0 and one.doc_id is None


def test_many_rows_of_one_id(spark, monkeypatch):
    """Rows of null ids, of one id, and equal rows are dealt to many ranges, and still are one ring."""
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 5)
    rows = [(None, f"n{i}.") for i in range(60)] + [(None, None)] * 40 + [(7, f"h{i}.") for i in range(50)] + [(7, "same")] * 50 + [(i, f"s{i}.") for i in range(100, 140)]
    table = docs(spark, rows).repartition(3)
    assert fingerprint._numbers(table).groupBy("range").count().agg(F.max("count")).first()[0] <= 30
    got = fingerprint.with_next(table).collect()
    assert Counter(r.text for r in got) == Counter(r.next_text for r in got) == Counter(t or "" for _, t in rows)
    assert all(r.next_text == f"s{r.doc_id + 1}." for r in got if 100 <= (r.doc_id or 0) < 139)


@pytest.mark.parametrize("rounds", [2, 9])
def test_peeling_recovers_sides(spark, monkeypatch, rounds):
    """Too few rounds leave pairs for larger tries; the digests found are the same."""
    monkeypatch.setattr(fingerprint, "ROUNDS", rounds)
    mix = lambda xs: [xxhash.xxh64_intdigest(str(x).encode()) - 2**63 for x in xs]
    a, b = set(mix(range(60))), set(mix(range(40, 90)))
    rows = [(1, p, 64, n, k) for p, n, ks in ((0, 1, a), (0, -1, b), (1, 1, a), (1, -1, a), (2, 1, a)) for k in ks]
    all_items = spark.createDataFrame(rows, "rid long, pair int, places int, n int, k long")
    items = lambda asked: (all_items if asked is None else all_items.join(asked, ["rid", "pair"])).repartition(2, "rid").select(all_items.columns)
    got = {(r.pair, r.n, r.k) for r in fingerprint.differences(items, keep=True).collect()}
    assert got == {(0, 1, k) for k in a - b} | {(0, -1, k) for k in b - a} | {(2, 1, k) for k in a}
    assert {(r.pair, r.d) for r in fingerprint.differences(items).collect()} == {(0, 70), (2, 60)}


def test_pipeline(spark, tmp_path):
    rng = random.Random(6)
    en, de = "the and ship thing over water of to in".split(), "der und schön straße über wasser zu auf".split()
    rows = []
    for i in range(160):
        words = en if i % 2 else de
        rows.append((i, " ".join(rng.choices(words, k=60)) + f" n{i}", "en" if i % 2 else "de", f"s{i % 3}", 1))
    rows += [(200, rows[1][1], "en", "s1", 1), (201, rows[1][1] + " ", "en", "s1", 1), (202, "1234 !!", "en", "s0", 1), (203, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        df = stage(spark, df, str(tmp_path))
        assert (df.columns == schema.replace(",", "").split()[::2]) == (i < 4)
        df.write.parquet(str(tmp_path / f"s{i}"))
        df = spark.read.parquet(str(tmp_path / f"s{i}"))
        seen.append(sorted(r.doc_id for r in df.collect()))
    assert set(seen[0]) == {r[0] for r in rows} - {202, 203}
    # of equal texts the one with more code points stays
    assert set(seen[1]) == set(seen[0]) - {1, 200}
    texts = {r[0]: r[1] for r in rows}
    want = brute_components({i: brute_print(texts[i]) for i in seen[1]})
    assert seen[2] == sorted(i for i, c in want.items() if i == c)
    kept = spark.read.parquet(str(tmp_path / "s2"))
    copies = {r.doc_id: r.taken // r.size for r in mixing.mix(kept).collect()}
    assert Counter(seen[3]) == Counter({i: n for i, n in copies.items() if n}) and seen[4] == seen[3]
    coder = bpe.tokenizer(corpus_pipeline.tokenizer_path())
    assert all(coder.decode(bytes(r.token_ids)) == r.text and r.n_tokens == len(r.token_ids) // 4 for r in df.collect())


def test_pipeline_of_nothing_and_of_clashing_names(spark, tmp_path):
    """Every stage passes an empty table, and columns that bear the names of helpers, as they came."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    names = ["_lang", "_score", "_langid", "_copy", "_mix_row", "_words", "_id", "_size", "_copies", "_exact_row", "_near_row", "token_ids", "n_tokens", "row", "kept", "size"]
    words = "the and ship thing over water of to in".split()
    rng = random.Random(3)
    rows = [(i if i % 5 else None, " ".join(rng.choices(words, k=30)) if i % 7 else None, "en", f"s{i % 2}" if i % 3 else None, 1) for i in range(60)] * 2
    for given in ([], rows):
        df = spark.createDataFrame(given, schema)
        for name in names:
            df = df.withColumn(name, F.lit(f"own {name}"))
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, str(tmp_path))
            assert out.columns == (df.columns if i < 4 else [*df.columns, "token_ids_", "n_tokens_"])
            out.write.mode("overwrite").parquet(str(tmp_path / f"{len(given)}-{i}"))
            df = spark.read.parquet(str(tmp_path / f"{len(given)}-{i}"))
            assert all(r[n] == f"own {n}" for r in df.select(*names).collect() for n in names)
        assert df.isEmpty() == (not given)
