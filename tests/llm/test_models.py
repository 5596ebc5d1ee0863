import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sextant.llm import bpe, langid, lm

DOCS = "doc_id long, text string, lang string, token_ids string, row string"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, v, "x", "y") for i, t, v in rows], DOCS)


def library_ids(texts):
    coder = Tokenizer.from_file(PATH)
    return [np.array(e.ids, "<u4").tobytes() for e in coder.encode_batch(texts, add_special_tokens=False)]


def test_bpe_equals_library(spark):
    rng = random.Random(5)
    bits = ["a", "b", "th", " ", "  ", "\n", "'s", "<|endoftext|>", "<|", "1", "22", "é", "日本", "😀", "==", "\r\n", "\x00", "ing", "́", " "]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 60))) for _ in range(400)] + ["", "x" * 20000, " " * 5000, "ab" * 9000]
    rows = [*enumerate(texts), (1000, None), (3, texts[3])]
    got = bpe.round_trip(docs(spark, [(i, t, "en") for i, t in rows]), PATH).collect()
    want = Counter()
    for (i, t), ids in zip(rows, library_ids([t or "" for _, t in rows])):
        want[i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, got)) == want
    assert bpe.round_trip(docs(spark, []), PATH).count() == 0


def test_bpe_checks_are_exact():
    """A proposal passes the pair checks exactly if merging gives it."""
    coder = bpe.Tokenizer(PATH)
    rng = random.Random(2)
    words = ["".join(rng.choices("abeinst", k=rng.randint(1, 12))) for _ in range(3000)]
    for word in words:
        tokens = coder.propose(word.encode())
        pairs = np.array(list(zip(tokens, tokens[1:])), dtype=np.int64).reshape(-1, 2)
        good = bool(coder.compatible(pairs[:, 0], pairs[:, 1]).all()) if len(pairs) else True
        assert good == (coder.merge([word.encode()])[1].tolist() == tokens)
    word_of, flat = coder.propose_all([w.encode() for w in words])
    assert all(flat[word_of == i].tolist() == coder.propose(w.encode()) for i, w in enumerate(words))
    assert all(coder._merge_long([coder.ids[w.encode()[i : i + 1]] for i in range(len(w))]) == coder.merge([w.encode()])[1].tolist() for w in words[:500])


def test_bpe_forgets_words(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    monkeypatch.setattr(bpe, "BATCH_CHARS", 9)
    coder = bpe.Tokenizer(PATH)
    texts = ["one two three", "four five six seven", "one nine", "", "a b c d e f g h i j k", "long  text in \n parts <|endoftext|>", "  "]
    for _ in range(2):
        assert [coder.encode_all([t])[0] for t in texts] == library_ids(texts)


def test_bpe_tells_cuts_of_one_hash_apart():
    """The Thue-Morse word and its complement have equal sums under any odd powers modulo 2**64."""
    word = "a"
    for _ in range(11):
        word += word.translate({97: 98, 98: 97})
    texts = [x for n in (128, 256, 1024, 2048) for x in (word[:n], word[:n].translate({97: 98, 98: 97}))]
    for size in (bpe.CACHED_CUT, 4096):
        coder = bpe.Tokenizer(PATH)
        bpe.CACHED_CUT, kept = size, bpe.CACHED_CUT
        assert coder.encode_all(texts) == library_ids(texts) and coder.encode_all(texts[::-1]) == library_ids(texts[::-1])
        bpe.CACHED_CUT = kept


def test_bpe_cache_is_bounded_by_bytes(monkeypatch):
    """Distinct texts without a space: the worker's cache stays within its bytes, ids stay right."""
    rng = random.Random(6)
    letters = [chr(c) for c in range(0x4E00, 0x5000)] + list("abcdefgh")
    texts = ["".join(rng.choices(letters, k=rng.randint(20, 40))) for _ in range(100_000)]
    texts += ["".join(rng.choices(letters, k=3000)) for _ in range(50)] + ["、".join("".join(rng.choices(letters, k=30)) for _ in range(300))]
    monkeypatch.setattr(bpe, "CACHE_BYTES", 1 << 20)
    monkeypatch.setattr(bpe, "BATCH_CHARS", 5000)
    coder = bpe.Tokenizer(PATH)
    got = [ids for part in bpe._portions(texts) for ids in coder.encode_all(part)]
    assert got == library_ids(texts)
    assert coder.byte_starts[coder.n_known] <= len(coder.cut_bytes) == 1 << 20 and len(coder.tokens) <= 2 << 20


def test_bpe_gives_its_cache_back_at_the_end_of_a_task():
    """A worker holds no cache of cuts between tasks; ids are the same before and after."""
    texts = ["one two three", "", "four  five <|endoftext|> six"]
    coder = bpe.tokenizer(PATH)
    for _ in range(2):
        batches = bpe.released(iter([pd.Series(texts), pd.Series([None, "one nine"])]), PATH)
        assert list(next(batches)) == library_ids(texts) and coder.known is not None
        assert list(next(batches)) == library_ids(["", "one nine"])
        assert list(batches) == []
        assert all(getattr(coder, held) is None for held in ("known", "tokens", "cut_bytes", "starts", "byte_starts"))
    assert coder.encode_all(texts) == library_ids(texts)


WORDS = {"en": "the and ship thing over water", "fr": "le été où garçon mer eau", "de": "der und schön straße über wasser"}


def labelled(n=240, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choices(WORDS[lang].split(), k=rng.randint(5, 80))), lang))
    return rows


def test_language(spark):
    rows = labelled() + [(900, None, "en"), (901, "", "en"), (902, "123 !!", "de"), (903, WORDS["fr"] * 2000, None), (904, "été", "fr")]
    got = {r.doc_id: r for r in langid.identify(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, text, lang in rows:
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (text is None or not any(c.isalpha() for c in text))
    held = [(got[i].lang_pred, lang) for i, _, lang in labelled() if got[i].held_out]
    assert np.mean([a == b for a, b in held]) >= 0.95 and got[903].lang_pred == "fr"


def language_by_hand(net, raw):
    """Scores of a text by direct convolution, window by window, without tables."""
    total = np.zeros(len(net.langs))
    for at in range(0, max(1, len(raw)), langid.WINDOW):
        window = raw[at : at + langid.WINDOW]
        x = np.zeros((langid.WINDOW, langid.EMBEDDING))
        x[: len(window)] = net.embed[list(window)]
        pooled = []
        for i, w in enumerate(langid.WIDTHS):
            outs = [np.einsum("ke,kef->f", x[j : j + w], net.filters[w]) for j in range(langid.WINDOW - w + 1)]
            pooled.append(np.max(outs, axis=0) + net.bias[i * langid.FILTERS : (i + 1) * langid.FILTERS])
        z = np.maximum(np.concatenate(pooled), 0) @ net.dense + net.dense_bias
        total += len(window) * (z - z.max() - np.log(np.exp(z - z.max()).sum()))
    return total / max(1, len(raw))


def test_language_by_brute_force(spark):
    rows = labelled(60) + [(900, " ".join(f"{a} {b}" for a in WORDS["de"].split() for b in WORDS["fr"].split()) * 3, None), (901, "été " * 700, "fr"), (902, "x", None)]
    table = docs(spark, rows)
    net = langid.train(table, F.lit(True))
    for r in langid.predict(table, net).collect():
        z = language_by_hand(net, r.text.encode())
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert r.lang_pred == net.langs[int(z.argmax())] and r.lang_score == pytest.approx(p.max(), abs=1e-4)


def test_sample_is_drawn_from_whole_texts(spark, monkeypatch):
    """Of long texts a bounded number of windows, from everywhere in them."""
    seen = {}
    monkeypatch.setattr(langid, "fit", lambda windows, labels: seen.update(windows=windows, labels=labels))
    text = "".join(f"{i:07d} " for i in range(40_000))
    langid.train(docs(spark, [(1, "a" + text, "en"), (2, "b" + text, "de"), (3, "short", "de")]), F.lit(True))
    places = [int(w.split()[1]) for w in seen["windows"] if len(w) == langid.WINDOW]
    assert len(places) <= 2 * langid.SAMPLE_WINDOWS and min(places) < 12_000 and max(places) > 28_000 and b"short" in seen["windows"]


def test_language_and_ids_keep_clashing_columns(spark):
    df = docs(spark, [(1, "le été", "fr"), (2, None, None)]).selectExpr("*", "'p' AS lang_pred", "'s' AS lang_score", "'h' AS _langid", "'n' AS n_tokens")
    out = bpe.encode(langid.predict(df, langid.train(df, F.lit(True))), PATH)
    assert out.columns == [*df.columns, "lang_pred_", "lang_score_", "token_ids_", "n_tokens_"]
    assert {(r.lang_pred, r.lang_score, r._langid, r.n_tokens, r.token_ids) for r in out.collect()} == {("p", "s", "h", "n", "x")}


def test_language_without_labels(spark):
    rows = [(1, "some text", None), (2, None, None)]
    assert {r.lang_pred for r in langid.identify(docs(spark, rows)).collect()} == {"und"}
    assert langid.identify(docs(spark, [])).count() == 0


def test_prediction_ignores_other_columns(spark):
    net = langid.fit([t.encode() for _, t, _ in labelled()], [v for _, _, v in labelled()])
    a = langid.predict(docs(spark, [(1, "le été", "de")]), net).first()
    b = langid.predict(docs(spark, [(2, "le été", None)]), net).first()
    assert (a.lang_pred, a.lang_score) == (b.lang_pred, b.lang_score) and a.row == "y"


def test_gradients_match_differences():
    net = langid.start(["a", "b", "c"])
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (6, langid.WINDOW)), np.array([0, 1, 2, 0, 1, 2])
    for name in ("embed", "dense", "bias", "dense_bias"):
        net.__dict__[name] = net.__dict__[name].astype(np.float64)
    net.filters = {w: f.astype(np.float64) for w, f in net.filters.items()}

    def loss():
        z = langid.Folded(net).window_scores(x)
        return -z[np.arange(6), y].mean()

    grads = langid.gradients(net, x, y)
    for name, values in (("dense", net.dense), ("filters3", net.filters[3]), ("embed", net.embed)):
        at = np.unravel_index(np.abs(grads[name]).argmax(), values.shape)
        old = values[at]
        values[at] = old + 1e-5
        up = loss()
        values[at] = old - 1e-5
        down = loss()
        values[at] = old
        assert (up - down) / 2e-5 == pytest.approx(grads[name][at], rel=1e-2)


def lm_rows():
    rng = random.Random(4)
    rows = []
    for i in range(400):
        words = WORDS[rng.choice(list(WORDS))].split()
        rows.append((i, " ".join(rng.choices(words + [f"rare{rng.randint(0, 40)}"], k=rng.randint(1, 40))), "x"))
    return rows + [(1000, None, "x"), (1001, "", "x"), (1002, "THE\x0bUnseen été É", "x"), (7, rows[7][1], "x")]


def lm_tokens(text):
    return (text or "").encode().lower().split() + [b""]


def lm_model(spark, rows):
    """The vocabulary and parameters that ``score`` uses for the same documents."""
    train = docs(spark, rows).where(lm.id_remainder(10) != 0)
    counts = lm.token_counts(train)
    vocab = lm.vocabulary(counts)
    shared = spark.sparkContext.broadcast(vocab)
    mixed = train.select(F.xxhash64(F.col("doc_id").cast("string"), "text").alias("mix"), lm.encode_column(F.col("text"), shared)["ids"].alias("ids"))
    return vocab, lm.fit(mixed, vocab, shared)


def lm_log(vocab, params, counts, word, before):
    """log10 of one token after two others, from the definition."""
    own = {t: i for i, t in enumerate(vocab.tokens[: vocab.own])}
    shared = len(vocab.shared_total)
    cls = lambda w: own[w] if w in own else vocab.own + zlib.crc32(w[-lm.ENDING:]) % shared
    guess = sum(params["context"][cls(b)].astype(float) * params["weights"][k] for k, b in enumerate(before))
    c, size = cls(word), vocab.group
    group = np.exp(params["group"][:, :-1] @ guess + params["group"][:, -1])
    g = c // size
    mine = params["target"][g * size : (g + 1) * size]
    inside = np.exp(mine[:, :-1] @ guess + mine[:, -1])
    p = group[g] / group.sum() * inside[c - g * size] / inside.sum()
    if c >= vocab.own:
        same = [n for w, n in counts.items() if w not in own and cls(w) == c]
        p *= (counts[word] + 0.1) / (sum(same) + 0.1 * (len(same) + 1))
    return math.log10(p)


@pytest.mark.parametrize("head,own", [(65536, 2.0), (8, 0.5)])
def test_lm_by_brute_force(spark, monkeypatch, head, own):
    monkeypatch.setattr(lm, "HEAD_TOKENS", head)
    monkeypatch.setattr(lm, "OWN_CLASSES", own)
    rows = lm_rows()
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t, _ in rows if not held(i) for w in lm_tokens(t))
    n, v = sum(c.values()), len(c)
    got = lm.score(docs(spark, rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    texts = {i: t for i, t, _ in rows}
    vocab, params = lm_model(spark, rows)
    for r in got:
        ws = lm_tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        line = [b"", b"", *ws]
        assert r.score == pytest.approx(sum(lm_log(vocab, params, c, w, (line[i + 1], line[i])) for i, w in enumerate(ws)), rel=1e-4)
    if own == 2.0:
        mine = [r for r in got if r.held_out]
        assert sum(r.score for r in mine) > sum(r.base_score for r in mine)


def test_lm_probabilities_add_up(spark):
    rows = lm_rows()
    vocab, params = lm_model(spark, rows)
    before = [np.full(vocab.classes, 1), np.full(vocab.classes, vocab.classes - 1)]
    logs = lm.Scorer(vocab, params).logs(before, np.arange(vocab.classes))
    assert np.exp(logs).sum() == pytest.approx(1, rel=1e-4)
    c = Counter(w for i, t, _ in rows if zlib.crc32(str(i).encode()) % 10 for w in lm_tokens(t))
    # unknown words of all shared classes stand for what no known word takes
    total = sum(10 ** lm_log(vocab, params, c, w, (b"the", b"")) for w in c)
    assert 0.9 < total <= 1.001


def test_lm_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 1500)
    table = docs(spark, lm_rows())
    by_split = [sorted((r.doc_id, r.score) for r in lm.score(table.repartition(n)).collect()) for n in (1, 9)]
    assert [i for i, _ in by_split[0]] == [i for i, _ in by_split[1]]
    assert [x for _, x in by_split[0]] == pytest.approx([x for _, x in by_split[1]], rel=1e-6)


def test_lm_classes_grow(spark):
    few, many = (lm.vocabulary(spark.range(n).select(F.encode(F.col("id").cast("string"), "UTF-8").alias("token"), F.lit(3).cast("long").alias("n"))) for n in (400, 40_000))
    assert many.own > 9 * few.own and many.groups > 2 * few.groups


def test_lm_without_training(spark):
    assert lm.score(docs(spark, [])).count() == 0
    r = lm.score(docs(spark, [(1, "some words", "x")]), F.lit(True)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)
