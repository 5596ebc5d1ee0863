import collections
import random
import re

import pytest

from sextant.llm import line_dedup

DOCS = "doc_id long, text string, line string, place string, leaf string"
SPACE = r"[ \t\n\x0b\f\r]"


def masked(line):
    tokens = re.split(f"{SPACE}+", line)
    return " ".join("<*>" if re.search("[0-9]", x) else x for x in tokens).strip(" ")


def brute(texts):
    """The cleaned form of each text, by dictionaries."""
    forms = collections.defaultdict(set)
    for t in set(texts):
        for line in t.split("\n"):
            if masked(line).replace("<*>", "").strip():
                forms[tuple(masked(line).split(" "))].add(t)
    gone = {form for form, ts in forms.items() if len(ts) >= line_dedup.MIN_TEXTS}
    leaves = collections.defaultdict(list)
    for form in forms:
        if len(form) > line_dedup.DEPTH:
            leaves[len(form), form[: line_dedup.DEPTH]].append(form)
    for left in leaves.values():
        if len(set().union(*(forms[f] for f in left))) < line_dedup.MIN_TEXTS:
            continue
        for _ in range(line_dedup.LEAF_TEMPLATES):
            if len(left) < 2 or sum(len(forms[f]) for f in left) < line_dedup.LEAF_TEXTS:
                break
            common = []
            for at in range(len(left[0])):
                votes = collections.Counter()
                for form in left:
                    votes[form[at]] += len(forms[form])
                common.append(max(votes.items(), key=lambda x: (x[1], x[0].encode()))[0])
            mine = [f for f in left if sum(a == b for a, b in zip(f, common)) >= len(f) * line_dedup.AGREE]
            if len(set().union(*(forms[f] for f in mine))) >= line_dedup.LEAF_TEXTS:
                gone.update(mine)
            left = [f for f in left if f not in mine]
    return {t: "\n".join(x for x in t.split("\n") if tuple(masked(x).split(" ")) not in gone) for t in texts}


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{c}" for c in "abcdefghijklmnop"]
    rows = []
    for i in range(200):
        lines = [" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.4:
            lines.insert(rng.randint(0, len(lines)), f"copyright {1990 + i} by the authors of this page")
        for start in ("sent from the phone of", "sent from the phone of"):
            if rng.random() < 0.15:
                lines.append(f"{start} {rng.choice(words)} {rng.choice(['with best and warm regards to all', 'please excuse the typing errors below here'])} x{i}")
        if rng.random() < 0.3:
            lines.append(f"posted by the user {rng.choice(words)} on this long winded page here today")
        if rng.random() < 0.3:
            lines += ["", "  ", "short one"]
        rows.append("\n".join(lines))
    rows += ["one two three four five six copied only\nas a whole"] * 30 + ["", "\n\n", "x" * 50000]
    return rows


def test_rows_of_figures_stay(spark):
    texts = ["Totals\n12 34\n5 6", "Totals\n99 1\n7 8\n<*>", "other\n3 4\npage 1 of 2", "last\n3,5 4.5\npage 2 of 2\n<*> 1"]
    got = {r.doc_id: r.text for r in line_dedup.clean(frame(spark, texts)).collect()}
    assert got == {0: "12 34\n5 6", 1: "99 1\n7 8\n<*>", 2: "other\n3 4", 3: "last\n3,5 4.5\n<*> 1"}


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in enumerate(texts)], DOCS)


def test_by_brute_force(spark):
    texts = corpus()
    want = brute(texts)
    got = line_dedup.clean(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        before = texts[r.doc_id]
        assert r.text == want[before] and r.n_lines == len(before.split("\n")) and (r.line, r.place, r.leaf) == ("a", "b", "c")
        assert r.n_dropped == len(before.split("\n")) - (len(r.text.split("\n")) if r.n_dropped < r.n_lines else 0)
    assert sum(r.n_dropped for r in got) > 50


def test_variable_words_are_generalised(spark):
    texts = [f"posted by the user {w} on this long page\nown text {w}" for w in ("anna", "bob", "carl", "dora", "emil", "fritz")]
    assert {r.text for r in line_dedup.clean(frame(spark, texts)).collect()} == {f"own text {w}" for w in ("anna", "bob", "carl", "dora", "emil", "fritz")}


@pytest.mark.parametrize("texts", [[], [None, "", " "], ["a line that stands in copies of one text only"] * 20])
def test_nothing_to_drop(spark, texts):
    got = line_dedup.clean(frame(spark, texts)).collect()
    assert sorted(map(str, (r.text for r in got))) == sorted(map(str, texts)) and all(r.n_dropped == 0 for r in got)


def test_two_templates_of_one_leaf(spark):
    names = ["anna", "bob", "carl", "dora", "emil"]
    one = [f"sent from my phone with warm regards and love {w}\nown {w}{w}" for w in names]
    two = [f"sent from my phone please excuse all typing errors {w}\nown {w}{w}{w}" for w in names]
    assert {r.text for r in line_dedup.clean(frame(spark, one + two)).collect()} == {f"own {w * n}" for w in names for n in (2, 3)}


def test_short_lines_and_passages_of_two_texts(spark):
    passage = " ".join(f"p{c}" for c in "abcdefghijklmnopqrstuvwxyz" * 3)
    texts = [f"Menu\nalpha only\n{passage}", f"beta only\nMenu\n{passage}", "gamma only"]
    assert {r.text for r in line_dedup.clean(frame(spark, texts)).collect()} == {"alpha only", "beta only", "gamma only"}


def test_many_lines_and_clashing_names(spark):
    shared = [f"shared line {chr(97 + i % 26)}{'x' * (i // 26 % 40)}{'y' * (i // 1040)}" for i in range(40_000)]
    texts = ["\n".join(x for pair in zip(shared, (f"own {who} {'z' * (i % 50)}{'v' * (i // 50)}" for i in range(40_000))) for x in pair) for who in ("one", "two")]
    df = frame(spark, texts).selectExpr("*", "'a' AS n_lines", "'b' AS _line_dedup_places", "'c' AS form", "'d' AS n_dropped")
    out = line_dedup.clean(df)
    assert out.columns == [*df.columns, "n_lines_", "n_dropped_"]
    for r in out.collect():
        assert (r.n_lines, r.n_dropped, r.n_lines_, r.n_dropped_) == ("a", "d", 80_000, 40_000) and "shared" not in r.text and r.text.count("own") == 40_000


@pytest.mark.parametrize("task_forms", [2048, 1])
def test_a_leaf_has_as_many_templates_as_recur(spark, monkeypatch, task_forms):
    """Seven kinds of lines with the same beginning: all go, not those of three templates alone."""
    monkeypatch.setattr(line_dedup, "TASK_FORMS", task_forms)
    kinds = ["abcdefgh"[i] for i in range(7)]
    body = lambda k: " ".join(f"{k}{c}" for c in "pqrstuvwxyzpqrstuvwxyz")
    texts = [f"the same four words {body(k)} {'mnoqrs'[i]}end\nkept {k} {'mnoqrs'[i]}" for k in kinds for i in range(6)]
    got = [r.text for r in line_dedup.clean(frame(spark, texts)).collect()]
    assert sorted(got) == sorted(f"kept {k} {'mnoqrs'[i]}" for k in kinds for i in range(6))


@pytest.mark.parametrize("most_words", [1 << 20, 64])
def test_lines_of_leaves_that_recur_nowhere_are_left_out_before_the_shuffle(spark, most_words):
    rows = spark.range(20_000).selectExpr("xxhash64(id) AS leaf", "id AS place")
    leaves = rows.where("place % 40 = 0").select("leaf")
    left = line_dedup.likely(rows, leaves, most_words)
    assert left.columns == rows.columns
    assert left.where("place % 40 = 0").count() == 500  # none is lost, however small the filter
    assert left.count() < (2_500 if most_words > 64 else 5_000)
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert "Broadcast" in plan or "strategy=broadcast" in plan
    assert line_dedup.likely(rows, leaves.where("false")).count() == 0
