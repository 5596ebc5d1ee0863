"""Line deduplication by a log-template tree of fixed depth.

Every line is masked (a token with a digit becomes a variable field) and walks
down the tree: first by its number of tokens, then by its leading tokens. A masked
form that lines of at least MIN_TEXTS different texts have is a template of its
own. In a leaf of several forms of at least LEAF_TEXTS different texts, further
fields are generalised: the commonest token of each place makes a template, and
the forms that agree with it in enough places belong to it; from those left over
comes the leaf's next template, until they are too few or none agrees. Lines of templates that recur
(generalised ones in LEAF_TEXTS different texts) are dropped from all documents,
the first time too; the rest of each text stays as it was.

A line of variable fields alone, such as a row of figures, says nothing that could
recur: it has no template and stays.

Equal documents count as one text, so copies alone do not make their lines recur.
Blank lines stay. Null text gives null, empty text stays empty. Lines end at a line
feed. Only leaves with enough texts go on from the counting pass, and lines of other leaves are left
out by a filter of bits before they shuffle. Counts are partly aggregated before, and where lines meet the fate of their form, a form
that many of them have is split over tasks. Other columns pass through; where one
has the name of a new column, the new one gets underscores behind it. An empty
table gives none.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import fresh, joined, stored

#: Leading tokens that lead to a leaf.
DEPTH = 4
#: Different texts that a form must recur in to be dropped, and a generalised template.
MIN_TEXTS = 2
LEAF_TEXTS = 5
#: Generalised templates of every leaf that are made by passes over all leaves.
LEAF_TEMPLATES = 3
#: Forms of a leaf up to which one task makes all its further templates.
TASK_FORMS = 2048
#: Bits of a leaf in the filter of lines, and the most words of 64 bits that it has.
FILTER_BITS = 16
FILTER_WORDS = 1 << 20
#: Share of places in which a line must agree with its leaf's template.
AGREE = 0.8
FIELD = "<*>"


def forms_of(text: Column) -> Column:
    """Each line of a text as struct(form, n_tokens): variable fields masked, one space between tokens.

    Step by step over the array, so that nothing is worked out twice. Most lines have
    neither a digit nor odd white space; a plain search tells them from the others.
    """
    # anchored at a token's start, so that a long token without digits is read once
    fields = lambda x: F.regexp_replace(x, r"(?<!\S)[^\s\d]*+\d\S*+", FIELD)
    step = F.transform(F.split(text, "\n"), lambda x: F.when(x.rlike("[0-9]"), fields(x)).otherwise(x))

    def odd(x: Column) -> Column:
        found = x.startswith(" ") | x.endswith(" ")
        for part in ("  ", "\t", "\v", "\f", "\r"):
            found = found | x.contains(part)
        return found

    step = F.transform(step, lambda x: F.when(odd(x), F.trim(F.regexp_replace(x, r"\s+", " "))).otherwise(x))
    tokens = lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit(""))) + F.lit(1)
    return F.transform(step, lambda x: F.struct(x.alias("form"), tokens(x).alias("n_tokens")))


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def lines(docs: DataFrame) -> DataFrame:
    """(text_key, place, form, n_tokens, leaf) of all lines with a token that is not a variable field."""
    # key and forms first, so that neither is worked out again for each line
    texts = docs.where("text IS NOT NULL").select(text_key(F.col("text")).alias("text_key"), forms_of(F.col("text")).alias("forms"))
    each = texts.select("text_key", F.posexplode("forms").alias("place", "f"))
    constant = F.trim(F.replace("f.form", F.lit(FIELD), F.lit(""))) != ""
    visible = each.where(constant).select("text_key", "place", "f.form", "f.n_tokens")
    leading = F.substring_index("form", " ", DEPTH)
    return visible.withColumn("leaf", F.xxhash64("n_tokens", leading))


def _counted(rows: DataFrame, *key: str) -> DataFrame:
    """Different texts and lines of each key."""
    by_text = rows.groupBy(*key, "text_key").agg(F.count(F.lit(1)).alias("n"))
    return by_text.groupBy(*key).agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n_lines"))


def likely(rows: DataFrame, leaves: DataFrame, most_words: int = FILTER_WORDS) -> DataFrame:
    """``rows`` without most of those whose leaf is not among ``leaves``, a stored table; none of the others is lost.

    The bits of ``leaves`` are sent to all tasks, in words of 64, some FILTER_BITS for
    each leaf and ``most_words`` words at most. So the many lines that recur nowhere are
    left out before any shuffle; an exact join by leaf must follow.
    """
    words = 1 << min(leaves.count() * FILTER_BITS // 64, most_words - 1).bit_length()
    word = F.pmod(F.shiftright("leaf", 6), F.lit(words)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("leaf").bitwiseAND(F.lit(63)).cast("int"))
    bits = leaves.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    met = rows.withColumn("_word", word).join(F.broadcast(bits), "_word")
    return met.where(F.col("_bits").bitwiseAND(bit) != 0).select(*rows.columns)


def _further(first: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """All templates of what is left of one leaf, numbered from ``first`` on, by the rule of a pass."""

    def further(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left = [(k, int(n), list(tokens)) for k, n, tokens in zip(rows["form_key"], rows["texts"], rows["tokens"])]
        forms, templates, number = [], [], first
        while len(left) > 1 and sum(n for _, n, _ in left) >= LEAF_TEXTS:
            votes = [Counter() for _ in range(max(len(tokens) for *_, tokens in left))]
            for _, n, tokens in left:
                for at, token in enumerate(tokens):
                    votes[at][token] += n
            common = [max(v.items(), key=lambda x: (x[1], x[0].encode()))[0] for v in votes]
            agree = [sum(map(str.__eq__, tokens, common)) >= len(common) * AGREE for *_, tokens in left]
            if not any(agree):
                break
            mine = [k for (k, *_), a in zip(left, agree) if a]
            forms += mine
            templates += [number] * len(mine)
            left = [x for x, a in zip(left, agree) if not a]
            number += 1
        # the leaf's number and the template's make one
        mixed = [((int(key[0]) * 0x9E3779B97F4A7C15 + t * 0xBF58476D1CE4E5B9 + (1 << 63)) % (1 << 64)) - (1 << 63) for t in templates]
        return pd.DataFrame({"form_key": pd.Series(forms, dtype=object), "template": pd.Series(mixed, dtype="int64")})

    return further


def leaf_templates(forms: DataFrame) -> DataFrame:
    """(form_key, template) of the forms that belong to a template of their leaf with other forms.

    ``forms`` has leaf, form_key, form and texts. Each pass makes a template of
    every leaf that has forms of enough texts left. After LEAF_TEMPLATES of them, what is
    left of a leaf is finished in one task if it has TASK_FORMS forms at most; larger
    leaves take further passes until they are as small, or done.
    """
    found = None
    left = forms.select("leaf", "form_key", "texts", F.split("form", " ").alias("tokens"))
    for i in itertools.count():
        wide = left.groupBy("leaf").agg(F.count(F.lit(1)).alias("forms"), F.sum("texts").alias("all")).where((F.col("forms") > 1) & (F.col("all") >= LEAF_TEXTS))
        wide = stored(wide.select("leaf", "forms"), "line-wide-leaves")
        if i >= LEAF_TEMPLATES:
            few = left.join(wide.where(F.col("forms") <= TASK_FORMS), "leaf", "left_semi")
            found = found.unionByName(stored(few.groupBy("leaf").applyInPandas(_further(i), "form_key binary, template long"), "line-further"))
            wide = stored(wide.where(F.col("forms") > TASK_FORMS), "line-large-leaves")
            if wide.isEmpty():
                return found
        left = stored(joined(left, wide, "leaf", "forms"), "line-leaf-forms")
        places = left.select("leaf", "texts", F.posexplode("tokens").alias("at", "token"))
        votes = places.groupBy("leaf", "at", "token").agg(F.sum("texts").alias("votes"))
        best = votes.groupBy("leaf", "at").agg(F.max(F.struct("votes", "token"))["token"].alias("token"))
        common = best.groupBy("leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("common"))
        common = stored(common.join(wide, "leaf"), "line-common")
        same = F.filter(F.zip_with("tokens", "common", lambda a, b: a == b), lambda x: x)
        met = joined(left.drop("forms"), common, "leaf", "forms")
        placed = stored(met.withColumn("in", F.size(same) >= F.size("common") * F.lit(AGREE)), "line-agreeing")
        mine = placed.where("in").select("form_key", F.xxhash64("leaf", F.lit(i)).alias("template"))
        found = mine if found is None else found.unionByName(mine)
        # where none agreed, none would in the next pass
        moved = placed.where("in").select("leaf").distinct()
        left = placed.where("NOT in").select("leaf", "form_key", "texts", "tokens").join(moved, "leaf", "left_semi")


def recurring(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (text_key, place, form_key) that may be dropped, and the forms (form_key, n_lines) that are; both stored."""
    leaves = stored(_counted(lines(docs), "leaf").where(F.col("texts") >= MIN_TEXTS), "line-leaves")
    met = joined(likely(lines(docs), leaves), leaves.select("leaf", "n_lines"), "leaf", "n_lines").drop("n_lines")
    held = stored(met.withColumn("form_key", text_key(F.col("form"))), "line-forms")
    forms = stored(_counted(held, "leaf", "form_key", "form", "n_tokens"), "line-texts")
    general = stored(leaf_templates(forms.where(F.col("n_tokens") > DEPTH)), "line-general")
    # a text may have several forms of a template
    sized = general.join(forms.select("form_key", "n_lines"), "form_key")
    texts = joined(held.select("form_key", "text_key"), stored(sized, "line-sized"), "form_key", "n_lines").select("template", "text_key").distinct()
    often = texts.groupBy("template").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= LEAF_TEXTS)
    wide = general.join(often, "template", "left_semi").select("form_key", F.lit(True).alias("general"))
    gone = forms.join(wide, "form_key", "left").where((F.col("texts") >= MIN_TEXTS) | F.col("general"))
    return held.select("text_key", "place", "form_key"), stored(gone.select("form_key", "n_lines"), "line-gone")


def dropped(docs: DataFrame) -> DataFrame:
    """(text_key, places): the places of lines to drop of each text that has any, in order."""
    held, gone = recurring(docs)
    return joined(held, gone, "form_key", "n_lines").groupBy("text_key").agg(F.array_sort(F.collect_set("place")).alias("places"))


def without(all_lines: Column, places: Column) -> Column:
    """The lines whose number is not among the places, which are in order; linear in both."""
    # between two places lie lines that stay: a run of false for them, and true for the place
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.element_at(places, F.greatest(i, F.lit(1))))
    runs = F.transform(places, lambda p, i: F.concat(F.array_repeat(F.lit(False), p - before(i) - F.lit(1)), F.array(F.lit(True))))
    both = F.zip_with(all_lines, F.flatten(runs), lambda line, gone: F.struct(line.alias("line"), F.coalesce(gone, F.lit(False)).alias("gone")))
    return F.transform(F.filter(both, lambda x: ~x["gone"]), lambda x: x["line"])


def clean(docs: DataFrame, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` with the lines of recurring templates cut from ``text``, and two counts."""
    key, gone = fresh(docs, "_line_dedup_text"), fresh(docs, "_line_dedup_places")
    n_lines, n_dropped = fresh(docs, n_lines), fresh(docs, n_dropped)
    drops = dropped(docs).select(F.col("text_key").alias(key), F.col("places").alias(gone))
    out = docs.withColumn(key, text_key(F.col("text"))).join(drops, key, "left")
    all_lines = F.split("text", "\n")
    out = out.withColumn(n_lines, F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(all_lines)).cast("long"))
    out = out.withColumn(n_dropped, F.coalesce(F.size(gone), F.lit(0)).cast("long"))
    text = F.when(F.col(gone).isNotNull(), F.array_join(without(all_lines, F.col(gone)), "\n")).otherwise(F.col("text"))
    return out.withColumn("text", text).select(*docs.columns, n_lines, n_dropped)
