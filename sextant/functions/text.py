"""Column functions on text: identifier-aware tokens, symbols, contexts, byte prefixes.

All are built-in expressions. Lengths are UTF-8 bytes, not characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"\p{IsWhite_Space}"
ALNUM = r"\p{IsAlphabetic}\p{N}"
#: Before an upper-case letter that follows a lower-case one, or precedes one.
CAMEL_CUT = r"(?<=\p{IsLowercase})(?=\p{IsUppercase})|(?<=.)(?=\p{IsUppercase}\p{IsLowercase})"

#: Words of one part: with lower-case letters and digits alone, with a capital first, and with ASCII signs among either.
ONE_TOKEN = r"^[\p{Ll}0-9]++\z"
CAPITAL = r"^[A-Z][a-z0-9]*+\z"
_SIGNED = r"[!-,/-@\[-^`-~]*+[.-]*+\z"  # ASCII without capitals and _, - and . at the end alone
WITH_SIGNS = rf"^[.-]*+{_SIGNED}"
CAPITAL_WITH_SIGNS = rf"^[A-Z]{_SIGNED}"

# A pattern for each kind of definition, with the groups that hold names.
SYMBOL_PATTERNS = (
    (r"(?:async\s+)?function\s+(\w+)|const\s+(\w+)\s*=\s*(?:async\s*)?\(", 2),
    (r"class\s+(\w+)", 1),
    (r"export\s+(?:async\s+)?(?:function|class)\s+(\w+)", 1),
    (r"fn\s+(\w+)", 1),
    (r"struct\s+(\w+)", 1),
    (r"impl\s+(\w+)", 1),
)
# A line that opens a named block, and names that are keywords instead.
CONTEXT_PATTERN = (
    r"(?:^|\s)(?:async\s+)?(?:function\s+(\w+)|class\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\("
    r"|(?:static\s+)?(?:async\s+)?(\w+)\s*\([^)]*\)\s*\{|fn\s+(\w+)|struct\s+(\w+)|impl\s+(\w+))"
)
CONTEXT_GROUPS = 7
CONTEXT_SKIP = ("if", "for", "while", "switch", "catch", "else")
#: The keyword before each group of SYMBOL_PATTERNS: a text without it has no such name.
SYMBOL_KEYWORDS = (("function", "const"), ("class",), ("export",), ("fn",), ("struct",), ("impl",))


def words(text: Column) -> Column:
    """Words between Unicode white space, empty ones left out."""
    return F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != F.lit(""))


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike(f"[^{SPACES}]"), F.lit(False))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACES}]+|(?<![{SPACES}])[{SPACES}]+$", "")


def _longer_than(items: Column, n_bytes: int) -> Column:
    return F.filter(items, lambda x: F.octet_length(x) > F.lit(n_bytes))


def split_camel(word: Column) -> Column:
    """The camel-case parts of more than one byte, in lower case."""
    return F.transform(_longer_than(F.split(word, CAMEL_CUT), 1), lambda p: F.lower(p))


def _if_longer(item: Column, n_bytes: int) -> Column:
    return F.when(F.octet_length(item) > n_bytes, F.array(item)).otherwise(F.array().cast("array<string>"))


def word_tokens(word: Column) -> Column:
    """Distinct tokens of one word: camel parts, parts at - _ . and the cleaned whole.

    Most words are one part alone, and only the others are split. A word of lower-case
    letters and digits is its token. One with signs about it has the cleaned token, and
    itself in lower case if it starts with a capital.
    """
    clean = lambda x, also="": F.lower(F.regexp_replace(x, f"[^{ALNUM}{also}]", ""))
    camel = F.when(word != F.lower(word), split_camel(word)).otherwise(F.array().cast("array<string>"))
    parts = F.transform(F.split(word, "[-_.]"), lambda p: clean(p))  # not clean itself, which would be given the place as well
    every = F.array_distinct(_longer_than(F.concat(camel, parts, F.array(clean(word, "_"))), 1))
    bare = F.lower(F.regexp_replace(word, "[^A-Za-z0-9]", ""))
    both = F.array_distinct(F.concat(_if_longer(F.lower(word), 1), _if_longer(bare, 1)))
    return (
        F.when(word.rlike(ONE_TOKEN), _if_longer(word, 1))
        .when(word.rlike(CAPITAL), _if_longer(F.lower(word), 1))
        .when(word.rlike(WITH_SIGNS), _if_longer(bare, 1))
        .when(word.rlike(CAPITAL_WITH_SIGNS), both)
        .otherwise(every)
    )


def tokens(text: Column) -> Column:
    """Distinct tokens of a text."""
    return F.array_distinct(F.flatten(F.transform(words(text), word_tokens)))


def symbols(text: Column) -> Column:
    """Distinct names that the text defines, in lower case."""
    none = F.array().cast("array<string>")
    named = lambda p, g, keyword: F.when(~F.contains(text, F.lit(keyword)), none).otherwise(F.regexp_extract_all(text, F.lit(f"(?U){p}"), F.lit(g)))
    found = [named(p, g, keywords[g - 1]) for (p, n), keywords in zip(SYMBOL_PATTERNS, SYMBOL_KEYWORDS) for g in range(1, n + 1)]
    return F.array_distinct(F.transform(F.filter(F.flatten(F.array(*found)), lambda s: s != F.lit("")), lambda s: F.lower(s)))


def enclosing_context(content: Column, line_start: Column) -> Column:
    """The name of the block around a chunk's start: its line or the nearest above; null if none.

    The start is looked up inside the chunk's own lines, as the score report does.
    For the chunk's first line pass 1.
    """
    lines = F.split(content, "\n")
    last = F.least(F.greatest(line_start - F.lit(1), F.lit(0)), F.size(lines) - F.lit(1)).cast("int")

    def name(line: Column) -> Column:
        groups = [F.nullif(F.regexp_extract(line, f"(?U){CONTEXT_PATTERN}", g), F.lit("")) for g in range(1, CONTEXT_GROUPS + 1)]
        return F.coalesce(*groups)

    up = F.transform(F.reverse(F.slice(lines, F.lit(1), last + F.lit(1))), name)
    return F.try_element_at(F.filter(up, lambda n: n.isNotNull() & ~n.isin(*CONTEXT_SKIP)), F.lit(1))


def looks_like_identifier(query: Column) -> Column:
    """One word with a separator or with letters of both cases. A tab is no space here."""
    q = trimmed(query)
    mixed = q.rlike(r"\p{IsUppercase}") & q.rlike(r"\p{IsLowercase}")
    return (q != F.lit("")) & ~q.contains(" ") & (q.rlike("[-_.]") | mixed)


def utf8_prefix(text: Column, n_bytes: int) -> Column:
    """The longest prefix of whole characters that has at most n_bytes bytes."""
    raw = F.encode(text, "UTF-8")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, n_bytes - i).cast("string")) for i in range(min(4, n_bytes))]
    return F.when(F.octet_length(text) <= n_bytes, text).otherwise(F.coalesce(*cuts, F.lit("")))


def ellipsis(text: Column, n_chars: int) -> Column:
    return F.when(F.char_length(text) > n_chars, F.concat(F.substring(text, 1, n_chars), F.lit("…"))).otherwise(text)


def confidence_band(percent: Column) -> Column:
    """strong, good, weak or marginal, by a score's share of the best in percent."""
    return F.when(percent >= 80, "strong").when(percent >= 50, "good").when(percent >= 25, "weak").otherwise("marginal")
