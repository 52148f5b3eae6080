"""Column builders over text: normal forms, identity keys, tokens, sentences, small parsers.

Everything here is a built-in expression (whole-stage code, no Python on executors).  Class
shorthands of regular expressions are spelt out where engines differ: ``WS`` holds all white
space, and letters and digits are ``\\p{L}`` and ``\\p{N}``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomeloom.functions.words import INVARIANT

WS = "[ \\t\\n\\x0B\\f\\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
TOKEN = "\\p{N}[\\p{L}\\p{N}]*|\\p{L}[\\p{L}\\p{N}]*(?:['’-][\\p{L}\\p{N}]+)*"
CLAUSE_END = '[,;:()\\[\\]{}<>"“”«»|/\\\\]+'
SENTENCE_GAP = "([.!?…][\")\\]»”’]*)" + WS + "+([\\p{Lu}\\p{Nd}«\"“(\\[])"
#: A citation marker once separators are doubled: a year (a letter may follow), doi, arxiv, www, an address.
CITE_MARK = "(?i)(?:^|[^0-9A-Za-z_])(?:(?:19|20)[0-9][0-9][a-z]?|doi|arxiv|www)(?:$|[^0-9A-Za-z_])|https?::"


def flat(c: Column) -> Column:
    """White space collapsed to single spaces, trimmed."""
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def composed(c: Column) -> Column:
    """Compatibility composition (NFKC), by the library that Spark's own collations use; ASCII text
    is looked at and left alone.

    Spark takes the call for one that may vary, so what is joined or grouped on it has to be a
    column first.
    """
    made = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(c, F.lit("")), F.lit(True))
    return F.when(c.rlike("[^\\x00-\\x7F]"), made).otherwise(c)


def norm_id(c: Column) -> Column:
    """Compatibility composition, lower case, ё as е, runs of anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.translate(F.lower(composed(c)), "ё", "е"), "[^\\p{L}\\p{N}]+", " "))


def _cut(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _folds(w: Column) -> Column:
    """Whether plural folding looks at the word at all."""
    return (F.length(w) > 3) & w.endswith("s") & ~w.rlike("(?:ss|us|is|os)$") & ~w.isin(*INVARIANT) & ~w.rlike("\\p{IsCyrillic}")


def fold_token(w: Column) -> Column:
    """English plural to singular by spelling; Cyrillic, short and invariant words stay.

    Two letters of a sibilant plural come off only if the rest would itself stay.
    """
    two = _cut(w, 2)
    return (
        F.when(~_folds(w), w)
        .when(w.rlike("[^aeiou]ies$") & (F.length(w) >= 5), F.concat(_cut(w, 3), F.lit("y")))
        .when(w.rlike("(?:sh|ch|x|z|s)es$"), F.when(~_folds(two), two).otherwise(_cut(w, 1)))
        .otherwise(_cut(w, 1))
    )


def fold_head(normed: Column) -> Column:
    """concept_id of what norm_id gave: lone s dropped (unless alone), last word folded."""
    words = F.split(normed, " ")
    kept = F.when(F.size(words) == 1, words).otherwise(F.filter(words, lambda w: w != "s"))
    words = F.when(F.size(kept) > 0, kept).otherwise(words)
    n = F.size(words)
    return F.array_join(F.transform(words, lambda w, i: F.when(i == n - 1, fold_token(w)).otherwise(w)), " ")


def concept_id(c: Column) -> Column:
    return fold_head(norm_id(c))


def term_key(c: Column) -> Column:
    """norm_id, or the flattened lower-case text where that leaves nothing."""
    return F.coalesce(F.nullif(norm_id(flat(c)), F.lit("")), F.lower(flat(c)))


def carry_key(c: Column) -> Column:
    return F.lower(flat(c))


def out_norm(c: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one space (no composition)."""
    return F.trim(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", " "))


def bigrams(c: Column) -> Column:
    n = F.length(c)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.substring(c, i, F.lit(2))))


def dice(a: Column, b: Column) -> Column:
    """Sørensen-Dice over character bigrams as multisets; 1 for equal texts, 0 for empty or short ones."""
    left, right = bigrams(a), bigrams(b)
    shared = F.aggregate(
        F.array_distinct(left),
        F.lit(0),
        lambda s, g: s + F.least(F.size(F.filter(left, lambda x: x == g)), F.size(F.filter(right, lambda x: x == g))),
    )
    plain = 2.0 * shared / (F.length(a) + F.length(b) - 2)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when((F.length(a) < 2) | (F.length(b) < 2), 0.0).otherwise(plain)


def djb2(c: Column, start: int = 5381) -> Column:
    """h * 33 + c over code points, 32 bits."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    return F.aggregate(codes, F.lit(start).cast("long"), lambda h, x: (h * 33 + x).bitwiseAND(F.lit(0xFFFFFFFF)))


def content_key(data: Column) -> Column:
    """djb2 of the first 64 KiB in hex, a hyphen, the length in bytes in hex."""
    head = F.hex(F.substring(data, 1, 65536))
    codes = F.transform(F.regexp_extract_all(head, F.lit(".."), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("long"))
    h = F.aggregate(codes, F.lit(5381).cast("long"), lambda a, x: (a * 33 + x).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.lower(F.concat(F.hex(h), F.lit("-"), F.hex(F.octet_length(data).cast("long"))))


def page_signature(c: Column, stride: int = 32) -> Column:
    """Rolling hash over every stride-th character: cheap change detection of a page."""
    at = F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)), F.lit(stride))
    return F.aggregate(at, F.length(c).cast("long"), lambda h, i: (h * 31 + F.ascii(F.substring(c, i, F.lit(1)))).bitwiseAND(F.lit(0xFFFFFFFF)))


def tokens(c: Column) -> Column:
    """Words that begin with a letter, inner apostrophes and hyphens kept; never a digit's tail."""
    return F.regexp_extract_all(c, F.lit("(?<![\\p{L}\\p{N}])" + TOKEN.partition("|")[2]), F.lit(0))


def mine_key(c: Column) -> Column:
    return F.lower(F.array_join(tokens(c), " "))


def sentences(c: Column) -> Column:
    """Array of trimmed sentences: split where an end mark, white space and an opener meet."""
    parts = F.split(F.regexp_replace(c, SENTENCE_GAP, "$1\u0001$2"), "\u0001")
    trimmed = F.transform(parts, lambda s: F.regexp_replace(s, f"^{WS}+|{WS}+$", ""))
    return F.filter(trimmed, lambda s: s != "")


def clauses(sentence: Column) -> Column:
    """Array of token arrays, one for each clause that has tokens."""
    return F.filter(F.transform(F.split(sentence, CLAUSE_END), tokens), lambda t: F.size(t) > 0)


def is_capital(w: Column) -> Column:
    return w.rlike("^[\\p{Lu}\\p{Lt}]")


def is_prose(c: Column) -> Column:
    """At least 40 characters, fewer than 8 % of them digits."""
    return (F.length(c) >= 40) & (F.regexp_count(c, F.lit("[0-9]")) < F.length(c) * 0.08)


def clamp_sample(raw: Column, key: Column, window: int = 300) -> Column:
    """The sentence, or 300 characters around the term's first word with ellipses."""
    s = flat(raw)
    first = F.substring_index(key, " ", 1)
    at = F.greatest(F.lit(0), F.instr(F.lower(s), first) - 1)
    start, end = F.greatest(F.lit(0), at - 100), F.least(F.length(s), at + 200)
    middle = F.trim(F.substring(s, start + 1, end - start))
    cut = F.concat(F.when(start > 0, "…").otherwise(""), middle, F.when(end < F.length(s), "…").otherwise(""))
    return F.when(F.length(s) <= window, s).otherwise(cut)


def primary_subtag(c: Column) -> Column:
    first = F.split(F.lower(F.trim(c)), "[-_]")[0]
    return F.when(first.rlike("^[a-z]{2,3}$"), first).otherwise("")


def needs_translation(book: Column, target: Column) -> Column:
    to = primary_subtag(target)
    return (to != "") & (to != "und") & (F.coalesce(primary_subtag(book), F.lit("")) != to)


SCRIPTS = ("Latin", "Cyrillic", "Greek", "Han", "Hiragana", "Katakana", "Hangul", "Arabic", "Hebrew", "Devanagari")


def script_count(c: Column, script: str) -> Column:
    """Characters of a script."""
    return F.length(c) - F.length(F.regexp_replace(c, f"\\p{{Is{script}}}", ""))


def cite_marks(c: Column) -> Column:
    """How many citation markers the text has.

    Word boundaries are spelt out; a separator may bound two markers, so each is doubled.
    """
    return F.regexp_count(F.regexp_replace(c, "([^0-9A-Za-z_])", "$1$1"), F.lit(CITE_MARK))


def sample_floor(sampled: Column, total: Column) -> Column:
    """The count asked of a term when only part of a book was read: 5 at the rate read, from 2 to 5."""
    return F.least(F.lit(5), F.greatest(F.lit(2), F.round(5.0 * F.least(sampled, total) / F.greatest(F.lit(1), total)).cast("int")))


def spread_pages(total: Column, take: Column) -> Column:
    """Array of up to ``take`` page numbers spread evenly over 1..total."""
    n = F.least(take, total)
    return F.when(n < 1, F.array().cast("array<int>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (F.floor(i * total / n) + 1).cast("int")))
    )


def loose_number(c: Column) -> Column:
    """"12,5 %" as 12.5; null where no number is left."""
    cleaned = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, WS, ""), "^([^,]*),", "$1."), "[^0-9.eE+-]", "")
    return F.nullif(cleaned, F.lit("")).try_cast("double")


def flat_numbers(c: Column) -> Column:
    """Digit groups joined: "12 345" and "12,345" as 12345."""
    out = F.regexp_replace(c, "[\u00a0\u202f\u2009]", " ")
    for _ in range(4):
        out = F.regexp_replace(out, "([0-9])[ ,]+([0-9]{3})([^0-9]|$)", "$1$2$3")
    return out


def looks_stale(text: Column, tr: Column, page_count: Column) -> Column:
    """A heading's translation that ends or begins on a page number its text does not have."""
    source, result = flat(text), flat_numbers(flat(tr))
    numbers = F.regexp_extract_all(flat_numbers(source), F.lit("[0-9]+"), F.lit(0))
    tail = F.regexp_extract(result, "(?:^|[ (\\[«\"])([0-9]{1,4}) *[.)\\]»\"]?$", 1)
    head = F.regexp_extract(result, "^[(\\[«\"]?([0-9]{1,4})[ .)\\]]", 1)

    def dangling(d: Column) -> Column:
        n = F.nullif(d, F.lit("")).cast("int")
        return F.coalesce((d != "") & ~F.array_contains(numbers, d) & (n >= 1) & (n <= F.greatest(page_count, F.lit(1))), F.lit(False))

    return (result != "") & (F.length(source) <= 200) & (dangling(tail) | dangling(head))


def furniture_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[0-9]+", "#")


def roman_value(c: Column) -> Column:
    """Value of a Roman numeral, smaller letters before larger ones subtracted."""
    value = F.create_map(*[F.lit(x) for k, v in {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}.items() for x in (k, v)])
    values = F.transform(F.filter(F.split(F.lower(c), ""), lambda x: x != ""), lambda x: F.coalesce(F.try_element_at(value, x), F.lit(0)))
    nexts = F.concat(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.array(F.lit(0)))
    return F.aggregate(F.zip_with(values, nexts, lambda a, b: F.when(a < b, -a).otherwise(a)), F.lit(0), lambda s, x: s + x)


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), "^www\\.", "")


def html_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def plural_form(n: Column, lang: str) -> Column:
    """Index of the plural form: three for Slavic languages, two otherwise, none for some."""
    ones, tens = F.pmod(n, F.lit(10)), F.pmod(n, F.lit(100))
    if lang in ("ru", "uk"):
        return F.when((ones == 1) & (tens != 11), 0).when((ones >= 2) & (ones <= 4) & ~tens.between(12, 14), 1).otherwise(2)
    if lang in ("zh", "ja", "ko"):
        return F.lit(0)
    return F.when((n <= 1) if lang == "fr" else (n == 1), 0).otherwise(1)


def find_pattern(query: str) -> str:
    """A literal query as a pattern: case-blind, white space matching any gap or none."""
    import re

    return "(?i)" + f"{WS}*".join(re.escape(w) for w in query.split())


def any_of(c: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


#: What a word may begin after.
WORD_START = "[ \\t\\n\\x0B\\f\\r\u00a0–—_.():,/\\\\«»\"'-]"


def fuzzy_score(query: Column, target: Column) -> Column:
    """How well a query's letters fit a text: a substring far above scattered letters, word starts
    above middles, runs above gaps; null where the letters do not occur in order."""
    q, t = F.lower(query), F.lower(target)

    def starts(i: Column) -> Column:
        return (i == 1) | F.substring(t, i - 1, F.lit(1)).rlike(WORD_START)

    at = F.instr(t, q)
    whole = 100 - F.least(F.lit(50), at - 1) + F.when(starts(at), 30).otherwise(0)

    def step(held: Column, i: Column) -> Column:
        hit = (held["next"] <= F.length(q)) & (F.substring(t, i, F.lit(1)) == F.substring(q, held["next"], F.lit(1)))
        gain = 1 + 2 * held["run"] + F.when(starts(i), 8).otherwise(0)
        return F.when(hit, F.struct((held["next"] + 1).alias("next"), (held["run"] + 1).alias("run"), (held["score"] + gain).alias("score"))).otherwise(
            F.struct(held["next"].alias("next"), F.lit(0).alias("run"), held["score"].alias("score"))
        )

    walk = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), F.struct(F.lit(1).alias("next"), F.lit(0).alias("run"), F.lit(0).alias("score")), step)
    scattered = F.when(walk["next"] > F.length(q), walk["score"])
    return F.when(q == "", 0).when(at > 0, whole).otherwise(scattered).cast("double")
