"""Text expressions: tokens, entities, keywords, token counts, digests, question features. All JVM-side."""

from __future__ import annotations

import calendar

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no keywords, in alphabetical order.
STOP_WORDS = tuple(
    "a about after an and are as at be been before being but by can could did do does during else find for from give had has have how if in into "
    "is it its list may might not of on or shall should show tell that the then these this those through to was were what when where which "
    "who whom whose why will with would".split()
)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of at most 40 bytes."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & (F.octet_length(t) <= 40))


def word_set(text: Column) -> Column:
    """Distinct white-space words without signs, lower-case, of more than one byte."""
    words = F.transform(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]", "")))
    return F.array_distinct(F.filter(words, lambda w: F.octet_length(w) > 1))


def jaccard(a: Column, b: Column) -> Column:
    """Of two distinct arrays; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def entities(text: Column) -> Column:
    """Distinct lower-cased words of more than two letters or digits that begin with a capital."""
    words = F.transform(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
    return F.array_distinct(F.transform(F.filter(words, lambda w: (F.length(w) > 2) & w.rlike(r"^\p{Lu}")), lambda w: F.lower(w)))


def _bare_words(text: Column) -> Column:
    """White-space words with letters and digits only, in order; some may be empty."""
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))


def keywords(text: Column) -> Column:
    """Lower-case words of more than one byte that aren't stop words, in order, repeats included."""
    return F.filter(F.transform(_bare_words(text), lambda w: F.lower(w)), lambda w: (F.octet_length(w) > 1) & ~w.isin(*STOP_WORDS))


def digest(text: Column, length: int = 280) -> Column:
    return F.substring(text, 1, length)


def trim_chunk(text: Column, limit: int = 2000) -> Column:
    """At most ``limit`` characters: up to the last full stop past the half, else the last space, else a hard cut."""
    head = F.substring(text, 1, limit)
    stop = F.when(F.instr(F.reverse(head), ".") > 0, F.length(head) - F.instr(F.reverse(head), ".") + 1).otherwise(0)
    space = F.when(F.instr(F.reverse(head), " ") > 0, F.length(head) - F.instr(F.reverse(head), " ")).otherwise(0)
    cut = F.when(stop > limit // 2, F.substring(head, F.lit(1), stop)).when(space > 0, F.substring(head, F.lit(1), space)).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def contextualize(content: Column, metadata: Column, keywords: Column) -> Column:
    """``key: value. `` by key, ``Keywords: a, b. ``, a line break and the content; alone if there is nothing to add."""
    meta = F.array_join(F.transform(F.array_sort(F.map_entries(metadata)), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit(". "))), "")
    words = F.when(F.size(keywords) > 0, F.concat(F.lit("Keywords: "), F.array_join(keywords, ", "), F.lit(". "))).otherwise("")
    prefix = F.concat(F.coalesce(meta, F.lit("")), F.coalesce(words, F.lit("")))
    return F.when(prefix == "", content).otherwise(F.concat(prefix, F.lit("\n"), content))


def stable_id(*parts: Column) -> Column:
    """A UUID-shaped id that depends on the parts alone."""
    h = F.md5(F.concat_ws("\u0001", *parts).cast("binary"))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in cut])


_QUARTERS = tuple(f"q{k}" for k in (1, 2, 3, 4))
_SERIES = tuple(f"series {x}" for x in "abc")
#: Ordered rules: the first that fits names the intent. A phrase that starts with ``^`` must open the question.
INTENT_RULES = (
    ("comparison", ("compare", "difference", "versus", " vs ")),
    ("temporal", ("after", "before", "during", "since", "until", "between")),
    ("summary", ("summarize", "tldr", "brief", "short")),
    ("analytical", ("how many", "how much", "number of", "count of", "count the", "total number", "average", " avg ", "sum of", "most common", "least common", "percentage of", "what fraction", "group by")),
    ("explanation", ("why", "how does", "explain")),
    ("listing", ("^list", "show me", "find all", "all ", "every ")),
    ("code_search", ("code", "function", "implement", "source", "bug", "error")),
    ("entity_search", ("company", "companies", "startup", "funding", "raised", "founder", "investor", "invested", "enterprise", "customer")),
    ("factoid", ("^who", "^what", "^where", "^when")),
)
#: The temporal rule fits only if one of these occurs as well.
TEMPORAL_SIGNS = ("january", "february", "march", "202", *_QUARTERS, *_SERIES)
DATE_WORDS = (*(str(y) for y in range(2020, 2027)), *(m.lower() for m in calendar.month_name[1:]), *_QUARTERS, *_SERIES)
COMPARISON_SIGNS = ("compare", "versus", " vs ", "difference")
CODE_SIGNS = ("code", "function", "implement", "source")


def _holds(q: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | (q.startswith(p[1:]) if p[0] == "^" else q.contains(p))
    return out


def _lower(question: Column) -> Column:
    return F.lower(F.trim(F.coalesce(question, F.lit(""))))


def intent(question: Column) -> Column:
    """The first rule that fits; else ``general``."""
    q, out = _lower(question), None
    for name, phrases in INTENT_RULES:
        fits = _holds(q, phrases) & (_holds(q, TEMPORAL_SIGNS) if name == "temporal" else F.lit(True))
        out = F.when(fits, F.lit(name)) if out is None else out.when(fits, F.lit(name))
    return out.otherwise(F.lit("general"))


def dates(question: Column) -> Column:
    """The date words that occur, in the order of the list."""
    q = _lower(question)
    return F.filter(F.array(*[F.when(q.contains(d), F.lit(d)) for d in DATE_WORDS]), lambda x: x.isNotNull())


def is_comparison(question: Column) -> Column:
    return _holds(_lower(question), COMPARISON_SIGNS)


def is_code(question: Column) -> Column:
    return _holds(_lower(question), CODE_SIGNS)


def named_entities(question: Column) -> Column:
    """Words but the first that, without signs, begin with a capital and have more than one byte."""
    words = F.transform(_bare_words(question), lambda w, i: F.when((i > 0) & (F.octet_length(w) > 1) & w.rlike(r"^\p{Lu}"), w))
    return F.filter(words, lambda w: w.isNotNull())


def intent_confidence(question: Column) -> Column:
    """0.5, plus 0.2 for a recognised intent and 0.1 each for entities, dates and more than two keywords; at most 1."""
    bonus = lambda c: F.when(c, 0.1).otherwise(0.0)
    score = 0.5 + F.when(intent(question) != "general", 0.2).otherwise(0.0) + bonus(F.size(named_entities(question)) > 0) + bonus(F.size(dates(question)) > 0) + bonus(F.size(keywords(question)) > 2)
    return F.least(F.lit(1.0), score)


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes, as a signed long; null of null."""
    data = F.hex(F.encode(text, "UTF-8"))
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.substring(data, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))
    prime, offset = 0x100000001B3, 0xCBF29CE484222325 - (1 << 64)

    def times_prime(h: Column) -> Column:
        """The low 64 bits of ``h * prime`` = ``(h << 40) + h * 0x1B3``, in halves, so that nothing overflows."""
        low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)
        a = low * (prime & 0xFFFFFFFF)
        upper = (high * (prime & 0xFFFFFFFF) + low * (prime >> 32) + F.shiftrightunsigned(a, 32)).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.shiftleft(upper, 32).bitwiseOR(a.bitwiseAND(F.lit(0xFFFFFFFF)))

    empty = F.lit(offset).cast("long")
    return F.when(text.isNotNull(), F.when(F.octet_length(text) == 0, empty).otherwise(F.aggregate(codes, empty, lambda h, c: times_prime(h.bitwiseXOR(c)))))
