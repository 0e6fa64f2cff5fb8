"""Text expressions: normal forms, skeletons, fingerprints, similarity, cues, placeholders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Punctuation that normal forms drop, and cue words of the predicates.
PUNCTUATION = "，。！？、；："
AFFIRMATIVE = ("确认", "可以", "好的", "就这样", "确认预约")
BLANK = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
NEGATIVE_CUE = "不|别|取消"
AFFIRMATIVE_PREFIX = "^(可以|确认|好的|行|没问题|就订|订|就这样|好，)"
STRONG_TOKEN = "确认|没问题|就订|就他|就这个|就这样|可以，就"


def normalized(text: Column) -> Column:
    """Digits to N, without CJK punctuation and white space."""
    return F.regexp_replace(F.regexp_replace(text, r"\d", "N"), rf"[{PUNCTUATION}\s　]", "")


def skeleton(text: Column) -> Column:
    """Runs of CJK letters to X and of Latin letters to x, digits to N, punctuation and white space dropped."""
    return F.regexp_replace(normalized(F.regexp_replace(text, r"[A-Za-z]+", "x")), r"[\x{4e00}-\x{9fff}]+", "X")


def fingerprint(*cols: Column) -> Column:
    """SHA-256 over columns, nulls as a zero byte, so that neighbours can't run together."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols]), 256)


def bigrams(text: Column) -> Column:
    """Distinct character pairs; a text of one character is its own."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(2)))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; two empty ones are equal."""
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(any_ == 0, 1.0).otherwise(both / any_)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; two empty texts are equal."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def stripped(text: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    # most texts have none, and a search for it would read the whole text
    ends = F.left(text, F.lit(1)).rlike(BLANK) | F.right(text, F.lit(1)).rlike(BLANK)
    return F.when(ends, F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")).otherwise(text)


def is_affirmative(text: Column) -> Column:
    """The exact list, then negation cues, then prefixes, then strong tokens: the first that applies decides."""
    t = stripped(text)
    return F.when(t.isin(*AFFIRMATIVE), True).when(t.rlike(NEGATIVE_CUE), False).when(t.rlike(AFFIRMATIVE_PREFIX), True).when(t.rlike(STRONG_TOKEN), True).otherwise(False)


def labels(cues: dict[str, Column]) -> Column:
    """The names of the cues that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in cues.items()]))


def placeholders(text: Column) -> Column:
    """Tokens like <NAME_1>, in order."""
    return F.regexp_extract_all(text, F.lit(r"(<[A-Z]+_\d+>)"), F.lit(1))


def same_placeholders(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(placeholders(a)), F.array_distinct(placeholders(b))
    return (F.size(F.array_except(x, y)) == 0) & (F.size(F.array_except(y, x)) == 0)


def restored(text: Column, values: Column) -> Column:
    """``text`` with each token of the map put back; longer tokens first, so that <A_1> doesn't touch <A_12>."""
    pairs = F.array_sort(F.map_entries(values), lambda a, b: F.length(b["key"]) - F.length(a["key"]))
    return F.aggregate(pairs, text, lambda t, p: F.replace(t, p["key"], p["value"]))


def drawn(seed: int, key: Column) -> Column:
    """A reproducible order for splits and samples."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))
