"""Column functions: names, paths, commit subjects, weights and hashes.

All stay in the JVM; every division is guarded, since ANSI mode raises on zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark corrective and reverting commits, and assistant trailers.
FIX_WORDS = ("fix", "fixes", "fixed", "fixup", "bug", "bugfix", "hotfix", "patch", "repair", "broken", "regression", "crash", "panic")
REVERT_WORDS = ("revert", "reverts", "reverted", "reverting")
#: Half-life of churn, as hours; days after which an author counts as gone.
CHURN_HALF_LIFE_H, ORPHAN_DAYS = 182 * 24.0, 90


def package_of(symbol: Column) -> Column:
    """The text before the last ".(", else before the last ".", else ''."""
    method = F.regexp_extract(symbol, r"(?s)^(.*)\.\(", 1)
    return F.when(symbol.contains(".("), method).otherwise(F.regexp_extract(symbol, r"(?s)^(.*)\.", 1))


def short_id(symbol: Column) -> Column:
    """The last path element of the package, with the rest of the id."""
    package = package_of(symbol)
    return F.concat(F.regexp_replace(package, "(?s)^.*/", ""), F.substr(symbol, F.length(package) + 1))


def line_span(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(1), end - start + 1)


def is_test_file(path: Column) -> Column:
    return path.endswith("_test.go") | path.contains("/testdata/") | path.startswith("testdata/")


def is_source_file(path: Column) -> Column:
    return ~is_test_file(path) & path.endswith(".go") & (F.length(path) > 3)


def _words(words: tuple[str, ...]) -> str:
    return r"(?i)\b(" + "|".join(words) + r")\b"


def is_fix(subject: Column) -> Column:
    return subject.rlike(_words(FIX_WORDS))


def is_revert(subject: Column) -> Column:
    return subject.rlike(_words(REVERT_WORDS))


def author_of(email: Column, name: Column) -> Column:
    return F.lower(F.coalesce(F.nullif(email, F.lit("")), name))


def is_orphaned(last: Column, now: Column) -> Column:
    """Unknown, or more than ORPHAN_DAYS before now."""
    return F.coalesce(last < now - F.expr(f"INTERVAL {ORPHAN_DAYS} DAYS"), F.lit(True))


def age_hours(ts: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 3_600_000_000.0


def recency_weight(ts: Column, now: Column) -> Column:
    """Halves every 182 days; a time after now has age 0."""
    return F.pow(F.lit(2.0), -F.greatest(F.lit(0.0), age_hours(ts, now)) / CHURN_HALF_LIFE_H)


def hop_decay(hops: Column) -> Column:
    return F.pow(F.lit(2.0), -hops / 2.0)


def share_log(x: Column, total: Column) -> Column:
    """(x / total) * ln(1 + x); NULL where either is 0."""
    return F.nullif(x, F.lit(0)) / F.nullif(total, F.lit(0)) * F.log1p(x)


def familiarity(edits: Column, seen: Column, correct: Column, days: Column) -> Column:
    """1 - (1 - e)(1 - p), decayed by days, within [0, 1]."""
    e = 1 - F.exp(-edits / 3.0)
    accuracy = F.coalesce(correct / F.nullif(seen, F.lit(0)), F.lit(0.0))
    p = accuracy * (1 - F.exp(-seen / 2.0))
    value = (1 - (1 - e) * (1 - p)) * F.when(days > 0, F.exp(-days / 90.0)).otherwise(1.0)
    return F.when(F.isnan(value), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))


def sizes_match(a: Column, b: Column, ratio: float = 1.25) -> Column:
    return (a > 0) & (b > 0) & (F.greatest(a, b) / F.nullif(F.least(a, b), F.lit(0)) <= ratio)


def normalise_token(token: Column) -> Column:
    """Trim outer punctuation and space, lower-case."""
    return F.lower(F.trim(F.btrim(token, F.lit("(),.;\"'`"))))


def fnv1a_32(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes; fits a long, so plain arithmetic is exact."""
    data = F.hex(F.encode(text, "UTF-8"))
    bytes_ = F.transform(F.sequence(F.lit(0), F.octet_length(text) - 1), lambda i: F.conv(F.substr(data, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    start = F.lit(2166136261).cast("long")
    hashed = F.aggregate(bytes_, start, lambda h, b: h.bitwiseXOR(b) * F.lit(16777619).cast("long") % F.lit(4294967296))
    return F.when(F.octet_length(text) == 0, start).otherwise(hashed)


def rounded(x: Column, places: int = 4) -> Column:
    """Half up, as the JSON output has it."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / scale


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, one).otherwise(many))


def tier_label(tier: Column) -> Column:
    return F.when(tier == 1, "start here").when(tier == 2, "then these").otherwise("when you get to it")


def agrees(n: Column, one: str, many: str) -> Column:
    """The form of a verb for n things."""
    return F.when(n == 1, one).otherwise(many)


def first_doc_line(doc: Column, most: int = 160) -> Column:
    """Up to the first line break and `most` bytes of UTF-8; a letter that is cut goes whole."""
    line = F.substring_index(doc, "\n", 1)
    cut = F.regexp_replace(F.decode(F.substring(F.encode(line, "UTF-8"), 1, most), "ISO-8859-1"), "[\u00C0-\u00FF][\u0080-\u00BF]{0,2}$", "")
    whole = F.decode(F.encode(cut, "ISO-8859-1"), "UTF-8")
    return F.when(F.octet_length(line) > most, F.concat(whole, F.lit("…"))).otherwise(line)
