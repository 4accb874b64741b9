"""Text functions over columns. Lengths are code points unless a name says bytes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ELLIPSIS = "..."


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def lines(text: Column) -> Column:
    """Lines without their ends: \\n or \\r\\n closes a line, a final one opens none."""
    body = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n", -1))


def truncate(s: Column, limit: int) -> Column:
    """At most `limit` characters, the last three of them dots if it was cut."""
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.left(s, F.lit(max(limit - 3, 0))), F.lit(ELLIPSIS)))


def strip(s: Column) -> Column:
    """Unicode white space removed from both ends."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def strip_end(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)\s+$", "")


def preview(s: Column, limit: int = 60) -> Column:
    return truncate(strip(s), limit)


def export_cut(s: Column, limit: int) -> Column:
    """The first `limit` characters with dots after them: exports cut later than previews."""
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.left(s, F.lit(limit)), F.lit(ELLIPSIS)))


def pad(s: Column, width: int) -> Column:
    """Exactly `width` characters."""
    return F.rpad(s, width, " ")


def fit(s: Column, width: int) -> Column:
    """Exactly `width` characters, a cut shown by one sign."""
    return F.when(F.length(s) > width, F.concat(F.left(s, F.lit(max(width - 1, 0))), F.lit("…"))).otherwise(F.rpad(s, width, " "))


def wrap(s: Column, width: int) -> Column:
    """Greedy lines of at most `width` bytes; a longer word has a line of its own."""
    words = F.filter(F.split(strip(s), r"(?U)\s+"), lambda w: w != "")
    start = F.array().cast("array<string>")

    def add(out: Column, word: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joined = F.concat(last, F.lit(" "), word)
        return F.when(F.octet_length(joined) <= width, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(joined))).otherwise(F.concat(out, F.array(word)))

    folded = F.aggregate(words, start, lambda out, w: F.when(F.size(out) == 0, F.array(w)).otherwise(add(out, w)))
    return F.when(F.size(folded) == 0, F.array(F.lit(""))).otherwise(folded)


def block_form(s: Column) -> Column:
    """White space collapsed, and the blanks gone that formatters put at line breaks."""
    out = F.regexp_replace(strip(s), r"(?U)\s+", " ")
    for a, b in ((" .", "."), (" ,", ","), (" ;", ";"), (" )", ")"), ("( ", "(")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


#: How a line looks that continues or opens a split statement.
FRAGMENT = r"^(\.|,|\)|\]|\}|&&|\|\|)|(\(|\[|\{|,|=|&&|\|\|)$"


def looks_like_fragment(s: Column) -> Column:
    t = strip(s)
    return (t != "") & t.rlike(FRAGMENT)


def csv_field(s: Column) -> Column:
    flat = F.regexp_replace(s, r"\r\n|\r|\n", " ")
    return F.replace(flat, F.lit('"'), F.lit('""'))


def bytes_text(n: Column) -> Column:
    """Sizes of 1 KiB and more with one digit, of 1 MiB and more with two; ties to even."""
    kib, mib = F.bround(n / 1024, 1), F.bround(n / (1024 * 1024), 2)
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024 * 1024, F.format_string("%.1f KiB", kib)).otherwise(F.format_string("%.2f MiB", mib))


def hex_digest(s: Column, chars: int) -> Column:
    return F.substring(F.sha2(s, 256), 1, chars)


def content_hash(s: Column) -> Column:
    return hex_digest(s, 32)


def hunk_hash(rows: Column) -> Column:
    joined = F.when(F.size(rows) == 0, F.lit("")).otherwise(F.concat(F.array_join(rows, "\n"), F.lit("\n")))
    return hex_digest(joined, 16)


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def percent(a: Column, b: Column) -> Column:
    return ratio(a, b) * 100.0


def short_commit(c: Column) -> Column:
    return F.substring(c, 1, 7)


def file_line(reference: Column) -> tuple[Column, Column]:
    """(path, line): what follows the last colon is a line if it is an unsigned 32-bit
    number; else all of it is the path and line is null."""
    digits = F.regexp_extract(reference, r"^(?s)(.*):\+?([0-9]{1,18})$", 2)
    n = F.when(digits != "", digits.cast("bigint"))
    ok = n.isNotNull() & (n <= 4294967295)
    path = F.when(ok, F.regexp_extract(reference, r"^(?s)(.*):\+?([0-9]{1,18})$", 1)).otherwise(reference)
    return path, F.when(ok, n)
