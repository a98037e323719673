"""Text and key functions, Column to Column, all native.

Character classes are spelled out: Java's, Python's and RE2's shorthands differ.  Offsets are code points, half-open.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character sets and words that results depend on.
SPACES = " \t\n\r\x0b\x0c 　"
SPACE_CLASS = r"[ \t\n\r\x0b\x0c\x{a0}\x{3000}]"
KEY_TAIL = ":：;；、。，,."
VALUE_EDGE = "。，、；:;,:()[]{}<>"
PUNCTUATION = " \t　\r\n。，、；：？！,.;:?![]【】()（）「」『』\"'…—"
EDGE_CLASS = r"[ \t\n\r\x0b\x0c\x{3000}。，、；：？！,.!?;:\"'()（）\[\]【】{}<>「」『』…\-_/\\—]"
NOISE = " \t\n\r\x0b\x0c　：:0123456789()（）[]【】"
ALIAS_EDGE = "，。,:：;；()（）[]【】<>《》\"'"
MISSING = ("", "NA", "N/A", "NULL", "NONE", "—", "-", "无", "未知", "不详")
GENERIC_LABELS = ("别名", "标签", "字段", "名称", "项目")
PHONE_KEYS = ("电话", "联系方式", "联系电话")
PHONE = r"(?:\+?86[- ]?)?1[3-9][0-9]{9}"
STOP_CLASS = "[。；;，,\n]"
SENTENCE_ENDS = "。！？；.!?;"


def _wide(first: int, last: int) -> tuple[str, str]:
    codes = range(first, last + 1)
    return "".join(map(chr, codes)), "".join(chr(c - 0xFEE0) for c in codes)


FULL_WIDTH, HALF_WIDTH = (a + b for a, b in zip(_wide(0xFF01, 0xFF5E), ("　", " "), strict=True))


def fold_width(c: Column) -> Column:
    """Full-width forms and the ideographic space to their ASCII twins (the part of NFKC that text fields need)."""
    return F.translate(c, FULL_WIDTH, HALF_WIDTH)


def canonical_key(c: Column) -> Column:
    """Key form for comparison: colon and brackets half-width, no white space."""
    return F.regexp_replace(F.translate(c, "：（）", ":()"), SPACE_CLASS, "")


def normal_key(c: Column) -> Column:
    """Width folded, no white space, trailing separators dropped."""
    return F.rtrim(F.regexp_replace(fold_width(c), SPACE_CLASS, ""), F.lit(KEY_TAIL))


def normal_value(c: Column) -> Column:
    """Width folded, dashes unified; white space, then punctuation, dropped at the edges only."""
    folded = F.translate(fold_width(c), "—–", "--")
    return F.btrim(F.btrim(folded, F.lit(SPACES)), F.lit(VALUE_EDGE))


def strip_edges(c: Column, start: Column, end: Column, chars: str, keep_empty: bool = False) -> Column:
    """Struct (text, start, end) without edge ``chars``.

    If nothing is left, the start has moved past all of it; ``keep_empty`` then gives the original text back.
    """
    left = F.ltrim(c, F.lit(chars))
    text = F.rtrim(left, F.lit(chars))
    s = start + F.length(c) - F.length(left)
    e = end - (F.length(left) - F.length(text))
    return F.struct((F.when(text == "", c).otherwise(text) if keep_empty else text).alias("text"), s.alias("start"), e.alias("end"))


def strip_punctuation(c: Column, start: Column, end: Column) -> Column:
    return strip_edges(c, start, end, PUNCTUATION, keep_empty=True)


def strip_noise(c: Column, start: Column, end: Column) -> Column:
    return strip_edges(c, start, end, NOISE)


def tighten(c: Column, start: Column, end: Column) -> Column:
    return strip_edges(c, start, end, SPACES)


def strip_limited(c: Column, most: int) -> Column:
    """At most ``most`` edge characters dropped, left ones first."""
    left = F.length(F.regexp_extract(c, f"^{EDGE_CLASS}{{0,{most}}}", 0))
    rest = F.substring(c, left + 1, F.length(c))
    right = F.least(F.length(F.regexp_extract(rest, f"{EDGE_CLASS}*$", 0)), F.lit(most) - left)
    return F.substring(rest, F.lit(1), F.length(rest) - right)


def report_text(c: Column) -> Column:
    """Line ends unified, special spaces plain, colons full-width; null and blank are empty."""
    text = F.translate(F.regexp_replace(c, "\r\n?", "\n"), " 　:", "  ：")
    return F.when(F.btrim(F.coalesce(c, F.lit("")), F.lit(SPACES)) == "", "").otherwise(text)


def one_line(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, f"{SPACE_CLASS}+", " "), F.lit(" "))


def tidy(c: Column) -> Column:
    """No space before a mark, repeated marks once."""
    out = F.regexp_replace(c, f"{SPACE_CLASS}+([。；，,、！？:：])", "$1")
    for mark in "。！？；，,:：":
        out = F.regexp_replace(out, f"{mark}{{2,}}", mark)
    return out


def fingerprint(c: Column) -> Column:
    return F.md5(F.lower(F.regexp_replace(c, f"{SPACE_CLASS}+", "")))


def is_missing(c: Column) -> Column:
    return F.upper(F.btrim(F.coalesce(c, F.lit("")), F.lit(SPACES))).isin(*MISSING)


def clean_alias(canonical: Column, alias: Column, value: Column) -> Column:
    """A label from an alias: left of the colon (right, if the left is generic), left of 为 or 是, at most 50 characters.

    Missing aliases, and those that hold the value, become the canonical name.
    """
    edge = SPACES + ALIAS_EDGE
    a = F.btrim(alias, F.lit(edge))
    colon = F.when(F.instr(a, ":") > 0, F.instr(a, ":")).otherwise(F.instr(a, "："))
    left = F.btrim(F.substring(a, F.lit(1), colon - 1), F.lit(edge))
    right = F.btrim(F.substring(a, colon + 1, F.length(a)), F.lit(edge))
    generic = F.lit(False)
    for word in GENERIC_LABELS:
        generic = generic | F.contains(left, F.lit(word))
    a = F.when(colon > 0, F.when(generic, right).otherwise(left)).otherwise(a)
    verb = F.when(F.instr(a, "为") > 0, F.instr(a, "为")).otherwise(F.instr(a, "是"))
    a = F.when(verb > 0, F.btrim(F.substring(a, F.lit(1), verb - 1), F.lit(edge))).otherwise(a)
    bare = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    holds = (a != "") & (F.coalesce(value, F.lit("")) != "") & (F.contains(a, value) | F.contains(bare(a), bare(value)))
    return F.when(is_missing(alias) | F.coalesce(holds, F.lit(False)), canonical).otherwise(F.left(a, F.lit(50)))


def token_count(c: Column) -> Column:
    """CJK characters, runs of ASCII letters and digits, and single symbols."""
    return F.regexp_count(c, F.lit(r"[\x{4e00}-\x{9fff}]|[A-Za-z0-9]+|[^\p{L}\p{N}_ \t\n\r\x0b\x0c\x{a0}\x{3000}]"))


def is_valid_span(start: Column, end: Column, text: Column) -> Column:
    ok = (start >= 0) & (end > start) & (F.btrim(text, F.lit(SPACES)) != "")
    return F.coalesce(ok, F.lit(False))


def is_short(c: Column) -> Column:
    v = F.btrim(F.coalesce(c, F.lit("")), F.lit(SPACES))
    return (F.length(v) <= 8) | (token_count(v) <= 6) | v.rlike(r"^[0-9\-/ \t\n]{1,15}$") | v.rlike(r"^[a-zA-Z \t\n]{1,10}$") | v.rlike(r"^[\x{4e00}-\x{9fff}]{1,5}$")


def shorten_value(key: Column, value: Column, start: Column, cap: int = 64) -> Column:
    """Struct (text, start, end): the first phone number under a phone key; else a value over ``cap`` up to a stop mark after 6 characters."""
    phone_key = F.lit(False)
    for k in PHONE_KEYS:
        phone_key = phone_key | F.contains(key, F.lit(k))
    phone = F.regexp_extract(value, PHONE, 0)
    at = F.instr(value, phone) - 1
    head = F.regexp_extract(value, rf"(?s)^(.{{6}}[^。；;，,\n]*){STOP_CLASS}", 1)
    return (
        F.when(phone_key & (phone != ""), F.struct(phone.alias("text"), (start + at).alias("start"), (start + at + F.length(phone)).alias("end")))
        .when((F.length(value) > cap) & (head != ""), F.struct(F.btrim(head, F.lit(SPACES)).alias("text"), start.alias("start"), (start + F.length(head)).alias("end")))
        .otherwise(F.struct(value.alias("text"), start.alias("start"), (start + F.length(value)).alias("end")))
    )


def question(key: Column, aliases: Column, custom: Column) -> Column:
    """Question for a key: a custom one or the standard one, and up to two aliases (the first two; any two would do)."""
    some = F.slice(aliases, 1, 2)
    tail = F.when(F.size(some) == 2, F.concat(F.lit(","), key, F.lit("别名有"), F.array_join(some, "、"), F.lit("等"))).when(F.size(some) == 1, F.concat(F.lit(","), key, F.lit("别名有"), some[0])).otherwise("")
    return F.concat(F.when(F.coalesce(custom, F.lit("")) != "", custom).otherwise(F.concat(F.lit("找到文本中的"), key)), tail)


def context(report: Column, value: Column, left: int = 80, right: int = 80) -> Column:
    """The value's first place with what stands around it; the head of the report if it isn't there."""
    at = F.instr(report, value)
    first = F.greatest(F.lit(1), at - left)
    return F.when(at > 0, F.substring(report, first, F.least(F.length(report), at - 1 + F.length(value) + right) - first + 1)).otherwise(F.left(report, F.lit(max(200, left + right + 160))))


def starts_with_number(c: Column) -> Column:
    return c.rlike(r"^[ \t\x{3000}]*([0-9]+|[一二三四五六七八九十]+)[、.．)）]")


def ends_sentence(c: Column) -> Column:
    return F.right(F.rtrim(c, F.lit(SPACES)), F.lit(1)).isin(*SENTENCE_ENDS)


def length_score(actual: Column, expected: Column, short: Column, p50: Column, sigma: Column) -> Column:
    """How plausible a length is, 0.1 to 1: a bell curve around the key's prior; without one, a decay of the relative error."""
    s = F.when(short, F.greatest(F.lit(1.0), 0.8 * sigma)).otherwise(sigma)
    z = F.abs(actual - p50) / (s + 1e-6)
    rel = F.abs(actual - expected) / F.greatest(F.lit(1.0), expected)
    ratio = rel / F.when(short, F.lit(0.30)).otherwise(F.lit(0.75))
    score = F.when(p50.isNotNull(), F.exp(-(z * z) / 2.0)).otherwise(1.0 / (1.0 + ratio * ratio))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.1), score))
