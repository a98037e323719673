"""Masking of personal data, Column to Column."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .batches import bound_batches

# Cues and patterns.
ID = r"([0-9]{6})[0-9]{8}([0-9]{3}[0-9Xx])"
PHONE = r"(1[0-9]{5})[0-9]{4}([0-9])"
ADDRESS = r"(联系地址|地址)[：:][ \t\r\f\x0b]*\n?[^\n\r]*"
WORKPLACE = r"(工作单位|单位)[ \t\n\r\x{3000}:：]*([^\n\r，,。；;]{2,30})"
CASE_NUMBER = r"(病案号)[ \t\n\r\x{3000}:：]*([A-Za-z0-9\-]{3,30})"
PATIENT = r"(患者ID|ID号)[ \t\n\r\x{3000}:：]*([A-Za-z0-9\-]{3,30})"
NAME_CUE = r"姓[ ]*名|签[ ]*名"
#: Characters between a cue and a name, at most.
NAME_REACH = 12


def mask_id(c: Column) -> Column:
    """18-character national ids keep 6 and 4 characters."""
    return F.regexp_replace(c, ID, "$1" + "*" * 8 + "$2")


def mask_phone(c: Column) -> Column:
    """11-digit phone numbers keep 6 and 1 digits."""
    return F.regexp_replace(c, PHONE, "$1****$2")


def mask_address(c: Column) -> Column:
    return F.regexp_replace(c, ADDRESS, "$1：*")


def _masked(c: Column, pattern: str, head: int, tail: int) -> Column:
    """Values after a cue, rewritten as cue, colon and masked value; short ones lose all characters."""
    # Text between the matches: each match becomes one mark, U+0000 with U+0002; those of the text are followed by U+0001.
    c = F.replace(c, F.lit("\x00"), F.lit("\x00\x01"))
    plain = lambda x: F.replace(x, F.lit("\x00\x01"), F.lit("\x00"))
    cues, values = F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(2)), plain)
    pieces = F.split(F.regexp_replace(c, pattern, "\x00\x02"), "\x00\x02")

    def hide(v: Column) -> Column:
        n = F.length(v)
        whole = F.repeat(F.lit("*"), n)
        ends = F.concat(F.left(v, F.lit(head)), F.repeat(F.lit("*"), n - head - tail), F.right(v, F.lit(tail)) if tail else F.lit(""))
        return F.when(n > head + tail, ends).otherwise(whole)

    shown = F.zip_with(cues, values, lambda k, v: F.concat(k, F.lit(": "), hide(v)))
    return plain(F.when(F.size(cues) > 0, F.array_join(F.zip_with(pieces, F.concat(shown, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")).otherwise(c))


def mask_workplace(c: Column) -> Column:
    return _masked(c, WORKPLACE, 2, 0)


def mask_case_number(c: Column) -> Column:
    return _masked(c, CASE_NUMBER, 2, 2)


def mask_patient(c: Column) -> Column:
    return _masked(c, PATIENT, 2, 2)


def mask_name(c: Column) -> Column:
    """The 1 to 5 CJK characters after a name cue, within reach of it, keep the first; each edit moves on the text it has made."""
    bound_batches()
    return _mask_names(c)


@F.pandas_udf(StringType())
def _mask_names(texts: pd.Series) -> pd.Series:
    cue, name = re.compile(NAME_CUE), re.compile(r"[一-鿿]{1,5}")

    def one(text: str | None) -> str | None:
        at = 0
        while text and (m := cue.search(text, at)):
            at = m.end()
            found = name.search(text, at)
            if found and found.start() - at <= NAME_REACH:
                text = text[: found.start() + 1] + "*" * (found.end() - found.start() - 1) + text[found.end() :]
                at = found.end()
        return text

    return texts.map(one)


def mask_all(c: Column) -> Column:
    """Case number, workplace, patient, id, phone, name, address, in this order: ids go before phones."""
    return mask_address(mask_name(mask_phone(mask_id(mask_patient(mask_workplace(mask_case_number(c)))))))
