"""Texts cut at the ends of sentences, near a length."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import bound_batches

# Where a sentence ends; behind what a text without sentences may be cut; characters that don't count while a
# chunk grows, as they may be parts of written-out escapes; what is dropped from a chunk.
END, TAIL = "。", frozenset(")）]】 \n\t")
UNCOUNTED = frozenset("\n\t \\ntr")
DROPPED = re.compile(r"\\[ntr]")
SPACE = re.compile(r"\s+")


def cleaned(text: str) -> str:
    """Without written-out escapes and white space."""
    return SPACE.sub("", DROPPED.sub("", text))


def cut_points(text: str, most: int, least: int) -> list[int]:
    """Where ``text`` is cut: once ``most`` characters count, behind the last end of a sentence if ``least`` clean characters
    stand before it, else behind the next tail mark."""
    cuts, start, count, i, n = [], 0, 0, 0, len(text)
    while i < n:
        count += text[i] not in UNCOUNTED
        i += 1
        if count < most:
            continue
        end = text.rfind(END, start, i) + 1
        if end > 0 and len(cleaned(text[start:end])) >= least:
            start = end
        else:
            while i < n and text[i] not in TAIL:
                i += 1
            start = i = min(n, i + 1)
        cuts.append(start)
        count = len(cleaned(text[start:i]))
    return cuts


def ladder_chunks(docs: DataFrame, most: int = 500, ladder: Sequence[int] = (448, 256, 128), tiny: int = 10) -> DataFrame:
    """(doc_id, chunk, raw, body) of docs(doc_id, text): raw pieces without edge spaces, and these cleaned.

    The least clean length before a sentence's end is looked for along ``ladder``; as what stands before the last end is
    the longest, it is taken if it reaches the ladder's lowest step.  A piece of ``tiny`` or fewer clean characters joins
    the one before.  Null and empty texts, and texts of white space, have no chunk.
    """
    if not ladder:
        raise ValueError("the ladder has no step")
    least = min(ladder)
    bound_batches(docs.sparkSession)

    @F.pandas_udf("array<struct<raw:string,body:string>>")
    def split(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            parts: list[list[str]] = []
            at = [0, *cut_points(text, most, least), len(text)]
            for a, b in zip(at[:-1], at[1:], strict=True):
                raw = text[a:b].strip()
                if not raw:
                    continue
                body = cleaned(raw)
                if parts and len(body) <= tiny:
                    parts[-1] = [parts[-1][0] + raw, parts[-1][1] + body]
                else:
                    parts.append([raw, body])
            out.append([{"raw": r, "body": c} for r, c in parts])
        return pd.Series(out, dtype=object)

    rows = docs.filter("text <> ''").select("doc_id", split("text").alias("x"))
    return rows.select("doc_id", F.posexplode("x").alias("chunk", "c")).select("doc_id", "chunk", "c.raw", "c.body")
