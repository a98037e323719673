"""Per-document folds: breaks and packs that reset on overflow, as native array folds; a text's own keys are looked for in Python."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as T
from ..functions.batches import bound_batches


TEXTS = ArrayType(StringType())


def once(c: Column, work: Callable[[Column], Column]) -> Column:
    """``work(c)``; as a lambda's variable ``c`` is worked out once, however often it is used."""
    return F.get(F.transform(F.array(c), work), F.lit(0))


def pack(items: Column, size, budget: int) -> Column:
    """Array of arrays: neighbours of ``items`` while the sum of ``size(item)`` stays within ``budget``; a larger one stands alone."""
    none = F.expr("named_struct('i', 0, 'n', 0, 'starts', cast(array() as array<int>))")

    def add(acc: Column, n: Column) -> Column:
        fits = (acc["i"] > 0) & (acc["n"] + n <= budget)
        return F.struct(
            (acc["i"] + 1).alias("i"), F.when(fits, acc["n"] + n).otherwise(n).alias("n"),
            F.when(fits, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["i"]))).alias("starts"),
        )

    # The fold carries numbers only; items are copied once, when all starts are known.
    starts = lambda x: F.aggregate(F.transform(x, lambda i: size(i).cast("int")), none, add, lambda acc: acc["starts"])
    cut = lambda x, at: F.transform(at, lambda a, i: F.slice(x, a + 1, F.coalesce(F.get(at, i + 1), F.size(x)) - a))
    return once(items, lambda x: once(starts(x), lambda at: cut(x, at)))


def corpus_chunks(docs: DataFrame, separator: str, budget: int) -> DataFrame:
    """(doc_id, chunk, body): pieces between separators packed up to ``budget`` characters."""
    pieces = F.filter(F.split("text", "\\Q" + separator + "\\E"), lambda x: x != "")
    return docs.select("doc_id", F.posexplode(pack(pieces, F.length, budget)).alias("chunk", "x")).select("doc_id", "chunk", F.array_join("x", separator).alias("body"))


def packed_items(records: DataFrame, cap: int, separators: list[str]) -> DataFrame:
    """(id, par, body): a record's rendered fields (id, ord, line) packed under a token cap; the separators take turns by paragraph."""
    listed = records.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]).alias("lines"))
    rows = listed.select("id", F.posexplode(pack(F.col("lines"), T.token_count, cap)).alias("par", "x"))
    sep = F.element_at(F.array(*map(F.lit, separators)), F.col("par") % len(separators) + 1)
    return rows.select("id", "par", F.aggregate("x", F.lit(""), lambda acc, y: F.when(acc == "", y).otherwise(F.concat(acc, sep, y))).alias("body"))


def breaks_before(docs: DataFrame, words: list[str], apart: int) -> DataFrame:
    """(doc_id, text): a line break before each of ``words`` that stands ``apart`` characters or more behind the last break."""
    pattern = "(?=" + "|".join("\\Q" + w + "\\E" for w in words) + ")"
    none = F.struct(F.lit("").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, x: Column) -> Column:
        cut = F.length(acc["open"]) >= apart
        return F.struct(
            F.when(cut, F.concat(acc["done"], acc["open"], F.lit("\n"))).otherwise(acc["done"]).alias("done"),
            F.when(cut, x).otherwise(F.concat(acc["open"], x)).alias("open"),
        )

    out = F.aggregate(F.split("text", pattern), none, add, lambda acc: F.concat(acc["done"], acc["open"]))
    return docs.select("doc_id", out.alias("text"))


def balanced(c: Column, strings: bool) -> Column:
    """From the first brace to the one that closes it, or null; with ``strings``, braces within JSON strings don't count."""
    none = F.expr("named_struct('i', 0, 'depth', 0, 'first', 0, 'end', 0, 'quoted', false, 'escaped', false)")

    def add(acc: Column, x: Column) -> Column:
        inside = acc["quoted"] if strings else F.lit(False)
        opened, closed = ~inside & (x == "{"), ~inside & (x == "}") & (acc["depth"] > 0)
        depth = acc["depth"] + opened.cast("int") - closed.cast("int")
        quote = (acc["depth"] > 0) & (x == '"') & ~acc["escaped"]
        moved = F.struct(
            (acc["i"] + 1).alias("i"), depth.alias("depth"),
            F.when(opened & (acc["first"] == 0), acc["i"] + 1).otherwise(acc["first"]).alias("first"),
            F.when(closed & (depth == 0), acc["i"] + 1).otherwise(F.lit(0)).alias("end"),
            F.when(quote, ~acc["quoted"]).otherwise(acc["quoted"]).alias("quoted"),
            (acc["quoted"] & (x == "\\") & ~acc["escaped"]).alias("escaped"),
        )
        return F.when(acc["end"] > 0, acc).otherwise(moved)

    span = F.aggregate(F.split(c, ""), none, add, lambda acc: F.struct(acc["first"].alias("first"), acc["end"].alias("end")))
    return F.when(F.instr(c, "{") > 0, F.when(span["end"] > 0, F.substr(c, span["first"], span["end"] - span["first"] + 1)))


def json_object(c: Column) -> Column:
    """The first JSON object in noisy text: the whole text, a fenced block, or from the first brace to the one that closes it.

    Null if none of these parses; the last way counts braces in strings too.
    """
    whole = F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    fenced = F.regexp_extract(c, r"(?is)```(?:json)?[ \t\r\n]*\n(.*?)\n```", 1)
    fenced = F.regexp_replace(fenced, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    ok = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    full = lambda x: F.when(x.startswith("{") & (balanced(x, True) == x), ok(x))
    return F.coalesce(full(whole), full(fenced), ok(balanced(c, False)))


def places(text: str, keys: list[str]) -> list[int]:
    """Where one of ``keys`` begins in ``text``, in one pass: by the first characters, as many as the shortest key has."""
    least = min(map(len, keys), default=0)
    heads: dict[str, dict[int, set[str]]] = {}
    for k in sorted(keys, key=len):
        heads.setdefault(k[:least], {}).setdefault(len(k), set()).add(k)
    out = []
    for i in range(len(text) - least + 1) if keys else ():
        found = heads.get(text[i : i + least])
        if found is not None and any(text[i : i + n] in some for n, some in found.items()):
            out.append(i)
    return out


def _parts(text: str, cuts: list[int]) -> list[str]:
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]


@F.pandas_udf(TEXTS)
def _before_keys(texts: pd.Series, keys: pd.Series) -> pd.Series:
    """Texts cut before each place of a key; null keys cut nothing."""
    return pd.Series([None if t is None else [t] if k is None else _parts(t, [p for p in places(t, list(k)) if p > 0]) for t, k in zip(texts, keys, strict=True)], dtype=object)


@F.pandas_udf(TEXTS)
def _behind_keys(texts: pd.Series, keys: pd.Series) -> pd.Series:
    """Texts cut behind each place of a key; null keys cut nothing."""
    back = lambda t, k: [len(t) - p for p in reversed(places(t[::-1], [x[::-1] for x in k]))]
    return pd.Series([None if t is None else [t] if k is None else _parts(t, back(t, k)) for t, k in zip(texts, keys, strict=True)], dtype=object)


@F.pandas_udf(TEXTS)
def _behind_words(texts: pd.Series) -> pd.Series:
    """Texts cut behind each place of one of their own words of 3 characters or more; no such place reaches over a blank."""

    def one(text: str | None) -> list[str] | None:
        if text is None:
            return None
        words = text.split(" ")
        sizes: dict[int, set[str]] = {}
        for w in words:
            if len(w) >= 3:
                sizes.setdefault(len(w), set()).add(w)
        by_size, known, cuts, at = sorted(sizes.items()), {}, [], 0
        for w in words:
            ends = known.get(w)
            if ends is None:
                ends = known[w] = [e for e in range(3, len(w) + 1) if any(w[e - n : e] in some for n, some in by_size if n <= e)]
            cuts += [at + e for e in ends]
            at += len(w) + 1
        return _parts(text, cuts)

    return pd.Series([one(t) for t in texts], dtype=object)


def cut_at_keys(docs: DataFrame, budget: int, separator: str = "\n\n") -> DataFrame:
    """(doc_id, chunk, start, end, body) of docs(doc_id, text, keys): cut before a key once the tokens since the last cut exceed ``budget``.

    What exceeds the budget even so is cut at blank lines (``separator``); its empty parts go.  A text within the budget
    is one chunk; so is one that holds none of its keys and no blank line.  Null and empty texts have no chunk.
    """
    keys = F.filter("keys", lambda k: k != "")
    bound_batches(docs.sparkSession)
    rows = docs.filter("text <> ''").select("doc_id", "text", keys.alias("keys"))
    long = (F.size("keys") > 0) & (T.token_count(F.col("text")) > budget)
    rows = rows.select("doc_id", _before_keys("text", F.when(long, F.col("keys"))).alias("pieces"))
    none = F.expr("named_struct('done', cast(array() as array<string>), 'open', '', 'n', 0)")

    def add(acc: Column, x: Column) -> Column:
        # Sums of the pieces' tokens are never too low: a cut may only split a token.
        cut = F.when(acc["n"] > budget, T.token_count(acc["open"]) > budget).otherwise(F.lit(False))
        n = T.token_count(x).cast("int")
        return F.struct(
            F.when(cut, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(cut, x).otherwise(F.concat(acc["open"], x)).alias("open"),
            F.when(cut, n).otherwise(acc["n"] + n).alias("n"),
        )

    cut = F.aggregate("pieces", none, add, lambda acc: F.concat(acc["done"], F.array(acc["open"])))
    spans = F.aggregate(
        cut, F.expr("cast(array() as array<struct<start:int,end:int,body:string>>)"),
        lambda acc, x: F.concat(acc, F.array(F.struct(F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)).alias("start"), (F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)) + F.length(x)).alias("end"), x.alias("body")))),
    )
    out = rows.select("doc_id", F.posexplode(spans).alias("chunk", "s")).select("doc_id", "chunk", "s.start", "s.body")
    parts = F.when(T.token_count(F.col("body")) > budget, F.split("body", "\\Q" + separator + "\\E")).otherwise(F.array("body"))
    out = out.select("doc_id", "chunk", "start", F.posexplode(parts).alias("i", "part"))
    before = F.sum(F.length("part") + len(separator)).over(Window.partitionBy("doc_id", "chunk").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("start", (F.col("start") + F.coalesce(before, F.lit(0))).cast("int")).filter("part <> ''")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1
    return out.select("doc_id", number.alias("chunk"), "start", (F.col("start") + F.length("part")).alias("end"), F.col("part").alias("body"))


def cut_at_keywords(c: Column, words: list[str]) -> Column:
    """The text before the first of ``words`` with a colon, or at a line's start."""
    alternatives = "|".join("\\Q" + w + "\\E" for w in words)
    return F.regexp_replace(c, rf"(?s)((?:{alternatives})[：:]|\n(?:{alternatives})).*$", "")


def breaks_after_values(docs: DataFrame, budget: int) -> DataFrame:
    """(doc_id, text) of docs(doc_id, text, values): a blank line after a value where the tokens since the last one would exceed ``budget``.

    Texts within the budget, and those that hold none of their values of 3 characters or more, stay as they are.
    """
    bound_batches(docs.sparkSession)
    wanted = F.filter(F.transform("values", lambda v: F.trim(v)), lambda v: F.length(v) >= 3)
    return _broken(docs.withColumn("pieces", _behind_keys("text", F.when(F.size(wanted) > 0, wanted))), budget)


def breaks_after_words(docs: DataFrame, budget: int) -> DataFrame:
    """``breaks_after_values`` of docs(doc_id, text) where all words between blanks of a text are its values.

    Any such word of 3 characters or more ends a piece, inside of words too.
    """
    bound_batches(docs.sparkSession)
    return _broken(docs.select("doc_id", "text", _behind_words("text").alias("pieces")), budget)


def _broken(rows: DataFrame, budget: int) -> DataFrame:
    packed = F.array_join(F.transform(pack(F.col("pieces"), T.token_count, budget), lambda c: F.array_join(c, "")), "\n\n")
    return rows.select("doc_id", F.when(T.token_count(F.col("text")) <= budget, F.col("text")).otherwise(packed).alias("text"))


def sentence_chunks(docs: DataFrame, mark: str, most: int, least: int, tiny: int) -> DataFrame:
    """(doc_id, chunk, body): texts cut behind the last ``mark`` within ``most`` characters, if ``least`` stand before it; pieces of ``tiny`` join the one before."""
    none = F.expr("cast(array() as array<string>)")

    def add(acc: Column, x: Column) -> Column:
        last = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(""))
        cut = (F.size(acc) == 0) | ((F.length(last) + F.length(x) > most) & (F.length(last) >= least) & (F.length(x) > tiny))
        return F.when(cut, F.concat(acc, F.array(x))).otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, x))))

    sentences = F.filter(F.split("text", f"(?<=\\Q{mark}\\E)"), lambda x: x != "")
    return docs.select("doc_id", F.posexplode(F.aggregate(sentences, none, add)).alias("chunk", "body"))
