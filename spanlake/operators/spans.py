"""Tag sequences and spans.  Frames hold (doc, idx, label, mask, s, e) or (doc, start, end, type, ...)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.batches import bound_batches
from .charlabels import characters, tokens_of_characters, tokens_of_entities
from .fold import once
from .lists import by_doc


def char_labels(entities: DataFrame, lengths: DataFrame) -> DataFrame:
    """(doc, pos, label) of every labelled character of ``entities(doc, start, end, type, ord)`` within ``lengths(doc, length)``.

    First character B, last E, a single one E, others I; a later entity (by ord) overwrites.  Characters without label are left out.
    """
    return _in_batches(characters, "pos", F.lit(0).cast("long"), **_entity_lists(entities, lengths))


def _entity_lists(entities: DataFrame, lengths: DataFrame) -> dict[str, DataFrame]:
    known = F.col("doc").isNotNull()
    return {"e": entities.filter(known).select("doc", "start", "end", F.upper("type").alias("type"), "ord"), "n": lengths.filter(known).select("doc", "length")}


def _in_batches(work, number: str, like: Column, **frames: DataFrame) -> DataFrame:
    """(doc, number, label) by ``work`` of the lists of each document."""
    rows = by_doc(**frames)
    bound_batches(rows.sparkSession)
    some = next(iter(frames.values())).select("doc", like.alias(number)).schema
    return rows.mapInArrow(work, f"doc {some['doc'].dataType.simpleString()}, {number} {some[number].dataType.simpleString()}, label string")


def label_list(types: DataFrame) -> DataFrame:
    """(id, label): B, I and E of each type in order, O last, of ``types(type)``."""
    rows = types.select(F.upper("type").alias("type")).distinct().withColumn("o", F.lit(0)).select("o", "type", F.posexplode(F.array(*(F.lit(x) for x in "BIE"))).alias("p", "x"))
    rows = rows.select("o", "type", "p", F.concat_ws("-", "x", "type").alias("label")).unionByName(types.sparkSession.range(1).select(F.lit(1).alias("o"), F.lit("").alias("type"), F.lit(0).alias("p"), F.lit("O").alias("label")))
    return rows.select((F.row_number().over(Window.orderBy("o", "type", "p")) - 1).alias("id"), "label")


def _islands(tags: DataFrame) -> tuple[DataFrame, Column]:
    """Tags with ``prefix``, ``type`` and ``new``: whether no run goes on here.  A run is that of a B, I or E."""
    by = Window.partitionBy("doc").orderBy("idx")
    tagged = F.col("label").contains("-")
    rows = tags.withColumn("prefix", F.when(tagged, F.substring_index("label", "-", 1)).otherwise("O")).withColumn("type", F.when(tagged, F.expr("substring(label, instr(label, '-') + 1)")))
    rows = rows.withColumn("before", F.lag("prefix").over(by)).withColumn("before_type", F.lag("type").over(by)).withColumn("after", F.lead("idx").over(by))
    joins = F.col("prefix").isin("I", "E") & F.coalesce(F.col("before").isin("B", "I") & (F.col("before_type") == F.col("type")), F.lit(False))
    return rows.withColumn("new", ~joins), F.col("prefix").isin("B", "I", "E")


def token_spans(tags: DataFrame) -> DataFrame:
    """(doc, type, start, end) in token numbers; closed by E behind it, else where the next unmasked token is, or the end."""
    total = tags.groupBy("doc").agg((F.max("idx") + 1).alias("total"))
    rows, labelled = _islands(tags.filter("mask"))
    rows = rows.withColumn("island", F.sum(F.col("new").cast("int")).over(Window.partitionBy("doc").orderBy("idx")))
    last = F.max_by(F.struct("prefix", "idx", "after"), "idx")
    spans = rows.filter(labelled).groupBy("doc", "type", "island").agg(F.min("idx").alias("start"), last.alias("last")).join(total, "doc")
    end = F.when(F.col("last.prefix") == "E", F.col("last.idx") + 1).otherwise(F.coalesce("last.after", "total"))
    return spans.select("doc", "type", "start", end.alias("end"))


def char_spans(tags: DataFrame) -> DataFrame:
    """(doc, type, start, end) in characters; masked and zero-width tokens say nothing."""
    by = Window.partitionBy("doc").orderBy("idx")
    rows, labelled = _islands(tags.filter("mask and e > s").select("doc", "idx", "label", "s", "e"))
    # An island's first row gives the start, its last the end; both are seen in the rows' order, so nothing is grouped.
    start = F.last(F.when(F.col("new"), F.struct("s")), True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("last", F.coalesce(F.lead("new").over(by), F.lit(True))).withColumn("first", start)
    return rows.filter(labelled & F.col("last")).select("doc", "type", F.col("first.s").alias("start"), F.col("e").alias("end"))


def token_labels(tokens: DataFrame, chars: DataFrame) -> DataFrame:
    """Labels of ``tokens(doc, idx, s, e)`` from ``chars(doc, pos, label)``: the first B, else the last E, else the first I, else O.

    An I without a running entity of its type before it becomes B.
    """
    return _in_batches(tokens_of_characters, "idx", F.col("idx"), t=tokens.select("doc", "idx", "s", "e"), c=chars.filter("doc is not null and pos is not null").select("doc", "pos", "label"))


def entity_token_labels(tokens: DataFrame, entities: DataFrame, lengths: DataFrame) -> DataFrame:
    """``token_labels`` of ``char_labels(entities, lengths)`` in one pass: a text's characters never leave its row."""
    return _in_batches(tokens_of_entities, "idx", F.col("idx"), t=tokens.select("doc", "idx", "s", "e"), **_entity_lists(entities, lengths))


def clip(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """Entities (doc, start, end, type) that overlap ``chunks(doc, chunk, char_start, char_end)``, clipped, in the chunk's offsets."""
    rows = by_doc(e=entities.select("doc", "start", "end", "type"), c=chunks.select("doc", "chunk", "char_start", "char_end")).filter("doc is not null")
    return rows.select("doc", F.explode(_clipped(lambda c: c["chunk"].alias("chunk"), lambda c: c["char_start"])).alias("x")).select("doc", "x.*")


def _clipped(label, origin) -> Column:
    """One text's entities ``e`` as its chunks ``c`` see them: ``label(chunk)``, if given, start and end from ``origin(chunk)`` on, type."""

    def of(c: Column) -> Column:
        s, e = (lambda x: F.greatest(x["start"], c["char_start"])), (lambda x: F.least(x["end"], c["char_end"]))
        met = F.filter("e", lambda x: (x["end"] > c["char_start"]) & (x["start"] < c["char_end"]) & (e(x) > s(x)))
        return F.transform(met, lambda x: F.struct(*([label(c)] if label else []), (s(x) - origin(c)).alias("start"), (e(x) - origin(c)).alias("end"), x["type"].alias("type")))

    return F.flatten(F.transform("c", of))


def merged_clips(entities: DataFrame, chunks: DataFrame, gap: int | None = None) -> DataFrame:
    """``merge_chunks`` of ``clip(entities, chunks)`` in one pass: what the chunks see of a text's entities never leaves its row."""
    rows = by_doc(e=entities.select("doc", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "type"), c=chunks.select("doc", "char_start", "char_end")).filter("doc is not null")
    seen = F.array_distinct(_clipped(None, lambda c: F.lit(0).cast("long")))
    return rows.select("doc", F.explode(seen if gap is None else merged_list(F.array_sort(seen), gap)).alias("m")).select("doc", "m.type", "m.start", "m.end")


def merge_chunks(entities: DataFrame, gap: int | None = None) -> DataFrame:
    """Entities (doc, chunk, char_start, start, end, type) of overlapping chunks, in the text's offsets and once.

    With ``gap``, neighbours of one type no further apart become one; an entity of another type between ends the run.
    """
    rows = entities.select("doc", "type", (F.col("char_start") + F.col("start")).alias("start"), (F.col("char_start") + F.col("end")).alias("end"))
    if gap is None:
        return rows.distinct()
    x = lambda x: F.struct(x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end"), x["type"].alias("type"))
    listed = by_doc(all=rows).select("doc", F.array_sort(F.array_distinct(F.transform("all", x))).alias("all"))
    return listed.select("doc", F.explode(merged_list(F.col("all"), gap)).alias("m")).select("doc", "m.type", "m.start", "m.end")


def merged_list(spans: Column, gap: int) -> Column:
    """Sorted ``spans`` (start, end, type) with neighbours of one type within ``gap`` as one."""
    # The fold carries where runs begin; ends are the highest of a run.
    none = F.expr("named_struct('i', 0, 'type', cast(null as string), 'end', cast(null as bigint), 'starts', cast(array() as array<int>))")

    def add(acc: Column, x: Column) -> Column:
        joins = F.coalesce((acc["i"] > 0) & (acc["type"] == x["type"]) & (x["start"] <= acc["end"] + gap), F.lit(False))
        return F.struct(
            (acc["i"] + 1).alias("i"), x["type"].alias("type"), F.when(joins, F.greatest(acc["end"], x["end"])).otherwise(x["end"]).alias("end"),
            F.when(joins, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["i"]))).alias("starts"),
        )

    def run(own: Column) -> Column:
        first = F.get(own, F.lit(0))
        return F.struct(first["start"].alias("start"), F.array_max(F.transform(own, lambda x: x["end"])).alias("end"), first["type"].alias("type"))

    cut = lambda xs, at: F.transform(at, lambda a, i: once(F.slice(xs, a + 1, F.coalesce(F.get(at, i + 1), F.size(xs)) - a), run))
    return once(spans, lambda xs: once(F.aggregate(xs, none, add, lambda acc: acc["starts"]), lambda at: cut(xs, at)))


def expand_keys(entities: DataFrame, texts: DataFrame, prefixes: DataFrame) -> DataFrame:
    """KEY spans grown to the left by the first of the few ``prefixes(prefix, ord)`` that stands before them in ``texts(doc, body)``."""
    keys = entities.filter("type = 'KEY'").join(texts, "doc").crossJoin(prefixes)
    n = F.length("prefix")
    fits = (F.col("start") >= n) & (F.substring("body", F.col("start") - n + 1, n) == F.col("prefix"))
    first = keys.filter(fits).groupBy("doc", "start", "end").agg(F.min_by(F.length("prefix"), "ord").alias("grow"))
    return entities.join(first.withColumn("type", F.lit("KEY")), ["doc", "start", "end", "type"], "left").withColumn("start", F.col("start") - F.coalesce("grow", F.lit(0))).drop("grow")


def adjust(entities: DataFrame, texts: DataFrame, k: int, chars: str) -> DataFrame:
    """Other spans than KEY grown over at most ``k`` characters of ``chars`` on either side."""
    rows = entities.join(texts, "doc")
    head = F.substring("body", F.greatest(F.col("start") - k, F.lit(0)) + 1, F.least(F.col("start"), F.lit(k)))
    tail = F.substring("body", F.col("end") + 1, F.lit(k))
    left, right = F.length(head) - F.length(F.rtrim(head, F.lit(chars))), F.length(tail) - F.length(F.ltrim(tail, F.lit(chars)))
    other = F.col("type") != "KEY"
    return rows.withColumns({"start": F.when(other, F.col("start") - left).otherwise(F.col("start")), "end": F.when(other, F.col("end") + right).otherwise(F.col("end"))}).drop("body")


def char_to_token(positions: DataFrame, tokens: DataFrame) -> DataFrame:
    """For ``positions(doc, pos)`` the token of ``tokens(doc, idx, s, e)`` it lies in, else the nearest to the left, else to the right."""
    t = tokens.filter("e > s").groupBy("doc").agg(F.collect_list(F.struct("idx", "s", "e")).alias("t"))
    pos = F.col("pos")
    kind = lambda x: F.when((x["s"] <= pos) & (pos < x["e"]), 0).when(x["e"] <= pos, 1).otherwise(2)
    apart = lambda x: F.when((x["s"] <= pos) & (pos < x["e"]), 0).when(x["e"] <= pos, pos - x["e"]).otherwise(x["s"] - pos).cast("long")
    near = F.array_min(F.transform("t", lambda x: F.struct(kind(x).alias("k"), apart(x).alias("d"), x["idx"].alias("idx"))))
    return positions.select("doc", "pos").distinct().join(t, "doc", "left").select("doc", "pos", near["idx"].alias("idx"))


def span_ends(tags: DataFrame) -> DataFrame:
    """(doc, idx, ends): whether an entity ends at the token: an E, or a B or I that the next token doesn't carry on."""
    by = Window.partitionBy("doc").orderBy("idx")
    after = F.lead("label").over(by)
    kind = lambda c: F.substring(c, F.lit(3), F.length(c))
    goes_on = F.coalesce((after.startswith("I-") | after.startswith("E-")) & (kind(after) == kind(F.col("label"))), F.lit(False))
    return tags.select("doc", "idx", (F.col("label").startswith("E-") | ((F.col("label") != "O") & ~goes_on)).alias("ends"))


def best_span(logits: DataFrame, longest: int) -> DataFrame:
    """Best (start, end) of ``logits(doc, chunk, idx, start_logit, end_logit)``: the highest sum, start first, at most ``longest`` tokens."""
    a, b = logits.select("doc", "chunk", F.col("idx").alias("start"), "start_logit"), logits.select("doc", "chunk", F.col("idx").alias("end"), "end_logit")
    pairs = a.join(b, ["doc", "chunk"]).filter((F.col("end") >= F.col("start")) & (F.col("end") < F.col("start") + longest)).withColumn("score", F.col("start_logit") + F.col("end_logit"))
    return pairs.groupBy("doc", "chunk").agg(F.max_by(F.struct("start", "end", "score"), F.struct("score", -F.col("start"), -F.col("end"))).alias("x")).select("doc", "chunk", "x.*")


#: Tokens up to which a short field's span earns a bonus.
BONUS_TOKENS = 8
#: What a span loses at its end once it has been tightened.
SPAN_TAIL = " \t\r\n，。,；;、:：)]）】>》"


def dynamic_spans(logits: DataFrame, top: int = 20, alpha: float = 0.9, longest: int = 128, short_cap: int = 6, boost: float = 0.2) -> DataFrame:
    """(doc, chunk, start, end, score) of logits(doc, chunk, idx, start_logit, end_logit, is_short), one row per context token.

    The ``top`` starts meet the ``top`` ends.  A start's span may be as long as the softmax of the end logits from there on
    takes to reach ``alpha``, ``longest`` at most, ``short_cap`` (or a column ``cap``, if there is one and it is less) in
    short fields; these earn ``boost``, less by an eighth for each token.  The highest score wins, then the first start, then
    the first end.  If no pair fits, the best start goes with the best end within its reach.

    A chunk, which a model's input bounds, is one array; nothing is paired outside of it.
    """
    cap = F.least(F.lit(short_cap), F.coalesce("cap", F.lit(short_cap))) if "cap" in logits.columns else F.lit(short_cap)
    token = F.struct("idx", F.col("start_logit").cast("double").alias("s"), F.col("end_logit").cast("double").alias("e"))
    rows = logits.groupBy("doc", "chunk").agg(F.sort_array(F.collect_list(token)).alias("t"), F.max(F.coalesce("is_short", F.lit(False))).alias("short"), F.min(cap).alias("cap"))
    best = lambda f: F.slice(F.sort_array(F.transform("t", lambda x: F.struct((-x[f]).alias("low"), x["idx"].alias("idx"), x["s"].alias("s"), x["e"].alias("e")))), 1, top)

    def reach(start: Column) -> Column:
        tail = F.transform(F.filter("t", lambda x: x["idx"] >= start["idx"]), lambda x: x["e"])
        high = F.array_max(tail)
        total = F.aggregate(tail, F.lit(0.0), lambda a, e: a + F.exp(e - high))
        none = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
        count = F.aggregate(tail, none, lambda a, e: F.when(a["sum"] / total >= alpha, a).otherwise(F.struct((a["sum"] + F.exp(e - high)).alias("sum"), (a["n"] + 1).alias("n"))), lambda a: a["n"])
        return F.greatest(F.lit(1), F.least(count, F.lit(longest), F.when(F.col("short"), F.col("cap")).otherwise(longest)))

    def scored(start: Column, end: Column) -> Column:
        n = end["idx"] - start["idx"] + 1
        bonus = F.when(F.col("short") & (n <= BONUS_TOKENS), F.lit(boost) * (BONUS_TOKENS - n) / BONUS_TOKENS).otherwise(0.0)
        return F.struct((start["s"] + end["e"] + bonus).alias("score"), (-start["idx"]).alias("start"), (-end["idx"]).alias("end"))

    rows = rows.select("doc", "chunk", "t", "short", "cap", F.transform(best("s"), lambda x: F.struct(x["idx"].alias("idx"), x["s"].alias("s"), reach(x).alias("reach"))).alias("starts"), best("e").alias("ends"))
    near = lambda s, some: F.transform(F.filter(some, lambda e: (e["idx"] >= s["idx"]) & (e["idx"] < s["idx"] + s["reach"])), lambda e: scored(s, e))
    pairs = F.flatten(F.transform("starts", lambda s: near(s, F.col("ends"))))
    first = F.get("starts", F.lit(0))
    within = F.filter("t", lambda x: (x["idx"] >= first["idx"]) & (x["idx"] < first["idx"] + first["reach"]))
    end = F.array_max(F.transform(within, lambda x: F.struct(x["e"].alias("e"), (-x["idx"]).alias("low"))))
    fallback = scored(first, F.struct((-end["low"]).alias("idx"), end["e"].alias("e")))
    x = F.coalesce(F.array_max(pairs), fallback)
    return rows.select("doc", "chunk", x.alias("x")).select("doc", "chunk", (-F.col("x.start")).alias("start"), (-F.col("x.end")).alias("end"), "x.score")


def tightened_spans(spans: DataFrame, tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """``spans(doc, chunk, start, end, ...)`` of tokens with char_start, char_end and text, tightened, and tokens moved after them.

    From tokens(doc, chunk, idx, s, e) and texts(doc, chunk, body).  A span with white space at an edge also loses marks at
    its end; then it starts with the first token that ends behind its start, and ends with the last one that holds its last
    character, else the last before it.
    """
    keys = ["doc", "chunk"]
    listed = tokens.groupBy(keys).agg(F.sort_array(F.collect_list(F.struct("idx", "s", "e"))).alias("t"))
    rows = spans.join(listed, keys).join(texts.select(*keys, "body"), keys)
    of = lambda i: F.get(F.filter("t", lambda x: x["idx"] == F.col(i)), F.lit(0))
    rows = rows.withColumn("s0", of("start")["s"]).withColumn("e0", of("end")["e"])
    value = F.substr("body", F.col("s0") + 1, F.col("e0") - F.col("s0"))
    tight = T.tighten(value, F.col("s0"), F.col("e0"))
    rows = rows.withColumn("x", tight).withColumn("moved", (F.col("x.start") != F.col("s0")) | (F.col("x.end") != F.col("e0")))
    cut = F.rtrim(F.col("x.text"), F.lit(SPAN_TAIL))
    rows = rows.withColumn("char_start", F.col("x.start")).withColumn("char_end", F.when(F.col("moved"), F.col("x.start") + F.length(cut)).otherwise(F.col("x.end")))
    first = F.get(F.filter("t", lambda x: x["e"] > F.col("char_start")), F.lit(0))["idx"]
    inside = F.try_element_at(F.filter("t", lambda x: (x["s"] < F.col("char_end")) & (x["e"] >= F.col("char_end"))), F.lit(-1))["idx"]
    before = F.try_element_at(F.filter("t", lambda x: x["e"] <= F.col("char_end")), F.lit(-1))["idx"]
    start = F.when(F.col("moved"), F.coalesce(first, F.col("start"))).otherwise(F.col("start"))
    end = F.when(F.col("moved"), F.greatest(F.coalesce(inside, before, F.col("end")), start)).otherwise(F.col("end"))
    text = F.substr("body", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    return rows.withColumn("text", text).withColumns({"start": start, "end": end}).drop("t", "body", "s0", "e0", "x", "moved")


#: Field names that don't belong in an answer, and marks at which one is cut short or starts too early.
FIELD_NAMES = ("姓名", "性别", "年龄", "科室", "病区", "床号", "病理号", "住院号", "日期", "时间", "医院")
COLONS, CUT_SHORT = ("：", ":"), ("、", "，")
#: Scores so far apart decide alone; else the lead over the null score counts by this share.
CLEAR_LEAD, MARGIN_SHARE = 1.5, 0.2


def answer_penalty(text: Column) -> Column:
    """What an answer's text costs: under 2 or over 200 characters, a field's name with a colon, a cut end, a colon in front."""
    some = lambda test, marks: reduce(or_, (test(text, F.lit(m)) for m in marks))
    n = F.length(text)
    size = F.when(n < 2, -2.0).when(n > 200, -1.0).otherwise(0.0)
    label = F.when(some(F.contains, COLONS) & some(F.contains, FIELD_NAMES), -1.0).otherwise(0.0)
    return size + label + F.when(some(F.endswith, CUT_SHORT), -0.3).otherwise(0.0) + F.when(some(F.startswith, COLONS), -0.5).otherwise(0.0)


def best_answer(chunks: DataFrame, threshold: float, null: str = "max", quality: bool = False) -> DataFrame:
    """Best chunk answer per document of ``chunks(doc, chunk, start, end, score, null_score)``; no answer if the null score leads by more.

    ``null`` takes the ``max`` or ``mean`` of the chunks' null scores.  With ``quality``, which needs a column ``text``,
    chunks follow each other: one replaces the answer so far if its score is clearly higher, or, where neither's is, if
    score, ``answer_penalty`` and the lead over the null score add up to more.
    """
    if null not in ("max", "mean"):
        raise ValueError(f"null is max or mean, not {null}")
    nulls = (F.max if null == "max" else F.avg)("null_score").alias("null_score")
    if quality:
        rows = chunks.withColumn("penalty", answer_penalty(F.coalesce("text", F.lit("")))).withColumn("lead", F.col("score") - F.coalesce("null_score", F.lit(0)))
        all_ = F.sort_array(F.collect_list(F.struct("chunk", "start", "end", "score", "penalty", "lead")))

        def later(old, new):
            apart = new["score"] - old["score"]
            better = new["score"] + new["penalty"] + (new["lead"] - old["lead"]) * MARGIN_SHARE > old["score"] + old["penalty"]
            return F.when((apart > CLEAR_LEAD) | ((apart >= -CLEAR_LEAD) & better), new).otherwise(old)

        best = rows.groupBy("doc").agg(all_.alias("c"), nulls)
        best = best.select("doc", F.aggregate("c", F.get("c", F.lit(0)), later).alias("x"), "null_score")
        best = best.withColumn("x", F.struct("x.chunk", "x.start", "x.end", "x.score"))
    else:
        best = chunks.groupBy("doc").agg(F.max_by(F.struct("chunk", "start", "end", "score"), F.struct("score", -F.col("chunk"))).alias("x"), nulls)
    return best.select("doc", "x.*", "null_score", (F.col("null_score") - F.col("x.score") > threshold).alias("no_answer"))


def located(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, key, start, end) of the first place of ``wanted(doc, key, value)`` in ``texts(doc, body)``, tightened; -1, -1 if missing."""
    rows = wanted.join(texts, "doc")
    at = F.expr("instr(body, value)") - 1
    span = T.tighten(F.col("value"), at, at + F.length("value"))
    found = (at >= 0) & (F.col("value") != "")
    pick = lambda c: F.when(found, span[c]).otherwise(F.lit(-1))
    return rows.select("doc", "key", pick("start").alias("start"), pick("end").alias("end"))


#: Characters of a short item that texts are searched by, at most.
HEAD = 8


def found_anywhere(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item, doc, start, end): the first place of each of ``items(item, value)`` in the texts of ``docs(doc, body)`` that hold it.

    An item of three or more parts between spaces is looked for by its longest inner one, which is a part of any text
    that holds the item; shorter ones by their first characters.  Candidates are pairs of ids; texts are fetched for
    these only.  Empty and null items are found nowhere.
    """
    parts = F.split("value", " ")
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    keyed = items.filter("value <> ''").select("item", "value", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"].alias("w"))
    long, short = keyed.filter("w is not null"), keyed.filter("w is null").withColumn("w", F.left("value", F.lit(HEAD)))
    pairs = docs.select("doc", F.explode(F.array_distinct(F.split("body", " "))).alias("w")).join(long.select("w", "item"), "w").select("doc", "item")
    for (n,) in sorted(short.select(F.length("w")).distinct().collect()):  # HEAD rows at most
        heads = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("body") - n + 1), lambda i: F.substr("body", i, F.lit(n))))
        at = docs.filter(F.length("body") >= n).select("doc", F.explode(heads).alias("w"))
        pairs = pairs.union(at.join(short.filter(F.length("w") == n).select("w", "item"), "w").select("doc", "item"))
    rows = pairs.distinct().join(items, "item").join(docs, "doc").filter(F.contains("body", F.col("value"))).withColumn("start", F.expr("instr(body, value)") - 1)
    return rows.select("item", "doc", "start", (F.col("start") + F.length("value")).alias("end"))
