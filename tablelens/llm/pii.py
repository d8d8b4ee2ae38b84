"""Personal data: fixed patterns, and context terms that reveal the entities found, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.common import SPACE
from tablelens.session import cut_lineage

# What is searched for, each as one linear pass. A match always starts where its run of
# characters starts (or right behind the match before), so look-behinds and possessive repeats change
# no match; cards below 13 digits fail anyway and are skipped at once.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried.
HINTS = {"email": "@", "phone": "+"}
BYTE = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
TERM = r"[\p{L}\p{M}\p{N}]+"

#: Smoothing: a term's documents count with so many more that hold the entity at its rate in the whole table.
PRIOR = 1
#: Spans that are appended one by one to a list.
CHUNK = 256
#: Shares of an entity's information that a term may give away: generalised from the first, removed from the second.
GENERALISE, REMOVE = 0.8, 0.95


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    back = F.reverse(_digits(value))
    at = F.sequence(F.lit(1), F.length(back))
    digit = lambda i: F.substr(back, i, F.lit(1)).cast("int")
    twice = lambda i: 2 * digit(i) - F.when(digit(i) > 4, 9).otherwise(0)
    return F.aggregate(at, F.lit(0), lambda s, i: s + F.when(i % 2 == 0, twice(i)).otherwise(digit(i))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_like(p, F.lit(BYTE)))
    if kind == "card":
        n = F.length(_digits(value))
        return F.when((n >= 13) & (n <= 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _spans(kind: str, text: Column) -> Column:
    """All valid matches of one kind: start and end in code points, end exclusive, and the text matched."""
    pattern = PATTERNS[kind]
    steps = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.char_length(pair["gap"])
        end = begin + F.coalesce(F.char_length(pair["value"]), F.lit(0))
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), pair["value"].alias("value"))
        keep = pair["value"].isNotNull() & _valid(kind, pair["value"])
        return F.struct(end.alias("at"), F.when(keep, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    def line(some: Column, at: Column) -> Column:
        return F.aggregate(some, F.struct(at.alias("at"), none.alias("spans")), step, lambda state: state["spans"])

    def chunks(every: Column) -> Column:
        """Appending copies a list, so a long one is made of chunks whose places are known from their lengths."""
        chunk = lambda number: F.slice(every, number * CHUNK + 1, F.lit(CHUNK))
        wide = lambda number: F.aggregate(chunk(number), F.lit(0), lambda n, p: n + F.char_length(p["gap"]) + F.coalesce(F.char_length(p["value"]), F.lit(0)))
        numbers = F.sequence(F.lit(0), ((F.size(every) - 1) / CHUNK).cast("int"))
        nowhere = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        begins = F.aggregate(numbers, nowhere, lambda s, number: F.struct((s["at"] + wide(number)).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"])
        return F.flatten(F.zip_with(numbers, begins, lambda number, at: line(chunk(number), at)))

    located = F.transform(F.array(steps), lambda every: F.when(F.size(every) <= CHUNK, line(every, F.lit(0))).otherwise(chunks(every)))[0]
    worth = F.contains(text, F.lit(HINTS[kind])) if kind in HINTS else F.regexp_like(text, F.lit(pattern))
    return F.when(worth, located).otherwise(none)


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _row, _text, base``: the pattern spans of every row by kind, then place. ``_row`` tells texts of one id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_row"), text.alias("_text"))
    # exploded, so that a filter on the spans doesn't search a text once more
    return rows.select("*", F.explode(F.array(F.concat(*[_spans(kind, F.col("_text")) for kind in PATTERNS]))).alias("base"))


def term_key(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def _terms(text: Column) -> Column:
    """The distinct terms of a whole text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), term_key))


def document_frequency(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``term, c_t``: in how many rows each term occurs, over all whole texts. Terms are 64-bit hashes of lower-case words."""
    terms = docs.select(F.explode(_terms(F.coalesce(F.col(text_col), F.lit("")))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("c_t"))


def _entities(base: Column) -> Column:
    """The distinct entities of a row's pattern spans."""
    return F.array_distinct(F.transform(base, lambda b: F.xxhash64(b["kind"], F.lower(b["value"]))))


def _same_row(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on row keys, of which the id may be null; ``right`` names them ``_rid`` and ``_rrow``."""
    return left.join(right, F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_row") == F.col("_rrow")), how).drop("_rid", "_rrow")


def _term_spans(held: DataFrame, terms: DataFrame) -> DataFrame:
    """``_id, _row, added``: all places of the given ``terms`` (``_rid, _rrow, term, kind``) of a text, outside base spans, in code points.

    Words and base spans of a text stand in one line, a row each. Running sums give the places, a running maximum of the base spans'
    ends says which words are free; so long texts with many spans cost in proportion, and a text is never one value that grows by copies.
    """
    words, gaps = F.regexp_extract_all("_text", F.lit(TERM), F.lit(0)), F.split("_text", TERM, -1)
    chosen = _same_row(held, terms.select("_rid", "_rrow").distinct(), "leftsemi")
    line = chosen.select("_id", "_row", "base", F.posexplode(F.arrays_zip(gaps.alias("gap"), words.alias("word"))).alias("place", "pair"))
    length = F.coalesce(F.char_length("pair.word"), F.lit(0))
    step = F.char_length("pair.gap") + length
    upto = F.sum("step").over(Window.partitionBy("_id", "_row").orderBy("place"))
    line = line.select("_id", "_row", "place", step.alias("step"), length.alias("n"), term_key(F.col("pair.word")).alias("term")).withColumn("stop", upto).filter("term is not null")
    line = line.select("_id", "_row", "stop", (F.col("stop") - F.col("n")).alias("start"), "term", F.lit(None).cast("long").alias("until"))
    base = chosen.select("_id", "_row", F.explode("base").alias("b")).select("_id", "_row", F.col("b.start").cast("long").alias("stop"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("term"), F.col("b.end").cast("long").alias("until"))
    # a base span covers words that stop behind its start: at equal places the word comes first
    order = Window.partitionBy("_id", "_row").orderBy("stop", F.col("until").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    free = line.unionByName(base).withColumn("covered", F.max("until").over(order)).filter("term is not null and (covered is null or covered <= start)")
    keyed = terms.select("_rid", "_rrow", F.col("term").alias("_term"), "kind")
    hit = free.join(keyed, F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_row") == F.col("_rrow")) & (F.col("term") == F.col("_term")))
    span = F.struct("kind", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("end"))
    return hit.groupBy("_id", "_row").agg(F.array_sort(F.collect_list(span)).alias("added"))


def risky_terms(docs: DataFrame, held: DataFrame, text_col: str = "text", *, prior: float = PRIOR, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``_id, _row, entity, term, kind``: the terms of a text that give away too much of an entity in the same text.

    A term discloses the share PMI(term; entity) / IC(entity) of the entity's information, with
    PMI = log(p(entity | term) / p(entity)), IC = -log p(entity) and p(entity) = c_e / N. N rows, the rows c_e with
    the entity, c_t with the term and c_te with both are all counted over whole texts of the whole table, in rows: rows
    that repeat id and text are one text with a multiplicity, so that c_te is never above c_e or c_t.
    Every entity is judged from its first row on: p(entity | term) = (c_te + prior p(entity)) / (c_t + prior) leans
    towards p(entity) where a term is rare, so one chance meeting tells less than many.

    What occurs in one text alone meets the same things as its neighbours that do so too. Such entities of a text are one entity
    here, and such terms one term until they are judged, so a long text makes pairs only of what it shares with others.
    """
    rows = docs.count()
    rate = F.col("c_e") / rows

    def share(c_te: Column) -> Column:
        return F.try_divide(F.ln((c_te + prior * rate) / (F.col("c_t") + prior) / rate), -F.ln(rate))

    texts = held.groupBy("_id", "_row").agg(F.count(F.lit(1)).alias("n"), F.first("base").alias("base"), F.first("_text").alias("_text"))
    own = F.xxhash64(F.lit("own"), "_id", "_row")
    entities = texts.select("_id", "_row", "n", F.explode(_entities(F.col("base"))).alias("entity"))
    frequency = entities.groupBy("entity").agg(F.sum("n").alias("c_e"))
    # c_te is at most c_e, so a share of ``generalise`` bounds c_t: terms above the bound of the most frequent entity are settled, and no pair is lost
    most = (frequency.agg(F.max("c_e")).first()[0] or 0) / max(rows, 1)
    bound = (most * rows + prior * most) / most ** (1 - generalise) if most else 0
    entities = entities.join(frequency, "entity").withColumn("entity", F.when(F.col("c_e") == F.col("n"), own).otherwise(F.col("entity"))).distinct()
    terms = texts.select("_id", "_row", "n", F.explode(_terms(F.col("_text"))).alias("term"))
    terms = terms.join(document_frequency(docs, text_col).filter(F.col("c_t") <= bound), "term")
    terms = cut_lineage(terms.withColumn("as", F.when(F.col("c_t") == F.col("n"), own).otherwise(F.col("term"))))
    meeting = terms.select(F.col("_id").alias("_rid"), F.col("_row").alias("_rrow"), F.col("as").alias("term"), "c_t").distinct()
    met = _same_row(entities, meeting).filter(share(F.least("c_e", "c_t")) >= generalise)
    met = cut_lineage(met.select("_id", "_row", "n", "entity", "term", "c_e", "c_t"))
    together = met.groupBy("entity", "term").agg(F.sum("n").alias("c_te"), F.first("c_e").alias("c_e"), F.first("c_t").alias("c_t")).withColumn("share", share(F.col("c_te")))
    risky = together.filter(F.col("share") >= generalise).select("entity", "term", F.when(F.col("share") >= remove, "remove").otherwise("generalise").alias("kind"))
    found = met.join(risky, ["entity", "term"]).select(F.col("_id").alias("_rid"), F.col("_row").alias("_rrow"), "entity", F.col("term").alias("as"), "kind")
    named = terms.select("_id", "_row", "term", F.col("as").alias("_as"))
    named = named.join(found, F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_row") == F.col("_rrow")) & (F.col("_as") == F.col("as")))
    return named.select("_id", "_row", "entity", "term", "kind").distinct()


def disclosing_terms(docs: DataFrame, found: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``_id, _row, added``: every place of the ``risky_terms`` in every text that holds their entity, however far from it."""
    held = cut_lineage(found.filter(F.size("base") > 0).repartition("_id", "_row"))
    risky = risky_terms(docs, held, text_col, **options).groupBy(F.col("_id").alias("_rid"), F.col("_row").alias("_rrow"), "term").agg(F.max("kind").alias("kind"))
    return _term_spans(held.dropDuplicates(["_id", "_row"]), cut_lineage(risky))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: ``id_col, base, added, text``.

    ``base`` holds the spans of e-mail addresses, IP addresses, card and phone numbers (kind, start, end in code
    points, value); ``added`` the spans of terms to generalise or remove. A null text counts as empty and
    has none. Null ids take part; rows that repeat id and text count like any other and get the same answer.
    An empty table gives an empty result.
    """
    found = base_spans(docs, id_col, text_col)
    terms = disclosing_terms(docs, found, text_col, **options).select(F.col("_id").alias("_rid"), F.col("_row").alias("_rrow"), F.array_sort("added").alias("added"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    out = _same_row(found, terms, "left")
    return out.select(F.col("_id").alias(id_col), "base", F.coalesce("added", none).alias("added"), F.col("_text").alias(text_col))


def sanitised(text_col: str = "text") -> Column:
    """The text of a ``personal_data`` row with entities and generalised terms replaced by their kind and removed terms left out; empty texts stay empty."""
    spans = F.array_sort(F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("put"))),
        F.transform("added", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["kind"] == "remove", "").otherwise("[TERM]").alias("put"))),
    ))
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        new = s["start"] >= state["at"]
        piece = F.concat(F.substr(text, state["at"] + 1, s["start"] - state["at"]), s["put"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(new, F.concat(state["out"], F.array(piece))).otherwise(state["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substr(text, s["at"] + 1, F.char_length(text))))
