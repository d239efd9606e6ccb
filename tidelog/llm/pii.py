"""Personal data: patterns find protected entities, corpus co-occurrence finds the terms that give them away. DataFrame operations only.

Base spans are leftmost non-overlapping matches per kind: e-mail, IP, card (Luhn) and phone numbers; a match that fails its test is
dropped. Secrets (access keys, and values assigned to a name such as ``password``) are protected entities too, with spans of their own.
Terms are runs of four letters or more that overlap no entity. Over all documents and their whole texts, a term t discloses
an entity e (kind and value) by log2(P(e | t) / P(e)) bits, with P(e | t) the share of the documents that hold t which hold e too. A term
whose disclosure and share reach ``BITS`` and ``SHARE``, seen with e in ``SUPPORT`` documents or more, is a span of its own wherever it
stands in any document. Sanitising puts a kind's mark in place of a span: entities are generalised to their kind, terms to ``[TERM]``.

Each text is searched once, for its entities and the 64-bit hashes by which its terms are known from there on. Document counts of terms
are taken over all documents and terms, summed in each task before they are shuffled. Terms are paired with an
entity only where it is in ``SUPPORT`` documents and rare enough that some term could reach ``BITS``, which loses nothing; copies of
a text are one row with a count, so a large group of them is paired once.

Defined cases: null and empty texts have no spans; rows of one id and one text get the same spans; a null id is an id of its own; other
columns are left out of tables of spans and kept by ``sanitise``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Scope, written

KINDS = ("email", "ip", "card", "phone", "term", "secret")
#: Patterns of the kinds. Runs are entered at their start or where a match has ended, and repeats give nothing back, which changes
#: no match (what follows a repeat is never one of its own characters) and keeps long runs linear and off the stack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Public forms of access keys, and a value with a digit that is assigned to a telling name.
KEYS = ("AKIA", "ASIA", "ghp_", "gho_")
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey", "api-key")
SECRET = rf"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{{16}}|gh[po]_[A-Za-z0-9]{{36}})(?![A-Za-z0-9])|(?i:{'|'.join(NAMES)})[\x22']?\x20{{0,2}}[=:]\x20{{0,2}}[\x22']?(?=[A-Za-z+/_-]{{0,64}}[0-9])[A-Za-z0-9+/_-]{{8,}}+"
TERM = r"\p{L}{4,}+"
PART = r"0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Stands for base spans while terms are sought; no character of a text. A run of letters that touches it overlaps a base span.
HIDDEN = "\uffff"
APART = rf"(?<![\p{{L}}{HIDDEN}])\p{{L}}{{4,}}+(?!{HIDDEN})"
SHARE, BITS, SUPPORT = 0.5, 4.0, 3
SPAN = "struct<start:int,kind:int,end:int,value:string>"


def located(text: Column, pattern: str, kind: int, valid, offset: Column | None = None) -> Column:
    """The matches of a pattern as an array of spans (code points, end exclusive), kept if ``valid(match)``."""
    zipped = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m")))
    start = F.struct((F.lit(0) if offset is None else offset).cast("int").alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(s: Column, x: Column) -> Column:
        at = s["at"] + x["gap"]
        end = at + F.length(x["m"])
        span = F.struct(at.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("value"))
        return F.struct(F.coalesce(end, s["at"]).alias("at"), F.when(x["m"].isNotNull() & valid(x["m"]), F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(zipped, start, step)["spans"]


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind. Texts without the mark of a kind are not searched for it."""
    none = F.array().cast(f"array<{SPAN}>")
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
    email = F.when(F.contains(text, F.lit("@")), located(text, EMAIL, 0, lambda m: F.lit(True))).otherwise(none)
    ip = F.when(F.rlike(text, F.lit(r"[0-9]\.[0-9]")), located(text, IP, 1, lambda m: F.rlike(m, F.lit(rf"^{PART}(?:\.{PART}){{3}}$")))).otherwise(none)
    card = F.when(F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){11}")), located(text, CARD, 2, lambda m: F.length(digits(m)).between(12, 19) & F.call_function("luhn_check", digits(m)))).otherwise(none)
    phone = F.when(F.contains(text, F.lit("+")), located(text, PHONE, 3, lambda m: F.length(digits(m)).between(9, 15))).otherwise(none)
    return F.coalesce(F.array_sort(F.concat(email, ip, card, phone)), none)


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (F.contains(text, F.lit(p)) for p in parts))


def entity_spans(text: Column) -> Column:
    """Base spans and secrets, by start, then kind."""
    none = F.array().cast(f"array<{SPAN}>")
    assigned = any_of(text, ("=", ":")) & any_of(F.lower(text), NAMES)
    secrets = F.when(any_of(text, KEYS) | assigned, located(text, SECRET, 5, lambda m: F.lit(True))).otherwise(none)
    return F.array_sort(F.concat(base_spans(text), F.coalesce(secrets, none)))


def of_base(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] < 4)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def entities_of(spans: Column) -> Column:
    """The distinct entities of spans."""
    return F.array_distinct(F.transform(spans, lambda s: F.xxhash64(s["kind"], F.lower(s["value"]))))


def term_key(term: Column) -> Column:
    """What a term is known by: a 64-bit hash of it in small letters."""
    return F.xxhash64(F.lower(term))


def terms_of(text: Column, entities: Column) -> Column:
    """The keys of the distinct terms of a text."""
    hidden = F.when(F.size(entities) > 0, replaced(text, entities, F.lit(HIDDEN))).otherwise(text)
    found = F.array_distinct(F.regexp_extract_all(hidden, F.lit(APART), F.lit(0)))
    return F.array_distinct(F.transform(found, lambda t: term_key(t)))


def overlaps(spans: Column, t: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, found, terms): the entity spans and the distinct terms of each row, written to the shared folder. Texts are searched here once."""
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    spanned = docs.withColumn("found", entity_spans(F.col("text")))
    return written(spanned.select("id", "th", "found", terms_of(F.col("text"), F.col("found")).alias("terms")), "pii")


def disclosing_terms(found: DataFrame) -> DataFrame:
    """(term): the distinct terms that disclose an entity."""
    n = found.agg(F.count("*").cast("double").alias("n"))
    # one row per text, ``times`` its rows and ``documents`` those of different ids
    once = found.where(F.size("found") > 0).groupBy("id", "th").agg(F.count("*").alias("times"), F.first(entities_of(F.col("found"))).alias("entities"), F.first("terms").alias("terms"))
    held = once.groupBy("th").agg(F.sum("times").alias("times"), F.count("*").alias("documents"), F.first("entities").alias("entities"), F.first("terms").alias("terms"))
    with Scope() as tables:
        held = written(held, "held")
        each = held.select("th", "times", "documents", F.explode("entities").alias("entity"))
        entities = each.groupBy("entity").agg(F.sum("times").alias("with_entity"), F.sum("documents").alias("documents"))
        # a share is 1 at most: a more frequent entity is given away by no term
        likely = entities.where((F.col("documents") >= SUPPORT) & (F.log2(n.scalar() / F.col("with_entity")) >= BITS))
        likely = written(likely.select("entity", "with_entity"), "entities")
        together = each.join(likely, "entity").select("th", "times", "documents", "entity", "with_entity").join(held.select("th", "terms"), "th").select("entity", "with_entity", "times", "documents", F.explode("terms").alias("term"))
        together = together.groupBy("entity", "with_entity", "term").agg(F.sum("documents").alias("documents"), F.sum("times").alias("both")).where(F.col("documents") >= SUPPORT)
        together = written(together, "together")
        # the documents that hold each term: one row per document and distinct term, summed in every task before it is shuffled
        counts = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("with_term"))
        share = F.col("both") / F.col("with_term")
        scored = together.join(counts, "term").where((share >= SHARE) & (F.log2(share * n.scalar() / F.col("with_entity")) >= BITS))
        return tables.keep(written(scored.select("term").distinct(), "disclosing"))


def term_spans(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, terms): for rows that have them, the spans of disclosing terms."""
    with Scope() as tables:
        disclosing = disclosing_terms(found)
        docs = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
        each = found.select("id", "th", F.explode("terms").alias("term"))
        holding = written(each.join(disclosing, "term").groupBy("id", "th").agg(F.collect_set("term").alias("__held")), "holding").toDF("__id", "__th", "__held")
        marked = docs.join(holding, docs["id"].eqNullSafe(holding["__id"]) & (docs["th"] == holding["__th"])).withColumn("found", entity_spans(F.col("text")))
        spans = F.filter(located(F.col("text"), TERM, 4, lambda m: F.array_contains("__held", term_key(m))), lambda t: ~overlaps(F.col("found"), t))
        return tables.keep(written(marked.select("id", "th", spans.alias("terms")).groupBy("id", "th").agg(F.first("terms").alias("terms")), "terms"))


def spans_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans) of every row: arrays of spans, the second with secrets and disclosing terms."""
    found = find(df, id_col, text_col)
    terms = term_spans(df, found, id_col, text_col).withColumnRenamed("id", "__id").withColumnRenamed("th", "__th")
    found = found.select("id", "th", "found")
    joined = found.join(terms, found["id"].eqNullSafe(terms["__id"]) & (found["th"] == terms["__th"]), "left")
    everything = F.array_sort(F.concat("found", F.coalesce(terms["terms"], F.array().cast(f"array<{SPAN}>"))))
    return joined.select(F.col("id").alias(id_col), of_base(F.col("found")).alias("base"), everything.alias("spans"))


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, counts per base kind, ``base_sha256``, ``spans``, ``n_term``, ``n_secret`` and ``n_private`` (all spans) of every row."""
    spans = spans_of(df, id_col, text_col)
    count = lambda k, of="base": F.size(F.filter(of, lambda s: s["kind"] == k)).cast("long")
    return spans.select(id_col, *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), count(4, "spans").alias("n_term"), count(5, "spans").alias("n_secret"), F.size("spans").cast("long").alias("n_private"))


def replaced(text: Column, spans: Column, mark: Column | None = None) -> Column:
    """The text with a mark in place of each span, that of its kind if none is given; overlapping spans get the mark of the first."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("pieces"))

    def step(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["at"]
        piece = F.array(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.get(marks, x["kind"]) if mark is None else mark)
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(fresh, F.concat(s["pieces"], piece)).otherwise(s["pieces"]).alias("pieces"))

    return F.aggregate(spans, start, step, lambda s: F.concat(F.array_join(s["pieces"], ""), F.substring(text, s["at"] + 1, F.length(text))))


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with marks in place of all spans of ``text_col``. Rows without spans stay as they are."""
    terms = term_spans(df, find(df, id_col, text_col), id_col, text_col).select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("terms").alias("__terms"))
    keyed = df.withColumn("__key", F.xxhash64(F.col(text_col)))
    joined = keyed.join(terms, keyed[id_col].eqNullSafe(terms["__id"]) & (keyed["__key"] == terms["__th"]), "left")
    none = F.array().cast(f"array<{SPAN}>")
    spanned = joined.withColumn("__spans", F.array_sort(F.concat(entity_spans(F.col(text_col)), F.coalesce("__terms", none))))
    text = F.when(F.size("__spans") > 0, replaced(F.col(text_col), F.col("__spans"))).otherwise(F.col(text_col))
    return spanned.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])
