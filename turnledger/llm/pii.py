"""Personal data: fixed kinds by pattern, and terms that disclose them by corpus co-occurrence. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.llm.common import id_and_text, let
from turnledger.llm.spans import find_spans
from turnledger.session import materialize

# Possessive loops run without recursion, and a match starts where a run of its characters starts (or the last match
# ended), so long runs stay linear. Neither changes what matches.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
SUPPORT = 3  # different texts that must hold a term and an entity before the term can count as disclosing
PRIOR = 1.0  # documents with the term alone that are assumed unseen; shrinks the estimate of rare terms
ALPHA = 1.25  # a term discloses an entity if its information about it is at least this part (1 / alpha) of the entity's own
SALTS = 16
TERM = r"\p{L}++"  # a whole run of letters
NO_TERM = r"\P{L}++"  # what lies between terms


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        digit = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, digit).otherwise(digit * 2 - F.when(digit > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda total, i: total + value(i)) % 10 == 0


def _holds(kind: str, found: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255))
    if kind == "card":
        return let(_digits(found), lambda d: F.length(d).between(16, 19) & luhn(d))
    if kind == "phone":
        return F.length(_digits(found)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Spans of one fixed kind; matches that fail its check are dropped. Cheap tests keep most texts from the patterns."""
    pattern = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}[kind]
    gate = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike("[0-9]"))
    spans = F.filter(find_spans(text, pattern), lambda s: _holds(kind, s["found"]))
    return F.when(gate, spans).otherwise(F.array().cast("array<struct<start: bigint, end: bigint, found: string>>"))


def outside_entities(text: Column) -> Column:
    """The text with a blank for every character of an address, the one kind with letters; places stay."""
    blanks = F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), lambda m: F.repeat(F.lit(" "), F.length(m)))
    pieces = F.zip_with(F.split(text, EMAIL, -1), blanks, lambda gap, blank: F.concat(gap, F.coalesce(blank, F.lit(""))))
    return F.when(F.contains(text, F.lit("@")), F.array_join(pieces, "")).otherwise(text)


def distinct_terms(text: Column) -> Column:
    """Terms of a whole text in lower case, each once."""
    runs = F.array_distinct(F.array_remove(F.split(outside_entities(text), NO_TERM, -1), ""))
    return F.array_distinct(F.transform(runs, F.lower))


def group_of(kind: str, found: Column) -> Column:
    """What a value shares with others of its owner: domain of an address, network of an ip, first digits of a number."""
    if kind == "email":
        return F.substring_index(found, "@", -1)
    if kind == "ip":
        return F.substring_index(found, ".", 2)
    return F.substring(_digits(found), 1, 6 if kind == "card" else 5)


def _entities(kind: str) -> Column:
    """The values of one kind and the groups that they belong to."""
    values = F.transform(kind, lambda s: F.lower(s["found"]))
    return F.concat(F.transform(values, lambda v: F.concat(F.lit(kind + ":"), v)),
                    F.transform(values, lambda v: F.concat(F.lit(kind + " group:"), group_of(kind, v))))


def _written(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Fixed kinds of every whole text; the entities and terms of texts that hold any. Written once."""
    rows = id_and_text(docs, id_col, text_col)
    for kind in KINDS:
        rows = rows.withColumn(kind, base_spans(F.col("text"), kind))
    some = F.size(F.concat(*KINDS)) > 0
    return materialize(rows.select(
        "doc_id", F.md5(F.col("text").cast("binary")).alias("text_key"),
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.concat(*[_written(kind, F.col(kind)) for kind in KINDS]).alias("base"),
        F.when(some, F.array_distinct(F.concat(*[_entities(kind) for kind in KINDS]))).alias("entities"),
        F.when(some, distinct_terms(F.col("text"))).alias("words")), "pii-scan")


def disclosing_terms(docs: DataFrame, scanned: DataFrame, text_col: str, support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """``(entity, term, pmi, own)``: terms whose pointwise mutual information with an entity exceeds the threshold.

    Shares are of documents, over whole texts of the whole corpus: with the entity, with the term, with both. The
    support counts different texts, as copies are no evidence of their own. An entity is a value or the group it
    belongs to. The information of the entity is ``own = log2(N / n_entity)``; a term that occurs only with it reveals
    nearly all of it, the more documents the nearer.

    Equal texts count together, and entities below the support go before they meet terms, as no term can reach it with
    them. A common entity is dealt over ``SALTS`` places; pairs are added up in every task before they are shuffled.
    """
    total = scanned.count()
    texts = scanned.where("entities is not null").groupBy("text_key").agg(
        F.count(F.lit(1)).alias("copies"), F.first("entities").alias("entities"), F.first("words").alias("words"))
    texts = materialize(texts, "pii-texts")
    different, documents = F.count(F.lit(1)).alias("n_texts"), F.sum("copies")
    held = texts.select("text_key", "copies", F.explode("entities").alias("entity"))
    entities = held.groupBy("entity").agg(different, documents.alias("n_entity")).where(F.col("n_texts") >= support).drop("n_texts")
    dealt = entities.select("entity", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    held = held.withColumn("salt", F.pmod(F.xxhash64("text_key"), F.lit(SALTS))).join(dealt, ["entity", "salt"], "left_semi")
    pairs = held.select("text_key", "copies", "entity").join(texts.select("text_key", "words"), "text_key").select(
        "entity", "copies", F.explode("words").alias("term"))
    pairs = pairs.groupBy("entity", "term").agg(different, documents.alias("n_both")).where(F.col("n_texts") >= support)
    found = distinct_terms(F.coalesce(F.col(text_col), F.lit("")))
    terms = docs.select(F.explode(found).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    joined = pairs.join(terms, "term").join(entities, "entity")
    own = F.log2(F.lit(float(total)) / F.col("n_entity"))
    pmi = F.log2(F.lit(float(total)) * F.col("n_both") / ((F.col("n_term") + PRIOR) * F.col("n_entity")))
    return joined.select("entity", "term", pmi.alias("pmi"), own.alias("own")).where(F.col("pmi") * alpha >= F.col("own"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """One row per document: counts and spans of the fixed kinds, and the spans of terms that disclose them.

    ``base`` lists the fixed spans as ``kind:start:end`` by kind (email, ip, card, phone), then start; ``terms`` lists
    ``term:start:end`` by start. Places count code points, ends are exclusive. A term that discloses any entity is
    listed wherever it stands, also in documents without the entity; letters of an address are no terms.

    A null text counts as empty and has no spans. Rows that repeat a key and a text get the same answer; null keys
    are kept. An empty table gives an empty result; other columns are left out.
    """
    scanned = scan(docs, id_col, text_col)
    told = materialize(disclosing_terms(docs, scanned, text_col, support, alpha).select("term").distinct(), "pii-told")
    rows = id_and_text(docs, id_col, text_col).select(
        F.col("doc_id").alias("_id"), F.md5(F.col("text").cast("binary")).alias("_key"), "text")
    named = rows.select("_key", F.explode(distinct_terms(F.col("text"))).alias("term")).join(told, "term", "left_semi")
    named = materialize(named.groupBy("_key").agg(F.collect_set("term").alias("told")), "pii-named")
    spans = F.filter(find_spans(outside_entities(F.col("text")), TERM), lambda s: F.array_contains("told", F.lower(s["found"])))
    marks = rows.select("_key", "text").dropDuplicates(["_key"]).join(named, "_key").select("_key", F.transform(
        spans, lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["end"])).alias("terms"))
    joined = scanned.join(marks, F.col("text_key") == F.col("_key"), "left")
    return joined.select("doc_id", "text_key", *[f"n_{kind}" for kind in KINDS], "base",
                         F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(doc_id, text)``: every found span is generalised to its kind in brackets; overlapping spans become one."""
    rows = id_and_text(docs, id_col, text_col)
    marks = find(docs, id_col, text_col, **options).where((F.size("base") > 0) | (F.size("terms") > 0)).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.concat("base", "terms").alias("marks")).dropDuplicates(["_id", "_key"])
    joined = rows.join(marks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.md5(F.col("text").cast("binary")) == F.col("_key")), "left")
    spans = F.array_sort(F.transform(F.coalesce("marks", F.array().cast("array<string>")), lambda m: F.struct(
        F.split(m, ":")[1].cast("int").alias("start"), F.split(m, ":")[2].cast("int").alias("end"), F.split(m, ":")[0].alias("kind"))))
    text = F.col("text")

    def step(done: Column, s: Column) -> Column:
        apart = s["start"] >= done["at"]
        grown = F.concat(done["out"], F.substring(text, done["at"] + 1, s["start"] - done["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.when(apart, grown).otherwise(done["out"]).alias("out"), F.greatest(done["at"], s["end"]).alias("at"))

    end = F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step,
                      lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))
    return joined.select("doc_id", end.alias("text"))
