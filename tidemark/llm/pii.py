"""Personal data: pattern spans, and terms that reveal them by information content.

DataFrame functions only. Base spans are e-mail addresses, IP addresses, card
and phone numbers. An entity is the exact value of a span. Everything is
counted in distinct texts, so that copies prove nothing: with n texts, an
entity in e of them has an information content of log2(n / e), and a term (a
lower-cased word of three letters or more) in t of them, b with the entity, has
a mutual information with it of log2(n b / (e t)). A term of which this is at
least `threshold` times the content reveals the entity; at 1, the default,
whoever reads the term knows of the entity, since the term stands in no other
text. Co-occurrence is over whole texts, and a revealing term is a span
wherever it stands in any text.

Such a term is generalised (kind `general`) to its first STEM letters where
all words that begin with them are in so many texts that they fall short of the
threshold; otherwise it is removed (kind `term`). That b texts all hold the
entity by chance has a probability of 2 to the power of -(b times the content).
With as many pairs as there are terms times entities some do so by chance, so
the exponent must reach `evidence` bits and the logarithm of that number;
pairs that don't prove nothing and are left alone, so are entities that all
texts hold. One text proves nothing either, nor do near copies of one: among a
pair's texts at least APART of the four minimum hashes of their words must
differ.

Null text is empty and has no spans. Null ids are kept as they are. Repeated
rows give repeated results and count as one text; empty tables give no rows.
Columns other than those named are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import materialise

#: Of four minimum hashes, how many must not be the same in all of a pair's texts.
APART = 2
KINDS = ("email", "ip", "card", "phone")
#: The patterns in the form that Java runs without backtracking or recursion: possessive loops, and a match can
#: begin inside a run of its characters only where the match before it ended (\G).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kinds of revealing terms: removed, or generalised to this many first letters.
TERM, GENERAL, STEM = "term", "general", 4
WORD = r"[^\x20\x09-\x0D]+"
#: The most frequent terms, a list of this bounded size, are told apart before anything is joined by term.
FREQUENT, FREQUENT_LENGTH = 10000, 64
SPANS = "array<struct<kind:string,start:bigint,stop:bigint,value:string>>"

def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        plain = F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(plain, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def located(text: Column, pattern: str, kind: str, valid=None) -> Column:
    """Array of (kind, start, stop, value) of the pattern's matches, in code points; matches that aren't valid are left out."""
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(match.alias("m"), F.split(text, pattern, -1).alias("p"))
    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        stop = start + F.length(x["m"])
        span = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), stop.alias("stop"), x["m"].alias("value")))
        ok = F.lit(True) if valid is None else valid(kind, x["m"])
        return F.struct(stop.alias("at"), F.when(ok, F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("found"))
    found = F.aggregate(F.filter(pairs, lambda x: x["m"].isNotNull()), start, step, lambda acc: acc["found"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPANS))


def base_spans(text: Column) -> Column:
    """All base spans by kind as in KINDS, then by start."""
    return F.concat(*(located(text, PATTERNS[k], k, _valid) for k in KINDS))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """key, text, base (spans), entities, and sig (four minimum hashes of 16 bits each) of each distinct text."""
    texts = docs.select(_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text")).groupBy("key").agg(F.first("text").alias("text"))
    found = texts.select("key", "text", base_spans(F.col("text")).alias("base"))
    found = found.withColumn("entities", F.array_distinct(F.transform("base", lambda s: F.xxhash64(s["kind"], s["value"]))))
    return found.withColumn("sig", F.when(F.size("entities") > 0, _signature(F.col("text"))).otherwise(0))


def _terms(text: Column) -> Column:
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))), lambda w: w.rlike(r"\p{L}{3}"))


def _signature(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))

    def lane(k: int) -> Column:
        least = F.array_min(F.transform(words, lambda w: F.xxhash64(w, F.lit(k))))
        return F.shiftleft(F.coalesce(least, F.lit(0)).bitwiseAND(F.lit(0xFFFF)), 16 * k)

    return lane(0).bitwiseOR(lane(1)).bitwiseOR(lane(2)).bitwiseOR(lane(3))


def _stem(term: Column) -> Column:
    return F.concat(F.left(term, F.lit(STEM)), F.lit("*"))


def frequencies(texts: DataFrame) -> DataFrame:
    """term, t: the number of texts with each term, and (with a star) with a word of each beginning of STEM letters."""
    own = _terms(F.col("text"))
    return texts.select(F.explode(F.concat(own, F.array_distinct(F.transform(own, _stem)))).alias("term")).groupBy("term").agg(F.count("*").alias("t"))


def _texts_of(live: DataFrame, texts: DataFrame) -> DataFrame:
    """entities, sig, text: the texts that hold entities of `live` (entity, e), with these entities only.

    The most frequent entities, a list of bounded size, are told apart by a broadcast: no other one is a hot key of the join.
    """
    often = materialise(live.orderBy(F.desc("e"), "entity").limit(FREQUENT).select("entity"))
    held = texts.select("key", F.explode("entities").alias("entity"))
    hot = held.join(F.broadcast(often), "entity", "left_semi")
    rest = held.join(F.broadcast(often), "entity", "left_anti").join(live, "entity", "left_semi")
    own = hot.unionByName(rest).groupBy("key").agg(F.collect_list("entity").alias("entities"))
    return texts.drop("entities").join(own, "key").select("entities", "sig", "text")


def revealing_terms(texts: DataFrame, threshold: float = 1.0, evidence: float = 9.0) -> tuple[DataFrame, DataFrame]:
    """(term, general): terms whose mutual information with an entity reaches the threshold, and whether a beginning of theirs doesn't;
    and (term): a bounded list of the most frequent terms, which reveal nothing.

    texts: the rows of distinct_texts().
    """
    n = max(texts.count(), 1)
    counts = materialise(frequencies(texts), clean=True)
    with_entities = texts.where(F.size("entities") > 0)
    entities = with_entities.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("e")).where(F.col("e") < n)
    known = entities.agg(F.max("e").alias("most"), F.count("*").alias("n")).first()
    most = known["most"] or 1
    bits = evidence + math.log2(max(known["n"], 1)) + math.log2(max(counts.count(), 1))
    # b is at most e, so no term of more texts than this reveals anything
    limit = most * (n / most) ** (1 - threshold) * (1 + 1e-9)
    often = materialise(counts.where((F.col("t") > limit) & (F.length("term") <= FREQUENT_LENGTH)).orderBy(F.desc("t"), "term").limit(FREQUENT).select("term"))
    content = F.log2(F.lit(float(n)) / F.col("e"))
    # b is at most e, so no entity of too few texts is revealed by anything, and only texts with another entity have pairs
    live = materialise(entities.where((F.col("e") > 1) & (F.col("e") * content >= bits)), clean=True)
    pairs = _texts_of(live, with_entities).select("entities", "sig", F.explode(_terms(F.col("text"))).alias("term")).join(F.broadcast(often), "term", "left_anti")
    pairs = pairs.select("term", "sig", F.explode("entities").alias("entity"))
    both = pairs.groupBy("entity", "term").agg(F.count("*").alias("b"), F.bit_or("sig").alias("_any"), F.bit_and("sig").alias("_all"))
    differ = F.col("_any").bitwiseXOR(F.col("_all"))
    apart = sum((F.when(F.shiftright(differ, 16 * k).bitwiseAND(F.lit(0xFFFF)) != 0, 1).otherwise(0) for k in range(4)), F.lit(0))
    both = both.where((F.col("b") > 1) & (apart >= APART)).drop("_any", "_all")
    scored = both.join(counts.where(F.col("t") <= limit), "term").join(live, "entity")
    enough = F.lit(threshold) * content - 1e-9
    mutual = F.log2(F.lit(float(n)) * F.col("b") / (F.col("e") * F.col("t")))
    revealing = scored.where((F.col("b") * content >= bits) & (mutual >= enough)).select("term", enough.alias("enough"))
    # every text with the entity may have a word of that beginning: the most that it can reveal
    broader = revealing.withColumn("stem", _stem(F.col("term"))).join(counts.select(F.col("term").alias("stem"), F.col("t").alias("s")), "stem")
    general = (F.log2(F.lit(float(n)) / F.col("s")) < F.col("enough")) & (F.length("term") > STEM)
    return materialise(broader.groupBy("term").agg(F.min(general).alias("general")), clean=True), often


def with_terms(docs: DataFrame, threshold: float = 1.0, evidence: float = 9.0) -> DataFrame:
    """key, base, terms of each distinct text: base spans, and spans of revealing terms that no base span touches."""
    texts = materialise(distinct_texts(docs), clean=True, codec="zstd")
    reveal, often = revealing_terms(texts, threshold, evidence)
    words = texts.select("key", F.explode(_terms(F.col("text"))).alias("term")).join(F.broadcast(often), "term", "left_anti")
    own = words.join(reveal, "term").groupBy("key").agg(F.collect_list(F.struct("term", "general")).alias("reveal"))
    out = texts.join(own, "key", "left")
    kind = F.map_from_entries("reveal")
    terms = F.transform(
        F.filter(located(F.col("text"), WORD, TERM), lambda w: F.map_contains_key(kind, F.lower(w["value"])) & ~F.exists("base", lambda s: (s["start"] < w["stop"]) & (w["start"] < s["stop"]))),
        lambda w: F.struct(F.when(F.try_element_at(kind, F.lower(w["value"])), F.lit(GENERAL)).otherwise(F.lit(TERM)).alias("kind"), w["start"].alias("start"), w["stop"].alias("stop"), w["value"].alias("value")),
    )
    return out.select("key", "base", F.when(F.col("reveal").isNotNull(), terms).otherwise(F.array().cast(SPANS)).alias("terms"))


def with_spans(docs: DataFrame, keep: list[str] | None = None, threshold: float = 1.0, evidence: float = 9.0) -> DataFrame:
    """The columns of docs named in `keep` (all) in a struct `doc`, base and terms: base spans, and spans of revealing terms of each row."""
    texts = with_terms(docs.select("text"), threshold, evidence)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep or docs.columns)).alias("doc"), _key(F.col("text")).alias("key"))
    return rows.join(texts, "key").select("doc", "base", "terms")


def sanitise(text: Column, spans: Column) -> Column:
    """The text with each span replaced: by its kind, or for a generalised term by its beginning; of overlapping spans the first counts."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["value"].alias("value"))))

    def mark(s: Column) -> Column:
        return F.when(s["kind"] == GENERAL, _stem(s["value"])).when(s["kind"] == TERM, F.lit("[REMOVED]")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))

    def step(acc: Column, s: Column) -> Column:
        piece = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        done = F.struct(s["stop"].alias("at"), F.concat(acc["out"], piece, mark(s)).alias("out"))
        return F.when(s["start"] >= acc["at"], done).otherwise(F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), acc["out"].alias("out")))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    rest = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2147483647))))
    return F.when(F.size(spans) > 0, rest).otherwise(text)


def op10(documents: DataFrame) -> DataFrame:
    """One row per document: counts by kind, digest of the base spans, all spans."""
    out = with_spans(documents.select("doc_id", "text"), ["doc_id"])

    def count(spans: str, kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count("base", k) for k in KINDS]
    spans = F.concat("base", "terms")
    return out.select("doc.doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(spans).alias("spans"), count("terms", TERM), count("terms", GENERAL))
