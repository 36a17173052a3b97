"""Secrets: pattern spans, and how many owners hold each candidate in the whole corpus.

DataFrame functions only. Base spans are assignments of a value to a word for
a secret, access keys and long hexadecimal strings; what each guards is its
value (for an assignment what is assigned, else the match). A further
candidate is `bare`: a run of BARE_LEAST letters, digits and underscores or
more, with three digits and three letters at least, that no base span touches.

Each candidate's value is hashed (SHA-256) and counted over the corpus: in how
many distinct repositories, and with how many distinct owners. An example of a
manual is copied by many; a credential stays with who owns it. By class:

  live      one owner holds it, and it looks live: at least ENTROPY bits a
            character, and no placeholder in it
  dummy     one owner holds it, and it doesn't look live
  shared    more owners hold it, fewer than `copied`
  example   `copied` owners or more hold it

Added to the base spans are the bare candidates of class live, as kind `bare`;
base spans are kept whatever their class. Counting merges rows on the map side
and goes by (value, owner, repository), then (value, owner), then value, so a
value that a third of the corpus holds is many groups until its owners are few.

Where a table has no repositories, each distinct text is one; a null owner is
an owner like any other. Null text is empty and has no spans. Null ids are kept
as they are. Repeated rows give repeated results and count once; empty tables
give no rows. Columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pii import SPANS, located
from .tables import materialise

KINDS = ("assign", "access", "hex")
BARE, BARE_LEAST, ASSIGNED_LEAST = "bare", 20, 8
#: Possessive loops and starts at the head of a run: no backtracking. A run of under 16 or 32 characters would be
#: dropped, and no part of it could stand; an assignment is matched whatever its length, since a failing one is not retried.
PATTERNS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""",
    "access": r"AKIA[A-Z0-9]{12,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{32,}+",
    BARE: r"(?<![A-Za-z0-9_])(?=(?:[A-Za-z_]*+[0-9]){3})(?=(?:[0-9_]*+[A-Za-z]){3})[A-Za-z0-9_]{%d,}+" % BARE_LEAST,
}
#: Bits a character that a value must have to look live, and what no live one holds.
ENTROPY = 2.5
PLACEHOLDER = r"(?i)example|changeme|placeholder|dummy|sample|your_|xxxx|0123456|1234567|abcdefg"
CLASSES = ("live", "dummy", "shared", "example")


def guarded(kind: Column, match: Column) -> Column:
    """The value that a match guards."""
    return F.when(kind == "assign", F.regexp_extract(match, PATTERNS["assign"], 2)).otherwise(match)


def _valid(kind: str, match: Column) -> Column:
    return F.length(F.regexp_extract(match, PATTERNS["assign"], 2)) >= ASSIGNED_LEAST if kind == "assign" else F.lit(True)


def _by_start(spans: Column) -> Column:
    """Spans by start, then by kind as listed."""
    rank = lambda s: F.array_position(F.array(*(F.lit(k) for k in (*KINDS, BARE))), s["kind"])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s.alias("span"))))
    return F.transform(ordered, lambda x: x["span"])


def base_spans(text: Column) -> Column:
    return _by_start(F.concat(*(located(text, PATTERNS[k], k, _valid) for k in KINDS)))


def bare_spans(text: Column, base: Column) -> Column:
    """Bare candidates that no base span touches."""
    return F.filter(located(text, PATTERNS[BARE], BARE), lambda w: ~F.exists(base, lambda s: (s["start"] < w["stop"]) & (w["start"] < s["stop"])))


def looks_live(value: Column) -> Column:
    """Whether the Shannon entropy of the characters reaches ENTROPY and nothing in the value says that it's a placeholder."""
    n = F.length(value).cast("double")
    chars = F.split(value, "")

    def part(acc: Column, c: Column) -> Column:
        share = (n - F.length(F.replace(value, c, F.lit("")))) / n
        return acc - share * F.log2(share)

    bits = F.aggregate(F.array_distinct(F.filter(chars, lambda c: c != "")), F.lit(0.0), part)
    return (bits >= ENTROPY - 1e-9) & ~value.rlike(PLACEHOLDER)


def candidates(docs: DataFrame, repository: str | None = None, owner: str = "source") -> DataFrame:
    """_row, doc (the columns of docs), owner, repository, base and bare (spans, whose value is the match) of each row, written once."""
    text = F.coalesce("text", F.lit(""))
    repo = F.sha2(text, 256) if repository is None else F.col(f"`{repository}`")
    keep = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    rows = docs.select(keep.alias("doc"), F.col(f"`{owner}`").alias("owner"), repo.alias("repository"), text.alias("text"), base_spans(text).alias("base"))
    # numbers given here hold for good, since the rows are written
    rows = rows.select(F.monotonically_increasing_id().alias("_row"), "doc", "owner", F.when((F.size("base") > 0) | F.col("text").rlike(PATTERNS[BARE]), F.col("repository")).alias("repository"), "base", bare_spans(F.col("text"), F.col("base")).alias("bare"))
    return materialise(rows)


def _values(spans: Column) -> Column:
    return F.array_distinct(F.transform(spans, lambda s: guarded(s["kind"], s["value"])))


def _digest(value: Column) -> Column:
    return F.sha2(value, 256)


def ownership(rows: DataFrame, copied: int = 3) -> DataFrame:
    """digest, repositories, owners, class of each candidate value of the rows of candidates()."""
    held = rows.where((F.size("base") > 0) | (F.size("bare") > 0)).select("owner", "repository", F.explode(_values(F.concat("base", "bare"))).alias("value"))
    held = held.select("owner", "repository", _digest(F.col("value")).alias("digest"), looks_live(F.col("value")).alias("lively"))
    once = held.groupBy("digest", "owner", "repository").agg(F.max("lively").alias("lively"))
    own = once.groupBy("digest", "owner").agg(F.count("*").alias("n"), F.max("lively").alias("lively"))
    out = own.groupBy("digest").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"), F.max("lively").alias("lively"))
    kind = F.when(F.col("owners") >= copied, "example").when(F.col("owners") > 1, "shared").when(F.col("lively"), "live").otherwise("dummy")
    return out.select("digest", "repositories", "owners", kind.alias("class"))


def with_classes(docs: DataFrame, repository: str | None = None, owner: str = "source", copied: int = 3) -> DataFrame:
    """doc, base, bare, found: per row its spans and a map from a value's digest to (repositories, owners, class)."""
    rows = candidates(docs, repository, owner)
    verdicts = ownership(rows, copied)
    some = (F.size("base") > 0) | (F.size("bare") > 0)
    asked = rows.where(some).select("_row", F.explode(_values(F.concat("base", "bare"))).alias("value")).select("_row", _digest(F.col("value")).alias("digest"))
    entry = F.struct(F.col("digest"), F.struct("repositories", "owners", "class"))
    found = asked.join(verdicts, "digest").groupBy("_row").agg(F.map_from_entries(F.collect_list(entry)).alias("found"))
    return rows.join(found, "_row", "left").select("doc", "base", "bare", "found")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op12(documents: DataFrame, copied: int = 3) -> DataFrame:
    """One row per document: counts by kind, digest of the base spans, all spans, then the classes of the base spans and of what was added."""
    out = with_classes(documents.select("doc_id", "text", "source"), copied=copied)
    kind_of = lambda s: F.try_element_at("found", _digest(guarded(s["kind"], s["value"])))["class"]
    none = F.array().cast(SPANS)
    added = F.when(F.col("found").isNull(), none).otherwise(F.filter("bare", lambda s: kind_of(s) == "live"))
    out = out.select("doc.doc_id", "base", "found", added.alias("added")).withColumn("classes", F.when(F.col("found").isNotNull(), F.transform("base", kind_of)))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def of_class(c: str) -> Column:
        return F.coalesce(F.size(F.filter("classes", lambda x: x == c)), F.lit(0)).cast("long").alias(f"base_{c}")

    return out.select(
        "doc_id", *(count(k) for k in KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(_by_start(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_bare"), *(of_class(c) for c in CLASSES),
    )


def _sql_pattern(kind: str) -> str:
    """The pattern for an engine without look-around: the same matches, once those that fail are dropped."""
    plain = {"access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}", BARE: "[A-Za-z0-9_]{%d,}" % BARE_LEAST}
    return plain.get(kind, PATTERNS[kind].replace("?+", "?").replace("*+", "*").replace("++", "+")).replace("'", "''")


_KIND = " UNION ALL ".join(f"SELECT rid, '{k}' AS kind, {i} AS rank, regexp_extract_all(t, '{_sql_pattern(k)}') AS m, string_split_regex(t, '{_sql_pattern(k)}') AS p FROM d" for i, k in enumerate((*KINDS, BARE), 1))
_DIGITS, _LETTERS = ("length(regexp_replace(v, '[^%s]', '', 'g'))" % c for c in ("0-9", "A-Za-z"))
SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
k AS ({_KIND}),
n AS (SELECT rid, kind, rank, m, p, unnest(range(1, len(m) + 1)) AS i FROM k WHERE len(m) > 0),
a AS (SELECT rid, kind, rank, m[i] AS v, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS b FROM n),
g AS (SELECT *, b + length(v) AS e, CASE WHEN kind = 'assign' THEN regexp_extract(v, '{_sql_pattern("assign")}', 2) ELSE v END AS value FROM a),
base AS (SELECT * FROM g WHERE kind IN ('access', 'hex') OR kind = 'assign' AND length(value) >= {ASSIGNED_LEAST}),
bare AS (SELECT * FROM g WHERE kind = '{BARE}' AND {_DIGITS} >= 3 AND {_LETTERS} >= 3 AND NOT EXISTS (SELECT 1 FROM base WHERE base.rid = g.rid AND base.b < g.e AND g.b < base.e)),
cand AS (SELECT * FROM base UNION ALL SELECT * FROM bare),
chars AS (SELECT value, c, count(*) AS n FROM (SELECT value, unnest(string_split(value, '')) AS c FROM (SELECT DISTINCT value FROM cand)) WHERE c <> '' GROUP BY value, c),
bits AS (SELECT value, -sum(n / length(value) * log2(n / length(value))) AS bits FROM chars GROUP BY value),
own AS (SELECT value, count(DISTINCT coalesce('=' || source, '')) AS owners FROM cand JOIN d USING (rid) GROUP BY value),
cls AS (SELECT value, CASE WHEN owners >= 3 THEN 'example' WHEN owners > 1 THEN 'shared' WHEN bits >= {ENTROPY} - 1e-9 AND NOT regexp_matches(value, '{PLACEHOLDER}') THEN 'live' ELSE 'dummy' END AS class FROM own JOIN bits USING (value)),
sp AS (SELECT * FROM (SELECT *, FALSE AS more FROM base UNION ALL SELECT *, TRUE FROM bare) JOIN cls USING (value) WHERE NOT more OR class = 'live'),
agg AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)}, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) FILTER (NOT more) AS bs, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) AS spans, count(*) FILTER (more) AS n_bare, {", ".join(f"count(*) FILTER (NOT more AND class = '{c}') AS base_{c}" for c in CLASSES)} FROM sp GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)}, sha256(coalesce(bs, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_bare, 0) AS n_bare, {", ".join(f"coalesce(base_{c}, 0) AS base_{c}" for c in CLASSES)} FROM d LEFT JOIN agg USING (rid)"""
