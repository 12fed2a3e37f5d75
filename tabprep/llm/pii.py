r"""Personal data: regular expressions propose spans, checksums confirm them, and words nearby adjust the score.

Base kinds, leftmost and without overlaps within each kind:

* email, always accepted;
* ip, four numbers of at most 255;
* card, 12 to 19 digits with single blanks or hyphens between them, confirmed by Luhn's check;
* phone, an international number of 9 to 15 digits.

Base spans are always reported, whatever their score. Two more kinds are reported from a score of 0.5 on: iban (confirmed by
mod-97, 0.9) and phone_local (ten digits in groups, 0.3, which needs a context word). A context word within 40 characters
before a span adds 0.3.

Patterns use possessive quantifiers where these find the same, so no text makes them slow or deep. All expressions are built-in
functions. Defined results: null and empty texts have no spans; each row is reported, repeated or not; positions are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import let, total

#: In this order kinds are named at the same start.
KINDS = ("email", "ip", "card", "phone", "iban", "phone_local")
BASE = KINDS[:4]

PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)",
    "phone_local": r"\(?[0-9]{3}\)?[\x20-][0-9]{3}[\x20-][0-9]{4}",
}
#: A text without this has no span of the kind.
NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]", "iban": "[A-Z]{2}[0-9]{2}[A-Z0-9\\x20]", "phone_local": "[0-9]{3}[\\x20-][0-9]{4}"}
SCORE = {"email": 0.6, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.9, "phone_local": 0.3}
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "address|server|host|ip",
    "card": "card|visa|credit|payment",
    "phone": "phone|call|tel|fax|mobile",
    "iban": "iban|account|bank",
    "phone_local": "phone|call|tel|fax|mobile",
}
NEAR, ADDS, ENOUGH = 40, 0.3, 0.5


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return total(F.sequence(F.lit(0), F.length(digits) - 1), value) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number without blanks has the remainder 1."""

    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(code, (i + 4) % F.length(code) + 1, F.lit(1)))
        return F.when(c < 58, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(0), F.length(code) - 1), F.lit(0), step) == 1


def _confirmed(kind: str, text: Column, span: Column) -> Column:
    hit = span["value"]
    if kind == "ip":
        return F.forall(F.split(hit, "\\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) <= 3) & (F.coalesce(F.when(F.length(q) <= 3, q).try_cast("int"), F.lit(0)) <= 255)))
    if kind == "card":
        return let(F.regexp_replace(hit, "[^0-9]", ""), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(F.regexp_replace(hit, "[^0-9]", "")).between(9, 15)
    apart = ~F.concat(F.substring(text, F.greatest(span["start"], F.lit(1)), F.when(span["start"] > 0, 1).otherwise(0)), F.lit(" "), F.substring(text, span["end"] + 1, F.lit(1))).rlike("[A-Za-z0-9+]")
    if kind == "iban":
        return apart & let(F.regexp_replace(hit, " ", ""), lambda c: F.length(c).between(15, 34) & mod97(c))
    return apart if kind == "phone_local" else F.lit(True)


def _spans(kind: str, text: Column) -> Column:
    """All confirmed spans of a kind: what the pattern leaves and what it takes give the positions."""
    pattern = PATTERNS[kind]
    place = "start int, end int, value string"

    def put(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["left"])
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.array_append(state["found"], F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value"))).alias("found"))

    def found(hits: Column) -> Column:
        zipped = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, lambda a, b: F.struct(a.alias("left"), b.alias("hit")))
        return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<{place.replace(' int', ':int').replace(' string', ':string')}>>").alias("found")), put, lambda s: s["found"])

    def scored(span: Column) -> Column:
        from_ = F.greatest(span["start"] - NEAR, F.lit(0))
        near = F.lower(F.substring(text, from_ + 1, span["start"] - from_)).rlike(f"\\b(?:{CONTEXT[kind]})")
        score = F.when(near, SCORE[kind] + ADDS).otherwise(SCORE[kind])
        return F.struct(span["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), span["end"].alias("end"), F.lit(kind).alias("kind"), score.alias("score"), span["value"].alias("value"))

    spans = F.transform(F.filter(let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found), lambda s: _confirmed(kind, text, s)), scored)
    if kind not in BASE:
        spans = F.filter(spans, lambda s: s["score"] >= ENOUGH)
    return F.when(text.rlike(NEEDS[kind]), spans)


def find_pii(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id and its spans by start and kind, each with start, rank of the kind, end, kind, score and value."""
    text = F.col("_text")
    plain = documents.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kinds = [F.coalesce(_spans(k, text), F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,score:double,value:string>>")) for k in KINDS]
    return plain.select(F.col("_id").alias(id_col), F.array_sort(F.concat(*kinds)).alias("spans"))


def op1_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *(number(k) for k in BASE), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _sql_kind(kind: str, pattern: str, keep: str) -> str:
    return f"""{kind}_pieces AS (
  SELECT rid, t, string_split_regex(t, '{pattern}') AS a, regexp_extract_all(t, '{pattern}') AS b FROM d),
{kind}_rows AS (
  SELECT rid, t, i, a[i] AS gap, b[i] AS hit FROM {kind}_pieces, unnest(range(1, len(b) + 1)) AS r(i)),
{kind}_all AS (
  SELECT rid, t, hit, CAST(sum(len(gap) + len(hit)) OVER (PARTITION BY rid ORDER BY i) AS BIGINT) AS e FROM {kind}_rows),
{kind}_spans AS (
  SELECT rid, '{kind}' AS kind, {KINDS.index(kind)} AS rank, e - len(hit) AS s, e FROM
    (SELECT *, e - len(hit) AS s, regexp_replace(hit, '[^0-9]', '', 'g') AS digits, replace(hit, ' ', '') AS code FROM {kind}_all) WHERE {keep}),
"""


_LUHN = "list_sum(list_transform(range(0, len(digits)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(digits[len(digits) - i] AS INT) WHEN CAST(digits[len(digits) - i] AS INT) > 4 THEN 2 * CAST(digits[len(digits) - i] AS INT) - 9 ELSE 2 * CAST(digits[len(digits) - i] AS INT) END)) % 10 = 0"
_APART = "NOT regexp_matches((CASE WHEN s > 0 THEN substring(t, s, 1) ELSE '' END) || ' ' || substring(t, e + 1, 1), '[A-Za-z0-9+]')"
_MOD97 = "list_reduce(list_prepend(0, list_transform(range(0, len(code)), lambda i: ascii(code[(i + 4) % len(code) + 1]))), lambda x, c: CASE WHEN c < 58 THEN (x * 10 + c - 48) % 97 ELSE (x * 100 + c - 55) % 97 END) = 1"
_LOCAL = f"regexp_matches(lower(substring(t, greatest(s - {NEAR}, 0) + 1, s - greatest(s - {NEAR}, 0))), '\\b({CONTEXT['phone_local']})')"

OP1_SQL = (
    "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),\n"
    + _sql_kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true")
    + _sql_kind("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(hit, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0")
    + _sql_kind("card", r"[0-9](?:[\x20-]?[0-9])+", f"len(digits) BETWEEN 12 AND 19 AND {_LUHN}")
    + _sql_kind("phone", PATTERNS["phone"], "len(digits) BETWEEN 9 AND 15")
    + _sql_kind("iban", PATTERNS["iban"], f"{_APART} AND len(code) BETWEEN 15 AND 34 AND {_MOD97}")
    + _sql_kind("phone_local", PATTERNS["phone_local"], f"{_APART} AND {_LOCAL}")
    + "every AS ("
    + " UNION ALL ".join(f"SELECT * FROM {k}_spans" for k in KINDS)
    + """),
g AS (SELECT rid, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM every GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_email, 0) AS BIGINT) AS n_email, CAST(coalesce(n_ip, 0) AS BIGINT) AS n_ip, CAST(coalesce(n_card, 0) AS BIGINT) AS n_card, CAST(coalesce(n_phone, 0) AS BIGINT) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)"""
)
