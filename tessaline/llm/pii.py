"""Personal data by regular expressions, checksums and context, in SQL functions only.

A pattern proposes spans, a validator (octet range, Luhn, digit count, mod 97)
confirms them, words shortly before a span raise its score. Positions come from
splitting the text by the pattern: the lengths of the pieces and of the matches
add up, by blocks, so that time stays in proportion to the spans too. Every pattern is written without backtracking into long runs, so time
stays linear in the text: a run is entered at its first character or right
after the match before (\\G), and repeated parts are possessive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: kind: (order, guard, pattern, least score, context words)
KINDS = {
    "email": (0, "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.8, "mail|contact|write|address"),
    "ip": (1, r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.5, "ip|host|server|address|login"),
    "card": (2, r"[0-9](?:[ -]?+[0-9]){11}", r"[0-9](?:[ -]?+[0-9])++", 0.7, "card|credit|visa|master|pay"),
    "phone": (3, "+", r"\+[0-9][ ().0-9-]+[0-9]", 0.6, "phone|tel|call|mobile|fax"),
    "iban": (4, r"[A-Z]{2}[0-9]{2}[ A-Z0-9]{11}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}+(?: [A-Z0-9]{1,3})?+|[A-Z0-9]{11,30}+)(?![A-Za-z0-9])", 0.9, "iban|account|bank|konto|compte|cuenta"),
}
CONTEXT = 40
OCTETS = "^" + r"\.".join([r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"] * 4) + "$"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an IBAN without spaces has remainder 1 once its first four characters stand last."""
    turned = F.concat(F.substring(code, 5, 40), F.substring(code, 1, 4))
    value = lambda c: F.when(c < "A", c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: (a * F.when(c < "A", 10).otherwise(100) + value(c)) % 97) == 1


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return text.rlike(OCTETS)
    if kind == "card":
        n = F.length(_digits(text))
        return F.when(n.between(12, 19), luhn(_digits(text))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(text)).between(9, 15)
    if kind == "iban":
        code = F.replace(text, F.lit(" "), F.lit(""))
        return F.when(F.length(code).between(15, 34), mod97(code)).otherwise(False)
    return F.lit(True)


SPAN = "array<struct<start:long,kind_no:int,end:long,kind:string,text:string,score:double>>"
#: Elements that are folded one after the other; longer arrays are folded by blocks, and the blocks' results likewise.
BLOCK = 64


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(values: Column) -> Column:
    return F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))


def running(values: Column, combine, first: Column, levels: int = 2) -> Column:
    """For each element of a non-empty array of longs what combine (sum, greatest) makes of `first` and all elements before it.

    Appending to an array copies it, so a fold keeps to BLOCK elements; where
    each block starts comes from the blocks' own results, level by level. The
    work is in proportion to the array up to BLOCK ** (levels + 1) elements.
    """

    def fold(part: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(part, state, lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    if not levels:
        return fold(values, first)
    whole = lambda v: F.transform(_blocks(v), lambda b: F.aggregate(F.slice(v, b * BLOCK + 2, BLOCK - 1), F.get(v, b * BLOCK), combine))
    each = lambda v, starts: F.flatten(F.transform(starts, lambda at, b: fold(F.slice(v, b * BLOCK + 1, BLOCK), at)))
    return let(values, lambda v: let(running(whole(v), combine, first, levels - 1), lambda starts: each(v, starts)))


def _with_spans(rows: DataFrame, kind: str) -> DataFrame:
    """rows with an array column named by the kind."""
    order, guard, pattern, _, _ = KINDS[kind]
    has = F.col("_t").contains(guard) if kind in ("email", "phone") else F.col("_t").rlike(guard)
    rows = rows.withColumn("_has", has)
    rows = rows.withColumn("_m", F.when(F.col("_has"), F.regexp_extract_all("_t", F.lit(pattern), F.lit(0)))).withColumn("_p", F.when(F.size("_m") > 0, F.split("_t", pattern, -1)))
    size = lambda c: F.length(c).cast("long")

    def found(steps: Column) -> Column:
        """steps: (m, gap) of each match, the match and the text between it and the one before."""
        starts = running(F.transform(steps, lambda x: size(x["gap"]) + size(x["m"])), lambda a, x: a + x, F.lit(0).cast("long"))
        placed = F.zip_with(steps, starts, lambda x, at: F.struct(x["m"].alias("m"), x["gap"].alias("gap"), (at + size(x["gap"])).alias("start")))
        valid = F.filter(placed, lambda x: _valid(kind, x["m"]))
        span = lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("kind_no"), (x["start"] + size(x["m"])).alias("end"), F.lit(kind).alias("kind"), x["m"].alias("text"), _score(kind, x["gap"]).alias("score"))
        return F.transform(valid, span).cast(SPAN)

    steps = F.slice(F.zip_with("_m", "_p", lambda m, p: F.struct(m.alias("m"), p.alias("gap"))), F.lit(1), F.size("_m"))
    return rows.withColumn(kind, F.when(F.size("_m") > 0, let(steps, found)).otherwise(F.array().cast(SPAN))).drop("_has", "_m", "_p")


def _score(kind: str, gap: Column) -> Column:
    """The kind's own score, and 0.2 more if a context word stands in the 40 characters before the span, as far as the match before."""
    _, _, _, least, context = KINDS[kind]
    near = F.lower(F.right(gap, F.lit(CONTEXT))).rlike(f"(?:^|[^a-z])(?:{context})")
    return F.round(F.least(F.lit(1.0), F.lit(least) + F.when(near, 0.2).otherwise(0.0)), 2)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, text and found: an array of spans (start, kind_no, end, kind, text, score) by start, then kind.

    Kinds: email, ip, card, phone and, added to these, iban. A null or empty
    text has no span; the doc_id may be null. Repeated rows are searched each for itself; an empty
    table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    for kind in KINDS:
        rows = _with_spans(rows, kind)
    return rows.select("doc_id", F.col("_t").alias("text"), F.array_sort(F.concat(*KINDS)).alias("found"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind_no"] < 4)
    return found.select(
        "doc_id", *(count(k) for k in KINDS if k != "iban"), F.sha2(F.encode(_listed(base), "UTF-8"), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"), count("iban"),
        F.coalesce(F.array_max(F.transform("found", lambda s: s["score"])), F.lit(0.0)).alias("max_score"),
    )


def redact(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id and text with every span of at least that score replaced by its kind in brackets.

    Overlapping spans are replaced as one, named by the first. A null text
    comes back empty. The text is cut into chunks first, so that a span deep in
    a long text is reached in time that does not grow with its place.
    """
    found = find_pii(docs).withColumn("_s", F.filter("found", lambda s: s["score"] >= least))
    chunk = 4096
    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / chunk).cast("int")), lambda k: F.substr(F.col("text"), k * chunk + 1, F.lit(chunk)))

    def between(held: Column, a: Column, b: Column) -> Column:
        """The characters [a, b) of the text."""
        first, last = F.floor(a / chunk).cast("int"), F.floor(b / chunk).cast("int")
        part = lambda k: F.substr(F.get(held, k), (F.greatest(a - k * chunk, F.lit(0)) + 1).cast("int"), F.greatest(F.least(b - k * chunk, F.lit(chunk)) - F.greatest(a - k * chunk, F.lit(0)), F.lit(0)).cast("int"))
        return F.array_join(F.transform(F.sequence(first, last), part), "")

    def walked(held: Column) -> Column:
        ends = running(F.transform("_s", lambda s: s["end"]), lambda a, x: F.greatest(a, x), F.lit(0).cast("long"))
        pieces = F.zip_with("_s", ends, lambda s, at: F.when(s["start"] >= at, F.concat(between(held, at, s["start"]), F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit("")))
        last = F.array_max(F.transform("_s", lambda s: s["end"]))
        return F.concat(F.array_join(pieces, ""), between(held, last, F.length("text").cast("long")))

    return found.select("doc_id", F.when(F.size("_s") > 0, let(chunks, walked)).otherwise(F.col("text")).alias("text"))
