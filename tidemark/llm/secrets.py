"""Secret scans with SQL expressions alone.

Base patterns: assignments to names of secrets, access key ids and long hexadecimal
runs. Beside them, candidate strings (runs of token characters, 20 or more, with a
letter and a digit) are scanned by a window of 20 characters: counts per character
are updated for the one that enters and the one that leaves, and with them the sum
of c log2 c, so the Shannon entropy of each window costs the same whatever came
before. Windows at or above the threshold of the candidate's character class join
into spans, unless the candidate is on the allow list. Sums are integers (units of
2**-20 bits), so nothing drifts and every engine agrees.

Where matches stand follows from two scans of one pattern: the pieces between the
matches and the matches themselves alternate, and the lengths add up.

Defined cases: a null text counts as empty and has no spans (a redacted null stays
null); spans are in code points, end exclusive; overlapping spans of several kinds
are all listed; a null doc_id and repeated rows are kept.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_text")

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Character class: (pattern of the whole candidate, characters, least bits a window).
CLASSES = {
    "entropy_hex": (r"^[0-9A-Fa-f-]+$", "0123456789abcdef-", 3.2),
    "entropy_text": (r"^[A-Za-z0-9+/_=-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", 3.75),
}
#: Candidates that are no secrets: UUIDs, words joined by marks, paths, and placeholders.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"^([A-Za-z]+|[0-9]+)([-_/=+]+([A-Za-z]+|[0-9]+))*[-_/=+]*$",
    r"(?i)example|sample|placeholder|x{6}",
)
UNIT = 1 << 20
SPAN = "array<struct<start:int,ord:int,end:int>>"


def located(text: Column, pattern: str, group: int = 0, chunk: int = 500) -> Column:
    """Matches in order: start, end, value (of the group).

    Positions are added up chunk by chunk, so the work stays in proportion to the matches.
    """
    pieces, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    kind = "array<struct<start:int,end:int,value:string>>"
    none = F.array().cast(kind)

    def add(acc, x):
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["v"].alias("value")))).alias("out"))

    def add_chunk(acc, part):
        at = F.coalesce(F.try_element_at(F.try_element_at(acc, F.lit(-1)), F.lit(-1))["end"], F.lit(0))
        return F.concat(acc, F.array(F.aggregate(part, F.struct(at.alias("at"), none.alias("out")), add, lambda a: a["out"])))

    parts = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(whole)).alias("p"), whole.alias("m"), value.alias("v"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / chunk).cast("int")), lambda k: F.slice(parts, k * chunk + 1, F.lit(chunk)))
    found = F.flatten(F.aggregate(chunks, F.array().cast(f"array<{kind}>"), add_chunk))
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(none)


def base_spans(text: Column) -> Column:
    """start, ord, end of the base matches, unsorted."""
    span = lambda kind: lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("ord"), x["end"].alias("end"))
    assign = F.filter(located(text, ASSIGN, 1), lambda x: F.length(x["value"]) >= 12)
    return F.concat(F.transform(assign, span("assign")), F.transform(located(text, ACCESS), span("access")), F.transform(located(text, HEX), span("hex"))).cast(SPAN)


def _hot(value: Column, chars: str, least: float) -> Column:
    """Joined windows of enough entropy within one candidate: a, b (end exclusive)."""
    weight = F.array(*[F.lit(round(c * math.log2(c) * UNIT) if c else 0) for c in range(WINDOW + 2)])
    limit = round((math.log2(WINDOW) - least) * WINDOW * UNIT)
    at = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(chars), c))
    steps = F.sequence(F.lit(1), F.length(value))
    none = F.array().cast("array<struct<a:int,b:int>>")
    start = F.struct(at.alias("at"), F.array_repeat(F.lit(0), len(chars)).alias("n"), F.lit(0).alias("sum"), none.alias("out"))

    def step(acc, i):
        comes = F.element_at(acc["at"], i)
        goes = F.when(i > WINDOW, F.element_at(acc["at"], F.greatest(i - WINDOW, F.lit(1)))).otherwise(0)
        old = F.when(goes > 0, F.element_at(acc["n"], F.greatest(goes, F.lit(1)))).otherwise(0)
        new = F.element_at(acc["n"], comes) - F.when(comes == goes, 1).otherwise(0)
        less = F.when(goes > 0, F.element_at(weight, old) - F.element_at(weight, old + 1)).otherwise(0)
        total = acc["sum"] + less + F.element_at(weight, new + 2) - F.element_at(weight, new + 1)
        counts = F.transform(acc["n"], lambda v, k: v + F.when(k + 1 == comes, 1).otherwise(0) - F.when(k + 1 == goes, 1).otherwise(0))
        last = F.try_element_at(acc["out"], F.lit(-1))
        joined = last["b"] >= i - WINDOW
        here = F.struct(F.when(joined, last["a"]).otherwise(i - WINDOW).alias("a"), i.alias("b"))
        out = F.when(joined, F.slice(acc["out"], 1, F.size(acc["out"]) - 1)).otherwise(acc["out"])
        hot = (i >= WINDOW) & (total <= limit)
        return F.struct(acc["at"].alias("at"), counts.alias("n"), total.alias("sum"), F.when(hot, F.concat(out, F.array(here))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def entropy_spans(text: Column) -> Column:
    """start, ord, end of the windows with high entropy."""
    c = F.filter(located(text, CANDIDATE), lambda x: F.regexp_like(x["value"], F.lit("[0-9]")) & F.regexp_like(x["value"], F.lit("[A-Za-z]")) & ~reduce(lambda a, b: a | b, [F.regexp_like(x["value"], F.lit(p)) for p in ALLOWED]))

    def spans(x):
        hexed, (pattern, chars, least) = CLASSES["entropy_hex"], CLASSES["entropy_text"]
        is_hex = F.regexp_like(x["value"], F.lit(hexed[0]))
        hot = F.when(is_hex, _hot(F.lower(x["value"]), *hexed[1:])).otherwise(_hot(x["value"], chars, least))
        kind = F.when(is_hex, KINDS.index("entropy_hex")).otherwise(KINDS.index("entropy_text"))
        return F.transform(hot, lambda h: F.struct((x["start"] + h["a"]).alias("start"), kind.alias("ord"), (x["start"] + h["b"]).alias("end")))

    return F.flatten(F.transform(c, spans)).cast(SPAN)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text, base and spans (base and entropy), each sorted by start, kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(F.col("doc_id").cast("long"), "text", F.array_sort(base_spans(text)).alias("base"), entropy_spans(text).alias("more"))
    return found.select("doc_id", "text", "base", F.array_sort(F.concat("base", "more")).alias("spans"))


def listed(spans: str) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kind, x["ord"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda x: x["ord"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every joined span replaced by a mark; ``spans`` sorted by start."""

    def add(acc, x):
        fresh = x["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        out = F.when(fresh, F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(spans, start, add, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """The rows of docs with their secrets marked out of the text; n_chars, if there, follows
    the text. Other columns stay as they are, whatever their names."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), base_spans(text).alias("base"), entropy_spans(text).alias("more"))
    found = found.select("row", F.array_sort(F.concat("base", "more")).alias("spans"))
    found = found.select("row", "spans", redacted(F.col("row.text"), F.col("spans")).alias("clean"))
    chars = F.when(F.size("spans") > 0, F.length("clean")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None
    new = {"text": F.col("clean"), "n_chars": chars}
    return found.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
