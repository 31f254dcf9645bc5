"""Secrets in texts: fixed patterns, and windows of high entropy.  DataFrame functions only.

Offsets count code points; ends are exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "entropy")

#: Runs that can hold a key: 20 characters or more, a digit among them.
WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+"
#: Character classes: name, alphabet, and the least entropy of a window in bits per character.
CLASSES = (("hexadecimal", "0123456789abcdef", 3.0), ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.9))
#: Whole candidates that are no secrets: digits with separators, and UUIDs.
ALLOWED = (r"^[0-9+/_=-]+$", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")
#: n * log2(n) in millionths, so that sums are whole numbers and don't drift.
UNIT = 1_000_000
TERMS = [round(n * math.log2(n) * UNIT) if n else 0 for n in range(WINDOW + 1)]


def matches(text: Column, pattern: str) -> Column:
    """All leftmost matches of pattern, never empty: array<struct<s int, e int, text string>>."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    rows = F.arrays_zip(found.alias("m"), F.slice(between, F.lit(1), F.size(found)).alias("b"))

    def step(state: Column, row: Column) -> Column:
        start = state["at"] + F.char_length(row["b"])
        end = start + F.char_length(row["m"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("s"), end.alias("e"), row["m"].alias("text")))).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,text:string>>").alias("out"))
    return F.aggregate(rows, zero, step, lambda state: state["out"])


def _spans(text: Column, hint: Column, pattern: str) -> Column:
    """matches, looked for only where the cheaper hint holds."""
    return F.when(hint, matches(text, pattern)).otherwise(F.array().cast("array<struct<s:int,e:int,text:string>>"))


def dense(text: Column, alphabet: str, least: float) -> Column:
    """The part of text that windows of least entropy cover, as struct<first int, last int>: offsets of the first such window and of the last one's end; first is -1 if there is none.

    A fold over the characters keeps how often each character stands in the window, and the sum
    of n * log2(n) over these counts; each step changes two counts and their terms.
    """
    terms = F.array(*[F.lit(x).cast("long") for x in TERMS])
    most = math.floor((math.log2(WINDOW) - least) * WINDOW * UNIT)  # of the sum, in windows that are dense enough
    places = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(alphabet), c))
    return _fold(places, len(alphabet), terms, most)


def _fold(places: Column, letters: int, terms: Column, most: int) -> Column:
    term = lambda n: F.element_at(terms, (n + 1).cast("int"))
    pairs = F.arrays_zip(places.alias("new"), F.concat(F.array_repeat(F.lit(0), WINDOW), F.slice(places, F.lit(1), F.greatest(F.size(places) - WINDOW, F.lit(0)))).alias("old"))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("sum"), F.array_repeat(F.lit(0), letters).alias("counts"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    count = lambda counts, k: F.when(k > 0, F.element_at(counts, k)).otherwise(F.lit(0))

    def step(state: Column, pair: Column) -> Column:
        new, old, counts = pair["new"], pair["old"], state["counts"]
        gain = F.when(new > 0, term(count(counts, new) + 1) - term(count(counts, new))).otherwise(F.lit(0).cast("long"))
        loss = F.when(old > 0, term(count(counts, old)) - term(count(counts, old) - 1)).otherwise(F.lit(0).cast("long"))
        total = F.when(new == old, state["sum"]).otherwise(state["sum"] + gain - loss)
        moved = F.when(new == old, counts).otherwise(F.transform(counts, lambda n, k: n + F.when(k + 1 == new, 1).otherwise(0) - F.when(k + 1 == old, 1).otherwise(0)))
        at = state["at"] + 1
        hit = (at >= WINDOW) & (total <= most)
        return F.struct(at.alias("at"), total.alias("sum"), moved.alias("counts"), F.when(hit & (state["first"] < 0), at - WINDOW).otherwise(state["first"]).alias("first"), F.when(hit, at).otherwise(state["last"]).alias("last"))

    return F.aggregate(pairs, zero, step, lambda state: F.struct(state["first"].alias("first"), state["last"].alias("last")))


def entropy_spans(text: Column, allowed: Sequence[str] = ALLOWED) -> Column:
    """Dense parts of candidate strings that no pattern of allowed matches: array<struct<s int, e int>>."""
    candidates = F.filter(_spans(text, text.rlike("[0-9]"), CANDIDATE), lambda x: ~x["text"].rlike("|".join(allowed)) if allowed else F.lit(True))
    (_, digits, low), (_, every, high) = CLASSES
    part = lambda x: F.when(x["text"].rlike(f"^(?:[{digits}]+|[{digits.upper()}]+)$"), dense(F.lower(x["text"]), digits, low)).otherwise(dense(x["text"], every, high))
    found = F.transform(candidates, lambda x: F.struct(x["s"].alias("at"), part(x).alias("part")))
    return F.transform(F.filter(found, lambda x: x["part"]["first"] >= 0), lambda x: F.struct((x["at"] + x["part"]["first"]).alias("s"), (x["at"] + x["part"]["last"]).alias("e")))


def base_spans(text: Column) -> dict[str, Column]:
    """Kind to array<struct<s int, e int, text string>>."""
    assign = _spans(text, text.rlike("(?i)passw(?:or)?d|secret|token|api_?key"), ASSIGN)
    return {
        "assign": F.filter(assign, lambda x: F.char_length(F.regexp_extract(x["text"], ASSIGN, 2)) >= 8),
        "access": _spans(text, text.contains("AKIA"), ACCESS),
        "hex": _spans(text, text.rlike("[0-9a-f]{32}"), HEX),
    }


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """id_col, text, base and spans of every document, both array<struct<s int, k int, e int>> in order.

    base: by the fixed patterns; spans: these and the dense candidate strings that overlap none
    of them.  k: place of the kind in KINDS.  Null is an empty text and has no span; repeated
    rows stay; a text is scanned whole, in one pass of each pattern; other columns are not
    looked at.  No row leaves its partition.
    """
    rows = _scanned(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), "text", allowed)
    rows = rows.withColumn("more", F.filter("more", lambda x: ~F.exists("base", lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))))
    return rows.select(F.col("row.id").alias(id_col), "text", "base", F.array_sort(F.concat("base", "more")).alias("spans"))


def _scanned(docs: DataFrame, text_col: str, allowed: Sequence[str]) -> DataFrame:
    """row (all columns of docs), text, base, more: all dense parts, those that overlap base spans among them."""
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    named = base_spans(F.col("text"))
    tag = lambda kind, spans: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e")))
    rows = rows.withColumn("base", F.array_sort(F.concat(*[tag(k, v) for k, v in named.items()])))
    rows = rows.withColumn("more", tag("entropy", entropy_spans(F.col("text"), allowed)))
    return rows


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """From scan: id_col, n_assign, n_access, n_hex long, base_sha256 and spans string."""
    # The lambda takes one parameter: Spark would pass the index of the span as a second one, with a default or without.
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(id_col, *map(count, range(3)), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(text: Column, spans: Column, mark: str) -> Column:
    """text with each of the spans, in order, replaced; overlapping spans are replaced together."""

    def step(state: Column, x: Column) -> Column:
        out = F.when(x["s"] >= state["at"], F.concat(state["out"], F.substring(text, state["at"] + 1, x["s"] - state["at"]), F.lit(mark))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], x["e"]).alias("at"), out.alias("out"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))


def redacted_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[SECRET]", allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """All rows and columns of docs, with the secrets of the text replaced by mark, and length_col made to follow where a text changes.

    A dense part that overlaps a base span is no span of ``scan``, but is replaced here together with it.
    """
    rows = _scanned(docs, text_col, allowed).withColumn("spans", F.array_sort(F.concat("base", "more")))
    found = F.size("spans") > 0
    rows = rows.withColumn("clean", F.when(found, redact(F.col("text"), F.col("spans"), mark)))
    changed = {text_col: F.coalesce("clean", f"row.`{text_col}`")}
    if length_col in docs.columns:
        changed[length_col] = F.when(found, F.char_length("clean").cast(docs.schema[length_col].dataType)).otherwise(F.col(f"row.`{length_col}`"))
    return rows.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
