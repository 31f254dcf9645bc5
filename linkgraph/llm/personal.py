"""Personal data in texts: fixed patterns, and spans that a character-level tagger adds.

Offsets count code points; ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from linkgraph.llm.tagger import WINDOW, Tagger, windows_of

KINDS = ("email", "ip", "card", "phone")
#: Parameters of training: labelled windows, width of the hidden layer, epochs, batch, rate.
SAMPLES, HIDDEN, EPOCHS, BATCH, RATE = 2400, 16, 6, 48, 0.02
#: Texts' characters that are tagged at once.
CHUNK = 1 << 21

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# As [0-9]+(\.[0-9]+){3}: a match never begins within a run of digits, so the rest of a run isn't tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@]")
_SEPARATORS = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others."""
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int, str]]:
    """From each @: back over the local part, ahead over the domain; as the pattern finds them, in linear time."""
    last, at = 0, text.find("@")
    while at >= 0:
        start, domain = at, _DOMAIN.match(text, at + 1)
        while domain and start > last and text[start - 1] in _LOCAL:
            start -= 1
        if domain and start < at:
            last = domain.end()
            yield start, last, "email"
        at = text.find("@", max(last, at + 1))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """By start, then as KINDS lists them."""
    out = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in m[0].split("."))):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = _SEPARATORS.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= len(_SEPARATORS.sub("", m[0])) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


# Labelled spans to train on


def labelled(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Windows of invented prose with labelled personal data in many notations, and with numbers that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    letters = lambda k: "".join(chr(97 + x) for x in rng.integers(0, 26, k))

    def plain_word() -> str:
        made = letters(int(rng.integers(1, 10)))
        return pick(made, made, made, made.capitalize(), made + ",", made + ".", made.upper(), made + "é" + made)

    def email() -> str:
        domain = pick("example", "mail", letters(int(rng.integers(2, 8))))
        return f"{letters(int(rng.integers(2, 8)))}{pick('', '.', '_', '-')}{pick('', digits(2), letters(3))}{pick('@', '@', ' @ ', '(at)@')}{domain}{pick('', digits(1))}.{pick('com', 'org', 'net', 'example.com')}"

    def ip() -> str:
        return ".".join(str(x) for x in rng.integers(0, 256, 4))

    def card() -> str:
        sep = pick("", "", " ", "-", ".")
        number = pick("4", "5", "37", "6") + digits(14)
        number += next(d for d in "0123456789" if luhn(number + d))
        return sep.join(number[i : i + 4] for i in range(0, len(number), 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick(f"+{pick('1', '44', '49')} ({a}) {b}-{c}", f"+{digits(1)}-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{digits(2)} {digits(2)} {b} {c}", f"+{digits(11)}", f"{a}.{b}.{c}")

    def number() -> str:
        return pick(digits(int(rng.integers(1, 6))), f"{digits(1)}.{digits(1)}", f"v{digits(1)}.{digits(1)}.{digits(1)}", f"20{digits(2)}-0{digits(1)}-1{digits(1)}", f"{digits(2)}:{digits(2)}", f"${digits(3)}.{digits(2)}", f"{digits(2)}%", letters(3) + digits(5) + letters(2) + digits(7), f"#{digits(6)}", f"key={digits(2)}{letters(3)}{digits(4)}{letters(6)}", f"AKIA{letters(3).upper()}{digits(4)}{letters(7).upper()}", f"@{letters(5)}")

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(n):
        text, spans = " ".join(plain_word() for _ in range(int(rng.integers(0, 6)))), []
        while len(text) < WINDOW:
            text += pick(" ", " ", "\n", " (", ": ", '"')
            what = pick("word", "word", "word", "number", *KINDS)
            piece = plain_word() if what == "word" else number() if what == "number" else makers[what]()
            if what in makers:
                spans.append((len(text), len(text) + len(piece), what))
            text += piece
        cut = int(rng.integers(0, max(1, len(text) - WINDOW + 1)))
        text = text[cut : cut + WINDOW]
        kept = [(max(0, s - cut), min(WINDOW, e - cut), k) for s, e, k in spans if e > cut and s - cut < WINDOW]
        out.append((text, kept))
    return out


@lru_cache(4)
def trained(samples: int = SAMPLES, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 7) -> Tagger:
    """Fitted on the driver, alike each time; on a number of windows that doesn't depend on the corpus."""
    tagger = Tagger.new(KINDS, hidden, seed)
    ids, gold = windows_of(labelled(samples, seed), tagger.tags)
    tagger.fit(ids, gold, epochs, BATCH, RATE, seed)
    return tagger


def plausible(text: str, kind: str) -> bool:
    """What a tagged span must hold to be taken."""
    digits = _SEPARATORS.sub("", text)
    if kind == "email":
        return re.fullmatch(r"[^\s@]+ ?@ ?[^\s@]+\.[A-Za-z]{2,}", text) is not None
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and re.fullmatch(r"[0-9]+(?: ?[.] ?[0-9]+){3}", text) is not None and all(len(x) <= 3 and int(x) <= 255 for x in parts)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"[0-9](?:[ ./-]{0,2}[0-9])+", text) is not None
    return 9 <= len(digits) <= 15 and re.fullmatch(r"[+(]?[0-9](?:[ ().-]{0,2}[0-9])+", text) is not None and re.search(r"[0-9][ ().-]", text) is not None


def added_spans(tagger: Tagger, texts: list[str], base: list[list[tuple[int, int, str]]]) -> list[list[tuple[int, int, str]]]:
    """Spans of the tagger that are plausible and overlap no base span.

    A window without a digit or an @ can hold none of the kinds, and is not tagged.
    """
    found = tagger.spans(texts, [[m.start() for m in _ANCHOR.finditer(t)] for t in texts])
    out = []
    for text, spans, known in zip(texts, found, base, strict=True):
        kept = []
        for s, e, kind in spans:
            while s < e and text[s] in " \n\t,;:\"'":
                s += 1
            while e > s and text[e - 1] in " \n\t,;:.\"'(-":
                e -= 1
            # A part of a longer number or word is none.
            whole = not (s and (text[s - 1].isalnum() or text[s - 1] in ".-_/@") or e < len(text) and (text[e].isalnum() or text[e] in "-_/@" or text[e] == "." and text[e + 1 : e + 2].isdigit()))
            if s < e and whole and plausible(text[s:e], kind) and not any(a < e and s < b for a, b, _ in known):
                kept.append((s, e, kind))
        out.append(kept)
    return out


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _grouped(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    first, texts, held = 0, [], 0
    for k, text in enumerate(batch.column(1)):
        texts.append(text.as_py() or "")
        held += len(texts[-1])
        if held > CHUNK:
            yield first, texts
            first, texts, held = k + 1, [], 0
    if texts:
        yield first, texts


def scan(docs: DataFrame, tagger: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_email, n_ip, n_card, n_phone long, base_sha256, spans string, redacted string of every document.

    The counts and the digest are of the base spans, spans also has those that the tagger adds;
    redacted is the text with each span replaced by its kind in brackets.  Null is an empty text
    and has no span; whole texts are scanned; repeated rows stay; other columns are not looked
    at; no row leaves its partition.
    """
    model = docs.sparkSession.sparkContext.broadcast(tagger or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _grouped(batch):
                base = [base_spans(x) if _ANCHOR.search(x) else [] for x in texts]
                spans = [sorted([*b, *a], key=lambda x: (x[0], KINDS.index(x[2]))) for b, a in zip(base, added_spans(model.value, texts, base), strict=True)]
                counts = [pa.array([sum(x[2] == kind for x in b) for b in base], pa.int64()) for kind in KINDS]
                digests = [hashlib.sha256(listed(b).encode()).hexdigest() for b in base]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), *counts, pa.array(digests), pa.array(map(listed, spans), pa.string()), pa.array(map(redact, texts, spans), pa.string())],
                    ["key", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "redacted"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("key"), docs[text_col].alias("text")).mapInArrow(run, f"key {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string")
    return out.withColumnRenamed("key", id_col)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Overlapping spans are replaced together, by the first one's kind."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
