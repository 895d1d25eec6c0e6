"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

The four base kinds (email, ip, card, phone) are exact: leftmost, non-overlapping for each kind, a match that fails its
check is dropped without a retry. The scored kinds (iban, ssn, secret) are proposed by patterns, must be confirmed by
their validators, and are added by score: what the kind and its validation are worth, plus or less what the words on
either side of the span say; a span stays from MIN_SCORE on, so words alone never make one. An iban ends where its
country's length says, or for other countries at the longest end of a group at which its check digits are right, as
capitals and digits may follow it.

All searches are linear in the text. The email's local part is found backwards from each '@' and the ip pattern starts
only where a run of digits starts, which changes no match but avoids a quadratic search of long runs.

Defined cases: a null text is an empty one and has no spans; a very long text is searched whole; spans of different kinds
may overlap, those of one kind don't; a null id stays null; repeated rows are judged each for
itself; an empty table gives an empty result; further columns play no part (redact() carries them along).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BASE_KINDS = ("email", "ip", "card", "phone")
SCORED_KINDS = ("iban", "ssn", "secret")
KINDS = BASE_KINDS + SCORED_KINDS
MIN_SCORE = 0.6
#: Code points on either side of a span in which context words count.
CONTEXT = 48

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Lengths of the countries' account numbers.
IBAN_LENGTHS = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 "
        "FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 "
        "ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 "
        "ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_SECRET = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])")
#: Words that raise or lower a score when they stand shortly before or behind a span, and by how much.
RAISE, LOWER = 0.3, 0.2
CONTEXT_WORDS = {
    "iban": (("iban", "account", "konto", "compte", "cuenta", "bank", "bic", "swift"), ("serial", "part", "model")),
    "ssn": (("ssn", "social", "security", "taxpayer", "tin"), ("order", "invoice", "serial", "isbn", "model")),
    "secret": (("token", "secret", "key", "password", "passwd", "bearer", "api"), ("sha", "sha1", "sha256", "md5", "checksum", "digest", "commit", "hash")),
}
_WORD = re.compile(r"[^\W_]+")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


_VALUES = {c: str(int(chr(c), 36)) for c in range(ord("A"), ord("Z") + 1)}


def mod97(account: str) -> bool:
    """Whether an account number's check digits are right: moved to the end and read with A=10..Z=35, it leaves 1 modulo 97."""
    return int((account[4:] + account[:4]).translate(_VALUES)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    low = 0
    while at >= 0:
        before = text[max(low, end) : at]
        start = max(low, end) + len(before.rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, (end := m.end())
        low = at + 1
        at = text.find("@", low)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(x := part.lstrip("0")) <= 3 and int(x or "0") <= 255 for part in m.groups()):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37 and 16 <= len(number := digits(m.group())) <= 19 and luhn(number):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(digits(m.group())) <= 15:
                yield m.span()


def context_score(kind: str, text: str, start: int, end: int) -> float:
    """What the words near a span add to its score or take from it."""
    around = text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]
    near = {w.lower() for w in _WORD.findall(around)}
    more, less = CONTEXT_WORDS[kind]
    return RAISE * (not near.isdisjoint(more)) - LOWER * (not near.isdisjoint(less))


def _iban_end(run: str) -> int | None:
    """Where an account number at the run's start ends, if its check digits are right there."""
    known, size, found = IBAN_LENGTHS.get(run[:2]), 0, None
    for group in re.finditer("[^ ]+", run):
        size += len(group.group())
        if size > (known or 34):
            break
        if size == known or not known and size >= 15:
            if mod97(run[: group.end()].replace(" ", "")):
                found = group.end()
    return found


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Spans whose check digits are right; the search goes on behind them, or behind the start of a run without one."""
    at = 0
    while m := _IBAN.search(text, at):
        end = _iban_end(m.group())
        if end is None:
            at = m.start() + 1
        else:
            yield m.start(), m.start() + end
            at = m.start() + end


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m.groups()
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    """Runs of hexadecimal digits that mix digits and letters, of eight kinds at least."""
    for m in _SECRET.finditer(text):
        found = m.group()
        if any(c.isdigit() for c in found) and any(c.isalpha() for c in found) and len(set(found)) >= 8:
            yield m.span()


def _worth(kind: str, found: str) -> float:
    """Score of a confirmed span without its context; an account number of a country without a known length needs some."""
    if kind == "iban":
        return 0.8 if found[:2] in IBAN_LENGTHS else 0.5
    return 0.4


def _scored(text: str) -> Iterator[tuple[str, int, int, float]]:
    for kind, spans in (("iban", _ibans), ("ssn", _ssns), ("secret", _secrets)):
        for a, b in spans(text):
            yield kind, a, b, _worth(kind, text[a:b]) + context_score(kind, text, a, b)


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans (kind, start, end, score), by kind as in KINDS, then start; base spans have score 1."""
    if not text:
        return []
    found = [(kind, a, b, 1.0) for kind, spans in zip(BASE_KINDS, (_emails, _ips, _cards, _phones), strict=True) for a, b in spans(text)]
    return found + [x for x in _scored(text) if x[3] >= MIN_SCORE - 1e-9]


def written(spans: list[tuple[str, int, int, float]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b, _ in spans)


def redacted(text: str | None) -> str | None:
    """The text with every span, or run of overlapping spans, replaced by <KIND> of the first."""
    spans = sorted((a, -b, kind) for kind, a, b, _ in find(text))
    if not spans:
        return text
    out, at = [], 0
    for a, minus_b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, -minus_b)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: id, counts of the base kinds, digest of the base spans, all spans."""

    def make():
        def f(x: dict) -> dict:
            out: dict = {"doc_id": x["id"], **{f"n_{k}": [] for k in BASE_KINDS}, "base_sha256": [], "spans": [], "n_scored": []}
            for text in x["text"]:
                spans = find(text)
                base = [s for s in spans if s[0] in BASE_KINDS]
                for k in BASE_KINDS:
                    out[f"n_{k}"].append(sum(s[0] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
                out["spans"].append(written(spans))
                out["n_scored"].append(len(spans) - len(base))
            return out

        return f

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return common.map_rows(rows, make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_scored long")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with the spans of its text replaced, and the length column, if it has one, brought up to date."""

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(redacted, na_action="ignore")

    common.bound_batches(docs.sparkSession)
    out = docs.withColumn(text_col, clean(F.col(f"`{text_col}`")))
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(text_col).isNotNull(), F.length(text_col).cast("long")).otherwise(F.col(length_col)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents."""
    return detect(common.table(spark, sf_dir, "documents"))


QUERIES = {"op1_pii": op1_pii}
ORACLES: dict[str, str] = {}
