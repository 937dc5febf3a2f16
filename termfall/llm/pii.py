"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds at-signs, schemes and identifier cues. A deterministic local parser expands
each anchor to its boundaries and validates it: e-mail addresses around at-signs, contact and credential-bearing
addresses after schemes, account numbers and secrets after cues. Addresses of machines, payment cards and phone numbers
need no cue: linear scans over digit runs find them.

Base kinds (email, ip, card, phone) equal leftmost, non-overlapping matches of their patterns; failing candidates are
dropped without a retry. The method adds the kinds in ADDED and leaves base spans as they are.

Edge cases: null and empty texts have no spans; texts are read whole, in time linear in their length (an e-mail pattern
run by a regex engine would be quadratic on long words); repeated rows each get their own result; an empty table gives
an empty table; columns other than the ones named are passed by.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches


BASE = ("email", "ip", "card", "phone")
ADDED = ("address", "account", "secret")
KINDS = BASE + ADDED

SCHEMES = ("http://", "https://", "ftp://", "mailto:", "tel:", "sip:")
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "kontonummer", "compte", "cuenta", "ssn", "social security", "passport", "tax id")
SECRET_CUES = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "api key")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
#: What stands between a scheme and an at-sign; what ends the run that is searched for one; the host behind it; the rest of the address.
_USER = re.compile(r"[^\s/@:?#\"'<>]+(?::[^\s/@?#\"'<>]*)?")
_STOP = re.compile(r"[\s/?#\"'<>]")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\.?(?::[0-9]+)?")
_TAIL = re.compile(r"(?:[/?#][^\s\"'<>]*)?")
_TEL = re.compile(r"\+?[0-9](?:[ ().-]?[0-9]){6,14}")
_ACCOUNT = re.compile(r"(?:\s+(?i:number|no|nr|num|nummer|id))?\.?\s{0,3}[:=#]?\s{0,3}(?:(?<=[\s:=#])(?i:is|ist|est|es|was|lautet)\b\s{0,3}[:=#]?\s{0,3})?\"?([A-Z]{0,2}[0-9][A-Z0-9]*(?:[ -][A-Z0-9]+)*)", re.ASCII)
_SECRET_HEAD = re.compile(r"\s{0,3}[:=]\s{0,3}[\"']?")
_SECRET = re.compile(r"[A-Za-z0-9_+/=.-]*")


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    found: dict[str, tuple[str, int]] = {"@": ("at", 1)}
    for what, words in (("scheme", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for w in words:
            for form in {w, w.upper(), w.capitalize(), w.title()}:
                found[form] = (what, len(form))
    a = ahocorasick.Automaton()
    for w, v in found.items():
        a.add_word(w, v)
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def iban(text: str) -> bool:
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", text):
        return False
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


#: Characters of an IBAN by country; a country that isn't listed may have any length that fits the checksum.
_IBAN_LENGTHS = dict(
    x.split(":")
    for x in (
        "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BI:27 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DJ:27 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FK:18 FO:18 FR:27 GB:22 "
        "GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MN:20 MR:27 "
        "MT:31 MU:30 NI:28 NL:18 NO:15 OM:23 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 RU:33 SA:24 SC:31 SD:18 SE:24 SI:19 SK:24 SM:27 SO:23 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20"
    ).split()
)
#: An account value is never longer than so many characters, blanks included.
_LONGEST = 80
#: Characters behind a cue in which its value is looked for: words between them, and one more than the longest value.
_REACH = 200


def _account(value: str) -> int | None:
    """How many characters of the value are an account: the longest run of its groups that is an IBAN, else the longest of an account's size."""
    ends = [m.start() for m in re.finditer(r"[ -]", value[: _LONGEST + 1])] + [len(value)] * (len(value) <= _LONGEST)
    for fits in (_whole_iban, _numbered):
        for end in reversed(ends):
            # A word after a number, as in "12345678 BIC", isn't part of it.
            if fits(re.sub(r"[ -]", "", value[:end])) and (fits is _whole_iban or not re.search(r" [A-Z]{3,}$", value[:end])):
                return end
    return None


def _whole_iban(compact: str) -> bool:
    return int(_IBAN_LENGTHS.get(compact[:2], len(compact))) == len(compact) and iban(compact)


def _numbered(compact: str) -> bool:
    digits = sum(c.isdigit() for c in compact)
    return 6 <= digits <= 20 and len(compact) <= 24 and digits >= len(compact) - 3


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    if start == at:
        return None
    m = _DOMAIN.match(text, at + 1)
    return (start, m.end()) if m else None


def _ips(text: str) -> list[tuple[int, int]]:
    """Four parts at a time of each dotted chain of numbers, as a leftmost non-overlapping match takes them."""
    out = []
    for m in _DOTTED.finditer(text):
        parts, start = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((start, end))
            start = end + 1
    return out


class _Addresses:
    """Addresses behind schemes. What was found out about a run of text serves all schemes in it, so the work is linear."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.at = self.stop = self.hopeless = -1

    def end(self, after: int) -> int | None:
        """Where the address that begins at `after` ends, if there is one."""
        text = self.text
        if self.stop < after:
            m = _STOP.search(text, after)
            self.stop = m.start() if m else len(text)
        if self.at < after:
            at = text.find("@", after, self.stop)
            self.at = at if at >= 0 else self.stop
        if self.at >= self.stop or self.at == self.hopeless or not _USER.fullmatch(text, after, self.at):
            return None
        host = _HOST.match(text, self.at + 1)
        if not host:
            self.hopeless = self.at
            return None
        return _TAIL.match(text, host.end()).end()


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end), by kind as in KINDS, then start; code points, end exclusive."""
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    floor = 0
    ends = {"address": 0, "account": 0, "secret": 0}
    addresses = _Addresses(text)
    for last, (what, n) in _automaton().iter(text):
        start, after = last - n + 1, last + 1
        if what == "at":
            if start >= floor and (span := _email(text, start, floor)):
                found["email"].append(span)
                floor = span[1]
            continue
        if start and (text[start - 1].isalnum() or text[start - 1] == "_"):
            continue
        if what == "scheme":
            if start < ends["address"]:
                continue
            if text[start:after].lower() == "tel:":
                m = _TEL.match(text, after)
                end = m.end() if m else None
            else:
                end = addresses.end(after)
            if end:
                found["address"].append((start, end))
                ends["address"] = end
        elif what == "account":
            m = _ACCOUNT.match(text, after, after + _REACH)
            if m and m.start(1) > after and m.start(1) >= ends["account"]:
                size = _account(m.group(1))
                if size:
                    found["account"].append((m.start(1), m.start(1) + size))
                    ends["account"] = m.start(1) + size
        elif (m := _SECRET_HEAD.match(text, after)) and m.end() >= ends["secret"]:
            # A run is read once, whether it is a secret or not: what begins inside it is no other one.
            m = _SECRET.match(text, m.end())
            ends["secret"] = m.end()
            if m.end() - m.start() >= 8 and _DIGITS.search(text, *m.span()):
                found["secret"].append(m.span())
    if _DIGITS.search(text):
        if "." in text:
            found["ip"] = _ips(text)
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGITS.findall(m.group())) <= 15:
                    found["phone"].append(m.span())
    return [(k, s, e) for k in KINDS for s, e in found[k]]


def redact(text: str | None, kinds: tuple[str, ...] = KINDS) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced as one, by the first's kind."""
    if not text:
        return text
    spans = sorted((s, -e, k) for k, s, e in find_spans(text) if k in kinds)
    if not spans:
        return text
    out, at = [], 0
    for s, e, k in spans:
        e = -e
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
            at = e
        elif e > at:
            at = e
    return "".join([*out, text[at:]])


_STRUCT = pa.struct([*[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])
_DDL = ", ".join([*[f"n_{k}: bigint" for k in KINDS], "base_sha256: string", "spans: string"])


def spans_column(text: Column) -> Column:
    """A struct column: how many spans of each kind, a digest of the base spans, and all spans as a string."""

    @F.arrow_udf(f"struct<{_DDL}>")
    def spans(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            found = find_spans(t.as_py())
            names = [f"{k}:{s}:{e}" for k, s, e in found]
            n = dict.fromkeys(KINDS, 0)
            for k, _, _ in found:
                n[k] += 1
            base = ",".join(names[: sum(n[k] for k in BASE)])
            rows.append({**{f"n_{k}": v for k, v in n.items()}, "base_sha256": hashlib.sha256(base.encode()).hexdigest(), "spans": ",".join(names)})
        return pa.array(rows, type=_STRUCT)

    return spans(text)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, counts by kind, digest of the base spans, all spans."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col), spans_column(F.col(text_col)).alias("__pii")).select(id_col, "__pii.*")


def redact_pii(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """All columns and rows of docs, spans in the text replaced, the count of characters kept in step."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        return pa.array([redact(t.as_py(), kinds) for t in texts], type=pa.string())

    out = docs.withColumn(text_col, cleaned.asNondeterministic()(F.col(text_col)))
    if chars_col and chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(F.col(chars_col).isNotNull(), F.length(text_col).cast(docs.schema[chars_col].dataType)))
    return out


#: The base kinds' numbers of spans in SQL.
SQL = r"""
WITH found AS (
  SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS emails, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ips,
    [regexp_replace(m, '[^0-9]', '', 'g') FOR m IN regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+')] AS cards, [regexp_replace(m, '[^0-9]', '', 'g') FOR m IN regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]')] AS phones
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
SELECT doc_id, len(emails) AS n_email,
  len([m FOR m IN ips IF len([p FOR p IN string_split(m, '.') IF coalesce(try_cast(p AS HUGEINT), 256) > 255]) = 0]) AS n_ip,
  len([d FOR d IN cards IF length(d) BETWEEN 13 AND 19 AND list_sum([CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(d[i] AS INTEGER) WHEN d[i] > '4' THEN 2 * CAST(d[i] AS INTEGER) - 9 ELSE 2 * CAST(d[i] AS INTEGER) END FOR i IN range(1, length(d) + 1)]) % 10 = 0]) AS n_card,
  len([d FOR d IN phones IF length(d) BETWEEN 9 AND 15]) AS n_phone
FROM found
"""
