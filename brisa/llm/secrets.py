"""Operator 1, secret scans.

Method: an Aho-Corasick automaton over the rules' keywords reads every text once; where a keyword
ends, its rules' regular expressions are tried anchored at that very place, never over the text;
what they capture is then held against the checksum or structure that the format embeds.

Rows: ``doc_id, rule, start, end, secret, checksum, valid``, one for each finding. ``start`` and
``end`` count characters. ``secret`` is masked. ``valid``: whether what the format embeds holds; null
where it embeds nothing that can be checked. A token's CRC-32 says much; of random cloud key ids, nine in
ten hold an account number that could be one, so there only ``false`` says something.

Defined results
- Null text or no finding: no row. Null ``doc_id``: kept, as null. Repeated rows: a row each.
- Ties: of findings that overlap, the one of the rule listed first stays, then the leftmost one.
- Empty and very long texts are ordinary texts. An empty table gives no rows. Extra columns are not
  read by ``scan``; ``redact`` keeps them.
"""

from __future__ import annotations

import base64
import json
import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brisa.llm import text
from brisa.session import ensure_importable

MASK = "[SECRET]"
SCHEMA = "doc_id bigint, rule string, start int, end int, secret string, checksum string, valid boolean"
_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


#: Header lines of a PEM block, with continuation lines.
_HEADERS = r"\s*(?:[A-Za-z][A-Za-z0-9-]*:(?:(?!-----)[^\n])*(?:\n[ \t](?:(?!-----)[^\n])*)*\n)+"


def crc32_base62(body: str, width: int = 6) -> str:
    """CRC-32 of ``body`` in base 62, as token formats with a checksum end with it."""
    n, out = zlib.crc32(body.encode("utf-8")), ""
    while n:
        n, r = divmod(n, 62)
        out = _B62[r] + out
    return out.rjust(width, "0")


def _crc(secret: str) -> bool:
    body = secret.rpartition("_")[2]
    return crc32_base62(body[:-6]) == body[-6:]


def _jwt(secret: str) -> bool:
    try:
        head = secret.split(".")[0]
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError):
        return False


def _pem(secret: str) -> bool | None:
    body = re.sub(r"-----[^-]+-----", "", secret)
    headers = re.match(_HEADERS, body)
    body = re.sub(r"\s", "", body[headers.end() :] if headers else body)
    try:
        raw = base64.b64decode(body, validate=True)
    except ValueError:
        return False
    if headers and "ENCRYPTED" in headers[0]:
        return None if raw else False  # the structure is encrypted, too
    # An ASN.1 sequence or OpenSSH's own format, or the file was cut or edited.
    return raw[:1] == b"\x30" or raw.startswith(b"openssh-key-v1\0")


def _account(secret: str) -> bool:
    """The key id embeds its account's number, 40 bits of which only those with up to 12 digits are used."""
    raw = base64.b32decode(secret[4:])
    return (int.from_bytes(raw[:6], "big") >> 7 & (1 << 40) - 1) < 10**12


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched where a keyword begins; group 1, or all of it, is the secret."""

    name: str
    keywords: tuple[str, ...]
    pattern: str
    checksum: str = "none"
    least_entropy: float = 0.0
    #: Masked even if the check fails.
    always: bool = False


CHECKS = {"crc32-base62": _crc, "jwt-header": _jwt, "asn1": _pem, "account-number": _account}
_L, _R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_ASSIGNED = ("token", "secret", "api_key", "api-key", "apikey", "password", "passwd", "access_key")
RULES = (
    Rule("forge_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), _L + r"(gh[pousr]_[A-Za-z0-9]{36})" + _R, "crc32-base62"),
    Rule("forge_fine_grained_token", ("github_pat_",), _L + r"(github_pat_[A-Za-z0-9]{22}_[A-Za-z0-9]{59})" + _R),
    Rule("forge_access_token", ("glpat-",), _L + r"(glpat-[A-Za-z0-9_-]{20,}+)"),
    Rule("package_registry_token", ("npm_",), _L + r"(npm_[A-Za-z0-9]{36})" + _R, "crc32-base62"),
    Rule("cloud_access_key", ("akia", "asia"), _L + r"(A[KS]IA[A-Z2-7]{16})" + _R, "account-number"),
    Rule("chat_token", ("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), r"(?<![A-Za-z0-9])(xox[abprs]-[0-9A-Za-z-]{20,})"),
    Rule("payment_api_key", ("sk_live_", "rk_live_"), _L + r"([sr]k_live_[0-9A-Za-z]{24,})" + _R),
    Rule("maps_api_key", ("aiza",), _L + r"(AIza[0-9A-Za-z_\-]{35})(?![0-9A-Za-z_\-])"),
    Rule("jwt", ("eyj",), _L + r"(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", "jwt-header"),
    Rule("private_key", ("-----begin ",), r"(-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----(?:" + _HEADERS + r")?[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )?PRIVATE KEY-----)", "asn1", always=True),
    Rule("assigned_secret", _ASSIGNED, r"""(?i:token|secret|api[_-]?key|password|passwd|access_key)["']?\s{0,3}(?::=|=>|[:=])\s{0,3}["']([0-9A-Za-z_\-/+.=]{16,})["']""", least_entropy=2.5),
    # Names and paths in code look much like it; the floor keeps most of them out.
    Rule("unquoted_secret", _ASSIGNED, r"""(?i:token|secret|api[_-]?key|password|passwd|access_key)\s{0,3}[:=][^\S\n]{0,3}([0-9A-Za-z_\-/+.=]{16,}+)(?!\S)""", least_entropy=3.5),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.compiled = [re.compile(r.pattern) for r in rules]
        self.automaton = ahocorasick.Automaton()
        by: dict[str, list[int]] = {}
        for k, rule in enumerate(rules):
            for word in rule.keywords:
                by.setdefault(word.lower(), []).append(k)
        for word, ks in by.items():
            self.automaton.add_word(word, (len(word), tuple(ks)))
        self.automaton.make_automaton()

    def judge(self, k: int, m: re.Match) -> tuple | None:
        rule = self.rules[k]
        g = 1 if m.re.groups else 0
        secret = m[g]
        if rule.least_entropy and _entropy(secret) < rule.least_entropy:
            return None
        check = CHECKS.get(rule.checksum)
        return (m.start(g), m.end(g), k, secret, check(secret) if check else None)

    def find(self, string: str) -> list[tuple]:
        """(start, end, rule index, secret, valid), by place, none overlapping."""
        low = string.lower()
        if len(low) != len(string):  # some capitals have longer small forms; places must stay
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in string)
        found = set()
        for end, (n, ks) in self.automaton.iter(low):
            for k in ks:
                m = self.compiled[k].match(string, end - n + 1)
                if m and (hit := self.judge(k, m)):
                    found.add(hit)
        return first_of_overlapping(found)


def first_of_overlapping(found) -> list[tuple]:
    """By place; of findings that overlap, the one of the rule listed first stays, then the leftmost one."""
    return text.first_of_overlapping(found, lambda h: (h[2], h[0], -h[1]))


def mask(secret: str) -> str:
    return secret[:4] + "*" * (len(secret) - 4)


_SCANNER: list[Scanner] = []


def scanner() -> Scanner:
    if not _SCANNER:
        _SCANNER.append(Scanner())
    return _SCANNER[0]


def _scan(batches):
    find, rules = scanner().find, RULES
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_()]
    for b in batches:
        rows = [(d, rules[k].name, s, e, mask(x), rules[k].checksum, ok) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for s, e, k, x, ok in find(t)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def scan(docs: DataFrame) -> DataFrame:
    """All findings in all documents. One pass, no shuffle."""
    ensure_importable(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_scan, SCHEMA)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each finding replaced by ``MASK``, but those whose checksum fails.

    Private keys are masked whatever their check says: a block that was cut still gives a key away.

    Other columns stay; ``n_chars`` is set anew. Documents without a finding are unchanged.
    """
    ensure_importable(docs.sparkSession)

    @F.pandas_udf(T.StringType())
    def clean(texts):
        find, out = scanner().find, []
        for t in texts:
            hits = [h for h in find(t) if h[4] is not False or RULES[h[2]].always] if t else []
            for s, e, *_ in reversed(hits):
                t = t[:s] + MASK + t[e:]
            out.append(t)
        return type(texts)(out, dtype=object)

    done = docs.withColumn("text", clean("text"))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(docs.columns)
