"""Secrets, licenses: against brute force."""

import base64
import random
import re
import string

from brisa.llm import licenses, secrets


def token(prefix, body, good=True):
    check = secrets.crc32_base62(body)
    return f"{prefix}{body}{check if good else check[:-1] + ('0' if check[-1] != '0' else '1')}"


def test_checksums_decide(spark):
    body = "abcdefghijABCDEFGHIJ0123456789"
    good, bad = token("ghp_", body), token("npm_", body, False)
    key = "AKIA" + "ABCDEFGHIJ234567"
    text = f'x {good} y {bad} {key} TOKEN: "0123456789abcdef0123" password = "aaaaaaaaaaaaaaaaaaaa" token = "{good}" ghp_short'
    docs = spark.createDataFrame([(1, text, len(text)), (2, "nothing", 7)], "doc_id bigint, text string, n_chars bigint")
    rows = secrets.scan(docs).collect()
    found = sorted((text[r.start : r.end], r.rule, r.valid) for r in rows)
    assert found == sorted([(good, "forge_token", True), (bad, "package_registry_token", False), (key, "cloud_access_key", True), ("0123456789abcdef0123", "assigned_secret", None), (good, "forge_token", True)])
    assert all("*" in r.secret for r in rows)
    clean = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert good not in clean[1].text and bad in clean[1].text and clean[1].n_chars == len(clean[1].text) and clean[2].text == "nothing"


def test_structures():
    assert secrets._jwt("eyJhbGciOiJIUzI1NiJ9.abcdefgh.abcdefgh") and not secrets._jwt("eyJhbGci.abcdefgh.abcdefgh")
    assert secrets._pem("-----BEGIN PRIVATE KEY-----\nMIIB\n-----END PRIVATE KEY-----") and not secrets._pem("-----BEGIN PRIVATE KEY-----\n!!\n-----END PRIVATE KEY-----")


def test_private_keys_are_masked(spark):
    """OpenSSH keys, encrypted keys with header lines, keys that fail the check."""
    rng = random.Random(5)
    body = lambda head, n=300: base64.encodebytes(head + rng.randbytes(n)).decode()
    block = lambda label, text: f"-----BEGIN {label}PRIVATE KEY-----\n{text}-----END {label}PRIVATE KEY-----"
    headers = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF\n\n"
    keys = [
        (block("OPENSSH ", body(b"openssh-key-v1\0")), True),
        (block("RSA ", headers + body(b"\x99")), None),
        (block("RSA ", headers.replace("\n", "\r\n") + body(b"\x99")), None),
        (block("", body(b"\x30")), True),
        (block("EC ", body(b"\x31")), False),
    ]
    docs = spark.createDataFrame([(k, f"before {key} after") for k, (key, _) in enumerate(keys)], "doc_id bigint, text string")
    found = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert [(found[k].rule, found[k].valid, found[k].end - found[k].start) for k in range(len(keys))] == [("private_key", ok, len(key)) for key, ok in keys]
    assert {r.text for r in secrets.redact(docs).collect()} == {f"before {secrets.MASK} after"}


def test_long_and_unquoted_secrets():
    rng, find = random.Random(6), secrets.Scanner().find
    chars = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
    for before, secret, after in [
        ('token = "', chars(700), '"'),
        ("", "xoxb-" + chars(400), " "),
        ("", "sk_live_" + chars(150), " "),
        ("API_KEY=", chars(32), "\n"),
        ("password: ", chars(24), ""),
    ]:
        assert [h[3] for h in find(f"x {before}{secret}{after}")] == [secret]
    assert not find("token = tokens[0] secret: aaaaaaaabbbbbbbbcccccccc password = get_password(user) token=\n" + chars(30))


def test_same_as_searching_everywhere():
    """The prefilter loses nothing: each rule's expression over the whole text finds no more."""
    rng, scan = random.Random(3), secrets.Scanner()
    parts = ["ghp_", "İ", "token", ' = "', '"', "AKIA", "xoxb-", "eyJ", "é", " ", "secret:", "sk_live_"]
    for _ in range(400):
        text = "".join(rng.choice(parts) if rng.random() < 0.5 else "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randint(1, 40))) for _ in range(30))
        brute = {h for k, p in enumerate(scan.compiled) for i in range(len(text)) if (m := p.match(text, i)) and (h := scan.judge(k, m))}
        assert scan.find(text) == secrets.first_of_overlapping(brute)


def distance_ends(pattern, text, most):
    """Ends of stretches within ``most`` edits of the pattern (Sellers' dynamic programme)."""
    col = list(range(len(pattern) + 1))
    out = set()
    for j, c in enumerate(text):
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(col[i] + (p != c), col[i + 1] + 1, new[i] + 1))
        col = new
        if col[-1] <= most:
            out.add(j + 1)
    return out


def test_license_errors_against_dynamic_programming():
    rng = random.Random(4)
    for name, notice in licenses.NOTICES:
        m = licenses.Matcher([(name, notice)])
        k = m.edits[0]
        for _ in range(12):
            bad = list(notice)
            for _ in range(rng.randint(0, k + 2)):
                i = rng.randrange(len(bad))
                bad[i : i + 1] = rng.choice([[], ["z"], [bad[i], "q"]])
            text = "lorem ipsum " * rng.randint(0, 4) + "".join(bad).title() + "\n dolor sit"
            ends = distance_ends(notice, licenses.fold(text), k)
            found = m.find(text)
            assert bool(found) == bool(ends)
            for s, e, _, n in found:
                assert n <= k and e in ends


def test_license_spans(spark):
    text = "a\nLicensed  under CC BY-NC 4.0. This work is lisenced under the GNU General Public Licence, version 3!"
    docs = spark.createDataFrame([(1, text), (2, "a license to kill; version 3"), (3, "Released under the MIT License.")], "doc_id bigint, text string")
    rows = sorted(licenses.scan(docs).collect())
    assert [(r.doc_id, r.license, r.edits) for r in rows] == [(1, "CC-BY-NC-4.0", 1), (1, "GPL-3.0", 3), (3, "MIT", 0)] or [(r.doc_id, r.license) for r in rows] == [(1, "CC-BY-NC-4.0"), (1, "GPL-3.0"), (3, "MIT")]
    assert all(r.matched == {1: text}.get(r.doc_id, "Released under the MIT License.")[r.start : r.end] for r in rows)
    assert re.match("(?i)licensed", rows[0].matched)
