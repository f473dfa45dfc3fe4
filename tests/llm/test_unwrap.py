import base64
import bz2
import gzip
import random
import re
import zlib
from urllib.parse import quote

import pytest
import zstandard

from backline.llm import unwrap as U
from .frames import ODD, docs

KEY = "AKIA" + "ABCDEFGHIJ234567"
SECRET = f"password = {'s3cr3tvalue'}"


def plain(text):
    """The base rule, literally: leftmost non-overlapping matches, failing ones dropped."""
    out = []
    for kind, rule, ok in (
        (0, r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 6),
        (1, r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        (2, r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ):
        out += [(m.start(), kind, m.end()) for m in re.finditer(rule, text) if ok(m)]
    return sorted(out)


TEXTS = [
    "secret: token = abcdefgh", 'PassWD"="abc" toKen:abcdef', "tokeN=abcdef", "ſecret=abcdefg Key", "api_key='x' apikey:1234567890", KEY + " " + KEY[:19] + "!", "AKIAxAKIA" + KEY[4:],
    "f" * 24 + "g" + "0" * 23, "é" * 9 + "deadbeef" * 4 + "ñ", "token=" + "a" * 24, "", "password=" + "=" * 7,
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_rule(text):
    assert U.unwrap_scan(text)["base"] == plain(text)


def b64(x):
    return base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()


def escaped(x):
    return "".join(f"\\u{ord(c):04x}" for c in x)


WRAPPED = {
    "url": quote(SECRET, safe="").replace("p", "%70"),
    "unicode": escaped(SECRET),
    "base64": b64("here is " + SECRET),
    "gzip": b64(gzip.compress(SECRET.encode())),
    "zlib": b64(zlib.compress(SECRET.encode())),
    "zstd": b64(zstandard.compress(SECRET.encode())),
    "double url": quote(quote(SECRET, safe=""), safe="").replace("assword", "%61ssword"),
    "base64 of escapes of base64": b64(escaped(b64(SECRET))),
    "packed twice": b64(gzip.compress(zlib.compress(SECRET.encode()))),
    "base64 of gzip of base64 of url": b64(gzip.compress(b64(quote(SECRET, safe="")).encode())),
}


@pytest.mark.parametrize("name", WRAPPED)
def test_nested_secret_is_mapped_into_its_wrapping(name):
    before, after = "some é text, ", " and more 漢字"
    text = before + WRAPPED[name] + after
    found = [s for s in U.unwrap_scan(text)["all"] if s[1] == 0]
    assert found, name
    for start, _, end in found:
        assert len(before) <= start < end <= len(before) + len(WRAPPED[name])


def test_exact_mapping_of_escapes():
    text = "ab %70assword%3D" + "abcdef%41x yz"
    r = U.unwrap_scan(text)
    assert (3, 0, text.index(" yz")) in r["all"]
    assert r["paths"][3, 0, text.index(" yz")] == "url"


def test_ends_on_data_that_unpacks_to_itself(monkeypatch):
    monkeypatch.setattr(U, "_unpack", lambda data: (data, False))
    assert U.unwrap_scan("x " + b64("just some words in here"))["layers"] <= 2
    text = "%25" * 50 + "41"
    assert U.unwrap_scan(text)["layers"] < 100


def test_oversize_layer_is_counted(monkeypatch):
    monkeypatch.setattr(U, "MAX_LAYER", 1000)
    assert U.unwrap_scan(b64(gzip.compress(b"token=abcdefg " * 1000)))["oversize"] == 1


def test_documents(spark):
    rows = ODD + [(6, WRAPPED["url"] + " " + KEY), (7, "token = 'abcdef1' " * 4000)]
    got = {r.doc_id: r for r in U.secret_spans(docs(spark, rows, extra=("spans",))).collect()}
    assert got[6].n_access == 1 and got[6].n_assign == 0 and got[6].spans.startswith("assign:0:") and got[6].found_in == "url"
    assert got[7].n_assign == 4000 and got[7].spans == got[7].base_spans
    assert U.secret_spans(docs(spark, rows)).count() == len(rows)
    assert U.secret_spans(docs(spark, [])).count() == 0


def lines(x, width=76):
    return "\n".join(x[k : k + width] for k in range(0, len(x), width))


FILLER = " ".join(f"word{k * 7919 % 1000}" for k in range(200))
MISSED = {
    "second gzip member": b64(gzip.compress(b"nothing here") + gzip.compress(SECRET.encode())),
    "second bzip2 member": b64(bz2.compress(b"nothing here") + bz2.compress(SECRET.encode())),
    "second zstandard frame": b64(zstandard.compress(b"nothing here") + zstandard.compress(SECRET.encode())),
    "percent run with a stray byte": "%FF" + "".join(f"%{b:02X}" for b in SECRET.encode()),
    "broken base64": lines(b64(FILLER + " " + SECRET + " " + FILLER), 12 * 4),
    "broken base64 of gzip": lines(b64(gzip.compress((FILLER + SECRET).encode()))),
}


@pytest.mark.parametrize("name", MISSED)
def test_every_member_stretch_and_line_is_read(name):
    text = "before " + MISSED[name] + "\nafter"
    found = [s for s in U.unwrap_scan(text)["all"] if s[1] == 0]
    assert found, name
    assert all(7 <= start < end <= 7 + len(MISSED[name]) for start, _, end in found)


def test_oversize_layers_are_read_to_the_end(monkeypatch):
    monkeypatch.setattr(U, "MAX_LAYER", 1000)
    for data in (("é x " * 5000 + SECRET + " y" * 700).encode(), gzip.compress(("x " * 5000 + SECRET).encode())):
        got = U.unwrap_scan(b64(gzip.compress(data)))
        assert any(kind == 0 for _, kind, _ in got["all"]) and got["oversize"] == 1


ACCESS = "AKIA" + "Q7Z2" * 5


@pytest.mark.parametrize("before", ["see https://host.example/files/", "id-", "blob_", "key/", "a/b-c_d/", "x", "xy", "xyz", "name="])
@pytest.mark.parametrize("after", ["", "==", "/more", ".", "-x"])
def test_base64_behind_other_letters(before, after):
    for secret in (ACCESS, "password=hunter22"):
        code = b64(f"the {secret} here").rstrip("=")
        found = U.unwrap_scan(f"{before}{code}{after}")["all"]
        first, last = len("the ") * 4 // 3, -(-len(f"the {secret}") * 8 // 6)
        assert (len(before) + first, 1 if secret is ACCESS else 0, len(before) + last) in found


@pytest.mark.parametrize("width", [4, 5, 12, 16, 64])
def test_base64_over_lines_of_any_width(width):
    code = lines(b64(FILLER[:100] + " " + ACCESS + " " + FILLER[:40]), width)
    found = [s for s in U.unwrap_scan("start\n" + code + "\n\nend")["all"] if s[1] == 1]
    assert found and all(6 <= a < b <= 6 + len(code) for a, _, b in found)


def test_bytes_that_are_not_text_end_a_layer_only():
    for junk in (b"\x00", b"\xff", b"\x07\x80\x81", "\u200b".encode()):
        code = b64(b"head " + junk + b" token=abcdefgh1 " + junk + b" " + ACCESS.encode() + junk)
        assert {k for _, k, _ in U.unwrap_scan(code)["all"]} == {0, 1}, junk
    packed = b64(gzip.compress(b"\x00\x01" + ACCESS.encode() + b"\xfe"))
    assert {k for _, k, _ in U.unwrap_scan(packed)["all"]} == {1}


def wrapped(rnd, text):
    """(encoded text, name) by one random encoding."""
    kind = rnd.randrange(8)
    code = base64.b64encode(text.encode()).decode()
    if kind == 0:
        return code, "base64"
    if kind == 1:
        return rnd.choice(["", "a/", "dir-", "k_", "p/q/"]) + code.replace("+", "-").replace("/", "_").rstrip("="), "url-safe"
    if kind == 2:
        return lines(code, rnd.randrange(4, 80)), "lines"
    if kind == 3:
        pack = rnd.choice([gzip.compress, bz2.compress, zlib.compress, zstandard.compress])
        return base64.b64encode(pack(text.encode())).decode(), "packed"
    if kind == 4:
        return "".join(f"%{b:02X}" for b in text.encode()), "percent"
    if kind == 5:
        return "".join(f"\\u{ord(c):04x}" for c in text), "unicode"
    if kind == 6:
        return base64.b64encode(bytes([rnd.randrange(128, 192)]) + text.encode() + b"\x00").decode(), "dirty"
    return rnd.choice(["https://h.example/", "id-", "f="]) + code.rstrip("="), "path"


@pytest.mark.parametrize("seed", range(120))
def test_generated_nestings(seed):
    rnd = random.Random(seed)
    text, names = f"{FILLER[:rnd.randrange(30)]} {ACCESS} {FILLER[:rnd.randrange(30)]}", []
    for _ in range(rnd.randrange(1, 5)):
        text, name = wrapped(rnd, text)
        names.append(name)
    before = rnd.choice(["", "some words ", "line\n"])
    found = [s for s in U.unwrap_scan(f"{before}{text} end")["all"] if s[1] == 1]
    assert found, names
    assert all(len(before) <= a < b <= len(before) + len(text) for a, _, b in found), names
