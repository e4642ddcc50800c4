"""Keys and tokens are found whatever text touches them."""

import base64
import textwrap

import pytest

from lagpair.llm import secrets


def der(tag, body):
    size = len(body)
    head = bytes([size]) if size < 128 else bytes([0x80 | (size.bit_length() + 7) // 8]) + size.to_bytes((size.bit_length() + 7) // 8, "big")
    return bytes([tag]) + head + body


def pkcs8(n):
    return der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48\xce\x3d\x02\x01") + der(6, b"\x2a\x86\x48\xce\x3d\x03\x01\x07")) + der(4, bytes(k % 251 for k in range(n))))


FIELD = lambda b: len(b).to_bytes(4, "big") + b
SSH = b"openssh-key-v1\0" + FIELD(b"none") + FIELD(b"none") + FIELD(b"") + b"\0\0\0\1" + FIELD(b"p" * 51) + FIELD(b"q" * 136)
PART = lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")
TOKEN = f"{PART('{"alg":"HS256"}')}.{PART('{"sub":"1"}')}.{PART('signature')}"


def b64(raw):
    return base64.b64encode(raw).decode().rstrip("=")


def found(text):
    return [(text[a:b], kind) for a, b, kind in secrets.confirmed_spans(text)]


@pytest.mark.parametrize("n", [109, 110, 111])
@pytest.mark.parametrize("tail", ["\nThe next line", "\r\nword", "\n", "", " x", "\n\nLater", "AAAA"])
def test_an_unpadded_key_ends_where_its_header_says(n, tail):
    key = b64(pkcs8(n))
    assert found(f"key: {key}{tail}") == [(key, "der")]


def test_wrapped_and_indented_keys():
    lines = textwrap.wrap(b64(pkcs8(300)), 64)
    for gap in ("\n", "\r\n", "\n    ", " \n\t"):
        text = "key: |\n    " + gap.join(lines) + "\nnext: word"
        assert found(text) == [(gap.join(lines), "der")]
        assert secrets.redact(text) == "key: |\n    [secret]\nnext: word"


def test_a_key_below_another_run_and_two_keys():
    a, b = b64(pkcs8(110)), b64(pkcs8(111))
    assert found("A" * 64 + f"\n{a}\n{b}\nend") == [(a, "der"), (b, "der")]


def test_padding_belongs_to_the_key():
    key = base64.b64encode(pkcs8(110)).decode()
    assert found(f"{key}\nword") == [(key, "der")]


def test_hex_and_openssh_keys_are_cut():
    assert found(pkcs8(110).hex() + "\nabcdef") == [(pkcs8(110).hex(), "der")]
    assert found(b64(SSH) + "\nThe") == [(b64(SSH), "openssh")]
    wrapped = "\n  ".join(textwrap.wrap(b64(SSH), 70))
    assert found(f"  {wrapped}\n  word") == [(wrapped, "openssh")]


@pytest.mark.parametrize("before,after", [("localhost.", ""), ("www.example-site.", ""), ("", ".trailing-part"), ("alpha-beta.gamma-delta.", ".x"), ("eyJhbGciOiJ.", "")])
def test_a_token_inside_a_dotted_run(before, after):
    assert found(f"see {before}{TOKEN}{after} there") == [(TOKEN, "jwt")]
    assert TOKEN not in secrets.redact(f"see {before}{TOKEN}{after} there")


def test_long_runs_are_linear():
    for text in ("a" * 2_000_000, "a." * 500_000, ("M" * 64 + "\n") * 20_000, "=\n" * 500_000):
        assert found(text) == []


def test_keys_in_other_dress():
    raw = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48\xce\x3d\x02\x01")) + der(4, bytes([251, 255, 254, 62, 63] * 30)))
    url = base64.urlsafe_b64encode(raw).decode().rstrip("=")
    assert "-" in url and "_" in url and found(f"k={url} end") == [(url, "der")]
    key = b64(pkcs8(110))
    for before in ("key", "abcMIIJ", "x/", "M" * 50, "-----BEGIN PRIVATE KEY-----"):
        assert found(before + key + "\nend") == [(key, "der")]
    lines = textwrap.wrap(pkcs8(110).hex(), 48)
    for gap in ("\n", "\r\n  "):
        assert found("dump:\n" + gap.join(lines) + "\n") == [(gap.join(lines), "der")]
    escaped = "\\n".join(textwrap.wrap(b64(pkcs8(300)), 64))
    text = '{"private_key": "-----BEGIN PRIVATE KEY-----\\n' + escaped + '\\n-----END PRIVATE KEY-----"}'
    assert found(text) == [(escaped, "der")] and escaped not in secrets.redact(text)
    pem = "\n".join(textwrap.wrap(base64.b64encode(SSH).decode(), 70))
    assert found(f"-----BEGIN OPENSSH PRIVATE KEY-----\n{pem}\n-----END OPENSSH PRIVATE KEY-----") == [(pem, "openssh")]


@pytest.mark.parametrize("n", [20, 60, 100, 101, 102, 150, 200, 220, 230, 256, 300, 1000, 4000, 9000])
@pytest.mark.parametrize("version", [0, 1, 2])
def test_keys_of_all_lengths_begin_with_known_digits(n, version):
    second = der(4, bytes(k % 249 + 1 for k in range(n))) if version == 1 else der(0x30, der(6, b"\x2a\x86\x48")) + der(4, bytes(k % 249 + 1 for k in range(n)))
    raw = der(0x30, der(2, bytes([version])) + second)
    for text in (b64(raw), base64.urlsafe_b64encode(raw).decode().rstrip("="), raw.hex()):
        assert found(f"a {text} b") == [(text, "der")]


def test_headers_without_a_key_are_passed_over():
    key = b64(pkcs8(200))
    assert found(key[:-4]) == [] and found(key[:100] + "!" + key[100:]) == []
    assert found("MIIBAAIBA" * 20_000) == [] and found("30820fff020100" * 20_000) == []


def test_repeated_rows_and_an_empty_table(spark, documents):
    key = b64(pkcs8(200))
    rows = [(1, key), (1, key), (None, key), (2, None), (3, "")]
    got = sorted(((r["doc_id"], r["spans"]) for r in secrets.find_secrets(documents(rows)).collect()), key=repr)
    assert got == sorted([(1, f"der:0:{len(key)}"), (1, f"der:0:{len(key)}"), (None, f"der:0:{len(key)}"), (2, ""), (3, "")], key=repr)
    assert secrets.find_secrets(documents([])).count() == 0 and secrets.redact_secrets(documents([])).count() == 0
