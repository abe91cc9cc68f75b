import time
import base64
import bz2
import gzip
import hashlib
import json
import lzma
import re
import urllib.parse
import zlib

import pytest
import zstandard
from hypothesis import given, strategies as st

from dripline.llm.secret_scan import KINDS, base_spans, find_secrets, redact, redacted, scan, written

SECRET = "password=hunter2hunter2"


def brute(text):
    """The contract, read literally."""
    word = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
    word += "|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    assign = re.compile(word + "[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


pieces = st.sampled_from(
    ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "=", ":", " ", "'", '"', "abcd",
     "12345678", "AKIA", "KIA", "AKIAABCDEFGHIJKL", "0123456789abcdef", "deadbeefdeadbeef", "é", "ſ",
     "K", "\n", "Z"]
)


@given(st.lists(pieces, max_size=14).map("".join))
def test_base_spans_follow_the_contract(text):
    assert base_spans(text) == brute(text)


def encoded(kind, data):
    if kind == "url":
        return urllib.parse.quote_from_bytes(data, safe="")
    if kind == "every":
        return "".join(f"%{x:02X}" for x in data)
    if kind == "unicode":
        return "".join(f"\\u{x:04x}" for x in data)
    if kind == "entities":
        return "".join(f"&#{x};" for x in data)
    if kind == "base64":
        return base64.b64encode(data).decode()
    if kind == "urlsafe":
        return base64.urlsafe_b64encode(data).decode()
    packed = {"gzip": gzip.compress, "zlib": zlib.compress, "bz2": bz2.compress, "xz": lzma.compress}
    return base64.b64encode(packed[kind](data)).decode()


LAYERS = ["url", "every", "unicode", "entities", "base64", "urlsafe", "gzip", "zlib", "bz2", "xz"]


@pytest.mark.parametrize("outer", LAYERS)
@pytest.mark.parametrize("inner", LAYERS)
def test_two_layers_are_opened_and_mapped(outer, inner):
    hidden = encoded(outer, encoded(inner, f"note {SECRET} end".encode()).encode())
    text = f"Ünïcode before: {hidden} and after"
    base, spans, _, _ = scan(text)
    low, high = text.index(hidden), text.index(hidden) + len(hidden)
    found = [s for s in spans if s[1] == 0]
    assert found and all(low <= start < end <= high for start, _, end in found)
    assert base == brute(text) and set(base) <= set(spans)


def test_a_layer_of_escapes_is_mapped_to_the_character():
    text = "é pass%77ord%3Dabcdefgh1 x"
    assert scan(text)[1] == [(2, 0, len(text) - 2)]


def test_base64_is_found_where_letters_stand_before_it():
    hidden = base64.b64encode(f"the {SECRET} is here".encode()).decode()
    for before in ("", "a", "ab", "abc"):
        text = f"x {before}{hidden}"
        assert [s for s in scan(text)[1] if s[1] == 0], before


def test_wrapped_base64():
    data = base64.b64encode((SECRET + " filler text " * 20).encode()).decode()
    lines = "\n".join(data[i : i + 76] for i in range(0, len(data), 76))
    assert [s for s in scan(f"mail:\n{lines}\n-- end")[1] if s[1] == 0]


def test_ten_layers():
    data = SECRET.encode()
    for _ in range(10):
        data = base64.b64encode(zlib.compress(data))
    assert [s for s in scan(f"a {data.decode()} b")[1] if s[1] == 0]


def test_layers_that_repeat_end():
    assert scan("%25" * 5 + "%2525252541")[3] == 0
    assert scan("\\u005cu005cu0041" * 3)[3] == 0


NESTED = {
    "percent": lambda n, c: "%" + "25" * n + f"{ord(c):02x}",
    "unicode": lambda n, c: "\\" + "u005c" * n + f"u{ord(c):04x}",
    "braces": lambda n, c: "\\" + "u{5c}" * n + f"u{{{ord(c):x}}}",
    "hex": lambda n, c: "\\" + "x5c" * n + f"x{ord(c):02x}",
    "entities": lambda n, c: "&" + "#38;" * n + f"#{ord(c)};",
    "hex entities": lambda n, c: "&" + "#x26;" * n + f"#x{ord(c):x};",
    "mixed": lambda n, c: "%" + "25" * n + "5cu00" + f"{ord(c):02x}",
}


@pytest.mark.parametrize("name", NESTED)
@pytest.mark.parametrize("n", [0, 3, 7, 8, 9, 40])
def test_nested_escapes_are_decoded_to_the_end(name, n):
    nested = NESTED[name]
    text = "é " + "".join(nested(n, c) for c in "password") + "=abcdefgh1 x"
    assert (2, 0, len(text) - 2) in scan(text)[1]


@pytest.mark.parametrize("name", NESTED)
def test_nested_escapes_take_linear_time(name):
    text = NESTED[name](20_000, "p") + "assword=abcdefgh1 x"
    started = time.perf_counter()
    assert (0, 0, len(text) - 2) in scan(text)[1]
    assert time.perf_counter() - started < 20


def test_deep_escapes_beside_other_layers():
    hidden = base64.b64encode(SECRET.encode()).decode()
    text = "".join(NESTED["percent"](12, c) for c in hidden) + " %C3%A9 " + "%25" * 9 + "C3%A9"
    assert [s for s in scan(text)[1] if s[1] == 0]


def test_too_long_a_layer_is_counted_and_the_rest_is_read():
    bomb = base64.b64encode(zlib.compress(b"a" * 100_000)).decode()
    other = base64.b64encode(SECRET.encode()).decode()
    _, spans, _, unopened = scan(f"{bomb} {other}", limit=10_000)
    assert unopened >= 1 and [s for s in spans if s[1] == 0]


def test_redacting():
    assert redacted("a token: abcdefgh1 b") == "a [assign] b"
    hidden = base64.b64encode(SECRET.encode()).decode()
    assert scan(redacted(f"see {hidden} and {SECRET}"))[1] == []
    assert redacted("nothing") == "nothing"


def test_rows(odd_documents, no_documents):
    rows = find_secrets(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert {row["n_assign"] for row in rows} == {0}
    assert rows[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert find_secrets(no_documents).collect() == []
    kept = redact(odd_documents)
    assert kept.columns == odd_documents.columns
    assert kept.exceptAll(odd_documents).isEmpty() and odd_documents.exceptAll(kept).isEmpty()
    assert redact(no_documents).collect() == []


def test_whole_table_against_brute_force(spark, sf_dir):
    # The smallest tables hold no secret.
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    texts = {row["doc_id"]: row["text"] for row in docs.collect()}
    rows = find_secrets(docs).collect()
    assert len(rows) == len(texts)
    for row in rows:
        base = brute(texts[row["doc_id"]])
        assert row["base_sha256"] == hashlib.sha256(written(base).encode()).hexdigest()
        counts = [sum(kind == k for _, kind, _ in base) for k in range(3)]
        assert counts == [row["n_assign"], row["n_access"], row["n_hex"]]
        assert set(written(base).split(",")) <= set(row["spans"].split(","))
        assert [f"{x['kind']}:{x['start']}:{x['end']}" for x in row["found"]] == (
            row["spans"].split(",") if row["spans"] else []
        )
    assert sum(len(row["found"]) for row in rows) > 3 and KINDS[0] == "assign"


PACKERS = {
    "gzip": gzip.compress,
    "zlib": zlib.compress,
    "bz2": bz2.compress,
    "xz": lzma.compress,
    "zstd": zstandard.ZstdCompressor().compress,
}


def hides_secret(text):
    return any(kind == 0 for _, kind, _ in scan(text)[1])


@pytest.mark.parametrize("outer", PACKERS)
@pytest.mark.parametrize("inner", PACKERS)
def test_compressed_in_compressed(outer, inner):
    packed = PACKERS[outer](PACKERS[inner](f"note {SECRET} end".encode()))
    hidden = base64.b64encode(packed).decode()
    text = f"see {hidden} end"
    assert hides_secret(text) and not hides_secret(redacted(text))
    twice = base64.b64encode(PACKERS[outer](packed)).decode()
    assert hides_secret(f"see {twice} end")


@pytest.mark.parametrize("name", PACKERS)
@pytest.mark.parametrize("n", [2, 3])
def test_all_members_are_read(name, n):
    pack = PACKERS[name]
    members = b"".join(pack(b"nothing of note here " * 9) for _ in range(n - 1))
    hidden = base64.b64encode(members + pack(SECRET.encode())).decode()
    assert hides_secret(f"see {hidden} end")
    # A secret may lie across two members.
    hidden = base64.b64encode(pack(SECRET[:12].encode()) + pack(SECRET[12:].encode())).decode()
    assert hides_secret(f"see {hidden} end")


def test_what_may_stand_between_members():
    first, second = b"nothing of note here " * 9, SECRET.encode()
    skipped = b"\x50\x2a\x4d\x18\x04\x00\x00\x00abcd"
    for name, between in (("gzip", bytes(5)), ("xz", bytes(4)), ("zstd", skipped)):
        data = PACKERS[name](first) + between + PACKERS[name](second)
        assert hides_secret(f"see {base64.b64encode(data).decode()} end"), name


def test_members_are_bounded_together():
    for name, pack in PACKERS.items():
        bomb = base64.b64encode(pack(b"a" * 6_000) + pack(b"a" * 6_000)).decode()
        assert scan(bomb, limit=10_000)[3] == 1, name
        assert scan(bomb, limit=12_000)[3] == 0, name


def test_a_missing_library_is_not_hidden(monkeypatch):
    def missing():
        raise ImportError("zstandard")

    monkeypatch.setattr("zstandard.ZstdDecompressor", missing)
    hidden = base64.b64encode(PACKERS["zstd"](SECRET.encode() * 3)).decode()
    with pytest.raises(ImportError):
        scan(hidden)


LONG_NOTE = f"{SECRET} ".encode() + b" ".join(hashlib.sha256(b"%d" % i).digest() for i in range(9))


@pytest.mark.parametrize("name", PACKERS)
def test_compressed_data_behind_other_letters(name):
    hidden = base64.b64encode(PACKERS[name](LONG_NOTE)).decode()
    for before in ("files/backup_", "data_", "a/b/c/", "x" * 50, "--"):
        assert hides_secret(f"see {before}{hidden} end"), before
    hidden = base64.b64encode(b"some bytes \x00\xff" + PACKERS[name](LONG_NOTE)).decode()
    assert hides_secret(hidden)


@pytest.mark.parametrize("name", PACKERS)
@pytest.mark.parametrize("quote", [urllib.parse.quote, urllib.parse.quote_plus])
def test_url_escaped_compressed_data(name, quote):
    packed = PACKERS[name](LONG_NOTE)
    hidden = f"https://host/path?q=1&data={quote(packed)}"
    text = f"é {hidden} and after it"
    assert hides_secret(text)
    start, _, end = next(x for x in scan(text)[1] if x[1] == 0)
    assert text.index(quote(packed)[:20]) == start and end == 2 + len(hidden)


@pytest.mark.parametrize("name", PACKERS)
def test_escaped_compressed_data(name):
    packed = PACKERS[name](LONG_NOTE)
    as_json = json.dumps(packed.decode("latin-1"))
    entities = "".join(chr(x) if chr(x).isalnum() and x < 128 else f"&#{x};" for x in packed)
    for text in (f"data = {packed!r} # bytes", f'{{"data": {as_json}}}', f"<p>{entities}</p>"):
        assert hides_secret(text), text


@pytest.mark.parametrize("pack", [bytes, gzip.compress])
@pytest.mark.parametrize("width", [8, 20, 59, 64])
@pytest.mark.parametrize(
    ("first", "between", "last"),
    [
        ("key: ", "\n     ", "\nend"),
        ('x = ("', '"\n     "', '")'),
        ('x = "', '" +\r\n\t"', '";'),
        ("> ", "\n> ", "\n> bye"),
        ("# ", "\n# ", "\n"),
        ('{"x": "', "\\n", '\\n"}'),
    ],
)
def test_base64_in_lines(pack, width, first, between, last):
    data = base64.b64encode(pack(LONG_NOTE)).decode()
    text = first + between.join(data[i : i + width] for i in range(0, len(data), width)) + last
    spans = [x for x in scan(text)[1] if x[1] == 0]
    assert spans and len(first) <= spans[0][0] < spans[0][2] <= len(text)
    assert not hides_secret(redacted(text))


def test_runs_of_letters_take_linear_time():
    for text in ("x" * 300_000, "abc\n" * 100_000, '"' * 100_000, "%78%9c" * 20_000, " \t" * 100_000):
        assert scan(text)[1] == []


def test_what_is_too_long_to_be_opened_is_redacted_whole():
    content = b"a" * 20_000 + SECRET.encode()
    for name, pack in PACKERS.items():
        hidden = base64.b64encode(pack(content)).decode()
        text = f"see {hidden} and token: abcdefgh1 end"
        assert scan(text, limit=10_000)[3] >= 1, name
        out = redacted(text, limit=10_000)
        assert "[unopened]" in out and out.endswith(" and [assign] end"), name
        assert not hides_secret(out), name
        assert "[unopened]" not in redacted(text), name
