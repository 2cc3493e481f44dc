import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import time
import zlib
from collections import Counter
from urllib.parse import quote

import pytest
import zstandard

from tessarion.llm import pii, quality_rules, secret_scan
from tessarion.llm.quality_rules import Bands, measure, repeated_words

SCHEMA = "doc_id long, text string, kept int, rules string"
EDGE = [(1, None), (2, ""), (3, " \n\t"), (None, "a b"), (4, "x " * 40_000), (4, "x " * 40_000), (5, "é　ü #*$ \n\nline\nline")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "clash") for i, t in rows], SCHEMA)


def brute_repeats(words, width=8):
    windows = [tuple(words[k : k + width]) for k in range(len(words) - width + 1)]
    n = Counter(windows)
    return len({k + j for k, w in enumerate(windows) if n[w] > 1 for j in range(width)})


@pytest.mark.parametrize("text", ["", "a b c d e f g h", "a " * 9, "a b c d e f g h i " * 3 + "z", "a b c d e f g h q a b c d e f g h", "a a a a a a a a b " * 2])
def test_repeated_words_against_brute_force(text):
    assert repeated_words(text.encode().split()) == brute_repeats(text.split())


def test_rules_against_brute_force(spark, rows_of):
    rows = rows_of("documents", 400) + EDGE
    got = quality_rules.op9(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_text = {(i, t): None for i, t in rows}
    press = zstandard.ZstdCompressor(level=3)
    want = Counter()
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        rep = brute_repeats(words)
        failed = len(words) < 20 or 100 * rep > 30 * len(words)
        want[i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), dup, rep, failed, measure(t, Bands(), press)[-1]] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")) for r in got) == want
    assert by_text


def test_bands_reject_repetition_and_noise_and_keep_prose(spark, rows_of):
    import random

    rng = random.Random(1)
    noise = " ".join("".join(chr(rng.randrange(33, 0x2FF)) for _ in range(12)) for _ in range(200))
    cycle = " ".join(f"w{k % 11}" for k in range(25)) + " " + "ab" * 4000
    press = zstandard.ZstdCompressor(level=3)
    assert not measure(noise, Bands(), press)[-1]
    assert not measure(cycle, Bands(), press)[-1]
    kept = quality_rules.keep_good(frame(spark, [(1, noise), (2, cycle), (3, None)]))
    assert kept.columns == ["doc_id", "text", "kept", "rules"] and kept.count() == 0
    assert quality_rules.op9(frame(spark, [])).count() == 0


def test_chunks_cover_every_byte_and_weigh_by_bytes(rows_of):
    import random

    rng = random.Random(4)
    press = zstandard.ZstdCompressor(level=3)
    prose = " ".join(t for _, t in rows_of("documents", 400) if measure(t, Bands(), press)[-1] and t.isascii())
    noise = "".join(chr(rng.randrange(33, 127)) for _ in range(5000))
    spoilt = [(4096, noise[:3000]), (4096, noise[:4096]), (5000, "ab" * 1450), (700, noise[:600]), (2000, "ab" * 500)]
    for k in range(0, 40):
        at = k * 997
        for n, tail in spoilt:
            assert not measure(prose[at : at + n] + tail, Bands(), press)[-1], (k, n)
            assert not measure(tail + prose[at : at + n], Bands(), press)[-1], (k, n)
    for n in (511, 512, 513, 1023, 1024, 1500):
        got = measure(noise[:n], Bands(), press)
        assert got[-3:] == ((0, 0, False) if n <= 512 else (-(-n // 512), n, False))
    assert sum(measure(t, Bands(), press)[-1] for t in (prose[k * 997 : k * 997 + 4096] for k in range(40))) >= 39


KEY = "AKIA" + "B7" * 9


def test_base_spans_and_digest(spark):
    text = f'é password: "hunter22" Token=abc {KEY} AKIAshort ' + "ab12" * 7 + " SECRET =ſſſſſſſ"
    base, spans, _ = secret_scan.find_secrets(text)
    assert [(k, text[s:e]) for s, k, e in base] == [(0, 'password: "hunter22'), (1, KEY), (2, "ab12" * 7)]
    row = secret_scan.secret_scan(frame(spark, [(1, text)])).first()
    said = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in base)
    assert row["base_sha256"] == hashlib.sha256(said.encode()).hexdigest() and row["spans"] == said and (row["n_assign"], row["n_access"], row["n_hex"]) == (1, 1, 1)


PLAIN = "password=correcthorse9"


@pytest.mark.parametrize(
    "hidden",
    [
        quote(PLAIN, safe="").replace("c", "%63"),
        "".join(f"\\u{ord(c):04x}" for c in PLAIN),
        "".join(f"&#{ord(c)};" for c in PLAIN),
        base64.b64encode(PLAIN.encode()).decode(),
        base64.urlsafe_b64encode(base64.b64encode(PLAIN.encode())).decode(),
        base64.b64encode(gzip.compress(PLAIN.encode())).decode(),
        base64.b64encode(zstandard.ZstdCompressor().compress(gzip.compress(PLAIN.encode()))).decode(),
        quote(base64.b64encode(PLAIN.encode()).decode().replace("=", "%3D")),
    ],
)
def test_nested_layers_map_back_into_their_region(hidden):
    text = f"héllo {hidden} tail"
    start = text.index(hidden)
    _, spans, layers = secret_scan.find_secrets(text)
    assert layers > 1
    assert any(k == "assign" and start <= s < e <= start + len(hidden) for s, k, e in spans)


B64 = base64.b64encode(PLAIN.encode()).decode()


@pytest.mark.parametrize(
    "hidden",
    [
        "https://x/?a=%E9&password%3Dhunter22",
        "https://x/?a=%00%FF&password%3Dhunter22",
        base64.b64encode(PLAIN.encode("utf-16")).decode(),
        base64.b64encode(b"\x1b[1m log\0 \xff " + PLAIN.encode() + b" \xe9").decode(),
        "blob_" + B64,
        "cfg/" + B64,
        "example/v/" + B64,
        "blob_" + base64.b64encode(gzip.compress(PLAIN.encode())).decode(),
        "\n".join(re.findall(".{1,64}", base64.b64encode(b"zzzz" * 10 + b" passwo" + b"rd=correcthorse9 " + b"yyyy" * 20).decode())),
    ],
)
def test_secrets_beside_other_bytes(hidden):
    text = f"héllo {hidden} tail"
    start = text.index(hidden)
    _, spans, _ = secret_scan.find_secrets(text)
    assert any(k == "assign" and start <= s < e <= start + len(hidden) for s, k, e in spans)


def test_spans_in_layers_are_exact():
    text = "x " + base64.b64encode(b"zzzz zzzz " + KEY.encode() + b" zzzz zzzz").decode()
    _, spans, _ = secret_scan.find_secrets(text)
    ((s, k, e),) = [x for x in spans if x[1] == "access"]
    inner = base64.b64decode(text[2 + (s - 2) // 4 * 4 : 2 + -(-(e - 2) // 4) * 4])
    assert KEY.encode() in inner and len(inner) <= len(KEY) + 4


def test_large_and_nested_streams_are_read_to_their_end():
    small = secret_scan.Limits(window_bytes=1 << 16, overlap_bytes=1 << 12)
    late = base64.b64encode(gzip.compress(b"a " * 9_000_000 + PLAIN.encode())).decode()
    _, spans, _ = secret_scan.find_secrets("x " + late)
    assert spans == {(2, "assign", 2 + len(late))}
    for packed in (
        gzip.compress(b"x" * 40) + gzip.compress(PLAIN.encode()),
        bz2.compress(b"x" * 40) + bz2.compress(PLAIN.encode()),
        lzma.compress(b"x" * 40) + lzma.compress(PLAIN.encode()),
        zlib.compress(b"x" * 40) + zlib.compress(PLAIN.encode()),
        zstandard.compress(b"x" * 40) + zstandard.compress(PLAIN.encode()),
        gzip.compress(PLAIN.encode() + random.Random(2).randbytes(9000))[:-900],
        bz2.compress(gzip.compress(b"a" * 65_530 + PLAIN.encode() + b"a" * 70_000)),
    ):
        hidden = base64.b64encode(packed).decode()
        _, spans, _ = secret_scan.find_secrets("x " + hidden, small)
        assert (2, "assign", 2 + len(hidden.rstrip("="))) in {(s, k, min(e, 2 + len(hidden.rstrip("=")))) for s, k, e in spans}
    assert secret_scan.find_secrets("%25" * 50)[2] < 100


def test_long_texts_take_time_in_proportion():
    began = time.monotonic()
    for unit in ("a", "a" * 79 + "\n", "%41", "\\u0041", "x%2", "&#6", "password ", "a1" * 30 + " "):
        secret_scan.find_secrets(unit * (1_000_000 // len(unit)))
    for unit in ("a", "1", "1.", "a@", "a.", "+1", "1 ", "a1,"):
        pii.base_spans(unit * (1_000_000 // len(unit)) + " a@b.co")
    assert time.monotonic() - began < 120


def contract_secrets(text):
    """The base spans as the contract words them."""
    found = []
    for kind, pattern, good in (
        ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ):
        found += [(m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text, re.A) if good(m)]
    return [x[2] for x in sorted(found)]


def test_secrets_of_the_tables_against_the_contract(spark, rows_of):
    rows = rows_of("documents", 400) + [(9000 + k, x) for k, x in enumerate(["", "SECRET='abcdef' api_key:=x token =  abcdefg", "AKIA" + "A" * 15, "0" * 23 + "g" + "f" * 24])]
    got = {r["doc_id"]: r for r in secret_scan.secret_scan(frame(spark, rows)).collect()}
    for i, t in rows:
        base = contract_secrets(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(got[i]["spans"].split(",")) | {""}
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex")]


def test_secret_edges(spark):
    got = secret_scan.secret_scan(frame(spark, EDGE)).collect()
    assert len(got) == len(EDGE) and all(r["spans"] == "" for r in got)


def test_pii_base_shapes():
    text = "é a.b@c-d.co 1.2.3.256 x 10.0.0.1 x 4111 1111 1111 1111 x +1 (202) 555-0100 x 00000000001.2.3.4 x " + "9" * 5000 + ".1.1.1"
    found = [(pii.KINDS[k], text[s:e]) for k, s, e in pii.base_spans(text)]
    assert found == [("email", "a.b@c-d.co"), ("ip", "10.0.0.1"), ("ip", "00000000001.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (202) 555-0100")]


def test_contexts_find_unseen_identifiers_and_base_stays(spark):
    seeds = [(k, f"w{k} please call me at +1 202 555 01{k:02d} today") for k in range(12)]
    hidden = [(50, "z please call me at 202-555-0199 today"), (51, "z the price was 202-555-0177 then"), (52, "y please call me at 030 1234 5678 today")]
    rows = {r["doc_id"]: r for r in pii.personal_data(frame(spark, seeds + hidden + EDGE[:4])).where("doc_id is not null").collect()}
    text = hidden[0][1]
    s = text.index("202")
    assert rows[50]["spans"] == f"phone:{s}:{s + 12}" and rows[50]["n_phone"] == 0 and rows[50]["n_discovered"] == 1
    s = hidden[2][1].index("030")
    assert rows[52]["spans"] == f"phone:{s}:{s + 13}"
    assert rows[51]["spans"] == "" and rows[3]["n_discovered"] == 0
    assert all(rows[k]["n_phone"] == 1 and rows[k]["spans"].startswith("phone:") for k in range(4, 12))


def test_tokens_that_are_no_identifiers_lower_a_pattern(spark):
    seeds = [(k, f"w{k} please call me at +1 202 555 01{k:02d} today") for k in range(12)]
    others = [(100 + k, f"w please call me at {k}pm today") for k in range(10)]
    hidden = [(50, "z please call me at 202-555-0199 today")]
    got = pii.personal_data(frame(spark, seeds + others + hidden)).where("doc_id >= 50").collect()
    assert all(r["spans"] == "" for r in got)


def contract_pii(text):
    """The base spans as the contract words them."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(f"email:{m.start()}:{m.end()}")
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append(f"ip:{m.start()}:{m.end()}")
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        twice = [sum(divmod(2 * x, 10)) for x in d[-2::-2]]
        if 16 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(twice)) % 10 == 0:
            found.append(f"card:{m.start()}:{m.end()}")
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(f"phone:{m.start()}:{m.end()}")
    return found


def test_pii_of_the_tables_against_the_contract(spark, rows_of):
    rng = random.Random(6)
    odd = ["".join(rng.choice("a.@%-1 2+(") for _ in range(60)) for _ in range(300)] + ["x@y@a.b.c@d.e", "a@b.c%d@e.f", "1.2.3.4.5.6.7.8", "1.2.3.256.1.2.3", "é@a.b"]
    rows = [(i, t) for i, t in rows_of("documents", 400)] + [(9000 + k, x) for k, x in enumerate(odd)]
    got = {r["doc_id"]: r for r in pii.personal_data(frame(spark, rows)).collect()}
    for i, t in rows:
        base = contract_pii(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x.startswith(k) for x in base) for k in pii.KINDS]


def test_pii_edges(spark):
    assert pii.personal_data(frame(spark, EDGE)).count() == len(EDGE)
    assert pii.personal_data(frame(spark, [])).count() == 0


def test_pii_counts_and_digest_by_kind(spark, rows_of):
    rows = rows_of("documents", 400) + [(7001, "a@b.co c@d.co 1.2.3.4 x +1 (202) 555-0100 x 4111 1111 1111 1111")]
    for r, (_, t) in zip(sorted(pii.personal_data(frame(spark, rows)).collect(), key=lambda r: r["doc_id"]), sorted(rows)):
        base = pii.base_spans(t)
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == i for b in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest() and set(said.split(",")) <= set(r["spans"].split(","))
