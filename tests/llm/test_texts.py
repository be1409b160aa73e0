"""Pieces that work on single texts, against plain versions."""

import base64
import json
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.llm import bpe, decontamination, licenses, quality, secrets, sharding, simhash, toxicity
from tagloom.llm.bwt import repeated_starts
from tagloom.llm.fmindex import word_repeats
from tagloom.llm.windows import MAX_WINDOWS, segment_runs

# -- BPE


@pytest.fixture(scope="module")
def reference():
    return tokenizers.Tokenizer.from_file(bpe.default_path())


@pytest.mark.parametrize("leaf", [4, 8, 64, 512])
def test_bpe_equals_the_library(reference, leaf):
    codec, rng = bpe.Codec(leaf=leaf, window=1 if leaf < 64 else bpe.WINDOW), random.Random(leaf)
    parts = ["a", "b", "ab", "é", "  ", "\n", " ", "<|endoftext|>", "the", "ing", "中", "1", "!", "'s", "'", "''", "'re", "'ll", "\u0301", "\x85", "\x1c", "\u200b", "\u00a0", "\t", "😀", "ก", "٣", "½", "\u0378"]
    texts = ["", " ", "a" * 5000, "ab" * 3000, " " * 3000, " " * 999 + "x", "=-" * 4000, "x" + "\n" * 3000 + "y", "aaab" * 999, "".join(rng.choice("etaoin") for _ in range(9000)), "中文" * 2000, "😀" * 900, "'" * 700 + "s" * 700]
    texts += ["".join(rng.choice(rng.sample(parts, 5)) for _ in range(rng.randint(1, 400))) for _ in range(300)]
    texts += ["".join(rng.choice(few) for _ in range(rng.randint(1, 200))) for _ in range(150) for few in [rng.sample(parts, 3)]]
    for t, ids in zip(texts, codec.encode_all(texts), strict=True):
        assert ids == reference.encode(t, add_special_tokens=False).ids, t[:80]
        assert codec.decode(ids) == reference.decode(ids, skip_special_tokens=False) == t


def test_bpe_joins_agree_for_any_cut(reference):
    codec = bpe.Codec(window=1)
    for text in ("internationalizationofunsplitwords" * 9, "it's 12's''s  \t x  " * 9, "....''llre!!!9 " * 6, " \n\n  a" * 20):
        data, whole = text.encode(), reference.encode(text, add_special_tokens=False).ids
        for cut in range(1, len(data)):
            halves = (codec.core.encode_ordinary(part.decode()) for part in (data[:cut], data[cut:]))
            assert codec.join(data, 0, next(halves), cut, next(halves), len(data)) == whole


def test_bpe_of_documents_goes_through_joins(reference):
    texts = [t.as_py() or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"]]
    codec = bpe.Codec()
    assert codec.encode_all(texts) == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    assert codec.joined > 0.9 * sum(len(t.encode()) for t in texts)


# -- secrets


def plain_spans(text):
    out = []
    for kind, pattern, least, group in (("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2), ("access", "AKIA[A-Z0-9]+", 16, 0), ("hex", "[0-9a-f]+", 32, 0)):
        out += [(m.start(), m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(out, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "=", ": ", "secret", "abc", "AKIA", "0123456789abcdef", "ZZZZ", "'", '"', " ", "Password", "api_key", "é", "ſecret", "XY12"]), max_size=14).map("".join))
def test_base_spans(text):
    assert sorted(secrets.base_spans(text), key=lambda s: (s[0], secrets.KINDS.index(s[2]))) == plain_spans(text)


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | len(b := n.to_bytes((n.bit_length() + 7) // 8)), *b])
    return bytes([tag]) + size + body


def test_structures_are_confirmed():
    rng = random.Random(1)
    number = lambda n: der(2, b"\x01" + rng.randbytes(n))
    rsa = der(0x30, der(2, b"\0"), number(128), der(2, b"\1\0\1"), *(number(64) for _ in range(6)))
    pkcs8 = der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2a\x86\x48"), der(5)), der(4, rsa))
    b64 = lambda b: base64.b64encode(b).decode()
    jwt = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (json.dumps({"alg": "HS256"}).encode(), b'{"sub": 1}', b"signature"))
    ssh = b"".join(len(x).to_bytes(4) + x for x in (b"ssh-ed25519", rng.randbytes(32)))
    for kind, s in (("der_key", b64(rsa)), ("der_key", b64(pkcs8)), ("der_key", rsa.hex().upper()), ("signed_token", jwt), ("ssh_key", b64(ssh)), ("pem_key", f"-----BEGIN RSA PRIVATE KEY-----\n{b64(rsa)}\n-----END RSA PRIVATE KEY-----")):
        text = f"so {s} it is"
        assert (3, 3 + len(s), kind) in secrets.spans(text), kind
    for s in (b64(rsa[:-3]), b64(rng.randbytes(300)), "ey" + jwt[2:].replace(".", "x"), b64(ssh[:-1]), "M" + "A" * 80):
        assert not secrets.confirmed_spans(f"so {s} it is")
    assert secrets.spans("") == []


def test_keys_after_signs_and_with_written_breaks():
    rng = random.Random(8)
    number = lambda n: der(2, b"\x01" + rng.randbytes(n))
    rsa = der(0x30, der(2, b"\0"), number(128), der(2, b"\1\0\1"), *(number(64) for _ in range(6)))
    pkcs8 = der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2a\x86\x48"), der(5)), der(4, rsa))
    for key in (rsa, pkcs8):
        s = base64.b64encode(key).decode()
        url = s.translate({43: 45, 47: 95})
        for before in ("PRIVATE_KEY=", "key=", "key==", "a-", "MAC-", "MAC-MIIB-", "'", ": ", "--"):
            for text in (s, url):
                assert (len(before), len(before) + len(text), "der_key") in secrets.spans(f"{before}{text}\n"), before
        assert not secrets.confirmed_spans(f"key={s[:60]}A{s[60:]}") and not secrets.confirmed_spans("key=" + "-MIIB" * 9000)
        for brk in ("\\n", "\\r\\n", "\\\\n", "\n"):
            for body in (s, s.replace("/", "\\/")):
                pem = f"-----BEGIN PRIVATE KEY-----{brk}" + brk.join(body[i : i + 64] for i in range(0, len(body), 64)) + f"{brk}-----END PRIVATE KEY-----"
                if "\\" in body[63::64]:
                    continue  # an escape cut in two
                assert secrets.confirmed_spans(f'{{"k": "{pem}"}}') == [(7, 7 + len(pem), "pem_key")], brk


def test_further_forms_of_keys():
    rng = random.Random(9)
    number = lambda n: der(2, b"\x01" + rng.randbytes(n))
    rsa = der(0x30, der(2, b"\0"), number(128), der(2, b"\1\0\1"), *(number(64) for _ in range(6)))
    dsa = der(0x30, der(2, b"\0"), number(128), number(20), number(127), number(127), number(19))
    wrap = lambda s, n, brk: brk.join(s[i : i + n] for i in range(0, len(s), n))
    for key in (rsa, dsa):
        s = base64.b64encode(key).decode()
        assert (4, 4 + len(s), "der_key") in secrets.spans(f"key {s} end")
        for n, brk in ((64, "\n"), (76, "\r\n"), (64, "\n    ")):
            w = wrap(s, n, brk)
            for before, after in (("", ""), ("key:\n", "\nand more words"), ("  ", "\n"), ("a ", f"{brk}QUJD")):
                assert (len(before), len(before) + len(w), "der_key") in secrets.spans(before + w + after), (n, before, after)
            assert not secrets.confirmed_spans(wrap(s[:70] + "A" + s[70:], n, brk)) and not secrets.confirmed_spans(w[:-9])
    body = wrap(base64.b64encode(rng.randbytes(640)).decode(), 64, "\n")
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF\n\n"
    for middle, found in ((head + body, True), (body, False), ("Comment: x\n\n" + wrap(base64.b64encode(rsa).decode(), 64, "\n"), True), (head + body[:-9], False)):
        pem = f"-----BEGIN RSA PRIVATE KEY-----\n{middle}\n-----END RSA PRIVATE KEY-----"
        assert ((2, 2 + len(pem), "pem_key") in secrets.spans(f"k {pem}")) == found
    began = time.process_time()
    secrets.spans("MIIB" + ("A" * 60 + "\nMIIB") * 5000)
    assert time.process_time() - began < 10


# -- licenses


def test_licenses():
    m = licenses.Matcher()
    x = licenses.inspect("Code, Under the MIT License; cc-by-nc cc by nc", m)
    assert (x["n_words"], x["places"], x["score"]) == (11, [(1, "mit"), (5, "cc-by-nc"), (8, "cc-by-nc")], 1.0)
    y = licenses.inspect("permision is herby granted, free of charge to any person obtaning a copy", m)
    assert y["places"] == [] and {n["label"] for n in y["notices"]} == {"mit"} and 0.9 < y["score"] < 1
    assert licenses.inspect("", m)["score"] == 0 and not licenses.inspect("nothing of the kind stands here", m)["notices"]
    assert licenses.digest(licenses.inspect("", m)) == (0, 0, None, None, "", "", 0.0)


def test_fuzzy_notices_within_the_bound_are_found():
    m, rng = licenses.Matcher(), random.Random(3)
    for wording, label, edits, _ in m.templates:
        for _ in range(20):
            s = list(wording)
            for _ in range(edits):
                s[rng.randrange(1, len(s) - 1)] = rng.choice("xyz")
            assert label in {f[2] for f in m.fuzzy(f" some words {''.join(s)} and more ")}


def test_repeated_notices_take_little():
    m = licenses.Matcher()
    began = time.process_time()
    x = licenses.inspect("licensed under the mit licence " * 16000, m)
    assert time.process_time() - began < 10
    assert [(n["first_word"], n["last_word"]) for n in x["notices"] if n["label"] == "mit"] == [(5 * i, 5 * i + 4) for i in range(16000)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["under", "the", "MIT", "license", "Apache", "version", "2", "CC", "by", "nc", "under the mit license", "é", "by-NC", "x", "CC BY NC"]), max_size=25), st.sampled_from([" ", "  ", ", ", "-", "\n"]))
def test_base_places(parts, glue):
    text = glue.join(parts)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    wanted = sorted((i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    got = licenses.inspect(text, licenses.Matcher())
    assert (got["n_words"], got["places"]) == (len(words), wanted)


# -- SimHash


def plain_fingerprint(text, size=4):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab C\n\tÄé\x1c\xa0", max_size=60))
def test_fingerprints(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def roots(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        p[find(a)] = find(b)
    groups: dict = {}
    return [groups.setdefault(find(i), len(groups)) for i in range(n)]


@pytest.mark.parametrize("parts,radius", [(1, 4), (4, 46)])
@pytest.mark.parametrize("n", [5, 40, 150])
def test_near_pairs_connect_what_is_near(parts, radius, n):
    rng = np.random.default_rng(n)
    f = rng.integers(0, 2**64, (n, parts), dtype=np.uint64)
    for i in range(n // 2, n):
        f[i] = f[rng.integers(0, i)]
        for b in rng.integers(0, 64 * parts, rng.integers(0, 2 * radius)):
            f[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    a, b = simhash.near_pairs(f, np.zeros(1, np.int64), radius)
    assert all(simhash.distances(f[i], f[j]) <= radius for i, j in zip(a, b, strict=True))
    near = [(i, j) for i in range(n) for j in range(i) if simhash.distances(f[i], f[j]) <= radius]
    assert roots(n, zip(a, b, strict=True)) == roots(n, near)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_similar_pairs_are_those_of_the_exact_similarity():
    rng = random.Random(31)
    base = [rng.sample(range(1 << 40), 60) for _ in range(8)]
    sets = [np.unique(np.array(rng.sample(b, rng.randint(48, 60)) + rng.sample(range(1 << 40), rng.randint(0, 9)), np.uint64)) for b in base for _ in range(15)] + [np.array([], np.uint64)] * 2
    f = np.array([simhash.wide_fingerprint(simhash.mix(s)) for s in sets], np.uint64)
    a, b = simhash.similar_pairs(sets, f, 0.8)
    plain = [set(s.tolist()) for s in sets]
    assert all(jaccard(plain[i], plain[j]) >= 0.8 for i, j in zip(a, b, strict=True))
    near = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard(plain[i], plain[j]) >= 0.8]
    assert len(near) > 100 and roots(len(sets), zip(a, b, strict=True)) == roots(len(sets), near)


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_block_keys_miss_nothing(blocks):
    masks, rng = simhash.block_masks(blocks, 4), random.Random(blocks)
    for _ in range(500):
        diff = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not diff & m for m in masks)


# -- repeats


def plain_repeats(texts, window):
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    return [[i for i in range(len(t) - window + 1) if seen[t[i : i + window]] > 1] for t in texts]


def test_indexes_find_all_repeats():
    rng = random.Random(3)
    for _ in range(150):
        window, letters = rng.choice([1, 2, 3, 5, 9, 20, 40]), rng.choice([b"a", b"ab", b"abcdef"])
        draw = lambda n: bytes(rng.choice(letters) for _ in range(n))  # noqa: B023, E731
        base = draw(60)
        texts = [draw(rng.randint(0, 20)) + base[a : a + rng.randint(0, 60)] + draw(rng.randint(0, 10)) for a in (rng.randint(0, 40) for _ in range(rng.randint(1, 6)))]
        assert [x.tolist() for x in repeated_starts(texts, window)] == plain_repeats(texts, window)
        rows = [tuple(b"%c" % x for x in t) for t in texts if t]
        if rows:
            assert [x.tolist() for x in word_repeats([b" ".join(r) for r in rows], window)] == plain_repeats(rows, window)
            weights = [rng.randint(1, 2) for _ in rows]
            copies = plain_repeats([r for r, w in zip(rows, weights, strict=True) for _ in range(w)], window)
            firsts = np.cumsum([0, *weights])[:-1]
            assert [x.tolist() for x in word_repeats([b" ".join(r) for r in rows], window, weights)] == [copies[i] for i in firsts]
            assert [x.tolist() for x in repeated_starts([b"".join(r) for r in rows], window, weights)] == [copies[i] for i in firsts]


def test_equal_windows_share_an_anchor():
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 2**64, 90, dtype=np.uint64)
    owner: dict = {}
    for letters in (2**64, 2**64, 2**64, 3, 2, 1):  # few letters give anchors that stand at several places
        x = np.concatenate([rng.integers(0, letters, rng.integers(1, 50), dtype=np.uint64), shared, rng.integers(0, letters, 30 if letters > 3 else 9000, dtype=np.uint64)])
        anchors, first, count, several = segment_runs(x, 35, 8)
        assert count.sum() == len(x) - 34 and (np.diff(first) == count[:-1]).all() and count.max() <= MAX_WINDOWS
        for a, f, c, s in zip(anchors, first, count, several):
            seen = set()
            for j in range(f, f + c):
                w = x[j : j + 35].tobytes()
                assert owner.setdefault(w, a) == a and (s or w not in seen)
                seen.add(w)


# -- decontamination


def edit_distance(p, t):
    """The fewest edits between p and any stretch of t."""
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        new = [i + 1]
        for j, d in enumerate(t):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_alignment_is_the_edit_distance():
    rng = random.Random(5)
    for _ in range(60):
        p = bytes(rng.choice(b"abcd") for _ in range(30))
        s = bytearray(p)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(s))
            s[i : i + rng.randint(0, 1)] = rng.choice([b"", b"x", b"yy"])
        t = bytes(rng.choice(b"efgh") for _ in range(20)) + bytes(s) + b"efgh" * 3
        begin, end, edits = (int(x[0]) for x in decontamination.align_all(p, np.zeros(1, np.int64), 30, t, 16, 8, 5))
        d = edit_distance(p, t)
        assert edits == d or edits > 3 and d > 3
        if edits <= 5:
            assert edit_distance(p, t[begin:end]) == edits


def plain_search(items, line, rule):
    """(item, fewest edits, found starts) by the edit distance of every passage."""
    out = {}
    for key, text in items:
        item = decontamination.normal(text or "")
        m = min(len(item), rule.length)
        if m:
            d = {s: edit_distance(item[s : s + m], line) for s in range(len(item) - m + 1)}
            good = {s: x for s, x in d.items() if x <= rule.edits(m)}
            if len(item) < rule.q and not re.search(rb"(?<![^ ])" + re.escape(item) + rb"(?![^ ])", line):
                good = {}
            if good:
                out[key] = min(good.values()), sorted(good)
    return out


@pytest.mark.parametrize("rule", [decontamination.Rule(24, 6, 0.09, 6), decontamination.Rule(40, 10, 0.05, 12)])
def test_search_is_that_of_all_passages(rule, monkeypatch):
    rng = random.Random(21)
    monkeypatch.setattr(decontamination, "SLICE", 50)
    monkeypatch.setattr(decontamination, "PAIRS", 300)
    draw = lambda n, letters="abcd ": "".join(rng.choice(letters) for _ in range(n))
    for turn in range(60):
        items = [(i, draw(rng.choice([3, 5, 11, 21, 30, 60, 80]), rng.choice(["abcd ", "ab", "abcdefghij "]))) for i in range(5)] + [(9, "no " * 30), (10, ""), (11, None)]
        index = decontamination.Index(items, rule)
        text = draw(20)
        for _ in range(4):
            part = list(rng.choice(items)[1] or "x")
            part = part[rng.randint(0, len(part) // 3) :]
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                i = rng.randrange(len(part))
                part[i : i + rng.randint(0, 1)] = [rng.choice(["", "z", "b"])]
                part = part or ["x"]
            text += " " + "".join(part) + draw(rng.randint(0, 30))
        line = decontamination.normal(text)
        got = {h[0]: (h[3], h[4]) for h in index.find(line)}
        wanted = {}
        for key, (edits, starts) in plain_search(items, line, rule).items():
            runs = np.split(np.array(starts), np.flatnonzero(np.diff(starts) > 1) + 1)
            wanted[key] = edits, sum(1 + (len(r) - 1) // rule.step for r in runs)
        assert got == wanted


def test_repetitive_texts_take_little():
    index = decontamination.Index([(1, "no " * 400), (2, "so it goes " * 90)], decontamination.Rule())
    began = time.process_time()
    found = index.find(decontamination.normal("no " * 60000))
    assert found == [(1, 0, 179999, 0, 1 + (1199 - 120) // 60)] and time.process_time() - began < 20


def test_edited_passages_are_found_and_others_not():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeioukstr") for _ in range(rng.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(45))) for i in range(20)]
    index = decontamination.Index([*items, (99, ""), (98, "short")], decontamination.Rule())
    for i, text in items:
        s = list(decontamination.normal(text).decode())
        for _ in range(len(s) // 40):
            s[rng.randrange(len(s))] = "z"
        line = decontamination.normal(f"{word()} {word()} {''.join(s)} {word()}")
        assert {h[0] for h in index.find(line)} == {i}
    assert not index.find(decontamination.normal(" ".join(word() for _ in range(3000)))) and not index.find(b"")


def test_excerpts_are_found_at_every_offset():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeioukstr") for _ in range(rng.randint(2, 9)))
    texts = [decontamination.normal(" ".join(word() for _ in range(40))) for _ in range(5)]
    index = decontamination.Index([(i, t.decode()) for i, t in enumerate(texts)], decontamination.Rule())
    around = [" ".join(word() for _ in range(20)).encode() for _ in range(2)]
    for i, t in enumerate(texts):
        for a in range(0, len(t) - 120, 7):
            for n in (120, 155):
                part = bytearray(t[a : a + n])
                assert (i, 0) in {(h[0], h[3]) for h in index.find(around[0] + b" " + part + b" " + around[1])}
                for _ in range(3):  # three edits are within the budget of every passage
                    at = rng.randrange(len(part))
                    part[at : at + rng.randint(0, 1)] = b"z"
                if len(part) >= 120:
                    assert i in {h[0] for h in index.find(around[0] + b" " + bytes(part) + b" " + around[1])}
        assert not index.find(around[0] + b" " + t[20:90] + b" " + around[1])


def test_alignments_together_are_those_alone():
    rng = random.Random(12)
    for _ in range(40):
        item = bytes(rng.choice(b"abcd") for _ in range(60))
        s = bytearray(item)
        for _ in range(rng.randint(0, 6)):
            i = rng.randrange(len(s))
            s[i : i + rng.randint(0, 1)] = rng.choice([b"", b"x", b"yy"])
        line, starts = bytes(rng.choice(b"efgh") for _ in range(rng.randint(0, 9))) + bytes(s), np.arange(31)
        got = decontamination.align_all(item, starts, 30, line, 0, 8, 5)
        for a in starts.tolist():
            alone = decontamination.align_all(item, np.array([a]), 30, line, 0, 8, 5)
            assert min(int(alone[2][0]), 6) == min(int(got[2][a]), 6)


# -- toxicity and quality


def test_ordinal_model_ranks_held_out_texts():
    rng = random.Random(8)
    bad, plain = ["vile", "awful", "horrid"], ["tree", "river", "stone", "cloud", "house"]

    def row():
        n = rng.choice([0, 0, 1, 2, 6])
        return n, toxicity.features(" ".join(rng.choices(plain, k=30) + rng.choices(bad, k=n)))

    rows = [row() for _ in range(900)]
    known = {k: 9.0 for w in bad for k in toxicity.features(w)}
    model = toxicity.fit([(int(n > 0), {f: c for f, c in x.items() if f in known}) for n, x in rows[:600]], known)
    assert list(model.thresholds) == sorted(model.thresholds)
    score = lambda s: toxicity.rate(model, s)
    assert not score("tree river stone")[3] and score("vile tree")[3] and score("")[1] == 0
    assert score("tree vile")[0] < score("vile awful horrid awful vile horrid awful tree")[0]
    assert toxicity.rate(toxicity.fit([(0, {})], {}), "vile") == (0, 0, 0, False)


def test_scores_are_those_of_the_formula():
    rng = random.Random(3)
    words = [f"word{i}".encode() for i in range(40)]
    weights = {w: rng.uniform(-1, 1) for w in words[:20]} | {b"word*": 0.1, b"word1*": -0.3}
    model = toxicity.OrdinalModel(weights, (0.5, 1.0, 2.5))
    for _ in range(50):
        text = " ".join(w.decode() for w in rng.choices(words, k=rng.randint(0, 30)))
        score = sum(weights[f] * (1 + np.log(n)) for f, n in toxicity.features(text).items() if f in weights)
        below = [1 / (1 + np.exp(-(t - score))) for t in model.thresholds]
        p = np.diff([0, *below, 1])
        severity, grade, p_toxic, toxic = toxicity.rate(model, text)
        assert abs(severity - p @ np.arange(4)) < 1e-9 and abs(p_toxic - (1 - p[0])) < 1e-9
        assert toxic == (p_toxic >= toxicity.THRESHOLD) == (grade > 0) and grade == (1 + int(np.argmax(p[1:])) if toxic else 0)


def test_moves_keep_to_room_and_exchange():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(2, 6)
        flows = {(a, b): rng.randint(1, 9) for a in range(n) for b in range(n) if a != b and rng.random() < 0.5}
        room = [rng.choice([0, 0, 3]) for _ in range(n)]
        got = sharding.allowance(flows, room)
        assert all(0 <= got[e] <= flows[e] for e in flows)
        for s in range(n):
            assert sum(m for (_, b), m in got.items() if b == s) <= room[s] + sum(m for (a, _), m in got.items() if a == s)
        assert not any(got[a, b] < flows[a, b] and got.get((b, a), 0) < flows.get((b, a), 0) for a, b in flows)
    assert sharding.allowance({(0, 1): 5, (1, 2): 4, (2, 0): 7}, [0, 0, 0]) == {(0, 1): 4, (1, 2): 4, (2, 0): 4}


def test_estimate_recovers_rules():
    rng = random.Random(9)
    patterns: Counter = Counter()
    for _ in range(20000):
        good = rng.random() < 0.8
        patterns[tuple(-1 if rng.random() < 0.1 else int(good) if rng.random() < a else int(not good) for a in (0.95, 0.9, 0.85, 0.6))] += 1
    e = quality.estimate(sorted(patterns.items()), 4)
    assert abs(e.prior - 0.8) < 0.06 and e.good[0] > e.good[3] and e.bad[0] < e.bad[3]
    assert quality.posterior(e, (1, 1, 1, -1)) > 0.9 > 0.1 > quality.posterior(e, (0, 0, 0, -1))
    assert quality.estimate([], 2).prior == 0.7
