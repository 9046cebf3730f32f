"""Secret scans, license scans, decontamination, revisits."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from floodgrid.llm import decontaminate, license_scan, secret_scan, warc_revisit

_ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return _ALNUM.findall((text or "").translate(_LOWER))


# Secrets


def plain_base(text):
    patterns = {
        "assign": re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        "access": re.compile(r"AKIA[A-Z0-9]+"),
        "hex": re.compile(r"[0-9a-f]+"),
    }
    least = {"assign": lambda m: len(m[2]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32}
    found = [(k, *m.span()) for k, p in patterns.items() for m in p.finditer(text) if least[k](m)]
    return sorted(found, key=lambda s: (s[1], list(patterns).index(s[0])))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["PassWord", "token", "api_key", "apikey", "ſecret", '"', "'", " ", ":", "=", "abcdef12", "x", "AKIA", "ABCD1234", "0123456789abcdef", "f", "é", "\n"]), max_size=25))
def test_base_spans_match_the_patterns(parts):
    text = "".join(parts)
    assert secret_scan.base_spans(text) == plain_base(text)


def test_entropy_counts_match_full_counting():
    rng = random.Random(5)
    for _ in range(200):
        run = "".join(rng.choices("abcdefghij0123456789"[: rng.randint(2, 20)], k=rng.randint(1, 80)))
        for bits in (2.0, 3.0, 3.5):
            want = set()
            for s in range(len(run) - 23):
                c = Counter(run[s : s + 24])
                if -sum(n / 24 * math.log2(n / 24) for n in c.values()) >= bits - 1e-9:
                    want |= set(range(s, s + 24))
            got = {i for a, b in secret_scan.entropy_windows(run, 24, bits) for i in range(a, b)}
            assert got == want


def test_entropy_finds_keys_and_spares_words():
    rng = random.Random(2)
    key = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=40))
    hexes = "".join(rng.choices("0123456789ABCDEF", k=40))
    for secret in (key, hexes):
        spans = secret_scan.entropy_spans(f"see {secret} there", [])
        assert spans and spans[0][1] >= 4 and spans[0][2] <= 44
    calm = "Donaudampfschifffahrtsgesellschaft 12345678901234567890123456 ABCDEFGHIJKLMNOPQRSTUVWXYZ aaaaaaaaaaaaaaaaaaaaaaaaaaaa1111111111"
    assert not secret_scan.entropy_spans(calm + " 123e4567-e89b-12d3-a456-426614174000 " + " ".join(secret_scan.PLACEHOLDERS), [])
    assert not secret_scan.entropy_spans(key, [("assign", 0, 40)])


@pytest.mark.parametrize("joined", ["{access}/{key}", "{key}_{hexes}", "{hexes}={key}", "{access}/{key}_{hexes}"])
def test_entropy_keeps_a_key_joined_to_a_base_span(joined):
    rng = random.Random(11)
    for _ in range(100):
        key = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=40))
        access = "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=16))
        hexes = "".join(rng.choices("0123456789abcdef", k=32))
        alone = secret_scan.entropy_spans(key, [])
        text = f"see {joined.format(access=access, key=key, hexes=hexes)} there"
        base = secret_scan.base_spans(text)
        assert len(base) == joined.count("{") - 1
        spans = secret_scan.entropy_spans(text, base)
        at = text.index(key)
        for _, a, b in alone:
            assert any(s <= at + a and at + b <= e for _, s, e in spans)
        assert not any(s < e2 and s2 < e for _, s, e in spans for _, s2, e2 in base)


def test_entropy_drops_remainders_without_a_window_of_their_own():
    rng = random.Random(12)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    text = "".join(rng.sample(alphabet, 20)) + "_" + "0123456789abcdef" * 2
    assert [k for k, *_ in secret_scan.base_spans(text)] == ["hex"]
    assert not secret_scan.entropy_spans(text, secret_scan.base_spans(text))
    example = "/".join(secret_scan.PLACEHOLDERS)
    assert not secret_scan.entropy_spans(example, secret_scan.base_spans(example))


def test_secrets_on_odd_and_empty_tables(spark, odd):
    out = secret_scan.scan_secrets(odd, keep=["doc_id", "row", "n_words"]).collect()
    assert len(out) == odd.count()
    assert {r.base_sha256 for r in out} == {hashlib.sha256(b"").hexdigest()}
    assert secret_scan.scan_secrets(odd.limit(0)).count() == 0


# Licenses


def test_license_base_places(spark):
    texts = ["Under the MIT\nLicense. mit license; CC-BY 4.0", "GNU General\tPublic  License v2, Apache License", "mit lizenz", "ÉMIT LICENSE mit licensed", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    phrases = {("gnu", "general", "public", "license"): "gpl", ("apache", "license"): "apache", ("cc", "by"): "cc-by", ("mit", "license"): "mit"}
    for r in license_scan.scan_licenses(docs).collect():
        w = words_of(r.text)
        places = sorted((i, label) for p, label in phrases.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p)
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        base = {label for _, label in places}
        assert r.base_labels == ",".join(sorted(base)) and base <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1


@pytest.mark.parametrize(
    "text,labels",
    [
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
        ("dual licensed under the terms of the Mozilla Public License Version 2.0", "mpl"),
        ("This is under the GNU Lesser General Public License, version 2.1", "lgpl"),
        ("er kommt mit dem Zug", ""),
        ("Released under MIT", "mit"),
        ("SPDX-License-Identifier: AGPL-3.0", "agpl"),
        ("two clause BSD license", "bsd-2-clause"),
        ("Released under the PSF License", "python"),
        ("SPDX-License-Identifier: BSL-1.0", "boost"),
    ],
)
def test_license_rules(text, labels):
    assert license_scan._scanner()(text.encode())[5] == labels


def texts_of(tree):
    """Every text of a parsed pattern; repeats with the fewest and one more, a set by its members, any digit as 7."""
    out = [""]
    for op, value in tree:
        name = str(op)
        if name == "LITERAL":
            more = [chr(value)]
        elif name == "IN":
            more = ["7" if str(k) == "CATEGORY" else chr(v) for k, v in value]
        elif name == "MAX_REPEAT":
            least, most, inner = value
            once = texts_of(inner)
            more = ["".join(p) for n in range(least, min(most, least + 1) + 1) for p in itertools.product(once, repeat=n)]
        elif name == "SUBPATTERN":
            more = texts_of(value[3])
        elif name == "BRANCH":
            more = [t for b in value[1] for t in texts_of(b)]
        else:
            raise ValueError(name)
        out = [a + b for a in out for b in more]
    return out


def test_every_license_text_holds_its_rules_keyword():
    entries = [(k, n) for _, k, names in license_scan.FAMILIES + license_scan.FRAMED_ONLY for n in names]
    entries += [(k, body) for _, k, body in license_scan.SENTENCES]
    for keyword, name in entries:
        for text in texts_of(re._parser.parse(name)):
            assert re.fullmatch(name, text) and keyword in text, (keyword, text)
    # Every rule's pattern holds a name or a sentence whole.
    for rule in license_scan.default_rules():
        assert any(k.encode() == rule.keyword and f"(?:{n})".encode() in rule.pattern.pattern for k, n in entries)


def test_license_suppression_and_count():
    rules = license_scan.default_rules()
    assert len(rules) >= 300
    scan = license_scan._scanner()
    found = scan(b"licensed under the gnu lesser general public license version 2 1")[7]
    assert found == "lgpl:0:11"


def test_licenses_on_odd_and_empty_tables(spark, odd):
    out = license_scan.scan_licenses(odd, keep=["doc_id"]).collect()
    assert len(out) == odd.count() and all(r.labels == "" and r.score == 0 for r in out)
    assert license_scan.scan_licenses(odd.limit(0)).count() == 0


# Decontamination


def plain_hits(text, items, window=13):
    w = words_of(text)
    hit, found = set(), set()
    for name, item in items:
        k = min(window, len(item))
        grams = {tuple(item[i : i + k]) for i in range(len(item) - k + 1)} if item else set()
        for i in range(len(w) - k + 1):
            if k and tuple(w[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                found.add(name)
    return len(w), len(hit), sorted(found)


def test_hits_match_plain_python_in_one_and_in_many_blocks(spark):
    rng = random.Random(9)
    voc = list("abcdefg")
    items = [(f"i{i}", " ".join(rng.choices(voc, k=rng.choice([0, 1, 3, 6, 14, 20])))) for i in range(30)] + [("i3", "a b c"), ("none", None)]
    docs = [(i, ", ".join(rng.choices(voc[: rng.choice([2, 7])] + ["zz"], k=rng.randint(0, 120)))) for i in range(80)]
    docs += [(100 + i, "zz " + (t or "") + " Zz") for i, (_, t) in enumerate(items)] + [(500, None)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    split = [(n, words_of(t)) for n, t in items]
    for block in (10_000, 40):
        for r in decontaminate.benchmark_hits(table, bench, block_words=block).collect():
            n_words, n_hit, found = plain_hits(r.row.text, split)
            assert (r.hits.n_words, r.hits.n_hit, r.hits["items"], r.hits.n_items) == (n_words, n_hit, sorted(set(found)), len(set(found))), r.row


def test_removed_spans(spark):
    item = " ".join(f"q{i}" for i in range(30))
    filler = " ".join(f"w{i}" for i in range(2000))
    docs = spark.createDataFrame([(1, f"{filler} (Q0, {item[3:]}) {filler}"), (2, f"{item} end"), (3, filler), (4, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([("x", item)], "item_id string, text string")
    out = {r.row.doc_id: r.t for r in decontaminate.remove_spans(decontaminate.benchmark_hits(docs, bench)).collect()}
    assert out == {1: f"{filler} () {filler}", 2: " end", 3: filler, 4: None}


def test_decontamination_on_odd_and_empty_tables(spark, odd):
    bench = spark.createDataFrame([("a", "x y z"), (None, "single")], "item_id string, text string")
    out = decontaminate.benchmark_hits(odd, bench).collect()
    assert sorted(r.row.doc_id for r in out if r.hits.n_hit) == [6, 6, 9]
    assert [r.hits.n_items for r in out if r.row.doc_id == 9] == [1]
    assert decontaminate.benchmark_hits(odd.limit(0), bench).count() == 0
    clean = decontaminate.benchmark_hits(odd, bench.limit(0))
    assert clean.where("hits.n_hit > 0").count() == 0 and clean.select("row.*").columns == odd.columns


# Revisits

_HEADERS = "array<struct<name:string,value:string>>"


@pytest.mark.parametrize(
    "url,canonical",
    [
        ("HTTP://WWW.Example.com:80/a/?b=2&a=1&utm_source=x#top", "example.com/a?a=1&b=2"),
        ("https://example.com", "example.com/"),
        ("https://example.com/?ref=x", "example.com/"),
        ("not a url#x", "not a url"),
        (None, None),
        ("", ""),
    ],
)
def test_canonical_url(spark, url, canonical):
    df = spark.createDataFrame([(url,)], "url string")
    assert df.select(warc_revisit.canonical_url(df["url"])).first()[0] == canonical


def test_merged_headers(spark):
    df = spark.createDataFrame(
        [([("Content-Type", "a"), ("X", "1"), ("Vary", "q")], [("x", "2"), ("content-type", "b"), ("Age", "3"), (None, "n")]), (None, None)],
        f"o {_HEADERS}, n {_HEADERS}",
    )
    out = [[tuple(h) for h in r[0]] for r in df.select(warc_revisit.merged_headers(df["o"], df["n"])).collect()]
    assert out == [[("Content-Type", "a"), ("Vary", "q"), ("x", "2"), ("Age", "3")], []]


def test_revisits_match_plain_python_on_a_hot_url(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        url = "http://hot.example.com/" if i % 3 == 0 else f"http://h{rng.randrange(20)}.example.com/p"
        kind, status = rng.choice([("response", 200), ("response", 404), ("revisit", 304), ("revisit", 304), ("request", None)])
        headers = [("ETag", rng.choice(["a", "W/a", "b"]))] if rng.random() < 0.7 else [("last-modified", rng.choice("xy"))]
        rows.append((i, None if i % 50 == 7 else url, None if i % 60 == 9 else rng.randrange(80), kind, status, headers))
    table = spark.createDataFrame(rows, f"record_id bigint, url string, date bigint, kind string, status int, headers {_HEADERS}")
    got = {r.record_id: (r.outcome, r.response_id) for r in warc_revisit.resolve_revisits(table.repartition(7)).collect()}
    assert len(got) == sum(r[3] == "revisit" for r in rows)
    for i, url, date, kind, _, headers in rows:
        if kind != "revisit":
            continue
        fits = [r for r in rows if r[3] == "response" and r[4] == 200 and r[1] == url and url and None not in (r[2], date) and r[2] < date]
        if not fits:
            assert got[i] == ("no_response", None)
            continue
        best = max(fits, key=lambda r: (r[2], r[0]))
        mine, theirs = {k.lower(): v for k, v in headers}, {k.lower(): v for k, v in best[5]}
        if "etag" in mine and "etag" in theirs:
            want = "resolved" if mine["etag"].removeprefix("W/") == theirs["etag"].removeprefix("W/") else "changed"
        elif "etag" not in mine and "last-modified" in mine and "last-modified" in theirs:
            want = "resolved" if mine["last-modified"] == theirs["last-modified"] else "changed"
        else:
            want = "unvalidated"
        assert got[i] == (want, best[0])


def test_revisits_of_an_empty_table(spark):
    empty = spark.createDataFrame([], f"record_id bigint, url string, date bigint, kind string, status int, headers {_HEADERS}")
    assert warc_revisit.resolve_revisits(empty).count() == 0
