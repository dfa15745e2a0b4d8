"""Tokenizer, packing and personal information."""

import base64
import os
import random

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import rows
from twinsieve.llm import packing, pii, tokens

RANKS = tokens.DEFAULT_RANKS
needs_ranks = pytest.mark.skipif(not os.path.exists(RANKS), reason="no rank file")

ODD = [
    "", " ", "  ", "a  b", "a   b", " a", "a ", "a \n b", "\n \nfoo", "x\n \nfoo", " \nfoo", "\x1c a \x1d\x1e b", "a\xa0 b", "a　b",
    "it's I'll 'D 'd", "\r\n \r\n x", "<|endoftext|> hi", "a" * 300, "aaaa bbbb " * 50, "日本語 テキスト", "é ǅ ½ ²", "😀😀 ‍", "a\x85 b",
]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    with open(RANKS, "rb") as f:
        return tokens.Encoder(f.read())


def split(encoded):
    flat, offsets = encoded
    return [list(map(int, flat[a:b])) for a, b in zip(offsets, offsets[1:])]


@needs_ranks
def test_odd_texts(encoder, reference):
    assert split(encoder.encode(ODD)) == [reference.encode_ordinary(t) for t in ODD]
    assert list(encoder.sizes([None, *ODD])) == [0] + [len(reference.encode_ordinary(t)) for t in ODD]


@needs_ranks
@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab e's\n\t\u3000\xa0é日1.!", "the ", "  "]), max_size=40).map("".join), max_size=6))
def test_random_texts(encoder, reference, texts):
    assert split(encoder.encode(texts)) == [reference.encode_ordinary(t) for t in texts]


@needs_ranks
def test_forgetting_changes_nothing(encoder, reference, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_UNITS", 3)
    for _ in range(3):
        assert split(encoder.encode(ODD)) == [reference.encode_ordinary(t) for t in ODD]


@needs_ranks
def test_token_queries(spark, reference):
    data = [(i, t, "x") for i, t in enumerate([None, *ODD])] + [(None, "no key", "x"), (1, ODD[3], "again")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, ids string")
    got = rows(tokens.token_ids(df))
    assert got == sorted(((i, reference.encode_ordinary(t) if t else []) for i, t, _ in data), key=repr)
    assert rows(tokens.token_counts(df)) == sorted(((i, len(reference.encode_ordinary(t)) if t else 0) for i, t, _ in data), key=repr)
    assert tokens.token_ids(df.limit(0)).count() == 0


# --- packing -------------------------------------------------------------------------------------


def check_packing(got, data, specs):
    load, parts = {}, {}
    for spec, container, doc, part, start, n in got:
        load[spec, container] = load.get((spec, container), 0) + n
        parts.setdefault((spec, doc), []).append((part, start, n))
    for (spec, _), n in load.items():
        assert n <= specs[spec]
    for spec, capacity in specs.items():
        for doc, n in data:
            mine = sorted(parts.pop((spec, doc)))
            assert sum(m[2] for m in mine) == max(0, n or 0) and [m[0] for m in mine] == list(range(len(mine)))
            assert [m[1] for m in mine] == [sum(x[2] for x in mine[:k]) for k in range(len(mine))]
            assert len(mine) == 1 or (n > capacity and all(m[2] == capacity for m in mine[:-1]))
    assert not parts
    return load


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 150)
    rng = random.Random(1)
    data = [(i, int(rng.lognormvariate(5, 1))) for i in range(1500)] + [(2000 + i, 40) for i in range(700)]
    data += [(3000, 0), (3001, None), (3002, -5), (3003, 512), (3004, 513), (3005, 5 * 512), (3006, 100_000)]
    specs = {1: 512, 2: 2048, 3: 8192}
    df = spark.createDataFrame([(i, n, 1) for i, n in data], "doc_id bigint, n_tokens bigint, capacity int")
    settings_ = spark.createDataFrame([*specs.items(), (4, None), (5, 0)], "spec_id int, capacity int")
    got = rows(packing.pack(df, settings_))
    load = check_packing(got, data, specs)
    for spec, capacity in specs.items():
        used = [n for (s, _), n in load.items() if s == spec]
        assert sum(used) / (len(used) * capacity) > 0.97
    report = {r["spec_id"]: r for r in packing.packing_report(packing.pack(df, settings_), settings_).collect()}
    assert report[1]["n_containers"] == len({c for s, c in load if s == 1}) and report[1]["fullest"] <= 512


def test_pack_edges(spark):
    specs = spark.createDataFrame([(1, 10)], "spec_id int, capacity int")
    none = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert packing.pack(none, specs).count() == 0
    empty = spark.createDataFrame([(1, 0), (2, 0)], "doc_id bigint, n_tokens bigint")
    assert packing.pack(empty, specs).count() == 2
    assert packing.pack(empty, specs.limit(0)).count() == 0
    same = spark.createDataFrame([(1, 25), (1, 25), (None, 3)], "doc_id bigint, n_tokens bigint")
    got = packing.pack(same, specs).collect()
    assert len(got) == 7 and sum(r["n_tokens"] for r in got) == 53
    loads = {}
    for r in got:
        loads[r["container_id"]] = loads.get(r["container_id"], 0) + r["n_tokens"]
    assert max(loads.values()) <= 10


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=30))
def test_plans_hold_every_item_once(histogram):
    plan = packing.plan_packing(dict(histogram), 64)
    used = {}
    for lengths, repeat in plan.patterns:
        assert sum(k * v for k, v in lengths.items()) <= 64 and repeat > 0
        for k, v in lengths.items():
            used[k] = used.get(k, 0) + v * repeat
    assert used == histogram


def test_least_squares_finds_an_exact_answer():
    combos = packing.combinations(12)
    truth = np.zeros(len(combos))
    truth[[1, 5, 9]] = (40, 25, 60)
    target = np.zeros(12)
    for c, x in zip(combos, truth):
        for b in c[c > 0]:
            target[b - 1] += x
    solved = packing.nonnegative_least_squares(combos, target, 3000)
    made = np.zeros(12)
    for c, x in zip(combos, solved):
        for b in c[c > 0]:
            made[b - 1] += x
    assert (solved >= 0).all() and np.abs(made - target).max() < 1.0


# --- personal information ------------------------------------------------------------------------

NAMES = [("Mira", "given"), ("Tolan", "given"), ("Berkel", "family"), ("Ostrova", "family"), ("Marsh", "family"), ("Haldor", "family")]

CASES = [
    ("write to mira.b+2@mail.example.org today", ["email:mira.b+2@mail.example.org"]),
    ("write to mira (at) example (dot) co (dot) org.", ["email:mira (at) example (dot) co (dot) org"]),
    ("info[at]example[dot]com, INFO AT example DOT com", ["email:info[at]example[dot]com", "email:INFO AT example DOT com"]),
    ("x＠y.example and a @ b.example", ["email:x＠y.example", "email:a @ b.example"]),
    ("icon@2x.png, kit@5.1.0, asked by @someone.else, cron@host: exit", []),
    ("call me on (212) 555-0144, or +44 (0)20 7946 0102", ["phone:(212) 555-0144", "phone:+44 (0)20 7946 0102"]),
    ("Telefon 030/23125859. Tél. 01 99 00 83 12 et 2125550144, courriel a@b.example", ["phone:030/23125859", "phone:01 99 00 83 12", "phone:2125550144", "email:a@b.example"]),
    ("call 212-555-0144 ext. 12", ["phone:212-555-0144"]),
    ("0049 (0)30 23125 545; (+34) 555607304", ["phone:0049 (0)30 23125 545", "phone:(+34) 555607304"]),
    ("spare part 562-555-6277, order #74453614, ISBN 0-00-063019-1, on 2024-01-31, address 192.0.2.16", []),
    ("Passport K-01028978 belongs to Mira Berkel.", ["idno:K-01028978", "name:Mira Berkel"]),
    ("Her identity number is 920–91–7478 and form 1914-04-9235/C", ["idno:920–91–7478"]),
    ("Steuernummer 08/807/094510 wurde; DNI 99.186.114-Y, expediente 12", ["idno:08/807/094510", "idno:99.186.114-Y"]),
    ("身份证号 99091819841106121X 已", ["idno:99091819841106121X"]),
    ("lives at 212-305 Fluthin Fluglurk Close. Then", ["address:212-305 Fluthin Fluglurk Close"]),
    ("Lieferung an Queipstraße 86a, Kai; wohnt Am Kotor 265B.", ["address:Queipstraße 86a", "address:Am Kotor 265B"]),
    ("Livraison : 160-306 bis, impasse Flazo, X", ["address:160-306 bis, impasse Flazo"]),
    ("Entrega en Calle de Yoceck, n.º 131. Send to 9 N. Foo Blvd., Bar", ["address:Calle de Yoceck, n.º 131", "address:9 N. Foo Blvd."]),
    ("bus 98 to Mezupt Terrace; Foo Street was closed; Baz Lane and Q Row", []),
    ("Signed, Berkel, Mira. Judge M. van Ostrova ruled.", ["name:Berkel, Mira", "name:M. van Ostrova"]),
    ("Mira K. Berkel-Ostrova of the Guild; TOLAN OSTROVA said", ["name:Mira K. Berkel-Ostrova", "name:TOLAN OSTROVA"]),
    ("Lake Berkel rose; the Berkel case; Mira Bridge and Tolan Hall; Mira went", []),
    ("Berkel & Partners Ltd and Tolan Haldor Institute and the marsh", []),
    ("Contact: Quen Zavor, 212-555-0144", ["name:Quen Zavor", "phone:212-555-0144"]),
    ("Zavor, Quen of Tri & Hol Partners Ltd came.\nQuen de la Zavor of Tri Board went.\nQuay Works of Tri Board\nQuen Zavor 治疗了", ["name:Zavor, Quen", "name:Quen de la Zavor", "name:Quen Zavor"]),
    ("cron: exit 110 Foo Street was closed, page 54 Bar Lane", []),
    ("İstanbul İİ Mira Berkel", ["name:Mira Berkel"]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_finder(text, want):
    found = pii.Finder(NAMES).find(text)
    assert [f"{k}:{text[a:b]}" for k, a, b in found] == want


def test_personal_queries(spark):
    text = CASES[10][0]
    data = [(1, text, "a"), (1, text, "a"), (2, None, "b"), (3, "", "c"), (4, "x " * 100_000 + text, "d"), (None, text, "e")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, kind string")
    names = spark.createDataFrame([*NAMES, (None, "given"), ("Q", None), NAMES[0]], "name string, name_kind string")
    got = rows(pii.find_personal(docs, names))
    assert len(got) == 8 and got.count((1, "idno", 9, 19)) == 2 and (4, "name", 200_031, 200_042) in got
    clean = dict(rows(pii.redact_personal(docs.where("doc_id > 1 or doc_id is null"), names)))
    assert clean[2] is None and clean[3] == "" and clean[None] == "Passport [IDNO] belongs to [NAME]."
    assert pii.find_personal(docs.limit(0), names).count() == 0
    assert pii.find_personal(docs, names.limit(0)).where("kind = 'idno'").count() == 4


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"aM.,@ -+()0159/:\nÉİ日", "Mira ", "Berkel", "call ", "Street", " at ", "(dot)"]), max_size=120).map("".join))
def test_spans_are_ordered_and_apart(text):
    spans = pii.Finder(NAMES).find(text)
    assert all(0 <= a < b <= len(text) for _, a, b in spans)
    assert all(x[2] <= y[1] for x, y in zip(spans, spans[1:]))
    assert regex.sub(r"\[[A-Z]+\]", "", pii.redact(text, spans)).count("") >= 1


def test_long_parts_are_found_whole():
    finder = pii.Finder([("Anna", "given"), ("Berg", "family")])
    street = "Sankt" + "a" * 60 + " Mühlen" + "b" * 60
    text = f"He lives at 12 {street.title()} Street, write to {'x' * 90}@example.org; identity number is{' ' * 60}957-14-8498."
    found = {k: text[a:b] for k, a, b in finder.find(text)}
    assert found["address"] == f"12 {street.title()} Street"
    assert found["email"] == "x" * 90 + "@example.org" and found["idno"] == "957-14-8498"
    assert finder.find("identity number is 000000000") == []


def test_long_texts_take_linear_time():
    finder = pii.Finder([("Anna", "given"), ("Smith", "family")])
    once = "Anna Smith lives at 12 Old Mill Street, call +1 415 555 0130 or mail a.b@c.org; Passport 957148498. "
    assert len(finder.find(once * 3000)) == len(finder.find(once)) * 3000
    for word in ("A", "street ", "a@", "1 ", "Smith ", "(", "Müllerstraße", "x of "):
        finder.find(word * (300_000 // len(word)))
