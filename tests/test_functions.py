import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsieve.config import DedupeConfig
from twinsieve.functions import minhash, text


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "c string").select(column).collect()]


def test_normalize(spark):
    got = one(spark, text.normalize_content(F.col("c")), "Hello, WORLD!! 新华社。", "  ", "ΑΣ ΑΣΑ", None, "a_b")
    assert got == ["hello world 新华社", "", "ας ασα".replace("ς", "σ"), None, "a b"]


def test_ngrams(spark):
    got = one(spark, text.char_ngrams(F.col("c")), "abcab", "ab", "", None)
    assert [list(x) if x is not None else None for x in got] == [["abc", "bca", "cab"], ["ab"], [], None]
    with pytest.raises(ValueError):
        text.char_ngrams(F.col("c"), 0)


def test_boilerplate(spark):
    short = "\n".join(["short"] * 30)
    values = ["", "  \n", "a {{x}} b", short, "A normal sentence of prose.", "\n".join(["a line that is long enough"] * 30)]
    assert one(spark, text.is_boilerplate(F.col("c"), ["{{"]), *values) == [True, True, True, True, False, False]
    assert text.parse_junk_patterns("# x\n\n a\\nb \n{{") == ["a\nb", "{{"]


def test_size_filter(spark):
    data = [(1000, 700), (1000, 699), (0, 5), (5, 0), (0, 0), (700, 1000)]
    df = spark.createDataFrame(data, "a int, b int").select(text.size_within(F.col("a"), F.col("b"), 0.3))
    assert [r[0] for r in df.collect()] == [True, False, True, True, True, True]


def test_hash_and_permutations():
    assert minhash.item_hash(b"abc") == 15751086913964468521
    assert minhash.item_hash(b"") == minhash.HASH_OFFSET
    assert minhash.permutations()[:2] == (
        (15021278609987233951, 5881210131331364753),
        (18149643915985481101, 12933668939759105464),
    )
    assert all(a % 2 for a, _ in minhash.permutations())


def test_signature_against_loops():
    texts, raw = ["hello world", "ab", "", "a longer text of words"], ["Hello World", "ab", "!!!", "x"]
    got = minhash.signatures(texts, raw)
    for t, r, sig in zip(texts, raw, got):
        items = [t[i : i + 3].encode() for i in range(len(t) - 2)] if len(t) > 3 else [t.encode()]
        if not t:
            items = [r.encode()]
        hashes = [minhash.item_hash(i) for i in items]
        want = [min(((a * h + b) % 2**64) >> 32 for h in hashes) for a, b in minhash.permutations()]
        assert list(sig) == want


def test_estimate_follows_exact_jaccard():
    """1000 letters of their own, edits spread out: shared grams are known in advance."""
    base = [chr(0x4E00 + i) for i in range(1000)]
    edited = list(base)
    edits = 12
    for k in range(edits):
        edited[40 + k * 80] = chr(0x8000 + k)
    total, changed = 998, edits * 3
    exact = (total - changed) / (total + changed)
    a, b = minhash.signatures(["".join(base), "".join(edited)], ["", ""])
    assert abs(float(np.mean(a == b)) - exact) <= 0.12


def test_jaccard_and_bands(spark):
    a = list(range(128))
    b = a[:64] + [-1] * 64
    df = spark.createDataFrame([(a, b, [1])], "a array<bigint>, b array<bigint>, c array<bigint>")
    r = df.select(
        minhash.signature_jaccard(F.col("a"), F.col("b")).alias("j"),
        minhash.signature_jaccard(F.col("a"), F.col("c")).alias("z"),
        minhash.band_slices(F.col("a")).alias("s"),
        minhash.band_hashes(F.col("a")).alias("h"),
        minhash.valid_signature(F.col("c")).alias("v"),
    ).first()
    assert (r["j"], r["z"], r["v"]) == (0.5, 0.0, False)
    assert len(r["s"]) == 16 and r["s"][1]["key"] == "8-9-10-11-12-13-14-15" and len(set(r["h"])) == 16


def test_config():
    for bad in ({"threshold": 1.1}, {"size_diff": -1}, {"min_content_length": -1}, {"max_matches_per_doc": 0}, {"edge_lookup": "x"}):
        with pytest.raises(ValueError):
            DedupeConfig(**bad)
