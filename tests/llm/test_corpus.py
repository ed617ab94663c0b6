from __future__ import annotations

import math
import os
import random

import pytest

from codestrata.llm.encode import CHUNK, OVERLAP, VOCABULARY, Stitch, _scan, decode, encode_corpus, encode_text, encoder
from codestrata.llm.mixing import Source, mixed, nearest_quotas, share_report, temperature_quotas, tempered
from codestrata.llm.terms import name_frequencies, term_counts

HAVE = os.path.exists("/opt/tokenizers/byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not HAVE, reason="no vocabulary files")
TEXTS = [
    None, "", " ", "\r\n\r\n", "Hello  world\n\n\n x", "<|endoftext|> is text", "naïve 東京タワー 👩‍💻 it's they'LL 'll", "a" * 5000, " " * 3000 + "x",
    "\n" * 999 + "y", "x1y22z" * 700, "!?" * 1500 + "'s", "".join(random.Random(1).choices("ab '\n\t.,9é漢sdlrv", k=9000)), "tab\there\u00a0nbsp\u3000wide",
]


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch([x or "" for x in TEXTS], add_special_tokens=False)]


@pytest.mark.parametrize("chunk,overlap", [(CHUNK, OVERLAP), (64, 16), (301, 7)])
def test_ids_equal_the_public_library_whatever_the_chunks(spark, chunk, overlap):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in encode_corpus(df, chunk=chunk, overlap=overlap).collect()}
    assert [got[i] for i in range(len(TEXTS))] == reference()


def test_planted_seams_and_repeated_ids(spark):
    """Runs over whole overlaps and chunks, contractions and symbols at every seam; repeated and null ids keep a row each."""
    step = CHUNK - OVERLAP
    texts = [" " * (step + k) + piece * n + "end" for k in (-2, -1, 0, 1) for piece, n in (("'s", 3000), ("漢", 5000), ("\"'ll", 900), ("..", 2500), ("9", 4100), ("a b", 1700))]
    df = spark.createDataFrame([(7 if i % 2 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(list(r.ids) for r in encode_corpus(df).collect())
    assert got == sorted(encode_text(t) for t in texts)
    assert encode_corpus(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        encode_corpus(df, chunk=10, overlap=9)


def test_stitching_against_whole_texts():
    rng = random.Random(5)
    pool = [" ", "\n", "'ll", "'s", "abc", "1", "..", "\t", "é", "漢字", "x", '"', "\u2019", "ss"]
    for _ in range(4000):
        text = "".join(rng.choice(pool) * rng.choice([1, 1, 2, 30]) for _ in range(rng.randrange(1, 40)))
        overlap = rng.randrange(2, 9)
        step = rng.randrange(2 * overlap, 60) - overlap
        parts = [text[i : i + step] for i in range(0, len(text), step)]
        n = max(1, len(parts) - (len(parts) > 1 and len(parts[-1]) <= overlap))
        stitch = Stitch(VOCABULARY, step)
        for k in range(n):
            piece = parts[k] + (parts[k + 1][:overlap] if k + 1 < len(parts) else "")
            stitch.add(k == 0, *_scan(encoder(), piece, k == 0, k == n - 1, step, overlap))
        assert stitch.finish() == encode_text(text), (text, step, overlap)


def test_round_trip():
    for t in TEXTS:
        assert decode(encode_text(t)) == (t or "")


def test_terms_against_brute_force(spark):
    rng = random.Random(2)
    data = [("hot" if rng.random() < 0.34 else f"t{rng.randrange(90)}", f"r{rng.randrange(40)}", rng.choice([1, 2, None])) for _ in range(5000)]
    data += [(None, "r1", 1), ("lost", None, 1)]
    expected: dict = {}
    for t, r, n in data:
        if t and r:
            e = expected.setdefault(t, [0, set()])
            e[0] += n or 0
            e[1].add(r)
    df = spark.createDataFrame(data, "name string, record string, n long").repartition(7)
    got = {r["name"]: (r.occurrences, r.records) for r in term_counts(df).collect()}
    assert got == {t: (n, len(rs)) for t, (n, rs) in expected.items()}


D = "delivery_id long, received_at timestamp, ts string, edit string, file string, decision string, symbols array<string>, name string"


def test_marks(spark):
    rows = [(i, None, f"2026-06-01T00:{i // 60:02d}:{i % 60:02d}Z", None, "f", "ask", ["every", "every", None] + (["few"] if i < 2 else []), "x") for i in range(200)]
    rows += [(900 + i, None, r[2], None, "f", "ask", ["only_in_a_repeat"], "x") for i, r in enumerate(rows[:5])]  # repeats are no records
    d = spark.createDataFrame(rows, D)
    s = spark.createDataFrame([("s1", "few", 5, "x"), ("s1", "few", 2, "x"), (None, "no", 1, "x"), ("s2", None, 1, "x")], "session_id string, name string, count long, mark string")
    got = {r["name"]: (r.occurrences, r.records, r.mark) for r in name_frequencies(d, s).collect()}
    assert got == {"every": (400, 200, "common"), "few": (9, 3, None)}
    assert name_frequencies(d.limit(0), s.limit(0)).count() == 0


DOC = "doc_id long, text string, source string, tokens string"
TGT = "source string, target_share double, max_repeats int, doc_id string"


def test_mixing(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(["word"] * rng.randrange(1, 60)), ["big", "big", "big", "small", "tiny"][min(4, i % 50 // 12)], "x") for i in range(3000)]
    docs += [(5000, None, "big", "x"), (5001, "", "small", "x"), (5002, "text", None, "x"), (5003, "text", "unwanted", "x")]
    df = spark.createDataFrame(docs, DOC)
    targets = spark.createDataFrame([("big", 0.5, 1, "x"), ("small", 0.3, 2, "x"), ("tiny", 0.15, 3, "x"), ("absent", 0.05, 9, "x"), (None, 0.5, 1, "x")], TGT)
    for how in ("nearest", "temperature", "exact"):
        mix = mixed(df, targets, how)
        report = {r.source: r for r in share_report(mix).collect()}
        assert set(report) == {"big", "small", "tiny", "absent"}
        assert report["absent"].taken == 0
        limits = {"big": 1, "small": 2, "tiny": 3}
        assert all(r.copies <= limits[r.source] for r in mix.selection.collect())
        if how == "temperature":
            assert mix.exponent > 0 and sum(r.taken for r in report.values()) == pytest.approx(mix.all_tokens, rel=0.02)
        elif how == "exact":
            for s, t in (("big", 0.5), ("small", 0.3), ("tiny", 0.15)):
                assert abs(report[s].share_of_mix - t / 0.95) < 0.01
        else:
            assert abs(report["big"].share_of_all_tokens - 0.5) < 0.01
            assert abs(report["small"].share_of_all_tokens - 0.3) < 0.01
    empty = mixed(df.limit(0), targets).selection
    assert empty.count() == 0


def test_the_budget_counts_documents_without_a_source(spark):
    docs = [(i, "word " * 20, "big", "x") for i in range(100)] + [(100 + i, "word " * 20, None, "x") for i in range(100)]
    targets = spark.createDataFrame([("big", 0.4, 1, "x")], TGT)
    mix = mixed(spark.createDataFrame(docs, DOC), targets)
    each = len(encode_text("word " * 20))
    report = share_report(mix).first()
    assert mix.all_tokens == 200 * each
    assert report.taken == 80 * each and report.share_of_all_tokens == 0.4
    assert {r.source for r in mix.selection.collect()} == {"big"}


def test_one_exponent_meets_the_entropy_or_the_limit():
    free = [Source("a", 0.5, 9, 800), Source("b", 0.3, 9, 150), Source("c", 0.2, 9, 50), Source("gone", 0.1, 9, 0)]
    quotas, exponent = temperature_quotas(free, 1000.0)
    h = lambda ws: -sum(w * math.log(w) for w in ws if w)
    assert h([q / 1000 for q in quotas]) == pytest.approx(h([0.5, 0.3, 0.2]), abs=1e-6)
    assert sum(quotas) == pytest.approx(1000) and quotas[3] == 0 and 0 < exponent < 1
    assert quotas[:3] == pytest.approx([1000 * w for w in tempered([0.8, 0.15, 0.05], exponent)])
    bound = [s._replace(repeats=2) for s in free]
    quotas, higher = temperature_quotas(bound, 1000.0)
    assert higher > exponent and max(q / s.tokens for q, s in zip(quotas[:3], bound)) == pytest.approx(2, rel=1e-6)
    assert temperature_quotas([], 10.0)[0] == [] and temperature_quotas(free, 0.0)[0] == [0.0] * 4
    assert nearest_quotas(free, 1000.0) == [500, 300, 200, 0] and nearest_quotas([Source("c", 0.2, 2, 50)], 1000.0) == [100]
