"""Periodic runs against brute force: single sequences, small tables, the registered query's rows."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sigsieve.llm import periodic_runs, queries

SF = "/root/testdata/sf0.001"


def _brute(s, min_words=24, min_exponent=3):
    n, found = len(s), []
    for p in range(1, n // min_exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and s[j] == s[j + p]:
                j += 1
            length = j + p - i
            if j > i and length >= max(min_words, min_exponent * p) and not any(all(s[k] == s[k + q] for k in range(i, i + length - q)) for q in range(1, p)):
                found.append((i, length, p))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def _sequence(r, n):
    s = [r.randrange(r.choice([1, 2, 3, 6, 400])) for _ in range(n)]
    for _ in range(r.randint(0, 3)):
        if n > 10:
            a, p, length = r.randrange(n), r.randint(1, 9), r.randint(1, 40)
            for i in range(a + p, min(n, a + length)):
                s[i] = s[i - p]
    return s


@pytest.mark.parametrize(("min_words", "min_exponent"), [(2, 2), (6, 3), (24, 3)])
def test_runs_of_small_sequences(min_words, min_exponent):
    r = random.Random(min_words)
    for _ in range(300):
        s = _sequence(r, r.randint(0, 70))
        assert periodic_runs.runs_of(s, min_words, min_exponent) == _brute(s, min_words, min_exponent)


def test_lce_is_the_common_prefix():
    r = random.Random(2)
    s = [r.randrange(2) for _ in range(300)]
    i, j = zip(*[(a, b) for a in range(301) for b in range(a + 1, 301) if r.random() < 0.2], strict=True)
    lce = periodic_runs.Lce(s)
    want = []
    for a, b in zip(i, j, strict=True):
        k = 0
        while b + k < 300 and s[a + k] == s[b + k]:
            k += 1
        want.append(k)
    import numpy as np

    assert lce(np.array(i), np.array(j)).tolist() == want


def _words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def _expected(doc_id, words):
    runs = _brute(words)
    gone = {i for a, length, p in runs for i in range(a + p, a + length)}
    best = None
    for x in runs:
        if best is None or x[1] * best[2] > best[1] * x[2]:
            best = x
    lines = "".join(f"{a},{length},{p}\n" for a, length, p in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def _sorted(rows):
    return sorted(map(tuple, rows), key=repr)


def test_documents(spark):
    r = random.Random(5)
    rows = [(i, " ".join(f"w{x}" for x in _sequence(r, r.randint(0, 150)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (None, "a b " * 20), (7, "a b " * 20), (7, "a b " * 20), (203, "x" * 50_000), (204, "é\x0bü\x1cz " * 30)]
    rows += [(205, "same " * 30_000), (206, "a b c d e f g h " * 3), (207, "a b c d e f g h " * 2 + "a b c d e f g")]
    rows += [(208, " ".join(f"u{i}" for i in range(20)) + " a b c" * 9), (209, "a b c " * 9 + " ".join(f"u{i}" for i in range(20)))]
    df = spark.createDataFrame([(*x, i, "n") for i, x in enumerate(rows)], "doc_id bigint, text string, runs int, collapsed string")
    got = periodic_runs.digests(periodic_runs.periodic_runs(df))
    small = [x for x in rows if x[0] != 205]
    want = [_expected(d, _words(t)) for d, t in small] + [(205, 1, 0, 30_000, 1, 30_000_000, hashlib.sha256(b"0,30000,1\n").hexdigest(), hashlib.sha256(b"same").hexdigest())]
    assert _sorted(got.collect()) == _sorted(want)
    assert periodic_runs.digests(periodic_runs.periodic_runs(df.limit(0))).count() == 0


def test_pieces_of_a_batch_do_not_touch(spark):
    rows = [(i, "p q r " * 12) for i in range(40)]  # every text one run, side by side
    got = periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1))
    assert {tuple(map(tuple, x.runs)) for x in got.collect()} == {((0, 36, 3),)}


def test_query_rows(spark):
    docs = [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = []
    for d, text in docs:
        words, h = _words(text), zlib.crc32(str(d).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        want.append(_expected(d, words))
    got = queries.op13_periodic_runs(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for c, t in got.dtypes if c not in ("runs_sha256", "collapsed_sha256")} == {"bigint"}
    assert _sorted(got.collect()) == _sorted(want) and any(x[1] for x in want)


def test_periods_leave_empty_texts(spark):
    rows = [(i, t) for i in range(40) for t in ("", None, "  ", "one")] + [(None, "a b")]
    got = queries.with_periods(spark.createDataFrame(rows, "doc_id bigint, text string")).select(F.col("doc_id"), F.trim("text").alias("text"))
    assert _sorted(got.collect()) == _sorted((d, t and t.strip()) for d, t in rows)
