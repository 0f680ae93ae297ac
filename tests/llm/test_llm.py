"""Operators of sigsieve.llm against brute force on small tables: nulls, empty and long texts, ties, repeats, hot keys."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sigsieve.llm import (
    chat_format,
    decontaminate,
    embedding_dedup,
    html_extract,
    language_id,
    license_scan,
    mixing,
    simhash_dedup,
    substring_dedup,
    suffix_dedup,
    textgrid,
)
from sigsieve.llm.components import components

DOCS = "doc_id bigint, text string"


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def _noisy(n, seed, letters="abcdefgh", low=0, high=60):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choice(letters[:2]) if r.random() < 0.9 else r.choice(letters) for _ in range(r.randint(low, high)))) for i in range(n)]
    for i in range(n, 2 * n):
        words = rows[r.randrange(n)][1].split()
        at = r.randrange(len(words) + 1)
        words[at:at] = ["zz"] * r.randint(0, 2)
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("width", [3, 9, 70, 369])
def test_minimizers_are_the_leftmost_minima(width):
    rng = np.random.default_rng(width)
    for values in (3, 1000, 2**60):
        g = rng.integers(0, values, 3000).astype(np.uint64)
        ends = np.sort(rng.choice(3000, 7, replace=False))
        first, last = np.append(0, ends), np.append(ends, 3000)
        place, low, high = textgrid.minimizers(g, first, last, width)
        got = {s: p for p, a, b in zip(place, low, high, strict=True) for s in range(a, b + 1)}
        assert got == {s: s + int(np.argmin(g[s : s + width])) for a, b in zip(first, last, strict=True) for s in range(a, b - width + 1)}


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)], "u bigint, v bigint")
    assert _sorted(components(chain).collect()) == _sorted([(i, 0) for i in range(1, 61)] + [(101, 100)])


# ---- 4


def _windows_brute(rows, size=13):
    least = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - size + 1):
            if d is not None:
                key = tuple(w[i : i + size])
                least[key] = min(least.get(key, d), d)
    result = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - size + 1):
            if d is not None and least[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        kept = [x for i, x in enumerate(w) if i not in gone]
        result.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return result


@pytest.mark.parametrize("hot", [200_000, 3])
def test_substring_dedup(spark, hot):
    rows = _noisy(120, 1)
    rows += [(500, None), (501, ""), (None, rows[3][1] * 3), (3, rows[3][1]), (3, "a b " * 300), (502, "a b " * 300), (503, "x y   a"), (504, "a\x1cb c")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", owner string, g int")
    assert _sorted(substring_dedup.digests(df, hot=hot).collect()) == _sorted(_windows_brute(rows))


def test_substring_dedup_rewrites_rows(spark):
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, text, 5), (2, text, 6), (3, f"new   {text} tail", 7), (4, "short  text", 8)], DOCS + ", n_chars bigint")
    assert _sorted(substring_dedup.remove_repeats(df).collect()) == [(1, text, 5), (3, "new tail", 8), (4, "short  text", 8)]
    assert substring_dedup.digests(df.limit(0)).count() == 0


# ---- 7


def _bytes_brute(rows, size):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[i : i + size] for _, t in texts for i in range(len(t) - size + 1))
    result = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        result.append((d, len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return result


@pytest.mark.parametrize(("size", "hot"), [(400, 50_000), (400, 4), (48, 50_000)])
def test_suffix_dedup(spark, size, hot):
    r = random.Random(3)
    rows = [(i, "".join(r.choice("ab cdeé") for _ in range(r.randint(0, 600)))) for i in range(60)]
    for i in range(60, 120):
        x, y, at = rows[r.randrange(60)][1], rows[r.randrange(60)][1], r.randrange(200)
        rows.append((i, x[:at] + "Q" + x[at:] if i % 2 else x[at : at + 450] + y[:300] + x[at:]))
    rows += [(400, "ab" * 900), (401, "x" * 399), (402, "x" * 400), (403, "x" * 401), (404, None), (405, ""), (None, rows[3][1] * 2), (7, rows[7][1]), (7, rows[7][1] * 2)]
    df = spark.createDataFrame(rows, DOCS)
    assert _sorted(suffix_dedup.digests(df, size, hot).collect()) == _sorted(_bytes_brute(rows, size))


def test_suffix_dedup_equals_its_sql(spark):
    import duckdb

    from sigsieve.llm.queries import SQL

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS FROM '/root/testdata/sf0.001/documents.parquet'")
    got = suffix_dedup.digests(docs).collect()
    assert _sorted(got) == _sorted(con.execute(SQL["op7_suffix_dedup"]).fetchall()) and any(r.n_removed for r in got)


def test_multikey_order_is_lexicographic():
    keys = np.random.default_rng(0).integers(0, 3, (500, 6)).astype(np.uint64)
    got = keys[suffix_dedup.multikey_order(keys)].tolist()
    assert got == sorted(got)


# ---- 8


def _fingerprint(text):
    w = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum((2 * sum(h >> k & 1 for h in hashes) > len(hashes)) << k for k in range(64))


def _least_linked(rows, linked):
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(root(i), []).append(row[0])
    return [min((x for x in groups[root(i)] if x is not None), default=None) for i in range(len(rows))]


@pytest.mark.parametrize("tile_rows", [4096, 2])
def test_simhash(spark, tile_rows):
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 80)))) for i in range(60)]
    for i in range(60, 140):
        text = rows[r.randrange(60)][1].split()
        if text and r.random() < 0.8:
            text[r.randrange(len(text))] = r.choice(words)
        rows.append((i, " ".join(text).upper()))
    rows += [(300, None), (301, ""), (302, " \n"), (None, rows[5][1]), (5, rows[5][1]), (303, "one two"), (304, "One  TWO"), (305, "lone " * 5000)]
    prints = [_fingerprint(t) for _, t in rows]
    roots = _least_linked(rows, lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    df = spark.createDataFrame([(*x, 0) for x in rows], DOCS + ", fp int")
    got = simhash_dedup.simhash_components(df, tile_rows=tile_rows).select("doc_id", "fp", "component_id").collect()
    assert _sorted((d, fp % 2**64, c) for d, fp, c in got) == _sorted((d, p, c) for (d, _), p, c in zip(rows, prints, roots, strict=True))
    if tile_rows == 2:
        kept = [d for d, _, _ in simhash_dedup.keep_one(df).collect()]
        assert sorted(kept) == sorted({c for c in roots if c is not None})


# ---- 6


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(80, 24))
    rows = [(i, (base[i % 80] + rng.normal(size=24) * (0.25 if i % 7 else 0)).tolist()) for i in range(400)]
    rows += [(900, None), (901, [0.0] * 24), (902, [None] + [1.0] * 23), (903, [math.nan] * 24), (904, [math.inf] * 24), (905, []), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [1e300] * 24), (909, [1e-300] * 24)]
    units = [None if e is None or not e or None in e or not np.isfinite(e).all() or not any(e) else np.array(e) / max(map(abs, e)) for _, e in rows]
    units = [None if u is None else u / np.linalg.norm(u) for u in units]
    near = lambda i, j: units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.9
    links = [sum(near(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    roots = _least_linked(rows, near)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, node int")
    got = embedding_dedup.near_duplicates(df, block_rows=16).collect()
    want = _sorted((i, n, c, i == c) for (i, _), n, c in zip(rows, links, roots, strict=True))
    assert sum(n for _, n, _, _ in got) >= 0.9 * sum(links)  # the promise; the next line is what this table gives
    assert _sorted(got) == want


def test_embeddings_spread_in_few_directions(spark):
    rng = np.random.default_rng(6)
    spread = np.concatenate([np.full(4, 4.0), np.full(60, 0.02)])
    vectors = rng.normal(size=(3000, 64)) * spread
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = units @ units.T >= 0.995
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df, least=0.995, sample_rows=320, list_rows=64, block_rows=64).collect()}
    assert sum(got.values()) == near.sum() > 0  # recall 1.0 over 10 lists; the sample holds few of the links
    assert got == dict(enumerate(near.sum(axis=1).tolist()))


# ---- 9


def test_decontamination(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(3, 70)))) for i in range(40)] + [(90, None), (91, ""), (92, "one two"), (93, "Lone!"), (94, "one two three four"), (95, "w1 w2 w3"), (96, "...")]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 300)))) for i in range(80)]
    for i in range(80, 200):
        text = r.choice(items[:40])[1].split()
        if r.random() < 0.5:
            text[r.randrange(len(text))] = "zzz"
        host = docs[r.randrange(80)][1].split()
        at = r.randrange(len(host) + 1)
        docs.append((i, " ".join(host[:at] + text + host[at:] * r.choice([1, 1, 20])).upper().replace(" ", r.choice([" ", ", ", "\n"]))))
    docs += [(300, None), (301, ""), (None, items[5][1]), (85, docs[85][1]), (302, "one, two"), (303, "a one TWO three four b"), (304, "lone"), (305, "alone one-two-three"), (306, "w1 w2 w3 " * 9)]
    size = {i: min(5, len(decontaminate.normal_words(t))) for i, t in items}
    grams = {i: decontaminate._shingles(t, size[i]) for i, t in items if size[i]}
    want = {(d, i, len(g & s), len(g)) for d, t in docs for i, g in grams.items() for s in [decontaminate._shingles(t, size[i])] if len(g & s) >= 0.8 * len(g)}
    assert {(302, 92, 1, 1), (303, 94, 1, 1), (304, 93, 1, 1), (305, 92, 1, 1)} <= want and not any(d == 305 and i == 93 for d, i, *_ in want)
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contaminated(d, b, block_items=7).drop("containment").collect()
    assert _sorted(decontaminate.contaminated(d, b, block_bytes=900).drop("containment").collect()) == _sorted(got)
    assert _sorted(got) == _sorted(want)
    hit = {(x, t) for x, t in docs for w in [{i for e, i, *_ in want if e == x}] if w and any(len(grams[i] & decontaminate._shingles(t, size[i])) >= 0.8 * len(grams[i]) for i in w)}
    assert _sorted(decontaminate.drop_contaminated(d, b).collect()) == _sorted(x for x in docs if x not in hit)
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0 and decontaminate.contaminated(d.limit(0), b).count() == 0
    assert _sorted(decontaminate.drop_contaminated(d, b.limit(0)).collect()) == _sorted(docs)
    wide = d.selectExpr("*", "1 as item_id", "2 as n_shared", "'x' as _r")
    assert decontaminate.contaminated(wide, b.selectExpr("*", "3 as doc_id")).count() == len(got)
    assert decontaminate.drop_contaminated(wide, b).columns == wide.columns


# ---- 10


def test_mixing_meets_its_targets(spark):
    rows = [(i, "t " * (1 + i % 9), "big" if i % 10 else f"s{i // 10 % 4}") for i in range(2000)] + [(5000, None, "empty"), (5001, "a b", None), (5001, "a b", None)]
    df = spark.createDataFrame(rows, DOCS + ", source string")
    tokens = df.selectExpr("source", f"cast({mixing.TOKENS} as bigint) n_tokens")
    per = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in {x for _, _, x in rows}}
    for share, limit in ((0.7, 1e9), (None, 4.0), (1.0, 4.0), (1.0, 1.5)):
        w = {r.source: r for r in mixing.source_weights(tokens, share, limit, None).collect()}
        p = np.array([r.weight for r in w.values()])
        assert "empty" not in w and abs(p.sum() - 1) < 1e-6
        passes = max(r.quota / per[s] for s, r in w.items())
        if limit > 1e6:
            assert abs(-(p * np.log(p)).sum() - share * np.log(len(p))) < 1e-5
        elif share is None:
            assert all(abs(r.quota - per[s]) <= 1 for s, r in w.items())
        else:
            assert limit - 0.35 < passes <= limit + 0.35  # quotas are whole tokens; the smallest source has four
    got = mixing.mix(df, 1.0, 4.0, block_docs=16).collect()
    quota = {r.source: r.quota for r in mixing.source_weights(tokens, 1.0, 4.0, None).collect()}
    spent = Counter()
    for r in got:
        spent[r.source] += r.n_tokens
    assert all(quota[s] - 9 < spent[s] <= quota[s] for s in quota)
    assert max(Counter((r.source, r.epoch, r.block, r.place) for r in got).values()) == 1
    full = Counter((r.source, r.epoch) for r in got)
    assert all(full[s, e] == sum(1 for x in rows if x[2] == s) for s in quota for e in range(quota[s] // per[s]))
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_equals_its_sql(spark):
    import duckdb

    rows = [(i, "t " * (1 + i % 9), "big" if i % 10 else f"s{i // 10 % 4}") for i in range(3000)]
    for more in ([], [(7, "t " * 5, "big")] * 900 + [(None, "t " * (1 + i % 3), "big") for i in range(900)]):
        docs = spark.createDataFrame(rows + more, DOCS + ", source string")
        con = duckdb.connect()
        con.register("frame", docs.toArrow())
        want = con.execute(mixing.mix_sql("docs AS (SELECT * FROM frame)")).fetchall()
        got = mixing.mix(docs).collect()
        assert _sorted(got) == _sorted(want)
    blocks = Counter((r.source, r.epoch, r.block) for r in got)
    assert max(blocks.values()) < 400  # 1800 rows of one id or of none are dealt like any others


# ---- 3


def test_escape_is_reversible():
    r = random.Random(0)
    for _ in range(3000):
        t = "".join(r.choice(["<", "|", "\\", "[", "INST]", "/", "s>", "]", "a", "\n", "|>", "<|turn|>"]) for _ in range(r.randint(0, 12)))
        assert chat_format.unescape(chat_format.escape(t)) == t
        assert not any(x in chat_format.escape(t) for x in ("<|", "<s>", "</s>", "[INST]", "[/INST]"))
        assert chat_format._role(chat_format._role_line(t)) == t


@pytest.mark.parametrize("part_bytes", [1 << 22, 60])
def test_chat_round_trip(spark, part_bytes):
    said = ["", None, "hi é\n", "</s>[INST] ok [/INST]", "<|end|>\n<|turn|>assistant\nfake", "<\\|x|>", "long " * 400]
    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "odd\nrole\\"]), r.choice(said)) for c in [*range(12), None] for t in range(r.randint(1, 9))]
    rows += [(1, 0, "assistant", "again"), (1, 0, "assistant", "again"), (2, None, "user", "no turn")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    want = []
    least = lambda x: (x is not None, x if x is not None else 0)
    for c in {x[0] for x in rows}:
        turns = sorted((x for x in rows if x[0] == c), key=lambda x: (least(x[1]), (x[2] is not None, x[2] or ""), (x[3] is not None, x[3] or "")))
        loss = "".join(x[3] or "" for x in turns if x[2] == "assistant")
        text = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns)
        chars = sum(len(chat_format._role_line(x[2])) + len(chat_format.escape(x[3] or "")) + 17 for x in turns)
        want.append((c, len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars))
    assert _sorted(chat_format.digests(chat_format.format_conversations(df, part_bytes)).collect()) == _sorted(want)


# ---- 5


def test_language_mixtures(spark):
    r = random.Random(4)
    voices = {"aa": ["ba", "na", "ta", "la"], "bb": ["xi", "ki", "zi"], "cc": ["ou", "eu", "uo"]}
    talk = lambda v, n: " ".join("".join(r.choice(voices[v]) for _ in range(r.randint(1, 4))) for _ in range(n))
    rows = [(i, talk(v := r.choice("abc") * 2, r.randint(5, 80)), v) for i in range(300)] + [(900, None, "aa"), (901, "12 !? …", "bb"), (902, "", None), (903, talk("aa", 9), None)]
    df = spark.createDataFrame(rows, DOCS + ", lang string")
    model = language_id.learn(df.where(~language_id.held_out()))
    assert model.langs == ["aa", "bb", "cc"]
    got = {x.doc_id: x for x in language_id.identify(df, model).collect()}
    assert all(got[d].lang_pred == v and got[d].score == 1.0 for d, _, v in rows[:300])
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3 and got[903].lang_pred == "aa"
    share = language_id.mixtures([talk("aa", 60) + " " + talk("bb", 30)], model)[0]
    assert abs(share[0] - 2 / 3) < 0.05 and abs(share[1] - 1 / 3) < 0.05 and share[2] == 0
    assert sorted(x.doc_id for x in language_id.keep_identified(df, model).collect()) == [*range(300), 903]
    empty = language_id.learn(df.limit(0))
    assert {(x.lang_pred, x.score) for x in language_id.identify(df, empty).collect()} == {("und", 0.0)}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.learn(docs.where(~language_id.held_out()))
    hit = language_id.identify(docs.where(language_id.held_out()), model).join(docs.select("doc_id", "lang"), "doc_id")
    assert hit.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] >= 0.98


# ---- 2


def _licenses_brute(rows, templates):
    """{(doc_id, license, shared, size)} by plain sets of whole shingles."""
    words = lambda t: "".join(c if c.isascii() and c.isalnum() else " " for c in (t or "").lower()).split()
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    result = set()
    for d, t in rows:
        held = []
        for name, family, wording in templates:
            k = min(5, len(words(wording)))
            own = grams(words(wording), k) if k else set()
            shared = own & grams(words(t), k) if k else set()
            if own and len(shared) >= 0.8 * len(own):
                held.append((name, family, shared, len(own)))
        for name, family, shared, size in held:
            confused = any(f == family and len(s) / n > len(shared) / size and shared <= s for _, f, s, n in held)
            if len(shared) == size or not confused:
                result.add((d, name, len(shared), size))
    return result


def test_license_scan(spark):
    import duckdb

    from sigsieve.llm.queries import SQL

    apache = dict((a, c) for a, _, c in license_scan.TEMPLATES)["Apache-2.0-notice"]
    pad = " ".join(f"x{i}" for i in range(3000))
    rows = [(1, f"{pad}\nReleased under the MIT License.\n{pad}"), (2, apache.upper().replace(" ", "\n")), (3, " ".join(w for i, w in enumerate(apache.split()) if i != 30)),
            (4, apache[: len(apache) // 2]), (5, None), (6, ""), (7, "MIT License"), (8, "this work is licensed under the GNU general public license, version 2"), (None, "Licensed under CC BY 4.0"), (1, "nothing"), (9, "All rights reserved")]
    df = spark.createDataFrame([(*x, 3) for x in rows], DOCS + ", license int")
    got = {(r.doc_id, r.license, r.n_shared, r.n_template) for r in license_scan.matches(df).collect()}
    assert got == _licenses_brute(rows, license_scan.TEMPLATES + license_scan.SHORT_TEMPLATES)
    assert (1, "MIT", 1, 1) in got and (2, "Apache-2.0-notice", 82, 82) in got and not any(d == 4 and a == "Apache-2.0-notice" for d, a, _, _ in got)
    assert license_scan.matches(df, []).count() == 0 and license_scan.matches(df.limit(0)).count() == 0
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    assert _sorted(con.execute(SQL["op2_license_scan"]).fetchall()) == _sorted(license_scan.matches(df).select("doc_id", "license", "family", "n_shared", "n_template", "containment").collect())


def test_license_notices_of_few_words(spark):
    pad = " ".join(f"x{i}" for i in range(3000))
    rows = [(1, "All rights reserved."), (2, f"{pad}\n(c) 2001.  ALL RIGHTS\nreserved\n{pad}"), (3, "all rights are reserved"), (4, "overall rights reserved"), (5, f"{pad} all rights"),
            (6, "Released under the MIT License.\nAll rights reserved."), (7, "Some rights reserved"), (8, None), (9, ""), (None, "all rights reserved"), (1, "nothing here")]
    df = spark.createDataFrame(rows, DOCS)
    got = _sorted((r.doc_id, r.license, r.n_shared, r.n_template) for r in license_scan.matches(df).collect())
    reserved = [(d, "All-rights-reserved", 1, 1) for d in (1, 2, 6, None)]
    assert got == _sorted([*reserved, (6, "MIT", 1, 1), (7, "Some-rights-reserved", 1, 1)])
    own = [("one", "a", "reserved"), ("two", "a", "x7 x8"), ("four", "b", "x7 x8 x9 x10"), ("none", "b", "...")]
    got = _sorted((r.doc_id, r.license) for r in license_scan.matches(df, own).collect())
    assert got == _sorted([(d, "one") for d in (1, 2, 3, 4, 6, 7, None)] + [(d, x) for d in (2, 5) for x in ("two", "four")])


def test_license_matches_keep_every_license(spark):
    text = {a: c for a, _, c in license_scan.TEMPLATES}
    edited = lambda name, at: " ".join("zz" if i == at else w for i, w in enumerate(text[name].split()))
    rows = [(1, f"{text['CC-BY-4.0']}\n{edited('CC0-notice', 0)}"), (2, f"{text['MIT']}\n{edited('MIT-text', 3)}"), (3, f"{text['GPL-3.0']}\n{edited('GPL-notice', 3)}"),
            (4, text["GPL-2.0"]), (5, f"{text['GPL-2.0']}\n{edited('GPL-3.0', 0)}"), (6, text["Apache-2.0-notice"])]
    df = spark.createDataFrame(rows, DOCS)
    got = _sorted((r.doc_id, r.license) for r in license_scan.matches(df).collect())
    assert got == _sorted([(1, "CC-BY-4.0"), (1, "CC0-notice"), (2, "MIT"), (2, "MIT-text"), (3, "GPL-3.0"), (3, "GPL-notice"),
                           (4, "GPL-2.0"), (5, "GPL-2.0"), (5, "GPL-3.0"), (6, "Apache-2.0"), (6, "Apache-2.0-notice")])
    assert {x[:2] for x in _licenses_brute(rows, license_scan.TEMPLATES)} == set(got)


# ---- 1


def test_html_extraction(spark):
    trees = html_extract.learn(spark)
    pages = [html_extract.parse(p) for p in html_extract.labelled_pages(200, seed=7)]
    exact = 0
    for page in pages:
        keep = html_extract.decode(page, trees.logit(html_extract.features([page])))
        assert all(keep[page.parent[i]] or not keep[i] for i in range(1, len(keep)))
        truth = (html_extract._labels(page) > 0) & np.array([t not in html_extract.NO_TEXT for t in page.tag])
        exact += html_extract.main_text(page, keep) == html_extract.main_text(page, truth)
    assert exact >= 0.93 * len(pages)
    body = "<nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One <i>two</i>three&nbsp;four,<br>five, six and seven.<p>Last &lt;one&gt;, with \n more.</article><div class='comments'><p>First, I say.</p></div>"
    rows = [(1, "u", f"<html><head><title>x</title><script>'</p>'</script></head><body>{body}<!-- <p>no</p> --></body></html>"), (2, None, None), (3, "u", ""), (4, "u", "<p>cut of<b")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(spark.createDataFrame([(*x, 1) for x in rows], "page_id bigint, url string, html string, text int"), trees).collect()}
    text = "A & B One twothree four, five, six and seven. Last <one>, with more."
    assert got[1] == (text, len(text)) and got[2] == got[3] == ("", 0)
