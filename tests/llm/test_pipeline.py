"""The pipeline against a stage-by-stage brute force on a small table."""

import random

import corpus_pipeline
from tests.llm.test_llm import _fingerprint, _least_linked

from sigsieve.llm import decontaminate, mixing


def test_pipeline_equals_brute_force(spark, tmp_path):
    r = random.Random(8)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(4000)]
    talk = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, talk(25)) for i in range(6)]
    passage = talk(60)
    rows = [(i, talk(r.randint(20, 120)), "en", f"src{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1] + " ", "en", "src0") for i in range(10)]  # copies
    rows += [(200 + i, f"{talk(80)} {passage} {talk(60)}", "en", "src1") for i in range(8)]  # a shared passage
    rows += [(300 + i, f"{talk(30)} {items[i][1]} {talk(30)}", "en", "src2") for i in range(6)]  # leaks
    rows += [(400, "123 !!!", "en", "src0"), (401, None, "en", "src0"), (402, "", None, None)]
    rows = [(*x, len(x[1] or "")) for x in rows]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, outs = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out = f"{tmp_path}/{len(outs)}"
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        outs.append(docs)
    assert all(o.columns == ["doc_id", "text", "lang", "source", "n_chars"] for o in outs[:4])

    left = [x for x in rows if x[1] and any(c.isalpha() for c in x[1])]
    assert sorted(x.doc_id for x in outs[0].collect()) == sorted(x[0] for x in left)
    prints = [_fingerprint(x[1]) for x in left]
    roots = _least_linked(left, lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    left = [x for x, root in zip(left, roots, strict=True) if x[0] == root]
    assert not any(100 <= x[0] < 110 for x in left)
    assert sorted(x.doc_id for x in outs[1].collect()) == sorted(x[0] for x in left)
    seen, kept = {}, []
    for x in left:
        w = x[1].split()
        for i in range(len(w) - 12):
            seen[tuple(w[i : i + 13])] = min(seen.get(tuple(w[i : i + 13]), x[0]), x[0])
    for x in left:
        w = x[1].split()
        gone = {j for i in range(len(w) - 12) if seen[tuple(w[i : i + 13])] < x[0] for j in range(i, i + 13)}
        text = " ".join(v for j, v in enumerate(w) if j not in gone) if gone else x[1]
        if text or not gone:
            kept.append((x[0], text, *x[2:4], len(text) if gone else x[4]))
    assert sorted(map(tuple, outs[2].collect()), key=repr) == sorted(kept, key=repr) and any(a[1] != b[1] for a, b in zip(left, kept, strict=False))
    grams = [decontaminate._shingles(t, 5) for _, t in items]
    clean = [x for x in kept if not any(len(g & decontaminate._shingles(x[1], 5)) >= 0.8 * len(g) for g in grams)]
    assert sorted(x.doc_id for x in outs[3].collect()) == sorted(x[0] for x in clean) and not any(300 <= x[0] < 306 for x in clean)
    want = mixing.mix(spark.createDataFrame(clean, outs[2].schema))
    order = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert order(outs[4]) == order(want) and outs[4].count() > 0
    assert order(corpus_pipeline.run(spark, str(tmp_path))) == order(want)


CLASHING = ["_id", "_hash", "_text_hash", "_spans", "_own", "c0", "c1", "text_hash", "fp", "component_id", "spans", "item_id", "lang_pred", "score", "n_words", "epoch", "block", "place", "n_tokens", "_h"]


def _stages(spark, rows, tmp_path, extra):
    columns = ", ".join(f"`{c}` int" for c in extra)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint" + (f", {columns}" if extra else "")
    spark.createDataFrame([(*x, *range(len(extra))) for x in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "the one short item that nobody holds at all"), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, outs = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        outs.append(docs)
    return outs


def test_stages_keep_clashing_columns(spark, tmp_path):
    r = random.Random(4)
    talk = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage = talk(40)
    rows = [(i, f"{talk(40)} {passage} {talk(20)}", "en", "s") for i in range(6)] + [(9, talk(30), None, None), (9, "", "en", "s"), (None, talk(30), "en", "s")]
    rows += [(20, rows[0][1], "en", "s"), (0, *rows[0][1:]), (21, "word " * 30_000, "en", "s")]
    rows = [(*x, len(x[1])) for x in rows]
    plain = _stages(spark, rows, tmp_path / "plain", [])
    wide = _stages(spark, rows, tmp_path / "wide", CLASHING)
    for a, b in zip(plain[:4], wide[:4], strict=True):
        assert b.columns == a.columns + CLASHING
        assert {tuple(x) for x in b.select(*CLASHING).collect()} == {tuple(range(len(CLASHING)))}
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect())) and a.count() > 0
    assert sorted(map(repr, plain[4].collect())) == sorted(map(repr, wide[4].collect()))


def test_stages_of_an_empty_table(spark, tmp_path):
    outs = _stages(spark, [], tmp_path, ["_id"])
    assert [o.count() for o in outs] == [0] * 5 and all(o.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] for o in outs[:4])
