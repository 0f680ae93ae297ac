"""Edges of the earlier operators: decoding and mixtures against plain versions; empty tables, clashing columns, long
texts, repeated rows and ties."""

import itertools
import random

import numpy as np
import pytest
from tests.llm.test_llm import DOCS, _bytes_brute, _sorted

from sigsieve.llm import chat_format, embedding_dedup, html_extract, language_id, mixing, simhash_dedup, suffix_dedup

EXTRA = "spans string, ids string, node string, fp string, lang_pred string, epoch string, block string, part string, k1 string, _h string, n_tokens string"


def _wide(df):
    """df with columns of any name beside it."""
    return df.selectExpr("*", *[f"'x' AS {c.split()[0]}" for c in EXTRA.split(", ") if c.split()[0] not in df.columns])


def test_decoding_is_the_best_closed_set():
    r, rng = random.Random(1), np.random.default_rng(1)
    for _ in range(60):
        inner = ""
        for _ in range(r.randint(1, 4)):
            inner += r.choice(["<p>a<b>b</b></p>", "<div><p>c</p><script>s</script></div>", "<ul><li>d</li></ul>", "text"])
        page = html_extract.parse(f"<body>{inner}</body>")
        n = len(page.tag)
        if n > 14:
            continue
        logit = rng.normal(0, 3, n)
        gain = np.clip(logit, -6, 6)
        gain[0] = 6.0
        best = -np.inf
        for bits in itertools.product([False, True], repeat=n - 1):
            keep = np.array([True, *bits])
            if all(not keep[i] or (keep[page.parent[i]] and page.tag[i] not in html_extract.NO_TEXT) for i in range(1, n)):
                best = max(best, gain[keep].sum())
        got = html_extract.decode(page, logit.copy())
        assert all(not got[i] or (got[page.parent[i]] and page.tag[i] not in html_extract.NO_TEXT) for i in range(1, n))
        assert abs(gain[got].sum() - best) < 1e-9


def _mixture_brute(text, model, rounds=10, penalty=1.0):
    """One document: expectation-maximisation over its words, then the language set of the largest penalised likelihood."""
    none = np.zeros(len(model.langs))
    if not any(c.isalpha() for c in text):
        return none
    bins, word_at, _ = language_id._trigrams([text])
    if not len(word_at):
        return none
    like = np.array([model.logs[b].sum(axis=0) for b in np.split(bins, word_at[1:])]) / language_id.OVERLAP
    n = len(like)

    def em(share):
        for _ in range(rounds):
            r = np.exp(like - like.max(axis=1, keepdims=True)) * share
            share = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
        return share, sum(np.log((np.exp(row - row.max()) * share).sum()) + row.max() for row in like)

    single = like.sum(axis=0)
    chosen, best = none.copy(), single.max()
    chosen[single.argmax()] = 1
    share, _ = em(np.full(len(model.langs), 1 / len(model.langs)))
    order = np.argsort(-share, kind="stable")
    for k in range(2, len(model.langs) + 1):
        if share[order[k - 1]] * n < 1:
            break
        seed = np.zeros(len(model.langs))
        seed[order[:k]] = share[order[:k]]
        fitted, fit = em(seed / seed.sum())
        if fit - 0.5 * penalty * (k - 1) * np.log(n) > best:
            chosen, best = fitted, fit - 0.5 * penalty * (k - 1) * np.log(n)
    return chosen


def test_mixtures_equal_one_document_at_a_time(spark):
    r = random.Random(3)
    voices = {"aa": ["ba", "na", "ta"], "bb": ["xi", "ki", "zi"], "cc": ["ou", "eu", "uo"], "dd": ["ba", "ki", "ou"]}
    talk = lambda v, n: " ".join("".join(r.choice(voices[v]) for _ in range(r.randint(1, 4))) for _ in range(n))
    rows = [(i, talk(v := r.choice(list(voices)), r.randint(5, 60)), v) for i in range(160)]
    model = language_id.learn(spark.createDataFrame(rows, DOCS + ", lang string"))
    texts = [" ".join(talk(r.choice(list(voices)), r.randint(0, 12)) for _ in range(r.randint(1, 4))) for _ in range(80)] + ["", "12 !?", "é", talk("aa", 30_000)]
    got = language_id.mixtures(texts, model)
    assert np.allclose(got, [_mixture_brute(t, model) for t in texts], atol=1e-9)


def test_language_ties_repeats_and_extra_columns(spark):
    rows = [(1, "same words here", "bb"), (2, "same words here", "aa"), (2, "same words here", "aa"), (None, "same words here", None)]
    docs = spark.createDataFrame(rows, DOCS + ", lang string")
    model = language_id.learn(docs.where("doc_id is not null").dropDuplicates())
    got = language_id.identify(_wide(docs), model).collect()
    assert len(got) == 4 and {(x.lang_pred) for x in got} == {"aa"}  # equal shares: the first in alphabetical order
    kept = language_id.keep_identified(_wide(docs), model)
    assert kept.columns == _wide(docs).columns and kept.count() == 4
    assert language_id.identify(docs.limit(0), model).count() == 0


def test_pages_empty_repeated_long_and_malformed(spark):
    trees = html_extract.learn(spark, n_pages=200)
    long = "<article>" + "<p>Some words of a long text, again and again.</p>" * 4000 + "</article>"
    rows = [(1, "u", long), (1, "u", long), (2, "u", "<p>cut <b"), (3, "u", "</div></p>>>&#x;&bogus;<"), (4, None, "<div " * 3000), (None, "u", "plain")]
    df = spark.createDataFrame([(*x, "n") for x in rows], "page_id bigint, url string, html string, n_chars string")
    got = html_extract.extract(df, trees).collect()
    assert len(got) == len(rows) and all(len(x.text) == x.n_chars for x in got)
    same = [x.text for x in got if x.page_id == 1]
    assert same[0] == same[1] and same[0].count("Some words") == 4000
    assert html_extract.extract(df.limit(0), trees).count() == 0


def test_empty_tables_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b c " * 200), (2, "a b c " * 200), (3, None)], DOCS)
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "ho")], "conv_id bigint, turn bigint, role string, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01])], "vec_id bigint, embedding array<double>")
    cases = [(docs, suffix_dedup.digests), (docs, simhash_dedup.simhash_components), (vectors, embedding_dedup.near_duplicates),
             (turns, lambda df: chat_format.digests(chat_format.format_conversations(df))),
             (docs.selectExpr("*", "'s' AS source"), mixing.mix)]
    for df, run in cases:
        plain = run(df)
        assert _sorted(run(_wide(df)).select(plain.columns).collect()) == _sorted(plain.collect())
        empty = run(df.limit(0))
        assert empty.columns == plain.columns and empty.count() == 0


def test_very_long_texts(spark):
    r = random.Random(6)
    base = "".join(r.choice("abcdef ") for _ in range(30_000))
    rows = [(1, base), (2, "x" * 500 + base[10_000:11_000] + "y" * 300), (3, "one two " * 20_000)]
    docs = spark.createDataFrame(rows, DOCS)
    assert _sorted(suffix_dedup.digests(docs).where("doc_id < 3").collect()) == _sorted(x for x in _bytes_brute(rows, 400) if x[0] < 3)
    got = {x.doc_id: x.n_tokens for x in mixing.mix(docs.selectExpr("*", "'s' AS source")).collect()}
    assert got[3] == 40_000


@pytest.mark.parametrize("block_docs", [4, 256])
def test_mixing_deals_equal_hashes_by_id(spark, block_docs):
    rows = [(7, "t " * n, "s") for n in range(1, 60)]  # one id, so one hash in each epoch
    docs = spark.createDataFrame(rows, DOCS + ", source string")
    got = mixing.mix(docs, block_docs=block_docs).where("epoch = 0").collect()
    assert sorted((x.block, x.place) for x in got) == sorted(({x.block for x in got}.pop(), p + 1) for p in range(len(got)))
    assert [x.n_tokens for x in sorted(got, key=lambda x: x.place)] == list(range(1, len(got) + 1)) and len(got) >= 58
