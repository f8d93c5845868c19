import itertools
import random

import numpy as np
import pytest

from trialweave.llm import langid

EN = "the cat and the dog went with that which this thing there where wherever nothing".split()
DE = "der hund und die katze gingen mit dem nicht schön über strasse zwischen zeitung".split()
RU = "кошка и собака пошли вместе туда где это было ничего хорошо время".split()


def corpus(n=120):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        name, words = rng.choice([("en", EN), ("de", DE), ("ru", RU)])
        rows.append((i, " ".join(rng.choice(words) for _ in range(20)), name))
    return rows


def test_viterbi_equals_best_path():
    rng = np.random.default_rng(2)
    for _ in range(60):
        sizes = rng.integers(0, 6, 4)
        scores = rng.normal(scale=3, size=(int(sizes.sum()), 3)).astype(np.float32)
        got = langid.viterbi(scores, sizes, switch=2.0)
        at = 0
        for n in sizes:
            own = scores[at : at + n]
            value = lambda path: sum(own[i, s] for i, s in enumerate(path)) - 2.0 * sum(a != b for a, b in itertools.pairwise(path))  # noqa: B023, E731
            if n:
                best = max(map(value, itertools.product(range(3), repeat=int(n))))
                assert abs(value(got[at : at + n]) - best) < 1e-3
            at += n


def test_words_and_scripts():
    words = langid.words_of("Ab1 кот,é")
    assert words.start.tolist() == [0, 4, 8] and words.end.tolist() == [2, 7, 9]
    names = [{langid.SCRIPT_NAMES[b] for b in range(32) if s >> b & 1} for s in words.scripts.tolist()]
    assert names == [{"latin"}, {"cyrillic"}, {"latin"}]
    assert (langid.words_of("AB").bucket == langid.words_of("ab").bucket).all()


def test_mixed_text_gets_spans(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == ["de", "en", "ru"]
    left, right = " ".join(EN[:8]), " ".join(RU[:8])
    rows = [(1, f"{left}. {right}"), (2, None), (3, " 12 !"), (4, ""), (5, "nicht die strasse"), (5, "the dog")]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    by_id = {(r.doc_id, r.lang_pred): r for r in got}
    spans = [(s.lang, s.start, s.end) for s in next(r for r in got if r.doc_id == 1).spans]
    assert spans == [("en", 0, len(left)), ("ru", len(left) + 2, len(left) + 2 + len(right))]
    assert all((i, "und") in by_id and by_id[(i, "und")].score == 0.0 for i in (2, 3, 4))
    assert (5, "de") in by_id and (5, "en") in by_id
    kept = langid.keep_identified(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang_pred string"), model)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 5, 5] and kept.columns == ["doc_id", "text", "lang_pred"]


def test_stage_keeps_texts_of_many_languages(spark):
    more = {"el": "και το σπίτι", "he": "שלום עולם טוב", "th": "ภาษา ไทย ดี"}
    docs = corpus() + [(1_000 + i, text, lang) for lang, text in more.items() for i in range(20)]
    model = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    mixed = "der hund nicht the cat with кошка и собака και το σπίτι שלום עולם טוב ภาษา ไทย ดี"
    rows = spark.createDataFrame([(1, mixed), (2, "12 !"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(rows, model).collect()}
    assert got[1].lang_pred != langid.UND and got[1].score < 0.3
    assert [r.doc_id for r in langid.keep_identified(rows, model).collect()] == [1]


def test_too_many_languages_fail(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 3)
    assert langid.fit(docs).languages == ["de", "en", "ru"]
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError, match="more than 2"):
        langid.fit(docs)


def test_long_text_in_pieces(spark, monkeypatch):
    text = " ".join(EN * 40)
    whole = langid.words_of(text)
    monkeypatch.setattr(langid, "CHUNK", 1_500)
    pieces = list(langid._pieces(text))
    assert len(pieces) > 1 and "".join(p for _, p in pieces) == text
    starts = np.concatenate([langid.words_of(p).start + o for o, p in pieces])
    assert starts.tolist() == whole.start.tolist()


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "the dog", None), (2, None, "en")], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert {r.lang_pred for r in langid.identify(docs, model).collect()} == {"und"}
    empty = docs.limit(0)
    assert langid.identify(empty, langid.fit(empty)).count() == 0
