"""op3: the model is trained on all trusted texts, not on a part of them."""

import os
from urllib.parse import urlparse

from ordercraft.llm import kneser_ney
from test_text_ops import brute_kneser_ney


def test_every_trusted_text_is_counted(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "BATCH_BYTES", 400)
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", 100)
    texts = [f"text w{i} of w{i % 97} and w{i % 89} ends" for i in range(2_300)]
    trusted = spark.createDataFrame([(i, "en", t) for i, t in enumerate([*texts, texts[0], None, ""])],
                                    "doc_id long, lang string, text string")
    asked = [*texts[::50], "", None, "nothing known here", "text text text"]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(asked)], "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in kneser_ney.perplexities(docs, trusted, keep=["doc_id"]).collect()}
    want = brute_kneser_ney(sorted(set(texts)), [t or "" for t in asked])
    assert len(got) == len(asked)
    for i, x in enumerate(want):
        assert abs(got[i].kn.log10_prob - x) < 1e-4 * max(1, abs(x)), asked[i]
        assert got[i].kn.n_tokens == len((asked[i] or "").split()) + 1
        assert (got[i].kn.perplexity is None) == (not asked[i])


def test_rounds_spread_words_and_joined_shares(spark, monkeypatch):
    """Several rounds, words and pairs that are spread, and shares beyond the broadcast
    ones give the plain counts' results; copies and nulls get a row each. No round's
    table is left, and the session's settings are as before."""
    for name, value in (("ROUND_BYTES", 20_000), ("BATCH_BYTES", 3_000), ("SHARD_BYTES", 2_000), ("SAMPLED", 1),
                        ("HEAD_WORDS", 20), ("HEAD_BIGRAMS", 15)):
        monkeypatch.setattr(kneser_ney, name, value)
    texts = [f"of the w{i % 41} of the w{i % 53} and w{i} of the end" for i in range(1_500)]
    trusted = spark.createDataFrame([(i, "en", t) for i, t in enumerate([*texts, texts[3], None, ""])],
                                    "doc_id long, lang string, text string")
    asked = [*texts[::40], "", None, None, "of the never seen", "the of the of", texts[0], "the w7 the w9 x of the", ""]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(asked)], "doc_id long, lang string, text string")
    rounds, settled = [], kneser_ney._settled

    def watched(scored, model):
        rest = scored.where("rest").select("cols").mapInArrow(kneser_ney._rest_rows, kneser_ney._ddl(kneser_ney.REST))
        rounds.append((model["whole"], model["whole2"], len(model["total3"]), rest.where("b1 > 0").count(),
                       rest.where("b2 > 0").count(), scored.inputFiles()))
        return settled(scored, model)

    monkeypatch.setattr(kneser_ney, "_settled", watched)
    held = {k: spark.conf.get(k, None) for k in kneser_ney.SETTINGS}
    got = {r.doc_id: r for r in kneser_ney.perplexities(docs, trusted, keep=["doc_id"]).collect()}
    assert {k: spark.conf.get(k, None) for k in kneser_ney.SETTINGS} == held
    whole, whole2, pairs, rest, rest2, files = zip(*rounds)
    assert len(rounds) == kneser_ney.ROUNDS and not any(whole + whole2) and min(pairs) > 0 and sum(rest) and sum(rest2)
    assert files[0] and not any(os.path.exists(urlparse(f).path) for x in files for f in x)
    want = brute_kneser_ney(sorted(set(texts)), [t or "" for t in asked])
    assert len(got) == len(asked)
    for i, x in enumerate(want):
        assert abs(got[i].kn.log10_prob - x) < 1e-5 * max(1, abs(x)), asked[i]
        assert got[i].kn.n_tokens == len((asked[i] or "").split()) + 1
