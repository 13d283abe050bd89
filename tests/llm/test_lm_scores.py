"""Pseudo-likelihood: a plain recomputation, probabilities that sum to one, what the network learns, odd inputs."""

import math
import random
from collections import Counter

import numpy as np

from quarry.llm import lm_scores as lm
from quarry.llm.common import Hashes
from tests.llm.helpers import clashing, documents, odd_texts, prose


def corpus():
    rng = random.Random(3)
    normal = ["the river of the stone and the light of the window " * rng.randint(3, 8) for _ in range(60)]
    shuffled = " ".join(random.Random(1).sample(normal[0].split(), len(normal[0].split())))
    texts = [t if t is None else t[:4000] for t in odd_texts()]
    return texts + normal + [shuffled, prose(rng, 40)], len(texts)


def plain(model, texts, hashes):
    """Every conditional from the network's parameters, token by token."""
    lists = [[int(np.array([hashes[w]], dtype=np.uint64).view(np.int64)[0]) for w in lm.tokens(t or "")] for t in texts]
    counts = Counter(i for x in lists for i in x)
    own = {int(i): (int(c), int(r)) for i, c, r in zip(model.words.own, model.words.code, model.words.rank, strict=True)}
    code = {i: own[i][0] if i in own else int(lm.hashed_code(np.array([i]))[0]) for i in counts}
    row = {i: 1 + own[i][1] if i in own and own[i][1] < lm.APART else 1 + lm.APART + code[i] // lm.SLOTS for i in counts}
    mass = Counter()
    for i, n in counts.items():
        if i not in own:
            mass[code[i]] += n
    net = model.net

    def softmax(z):
        z = np.exp(z - z.max())
        return z / z.sum()

    def conditional(ids, at, word):
        h = net["bias"].astype(float).copy()
        for k, d in enumerate(lm.OFFSETS):
            h += net["embed"][k][row[ids[at + d]] if 0 <= at + d < len(ids) else 0]
        h = np.tanh(h)
        c, s = divmod(code[word], lm.SLOTS)
        p = softmax(h @ net["class_w"] + net["class_b"])[c] * softmax(net["slot_w"][c] @ h + net["slot_b"][c])[s]
        return p if word in own else p * counts[word] / (mass[code[word]] + 1)

    return lists, counts, conditional


def test_scores_equal_a_plain_recomputation(spark, monkeypatch):
    texts, _ = corpus()
    docs = clashing(documents(spark, texts))
    model = lm.learn(docs)
    lists, counts, conditional = plain(model, texts, Hashes())
    got = {r["doc_id"]: r for r in lm.score(docs).collect()}
    assert len(got) == len(texts)
    for i, ids in enumerate(lists):
        want = sum(math.log(conditional(ids, at, w)) for at, w in enumerate(ids))
        assert got[i]["n_tokens"] == len(ids) and abs(got[i]["log_prob"] - want) < 1e-3 * (1 + abs(want)), i
        assert (got[i]["mean_log_prob"] is None) == (not ids)
    # all tokens of the corpus together, at one place: what is left over is kept for tokens never seen
    total = sum(conditional(lists[0], 5, w) for w in counts)
    assert 0.5 < total <= 1 + 1e-6


def test_counts_of_tokens_that_are_not_listed_are_joined(spark, monkeypatch):
    texts, first = corpus()
    whole = {r["doc_id"]: r["log_prob"] for r in lm.score(documents(spark, texts)).collect()}
    monkeypatch.setattr(lm, "own_codes", lambda n: lm.np.arange(min(len(n), 5)))
    listed = {r["doc_id"]: r["log_prob"] for r in lm.score(documents(spark, texts)).collect()}
    monkeypatch.setattr(lm, "LISTED", 7)
    joined = {r["doc_id"]: r["log_prob"] for r in lm.score(documents(spark, texts)).collect()}
    assert all(abs(joined[i] - listed[i]) < 1e-6 * (1 + abs(listed[i])) for i in joined) and whole != listed


def test_learned_order_and_repeatability(spark):
    texts, first = corpus()
    docs = documents(spark, texts).coalesce(1)
    got = {r["doc_id"]: r["mean_log_prob"] for r in lm.score(docs).collect()}
    assert got[first] > got[first + 60] > -20
    again = {r["doc_id"]: r["mean_log_prob"] for r in lm.score(docs).collect()}
    assert again == got


def test_training_beats_counts_alone():
    rng = np.random.default_rng(1)
    tokens = np.concatenate([np.array([1, 2, 3, 4, 5, 6, 7, 8]) + 8 * int(rng.integers(0, 3)) for _ in range(6000)])
    code, rows = tokens * 3, tokens.copy()
    mass = np.bincount(code, minlength=lm.CLASSES * lm.SLOTS).astype(float)
    at = np.arange(len(tokens))
    w = lm.windows(rows, np.zeros(len(at), dtype=int), np.full(len(at), len(at)), at)
    start = lm.empty_model(mass)
    trainer = lm.Trainer(start)
    for k in range(0, 40_000, 500):
        trainer.step(w[:, k : k + 500], code[k : k + 500])
    held = slice(40_000, 48_000)
    before, after = (lm.log_probs(m, w[:, held], code[held]).mean() for m in (start, trainer.m))
    unigram = np.log(mass[code[held]] / mass.sum()).mean()
    assert abs(before - unigram) < 0.05 and after > unigram + 1
    # a distribution over all codes, whatever the window
    every = np.arange(lm.CLASSES * lm.SLOTS)
    assert abs(np.exp(lm.log_probs(trainer.m, np.repeat(w[:, 77:78], len(every), axis=1), every)).sum() - 1) < 1e-3


def test_every_position_is_learned_from(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEP", 500)
    texts, _ = corpus()
    model = lm.learn(documents(spark, texts).coalesce(1))
    hashes, window, code = Hashes(), [], []
    for t in texts:
        own, rows, _ = model.words.codes(np.array([hashes[w] for w in lm.tokens(t or "")], dtype=np.uint64).view(np.int64))
        window += [[rows[at + d] if 0 <= at + d < len(rows) else 0 for d in lm.OFFSETS] for at in range(len(rows))]
        code += own.tolist()
    window, code = np.array(window).T, np.array(code)
    start = lm.empty_model(model.words.mass)
    trainer = lm.Trainer(start)
    for k in range(0, len(code), 500):
        trainer.step(window[:, k : k + 500], code[k : k + 500])
    assert len(code) % 500 and trainer.steps > 8
    want, got, before = (lm.log_probs(m, window, code) for m in (trainer.m, model.net, start))
    assert np.abs(got - want).max() < 0.01 and np.abs(before - want).mean() > 0.1


def test_gradients_are_slopes():
    rng = np.random.default_rng(2)
    code = rng.integers(0, lm.CLASSES * lm.SLOTS, 40)
    window = rng.integers(0, lm.CONTEXTS, (len(lm.OFFSETS), 40))
    window[:, :20] = window[:, 20:]
    code[:10] = code[10]
    m = {k: rng.normal(0, 0.3, v.shape) for k, v in lm.empty_model(np.ones(lm.CLASSES * lm.SLOTS)).items()}
    for name, g in lm.gradients(m, window, code).items():
        for at in [np.unravel_index(np.abs(g).argmax(), g.shape), *map(tuple, np.argwhere(g)[rng.integers(0, np.count_nonzero(g), 5)])]:
            up, down = (m | {name: m[name].copy()} for _ in range(2))
            up[name][at] += 1e-5
            down[name][at] -= 1e-5
            slope = (lm.log_probs(down, window, code) - lm.log_probs(up, window, code)).mean() / 2e-5
            assert abs(slope - g[at]) < 1e-7, (name, at)


def test_places_of_ids():
    rng = np.random.default_rng(4)
    ends = np.iinfo(np.int64)
    for n in (0, 1, 2, 900):
        ids = np.unique(np.concatenate([rng.integers(ends.min, ends.max, n), np.arange(n)]))
        asked = np.concatenate([ids, rng.integers(ends.min, ends.max, 500), np.arange(-3, n + 3), [ends.min, ends.max]])
        at, found = lm.Places(ids).find(asked)
        assert found.tolist() == np.isin(asked, ids).tolist() and (ids[at[found]] == asked[found]).all()


def test_copies_score_above_single_documents(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(6000)]
    single = [" ".join(words[40 * k : 40 * k + 40]) for k in range(140)]
    got = {r["doc_id"]: r["mean_log_prob"] for r in lm.score(documents(spark, single + single[:30])).collect()}
    assert np.mean([got[k] for k in range(30)]) > np.mean([got[k] for k in range(30, 140)]) + 0.3


def test_rows_are_handed_over_in_small_batches(spark, monkeypatch, tmp_path):
    rng = random.Random(12)
    docs = documents(spark, [prose(rng, rng.randint(1, 400)) for _ in range(300)]).coalesce(1)
    whole = {r["doc_id"]: r["log_prob"] for r in lm.score(docs).collect()}

    def noted(batches, name):
        for b in batches:
            with open(f"{tmp_path}/{name}", "a") as f:
                f.write(f"{b.nbytes} ")
            yield b

    def read(batches, *names, f=lm.text_batches, **more):
        return f(noted(batches, "-".join(names)), *names, **more)

    for name in ("_id_rows", "_count_rows"):  # sent to tasks by value, and so with ``read``
        monkeypatch.setattr(lm, name, lambda batches, f=getattr(lm, name): f(batches))
    monkeypatch.setattr(lm, "HANDED", 50_000, raising=False)
    monkeypatch.setattr(lm, "text_batches", read)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    got = {r["doc_id"]: r["log_prob"] for r in lm.score(docs).collect()}
    seen = {p.name: list(map(int, p.read_text().split())) for p in tmp_path.iterdir()}
    assert seen.keys() == {"doc_id-text", "ids", "row-doc_id-ids"}  # for tokens, for counts and training, for scores
    for name, sizes in seen.items():
        assert sum(sizes) > 300_000 and max(sizes) < 60_000, (name, sizes)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    assert got.keys() == whole.keys() and all(abs(got[k] - whole[k]) < 1e-4 * (1 + abs(whole[k])) for k in got)


def test_empty_table(spark):
    assert lm.score(documents(spark, ["a"]).limit(0)).count() == 0
