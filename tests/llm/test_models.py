"""Learned operators: language mixture, factorisation machine, Katz backoff."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldscope.llm import factorization, katz, langid
from fieldscope.llm.common import remainder

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_language_held_out_accuracy_and_sets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    profiles = langid.fit(docs, "text", "lang", remainder(F.col("doc_id"), 4) != 2)
    assert profiles.names == ["de", "en", "es", "fr"]
    found = langid.detect(docs, profiles).join(docs.select("doc_id", "lang"), "doc_id").where(remainder(F.col("doc_id"), 4) == 2)
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    texts = {r.lang: r.text for r in docs.where("length(text) between 1500 and 3000 and lang is not null").collect()}
    mixed = [(1, texts["de"][:1500] + " " + texts["es"][:1400], None, None, None), (2, texts["fr"], "x", None, 0)]
    got = {r.doc_id: r for r in langid.detect(spark.createDataFrame(mixed, DOCS), profiles).collect()}
    assert got[1].languages == ["de", "es"] and 0.35 < got[1].score < 0.65
    assert got[2].languages == ["fr"] and got[2].lang_pred == "fr"


def test_language_odd_input(spark):
    rows = [(1, None, "en", None, None), (2, "", "en", None, 0), (3, "123 !! ...", None, None, 1), (4, "the cat " * 40_000, "en", None, 1), (5, "der hund", "de", None, None), (5, "der hund", "de", None, None), (None, "the", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit("x"), "lang_pred": F.lit(1)})
    profiles = langid.fit(docs, "text", "lang", F.lit(True))
    got = [(r[0], r[1], r[2]) for r in langid.detect(docs, profiles).collect()]
    by = {k: (lang, s) for k, lang, s in got}
    assert len(got) == 7 and by[1] == by[2] == by[3] == ("und", 0.0) and by[4][0] == by[None][0] == "en" and by[5][0] == "de"
    none = langid.fit(docs.limit(0), "text", "lang", F.lit(True))
    assert none.names == [] and {r.lang_pred for r in langid.detect(docs, none).collect()} == {"und"}
    assert langid.detect(docs.limit(0), profiles).count() == 0


def test_letters():
    assert all(map(langid.has_letter, ["a", "1 é", "½ß", "語", "ʰ"]))
    assert not any(map(langid.has_letter, [None, "", "12 _", "½²", "Ⅷ ٣", "\u0301 😀"]))


def test_mixture_likelihood_never_falls():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(40), 3)
    counts, starts = rng.integers(1, 9, 40).astype(float), np.array([0, 25])
    last = -np.inf
    for steps in (0, 1, 2, 5, 20):
        shares, value = langid._em(p, counts, starts, np.ones((2, 3)), steps)
        assert value.sum() >= last - 1e-9 and np.allclose(shares.sum(axis=1), 1)
        last = value.sum()


def plain_mixture(log_p, text, steps=12, penalty=1.0):
    """Shares and language set of one text, trigram by trigram."""
    raw = " ".join("".join(c if c.isalpha() or ord(c) > 127 else " " for c in text.lower()).split())
    raw = b" " + raw.encode() + b" "
    counts = Counter(((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % 2**32) >> 16 for i in range(len(raw) - 2))
    grams, n_lang, total = sorted(counts), len(log_p), sum(counts.values())

    def run(allowed):
        shares = [1 / len(allowed) if x in allowed else 0.0 for x in range(n_lang)]
        limit, step = steps, 0
        while True:
            whole = {g: sum(math.exp(log_p[x][g]) * shares[x] for x in allowed) for g in grams}
            if step == limit:
                return shares, sum(counts[g] * math.log(whole[g]) for g in grams)
            new = [sum(counts[g] * math.exp(log_p[x][g]) * shares[x] / whole[g] for g in grams) / total if x in allowed else 0.0 for x in range(n_lang)]
            if max(abs(a - b) for a, b in zip(new, shares)) < 2e-3:
                limit = step + 1
            shares, step = new, step + 1

    single = [sum(counts[g] * log_p[x][g] for g in grams) for x in range(n_lang)]
    full, _ = run(range(n_lang))
    order = sorted(range(n_lang), key=lambda x: -full[x])
    cost = penalty * 0.5 * math.log1p(total / 3)
    best = max(range(n_lang), key=lambda x: single[x])
    value, chosen, winner = max(single) / 3 - cost, [best], best
    for k in range(2, n_lang + 1):
        part, likelihood = run(order[:k])
        if likelihood / 3 - k * cost <= value:
            break
        value, chosen = likelihood / 3 - k * cost, sorted(order[:k])
        winner = max(range(n_lang), key=lambda x: part[x])
    return winner, full[winner], chosen


def test_mixture_decisions_equal_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    profiles = langid.fit(docs, "text", "lang", remainder(F.col("doc_id"), 4) != 2)
    rows = docs.where("lang is not null and length(text) between 30 and 700").orderBy("doc_id").limit(60).collect()
    texts = [r.text for r in rows]
    mixed = [a[:300] + " " + b[:300] for a, b in zip(texts, texts[1:])] + ["la", "der the", "x y z"]
    log_p = profiles.log_p.astype(float).tolist()
    several = 0
    for text in texts + mixed:
        lang, share, chosen = langid.infer(profiles, [langid.trigrams(text)])[0]
        want = plain_mixture(log_p, text)
        assert (lang, chosen) == (want[0], want[2]) and abs(share - want[1]) < 2e-3
        several += len(chosen) > 1
    assert several > 10


def test_pairwise_part_equals_the_double_sum():
    rng = np.random.default_rng(1)
    machine = factorization.Machine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    index, value = np.array([3, 7, 9, 1, 7]), rng.normal(size=5)
    got, _ = machine.logits(index, value, np.array([0, 3]))
    for rows, logit in ((range(0, 3), got[0]), (range(3, 5), got[1])):
        want = 0.3 + sum(machine.linear[index[i]] * value[i] for i in rows)
        want += sum(machine.factors[index[i]] @ machine.factors[index[j]] * value[i] * value[j] for i in rows for j in rows if i < j)
        assert math.isclose(logit, want)


def test_quality_held_out_accuracy_and_odd_input(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    machine = factorization.fit(docs, labels, remainder(F.col("doc_id"), 4) != 2)
    found = factorization.score(docs, machine).join(labels, "doc_id").where(remainder(F.col("doc_id"), 4) == 2)
    assert found.agg(F.avg(((F.col("score") >= 0.7).cast("int") == F.col("quality")).cast("int"))).first()[0] > 0.95
    rows = [(1, None, None, None, None), (2, "", None, None, 0), (3, "x" * 300_000, None, None, -5), (4, "a b", None, None, None), (4, "a b", None, None, None), (None, "é", None, None, 1)]
    odd = spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit("x"), "quality": F.lit(1)})
    got = factorization.score(odd, machine).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    # Metadata may be absent, labels may be null or repeated, and there may be none at all.
    assert factorization.score(odd.drop("n_chars"), machine).count() == 6
    labels = spark.createDataFrame([(1, None, 0), (4, 1, 0), (4, 0, 1), (77, 1, 0)], "doc_id long, quality int, toxic int")
    assert factorization.score(odd, factorization.fit(odd, labels, F.lit(True))).count() == 6
    none = factorization.score(odd, factorization.fit(odd, labels.limit(0), F.lit(True)))
    assert {round(r.score, 2) for r in none.collect()} == {0.5}
    assert factorization.score(odd.limit(0), machine).count() == 0


class Plain:
    """Katz backoff written down as the formulas say."""

    def __init__(self, train, order):
        self.order, self.counts, self.follow = order, [None], defaultdict(Counter)
        for n in range(1, order + 1):
            c = Counter()
            for t in train:
                padded = ["<s>"] * (n - 1) + t
                for i in range(len(t)):
                    gram = tuple(padded[i : i + n])
                    c[gram] += 1
                    self.follow[gram[:-1]][gram[-1]] += 1
            self.counts.append(c)
        self.models = [None]
        for c in self.counts[1:]:
            of = np.array([sum(v == r for v in c.values()) for r in range(1, 7)])
            self.models.append(katz.good_turing(of, sum(c.values()), len(c)))

    def p(self, gram):
        context, word = gram[:-1], gram[-1]
        f = self.models[len(gram)].factor
        d = lambda c: c * (f[c] if c <= 5 else 1.0)
        seen = self.follow[context]
        size = sum(seen.values())
        if not size:
            return self.p(gram[1:]) if context else 1.0
        free = size - sum(map(d, seen.values()))
        low = any(c <= 5 for c in seen.values())
        whole, free = (size, free) if low else (size + 1, 1.0)
        if seen[word]:
            return (d(seen[word]) if low else seen[word]) / whole
        if not context:
            return free / whole
        return free / whole / (1 - sum(self.p((*gram[1:-1], w)) for w, c in seen.items() if c)) * self.p(gram[1:])


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz_equals_the_formulas(spark, order):
    rng = random.Random(order)
    vocab = [f"w{i}" for i in range(25)]
    pick = lambda: vocab[min(24, int(rng.expovariate(0.2)))]
    rows = [(i, " ".join(pick() for _ in range(rng.randint(0, 25))), None, None, None) for i in range(140)]
    rows += [(500, None, None, None, None), (501, "", None, None, None), (502, "new Words W1 w1", None, None, None), (502, "new Words W1 w1", None, None, None), (None, "w1 w2", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit("x"), "chunk": F.lit(1)})
    held = remainder(F.col("doc_id"), 7) == 2
    got = katz.katz_scores(docs, held, order=order, chunk_tokens=300, place_tokens=200, split=40).collect()
    marks = {r.doc_id: r.h for r in docs.select("doc_id", held.alias("h")).collect()}
    tokens = lambda t: [*(t or "").lower().split(), "</s>"]
    model = Plain([tokens(t) for k, t, *_ in rows if not marks[k]], order)
    total, distinct = sum(model.counts[1].values()), len(model.counts[1])
    assert len(got) == len(rows)
    texts = defaultdict(list)
    for k, t, *_ in rows:
        texts[k].append(t)
    for r in got:
        t = tokens(texts[r.doc_id][0])
        padded = ["<s>"] * (order - 1) + t
        want = sum(math.log10(model.p(tuple(padded[i : i + order]))) for i in range(len(t)))
        assert math.isclose(r.score, want, rel_tol=1e-9, abs_tol=1e-12), (r, want)
        assert math.isclose(r.base_score, sum(math.log10((model.counts[1][(w,)] + 1) / (total + distinct + 1)) for w in t), rel_tol=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(model.counts[1][(w,)] > 0 for w in t), total, marks[r.doc_id])
    if order > 1:  # exactly normalised, unknown words being one class
        for context in list(model.follow)[:40]:
            if context:
                assert math.isclose(sum(model.p((*context, w)) for (w,) in model.counts[1]) + model.p((*context, "?")), 1, rel_tol=1e-9)


def test_katz_counts_of_any_size():
    for most in (0, 7, (1 << 32) - 1, 1 << 32, 5_000_000_000, 1 << 60):
        counts = np.array([0, most // 2, most], np.int64)
        assert katz._get_counts(katz._put_counts(counts)).tolist() == counts.tolist()
    assert katz._get_counts(katz._put_counts(np.zeros(0, np.int64))).tolist() == []
    words = np.array([11, 12], np.uint64).tobytes()
    asked = [(0, c, b"", b"", b"", words, katz._put_counts(np.array([4_000_000_000, c])), b"") for c in range(3)]
    replies = katz.answer(1)(katz.pa.Table.from_batches(katz.batches(asked, katz._arrow(katz.QUESTIONS), 8))).to_pylist()
    assert all(katz._get_counts(r["totals"]).tolist() == [12_000_000_000, 3] for r in replies if r["chunk"] >= 0)
    assert np.frombuffer([r for r in replies if r["chunk"] == -1][0]["totals"], np.int64)[0] == 12_000_000_003


def plain_training(rows, rank, passes, batch, rate, decay, seed):
    """The same Adagrad steps, number by number, on all pairs instead of the sum of squares."""
    rng = np.random.default_rng(seed)
    bias, linear, factors = 0.0, defaultdict(float), rng.normal(0, 0.01, (factorization.SLOTS, rank))
    mean = min(0.999, max(0.001, sum(y for y, *_ in rows) / len(rows)))
    bias = math.log(mean / (1 - mean))
    seen, seen_f, seen_b = defaultdict(lambda: 1e-6), defaultdict(lambda: 1e-6), 1e-6

    def logit(slots, values):
        pairs = sum(values[a] * values[b] * float(factors[slots[a]] @ factors[slots[b]]) for a in range(len(slots)) for b in range(a + 1, len(slots)))
        return bias + sum(linear[s] * v for s, v in zip(slots, values)) + pairs

    for _ in range(passes):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = [rows[i] for i in order[at : at + batch]]
            errors = [(1 / (1 + math.exp(-logit(s, v))) - y) / len(part) for y, s, v in part]
            grad, grad_f = defaultdict(float), defaultdict(float)
            for e, (_, slots, values) in zip(errors, part):
                total = [sum(v * factors[s][f] for s, v in zip(slots, values)) for f in range(rank)]
                for s, v in zip(slots, values):
                    grad[s] += e * v
                    for f in range(rank):
                        grad_f[s, f] += e * v * (total[f] - v * factors[s][f])
            for s in grad:
                grad[s] += decay * linear[s] / len(part)
                seen[s] += grad[s] ** 2
            for s, f in grad_f:
                grad_f[s, f] += decay * factors[s][f] / len(part)
                seen_f[s, f] += grad_f[s, f] ** 2
            for s in grad:
                linear[s] -= rate * grad[s] / math.sqrt(seen[s])
            for s, f in grad_f:
                factors[s][f] -= rate * 0.3 * grad_f[s, f] / math.sqrt(seen_f[s, f])
            seen_b += sum(errors) ** 2
            bias -= rate * sum(errors) / math.sqrt(seen_b)
    return lambda slots, values: 1 / (1 + math.exp(-logit(slots, values)))


def test_training_and_scores_equal_plain_steps():
    rng = random.Random(8)
    rows = []
    for i in range(30):
        good = i % 2
        text = " ".join(rng.choices(["good", "fine", "well"] if good else ["bad", "spam", "junk"], k=6)).encode()
        slots, values = factorization.features(text, len(text))
        rows.append((float(good), slots, values))
    plain = plain_training([(y, s.tolist(), v.tolist()) for y, s, v in rows], 3, 2, 8, 0.1, 1e-4, 3)
    machine = factorization.train(rows, rank=3, passes=2, batch=8)
    for _, slots, values in rows:
        logit, _ = machine.logits(slots, values, np.array([0]))
        assert abs(1 / (1 + math.exp(-logit[0])) - plain(slots.tolist(), values.tolist())) < 1e-6


def test_quality_fit_takes_one_row_an_id(spark):
    rows = [(i, ("fine words here " if i % 2 else "spam junk buy ") * 20, "en", "a", 300) for i in range(40)]
    docs = spark.createDataFrame(rows + [(0, f"spam junk {i}", "en", "a", 1) for i in range(500)], DOCS).withColumns({c: F.lit(1) for c in ("__y", "__id", "y", "raw", "chars", "h", "row")})
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    fitted = factorization.fit(docs, labels, F.lit(True))
    scores = {r.doc_id: r.score for r in factorization.score(docs, fitted).collect()}
    assert scores[1] > 0.5 > scores[2]
    again = factorization.fit(docs.repartition(3, "text"), labels, F.lit(True))
    assert np.allclose(again.linear, fitted.linear)


def test_katz_without_training_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b", None, None, None), (2, None, None, None, None)], DOCS)
    got = katz.katz_scores(docs, F.lit(True)).collect()
    assert {(r.score, r.base_score, r.train_tokens, r.n_known) for r in got} == {(0.0, 0.0, 0, 0)}
    assert katz.katz_scores(docs.limit(0), F.lit(False)).count() == 0


def test_discounts_fall_back_where_good_turing_fails():
    good = katz.good_turing(np.array([1000, 400, 200, 120, 80, 60]), 9000, 3000)
    assert (good.factor[1:] > 0).all() and (good.factor[1:] < 1).all()
    for counts in ([0, 0, 0, 0, 0, 0], [5, 0, 0, 0, 0, 9], [1, 50, 3, 700, 2, 2]):
        factor = katz.good_turing(np.array(counts), 10, 5).factor[1:]
        assert (factor > 0).all() and (factor < 1).all()
