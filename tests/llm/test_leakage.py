import random

import numpy as np

from peerlens.llm import leakage
from peerlens.llm.leakage import WIDTH, columns_of, common_subsequences, corpus_terms, latent_terms, leaks, paraphrases, word_ids, words

DOCS = "doc_id long, text string, item_id string"
ITEMS = "item_id long, suite string, item_text string, answer string, doc_id string"


def brute(docs, items):
    index = {}
    for item, _, text, *_ in items:
        w = words(text)
        for k in range(len(w) - WIDTH + 1):
            index.setdefault(tuple(w[k : k + WIDTH]), set()).add(item)
    out = set()
    for doc, text, *_ in docs:
        w = words(text)
        for k in range(len(w) - WIDTH + 1):
            out |= {(doc, i) for i in index.get(tuple(w[k : k + WIDTH]), ())}
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, "s", say(rng.choice([5, 9, 10, 11, 40])), rng.choice([None, "w1 w2"]), "") for i in range(60)]
    docs = []
    for d in range(400):
        base, item = say(rng.randrange(0, 80)).split(), items[rng.randrange(60)][2].split()
        n = rng.choice([0, 8, 9, 10, 12, 40])
        at, start = rng.randrange(len(base) + 1), rng.randrange(max(1, len(item) - n + 1))
        docs.append((d, " ".join(base[:at] + item[start : start + n] + base[at:]), ""))
    return docs, items


def test_against_brute_force(spark):
    docs, items = corpus(9)
    text = items[3][2] + " " + " ".join(f"x{i}" for i in range(12))
    items += [(900, "s", None, None, ""), (901, "s", "", "a", ""), (902, "s", " ".join("ABCDEFGHIJKL"), "b", ""), (903, "s", text, None, ""), (904, "s", text, None, "")]
    docs += [(900, None, ""), (901, "", ""), (902, "Ａ b С d,e;f​ g h I J k", ""), (903, "a b c d e f g h i", ""), (904, text, ""), (905, text, ""), (906, "q " * 150_000 + text, "")]
    got = [tuple(r) for r in leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()]
    assert len(got) == len(set(got))
    want = brute(docs, items)
    assert (902, 902) in want and (906, 903) in want and len(want) > 60
    assert set(got) == want


def test_empty(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "s", " ".join("abcdefghijkl"), None, "")], ITEMS)
    assert leaks(docs, some).count() == 0
    assert leaks(spark.createDataFrame([(1, "a b", "")], DOCS), items).count() == 0
    assert paraphrases(docs, some).count() == 0


def test_paraphrase_with_a_changed_word(spark):
    item = "the ledger shows nine hundred payments leaving the north exchange before midnight on friday"
    docs = [(i, " ".join(f"n{i}x{j}" for j in range(40)), "") for i in range(50)]
    docs += [(90, "we saw that the ledger shows nine hundred transfers leaving the north exchange before midnight. forty", "")]
    got = paraphrases(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(7, "s", item, "forty", "")], ITEMS)).collect()
    assert [(r["doc_id"], r["item_id"], r["answered"]) for r in got] == [(90, 7, True)]
    assert got[0]["score"] >= 0.8


def slow_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_subsequences():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 6, (200, 10)), rng.integers(0, 6, (200, 20))
    assert common_subsequences(a, b).tolist() == [slow_subsequence(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def edited_corpus(seed):
    """Documents with runs of 8 to 14 words of items, some words of them changed or inserted."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, "s", " ".join(say(rng.choice([9, 10, 14, 60]))), rng.choice([None, "w1"]), "") for i in range(40)]
    docs = []
    for d in range(300):
        item = items[rng.randrange(40)][2].split()
        n = rng.choice([8, 10, 11, 13, 14])
        start = rng.randrange(max(1, len(item) - n + 1))
        run = item[start : start + n]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(run))
            run[at : at + rng.randrange(2)] = [rng.choice(vocabulary)]
        docs.append((d, " ".join(say(rng.randrange(23)) + run + say(rng.randrange(23))), ""))
    return docs, items


def slow_paraphrases(docs, items):
    out = {}
    for doc, text, *_ in docs:
        w = words(text)
        for item, _, told, *_ in items:
            t = words(told)
            for k in range(len(t) - WIDTH + 1):
                passage = t[k : k + WIDTH]
                if len(set(passage) & set(w)) < 4:
                    continue
                best = max(slow_subsequence(passage, w[at : at + 2 * WIDTH]) for at in range(max(1, len(w) - 2 * WIDTH + 1)))
                if best >= 8:
                    out[doc, item] = max(best / WIDTH, out.get((doc, item), 0.0))
    return out


def test_paraphrases_against_brute_force(spark):
    docs, items = edited_corpus(4)
    items.append((90, "s", "it is as it was and as it is now it is", "now", ""))
    docs += [(900, "so it was as it is and as it is now", ""), (901, "it was as it is and it is", ""), (902, None, ""), (903, items[3][2], ""), (903, items[3][2] + " w1", "")]
    want = slow_paraphrases(docs, items)
    got = paraphrases(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert len(want) > 150 and len(got) == len({(r["doc_id"], r["item_id"]) for r in got})
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in got} == want
    # whatever holds a whole passage is a paraphrase too
    assert brute([d for d in docs if d[1]], items) <= set(want)


def test_blocks_change_nothing(spark, monkeypatch):
    docs, items = edited_corpus(6)
    items.append((95, "s", " ".join(f"w{i % 397}" for i in range(900)), "w1", ""))  # longer than a block
    docs.append((950, " ".join(f"w{i % 397}" for i in range(250, 270)), ""))
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    whole = [sorted(tuple(r) for r in f(d, i).collect()) for f in (leaks, paraphrases)]
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 100)
    assert [sorted(tuple(r) for r in f(d, i).collect()) for f in (leaks, paraphrases)] == whole
    assert (950, 95) in whole[0]


def test_latent_space_knows_topics(spark):
    rng = random.Random(8)
    topics = [[f"t{k}w{i}" for i in range(30)] for k in range(4)]
    docs = [(d, " ".join(rng.choice(topics[d % 4]) for _ in range(30)), "") for d in range(400)]
    latent = latent_terms(corpus_terms(spark.createDataFrame(docs, DOCS), "doc_id", "text")).astype(float)

    def vector(k, at):
        v = sum(latent[columns_of(np.array(word_ids(f"t{k}w{i}")))[0]] for i in at)
        return v / np.linalg.norm(v)

    # passages of one topic without a common word are near, those of two topics are not
    near = [vector(k, range(10)) @ vector(k, range(10, 20)) for k in range(4)]
    far = [vector(k, range(10)) @ vector(j, range(10, 20)) for k in range(4) for j in range(4) if j != k]
    assert np.mean(near) > np.mean(far) + 0.15


def test_no_run_depends_on_the_vectors(spark, monkeypatch):
    docs, items = corpus(12)
    docs, items = docs[:60], items[:25]
    monkeypatch.setattr(leakage, "latent_terms", lambda terms: np.zeros((leakage.COLUMNS, leakage.RANK), np.int32))
    got = {tuple(r) for r in leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == brute(docs, items) != set()


def test_ids_are_the_same_everywhere():
    assert word_ids("A b, a_b") == [*word_ids("a"), *word_ids("B"), *word_ids("a"), *word_ids("b")]
    assert word_ids(None) == [] and len({word_ids(str(i))[0] for i in range(5_000)}) == 5_000
