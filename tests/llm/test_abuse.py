import random

import numpy as np

from tesserae.llm import abuse as A

D = "doc_id bigint, text string, source string, page_id bigint, score double, k bigint, y string"


def sentences(rnd, n):
    nouns, verbs = ["bridge", "river", "council", "market", "tower", "garden"], ["was built", "lies", "grew", "was sold", "is old"]
    return " ".join(f"The {rnd.choice(nouns)} {rnd.choice(verbs)} near the {rnd.choice(nouns)} in {rnd.randrange(1500, 2020)}." for _ in range(n))


def make(n=500, seed=1):
    """Abusive: an insult, or the mention of a group with contempt, in disguised spellings.  Not abusive: the same
    words in neutral accounts, and other vandalism."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        text, bad = sentences(rnd, rnd.randrange(2, 8)), rnd.random() < 0.3
        if bad:
            name = rnd.choice(["Ann", "Bob", "Cleo", "Dan"])
            s = rnd.choice([f"you stupid zorg {name} go away", f"the marsh people are zorgs and vermin {name}", f"{name} is a worthless blat and a liar"])
            s = rnd.choice([s, s.upper(), s.replace("o", "0"), s.replace("zorg", "z-o-r-g"), s.replace("a", "aaaa")])
        else:
            s = rnd.choice(["", "", "hello can i edit this", "The word zorg was once used by physicians as a technical term.", "The marsh people are known for their boats."])
        at = rnd.randrange(len(text))
        rows.append((i, text[:at] + " " + s + " " + text[at:], "ab"[i % 2], i, int(bad)))
    return rows


def test_held_out_accuracy():
    rnd = random.Random(9)
    train, test = make(900, 1), make(600, 2)
    votes = [b if rnd.random() > 0.05 else 1 - b for *_, b in train]  # one vote in twenty is wrong
    m = A.fit([A.word_hashes(r[1]) for r in train], np.array(votes, float), np.array([r[3] for r in train]))
    p = A.score_words(m, [A.word_hashes(r[1]) for r in test]) >= m.threshold
    y = np.array([r[4] for r in test], bool)
    assert (p & y).sum() / y.sum() > 0.9 and (p & y).sum() / p.sum() > 0.9
    # the same word in an insult and in a neutral account: pairs decide
    a, b = A.score_words(m, [A.word_hashes("you stupid zorg Ann go away"), A.word_hashes("The word zorg was once used by physicians as a technical term.")])
    assert a > 0.7 > 0.3 > b


def test_normal_form():
    same = ["idiot", "IDIOT", "1d10t", "i-d-i-o-t", "i.d.i.o.t!", "idiooooot", "id​iot", "id&nbsp;iot", "id''iot", "<b>idiot</b>"]
    assert len({A.word_hashes(x).tobytes() for x in same}) == 1
    assert A.normal_words("1984") == ["0"] and A.normal_words("h****s") == ["h*s"] and len(A.normal_words("漢字仮名")) == 3


def test_tables(spark):
    rows = [(i, t, s, g, 0.0, 1, "z") for i, t, s, g, _ in make(300)] + [(9001, None, None, None, 0.0, 1, "z"), (9002, "", "c", 1, 0.0, 1, "z"), (9003, " \n", "c", 1, 0.0, 1, "z"), (3, "repeat", "c", 1, 0.0, 1, "z")]
    docs = spark.createDataFrame(rows, D)
    votes = spark.createDataFrame([(i, b, "r") for i, _, _, _, b in make(300)] * 2 + [(5, None, "r"), (77777, 1, "r"), (None, 1, "r")], "doc_id bigint, abusive int, rater string")
    m = A.fit(*A.labelled_words(docs, votes))
    got = A.score(docs, m)
    assert got.count() == len(rows) and got.filter("doc_id > 9000 AND flagged").count() == 0
    assert got.filter("doc_id <= 300 AND flagged").count() > 60
    r = {x.source: x for x in A.rates(got).collect()}
    assert set(r) == {"a", "b", "c", None} and sum(x.n_docs for x in r.values()) == len(rows) and 0.15 < r["a"].rate < 0.45
    assert len(A.labelled_words(docs, votes, most=10)[0]) <= 10


def test_without_votes(spark):
    docs = spark.createDataFrame([(1, "x", "s", 1, 0.0, 1, "z")], D)
    none = spark.createDataFrame([], "doc_id bigint, abusive int, rater string")
    m = A.fit(*A.labelled_words(docs, none))
    assert A.score(docs, m).first().score == 0.0 and A.score(docs.limit(0), m).count() == 0
    one_sided = spark.createDataFrame([(1, 1, "r")], "doc_id bigint, abusive int, rater string")
    assert not A.score(docs, A.fit(*A.labelled_words(docs, one_sided))).first().flagged
