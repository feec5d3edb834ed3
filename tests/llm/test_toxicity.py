import random

import numpy as np

from tesselum.llm import toxicity as t


def _data(spark, n=600, identity=True):
    r = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        w = [f"w{r.randrange(200)}" for _ in range(30)]
        if toxic:
            w[r.randrange(30)] = r.choice(["vile", "filth"])
        # in the labels one group is named mostly in toxic texts
        if identity and r.random() < (0.8 if toxic else 0.05):
            w[0] = "women"
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_counterfactual_penalty_takes_the_blame_off_groups(spark):
    docs, labels = _data(spark)
    fair, plain = t.fit(docs, labels, penalty=50.0), t.fit(docs, labels, penalty=0.0)
    gap = lambda m: abs(m.score("women are here w1 w2") - m.score("men are here w1 w2"))
    assert gap(fair) < 0.1 * gap(plain) + 1e-3
    assert fair.score("men w1 w2 vile w3") > 0.7 > fair.score("women w1 w2 w3")


def test_edge_cases(spark):
    docs, labels = _data(spark, 200, False)
    model = t.fit(docs, labels.union(spark.createDataFrame([(1, None), (None, 1), (10_000, 1)], labels.schema)))
    odd = spark.createDataFrame([(1, None, 5.0), (2, "", 1.0), (3, "vile " * 50_000, 0.0), (3, "vile", 0.0)], "doc_id long, text string, score double")
    got = [r["score"] for r in t.score(odd, model).orderBy("doc_id").collect()]
    assert got[0] == got[1] < 0.7 and got[2] == got[3] > 0.7
    empty = spark.createDataFrame([], labels.schema)
    assert 0 <= t.fit(docs, empty).score("anything") <= 1
    assert t.score(docs.limit(0), model).count() == 0
    ones = labels.where("toxic = 1")
    assert t.fit(docs, ones).score("w") > 0.5


def test_training_separates():
    bias, w = t.train([[0], [1], [0, 1], []] * 20, np.array([1, 0, 1, 0] * 20, float), 2, {})
    assert w[0] > 2 > 0 > bias


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = t.op4_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    hits, misses = [r for r in got if r["toxic"]], [r for r in got if not r["toxic"]]
    assert np.mean([r["predicted"] for r in hits]) > 0.6 and np.mean([r["predicted"] for r in misses]) < 0.05
    assert all((r["score"] >= 0.7) == (r["predicted"] == 1) for r in got)


def test_long_terms_leave_no_beginning(spark):
    """What a swap changes is under the penalty, also for terms of more than six letters."""
    docs, labels = _data(spark)
    docs = docs.selectExpr("doc_id", "replace(text, 'women', 'immigrants') AS text")
    fair = t.fit(docs, labels, penalty=50.0)
    assert abs(fair.score("immigrants are here w1 w2") - fair.score("citizens are here w1 w2")) < 0.05
    assert fair.score("citizens w1 w2 vile w3") > 0.7 > fair.score("immigrants w1 w2 w3")
    assert not [f for f in t.features("Muslims, foreigners and lesbian women") if f.endswith("~")]
    assert "immigr~" in t.features("immigration")


def test_neutral_mentions_pass_with_the_default_penalty(spark):
    """Also where sentences name many groups, so that there are many pairs."""
    docs, labels = _data(spark)
    others = [g for terms in t.IDENTITY for g in terms[:2] if "women" not in terms]
    many = docs.selectExpr("doc_id", f"concat(text, ' ', element_at(array({', '.join(map(repr, others))}), cast(doc_id % {len(others)} as int) + 1)) AS text")
    for d in (docs, many):
        model = t.fit(d, labels)
        assert max(model.score(f"{w} w1 w2 w3") for w in ("women are here", "women", "men", "girls")) < 0.7 < model.score("men w1 w2 vile w3")


def test_default_penalty_closes_the_gap_of_long_terms(spark):
    docs, labels = _data(spark)
    for a, b in (("muslims", "christians"), ("immigrants", "citizens"), ("women", "men")):
        model = t.fit(docs.selectExpr("doc_id", f"replace(text, 'women', '{a}') AS text"), labels)
        assert abs(model.score(f"{a} are here w1 w2") - model.score(f"{b} are here w1 w2")) < 0.05
        assert model.score(f"{b} w1 w2 vile w3") > 0.7


def test_terms_of_several_lists_swap_within_all(spark):
    assert {"muslims", "muslime"} <= {o for _, o in t.swaps("Hindus came.")}


def test_false_positives_on_neutral_mentions(spark):
    """Neutral held-out texts that name the blamed group: fewer are called toxic with the penalty than without, and toxic ones are still found."""
    r = random.Random(5)
    docs, labels = _data(spark)
    neutral = ["women " + " ".join(f"w{r.randrange(200)}" for _ in range(8)) for _ in range(200)]
    toxic = [x.replace("women", "men") + " vile" for x in neutral]
    fair, plain = t.fit(docs, labels), t.fit(docs, labels, penalty=0.0)
    wrong = lambda m: sum(m.score(x) >= 0.5 for x in neutral)
    assert wrong(fair) == 0 < wrong(plain)
    assert sum(fair.score(x) >= t.THRESHOLD for x in toxic) > 190


def test_shared_ids_and_order(spark):
    docs, labels = _data(spark, 200)
    more = docs.union(docs.selectExpr("doc_id", "concat(text, ' twice') AS text"))
    a, b = t.fit(more.repartition(7), labels.repartition(3)), t.fit(more.repartition(2), labels)
    assert a == b
