from fractions import Fraction

from pyspark.sql import functions as F

from versetime.llm.mixing import MixtureWeights, leaf_budgets, mix

SF = "/root/testdata/sf0.001"


def shared(budget, nodes):
    """name -> share of ``nodes`` (name -> (capacity, weight)): water filling, one full child after another."""
    out, todo = {}, dict(nodes)
    while todo:
        total = sum(w for _, w in todo.values())
        name = min(todo, key=lambda k: (Fraction(todo[k][0], todo[k][1]), k))
        capacity, weight = todo[name]
        if capacity * total > weight * budget:
            return out | {k: budget * w // total for k, (_, w) in todo.items()}
        out[name] = capacity
        budget -= capacity
        del todo[name]
    return out


def test_shortages_go_to_siblings_first(spark):
    leaves = [("a", "en", "x", 100, 9), ("a", "en", "y", 10, 9), ("a", "de", "x", 1000, 9), ("b", "en", "x", 5000, 9), ("b", "fr", "z", 1, 9), ("c", "en", "x", 7, 1)]
    weights = MixtureWeights(domain={"a": 3, "b": 2}, language={"en": 4}, origin={"y": 9})
    for budget in (0, 1, 50, 600, 3000, 6000, 10_000):
        df = spark.createDataFrame(leaves, "domain string, language string, origin string, tokens long, docs long")
        found = {(r.domain, r.language, r.origin): r.given for r in leaf_budgets(df, weights, budget, 1).collect()}
        want = {}
        size = lambda *p: sum(x[3] for x in leaves if x[: len(p)] == p)
        for d, n in shared(budget, {d: (size(d), weights.domain.get(d, 1)) for d in "abc"}).items():
            for lang, m in shared(n, {x[1]: (size(d, x[1]), weights.language.get(x[1], 1)) for x in leaves if x[0] == d}).items():
                own = {x[2]: (x[3], weights.origin.get(x[2], 1)) for x in leaves if x[:2] == (d, lang)}
                want |= {(d, lang, o): g for o, g in shared(m, own).items()}
        assert found == want and sum(found.values()) <= budget


def test_odd_rows(spark):
    data = [(1, "a b c", "en", "s"), (2, None, "en", "s"), (None, "d e", None, None), (3, "", "en", "s"), (4, "f g h i", "en", "s"), (4, "f g h i", "en", "s")]
    df = spark.createDataFrame([(*r, 5, "q") for r in data], "doc_id long, text string, lang string, source string, epoch int, domain string")
    found = mix(df, F.lit("d"), MixtureWeights(), budget_percent=100, max_epochs=1)
    assert set(found.columns) == {*df.columns, "language", "origin", "n_tokens"}
    rows = found.collect()
    assert sum(r.n_tokens for r in rows) == 13 and {(r.language, r.origin) for r in rows} == {("en", "s"), ("und", "unknown")} and {r.epoch for r in rows} == {0}
    assert mix(df.limit(0), F.lit("d"), MixtureWeights()).count() == 0


def test_budget_is_kept_and_nearly_used(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mix(docs, F.lit("d"), MixtureWeights(), budget_percent=50, max_epochs=1).select("doc_id", "n_tokens", "language", "origin").collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    total = docs.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert 0.2 * total < sum(r.n_tokens for r in rows) <= total * 50 // 100
