import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline as P
from versetime.llm.common import staged
from tests.llm.test_decontaminate import best_windows
from tests.llm.test_fusion import plain_fusion
from tests.llm.test_jaccard import plain_kept
from tests.llm.test_mixing import shared
from tests.llm.test_tokens import expected
from versetime.llm.language import train
from versetime.llm.queries import LANGUAGES, WEIGHTS

SF = "/root/testdata/sf0.001"


def plain_mixed(docs):
    """Ids of the mixture of four fifths of the words, each once at most: water filling down the tree, sorted prefixes."""
    size = {i: len((r.text or "").encode().split()) for i, r in docs.items()}
    leaves = defaultdict(list)
    for i, r in docs.items():
        domain = "crawl" if r.source == "src0" else "forum" if r.source[-1] in "13579" else "curated"
        leaves[domain, r.lang, r.source].append(i)
    tokens = {k: sum(size[i] for i in own) for k, own in leaves.items()}
    below = lambda *p: sum(t for k, t in tokens.items() if k[: len(p)] == p)
    weight = lambda level, name: getattr(WEIGHTS, level).get(name, WEIGHTS.default)
    kept = set()
    for d, given in shared(below() * 80 // 100, {d: (below(d), weight("domain", d)) for d in {k[0] for k in tokens}}).items():
        for lang, part in shared(given, {x: (below(d, x), weight("language", x)) for x in {k[1] for k in tokens if k[0] == d}}).items():
            for o, budget in shared(part, {x: (below(d, lang, x), weight("origin", x)) for x in {k[2] for k in tokens if k[:2] == (d, lang)}}).items():
                own, total = leaves[d, lang, o], tokens[d, lang, o]
                full, rest = divmod(budget, max(1, total))
                kept |= set(own) if full else set()
                for i in sorted(own, key=lambda i: (hashlib.md5(f"7:{full}:{i}".encode()).hexdigest(), i)):  # noqa: B023
                    rest -= size[i]
                    if rest < 0:
                        break
                    kept.add(i)
    return kept


def test_each_stage_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in P.STAGES:
        out = staged(stage(spark, docs, SF), f"test-{name}")
        if name == "token_output":
            assert sorted(map(tuple, out.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == expected(sorted((i, r.text) for i, r in kept.items()))
            break
        now = {r.doc_id: r for r in out.collect()}
        assert out.columns == columns and all(kept[k] == r for k, r in now.items())
        if name == "language_id":
            own = list(kept)
            rated = plain_fusion([(kept[i].text, kept[i].lang, kept[i].source) for i in own], train(docs, LANGUAGES))
            assert now.keys() == {i for i, (_, _, accepted) in zip(own, rated, strict=True) if accepted}
        elif name == "near_dedup":
            assert now.keys() == plain_kept([(i, r.text) for i, r in kept.items()])
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert kept.keys() - now.keys() == {d for d, _ in best_windows([(i, r.text) for i, r in kept.items()], items)}
        elif name == "mixing":
            assert now.keys() == plain_mixed(kept)
        docs, kept = out, now


def test_stages_on_odd_rows(spark):
    text = "the old house on the hill was sold to a young family from the city in the spring of that year"
    data = [(1, None, "en", "src1"), (2, "", None, None), (3, text, "en", "src1"), (3, text, "en", "src1"), (None, text + " again and again for all to see", "en", None), (4, text * 2000, "en", "src0"), (5, "x", None, "src2")]
    docs = spark.createDataFrame([(*r, 1, "q", 2) for r in data], "doc_id long, text string, lang string, source string, n_chars long, row string, domain int")
    for rows in (docs, docs.limit(0)):
        for name, stage in P.STAGES:
            out = staged(stage(spark, rows, SF), f"odd-{name}")
            assert out.count() <= rows.count()
            if name != "token_output":
                assert out.columns == docs.columns
                if name == "near_dedup" and rows.count():
                    assert out.where("doc_id = 3").count() == 1
                rows = out if out.count() else rows.limit(0)
        assert rows.where(F.col("text").isNull()).count() == 0 or name == "token_output"
