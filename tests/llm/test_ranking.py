import math
import random
import re

import numpy as np
import pytest

from versetime.llm import ranking as R

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, results=R.RESULTS):
    """Every document against every item, in Python's whole numbers."""
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, t) for i, t in own if t]
    n, total, df = len(own), sum(len(t) for _, t in own), {}
    for _, t in own:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, t in own:
            m = 100 - 90 + (90 * len(t) * n) // total
            score = 0
            for x in set(terms(text)) & set(t):
                w, tf = math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))), t.count(x)
                score += w * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(repr(item), k, repr(i), -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:results], 1)]
    return sorted(out)


def corpus(n, seed=0):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)] + ["Straße", "ÉCOLE", "école", "naïve—x", "A1", "a1", "x_y", "x", "日本語", " "]
    texts = [" ,.\n"[rng.randrange(4)].join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(n)]
    docs = [(i if i % 11 else None, t) for i, t in enumerate(texts)]
    docs += [(5000 + i, texts[3]) for i in range(n // 3)]  # a text very often
    docs += [docs[5], docs[5], (7000, None), (7001, ""), (7002, "--- !"), (7003, "w1 " * 30_000), (7004, "W1")]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(25)]
    items += [(100, texts[3]), (101, None), (102, "?"), (103, "no such terms"), (None, texts[8]), (0, texts[9]), (104, texts[20])]
    return docs, items


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, block int").repartition(4),
        spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, doc_id int"),
    )


def rows(df):
    return sorted((repr(r["item_id"]), r["rank"], repr(r["doc_id"]), r["score"]) for r in df.collect())


@pytest.mark.parametrize("highest", [0, 255, 256, 65_535, 65_536, 2**32 - 1, 2**32, 2**50])
def test_numbers_are_packed_in_the_narrowest_width(highest):
    own = np.array([0, 1, highest], np.int64)
    assert (R.unpacked(R.packed(own)) == own).all() and not len(R.unpacked(R.packed(own[:0])))
    assert len(R.packed(own)) == 1 + 3 * next(w for w in (1, 2, 4, 8) if highest < 1 << 8 * w)


@pytest.mark.parametrize("size, items", [(8, 1024), (256, 7)])
def test_rows_are_those_of_all_documents_scored(spark, monkeypatch, size, items):
    monkeypatch.setattr(R, "BLOCK_DOCUMENTS", size)
    monkeypatch.setattr(R, "ITEMS", items)
    docs, queries = corpus(400)
    found = R.ranked(*frames(spark, docs, queries))
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and dict(found.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert rows(found) == plain(docs, queries)


def test_no_document_scores_more_than_its_block_bound_and_blocks_are_pruned(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_DOCUMENTS", 4)
    docs, items = corpus(300, 1)
    index = R.staged(R.index_blocks(frames(spark, docs, items)[0]), "test-index")
    n, total = index.agg(R.F.sum("n_docs"), R.F.sum("n_terms")).first()
    texts = [(t or "").encode() for _, t in items]
    queries = R.Queries(texts, n, total, R._frequencies(index, sorted({t for x in texts for t in R.terms_of(x)})))
    best = {}
    for r in plain(docs, items):
        best.setdefault(r[0], []).append(r[3])
    below = 0
    for block in index.collect():
        terms = R.shared_terms(bytes(block["terms"]), queries.place)
        bounds = queries.bounds(terms, *(R.unpacked(bytes(block[c])) for c in R.PEAKS))
        lengths, counts, at, tf = (R.unpacked(bytes(block[c])) for c in ("lengths", "df", "entry_docs", "entry_tf"))
        begin = np.cumsum(counts) - counts
        own = R.impacts(tf, lengths[at], n, total)
        entries = {int(q): (at[begin[i] : begin[i] + counts[i]], own[begin[i] : begin[i] + counts[i]]) for i, q in zip(*terms, strict=True)}
        for item in range(len(texts)):
            assert queries.scores(item, entries, len(lengths)).max() <= bounds[item]
            below += bounds[item] < min(best.get(repr(items[item][0]), [0])[-1:])
    assert below > 0.2 * len(texts) * index.count()


def test_empty_tables_and_other_numbers(spark):
    docs, items = corpus(40, 2)
    d, q = frames(spark, docs, items)
    assert R.ranked(d.limit(0), q).count() == 0 and R.ranked(d, q.limit(0)).count() == 0
    assert R.ranked(d.where("doc_id in (7000, 7001, 7002)"), q).count() == 0
    assert rows(R.ranked(d, q, results=3)) == plain(docs, items, 3)
