import math
import zlib
from collections import Counter, defaultdict

import pytest

from versetime.llm import ppm
from versetime.llm.queries import op10_lm_scoring

SF = "/root/testdata/sf0.001"


def split(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def scores(rows, order):
    """(n_tokens, n_known, base, score) of each text, by dictionaries of contexts."""
    seen, tokens = defaultdict(Counter), Counter()
    stream = lambda t: b"\xff" * order + b" ".join(split(t)) + b"\xff"
    for doc, text in rows:
        if not held(doc):
            tokens.update([*split(text), None])
            s = stream(text)
            for i in range(order, len(s)):
                for j in range(order + 1):
                    seen[s[i - j : i]][s[i]] += 1
    total, distinct = tokens.total(), len(tokens)
    out = []
    for _, text in rows:
        s, score = stream(text), 0.0
        for i in range(order, len(s)):
            gone = set()
            for j in range(order, -1, -1):
                own = seen.get(s[i - j : i])
                if not own:
                    continue
                left = {k: c for k, c in own.items() if k not in gone}
                mass = sum(left.values())
                if s[i] in left:
                    score += math.log10((left[s[i]] - 0.5) / mass)
                    break
                if left:
                    score += math.log10(len(left) / (2 * mass))
                gone = set(own)
            else:
                score -= math.log10(max(1, 256 - len(seen.get(b"", ()))))
        own = [*split(text), None]
        base = sum(math.log10((tokens[t] + 1) / (total + 1 * (distinct + 1))) for t in own)
        out.append((len(own), sum(tokens[t] > 0 for t in own), base, score))
    return total, out


def same(rows, found, order):
    total, want = scores(rows, order)
    assert {r.train_tokens for r in found} <= {total} and len(found) == len(rows)
    key = lambda r: (str(r[0]), *r[1:])
    a = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in found), key=key)
    b = sorted(((d, held(d), n, k, round(base, 6), round(s, 6)) for (d, _), (n, k, base, s) in zip(rows, want, strict=True)), key=key)
    for x, y in zip(a, b, strict=True):
        assert x[:4] == y[:4] and x[4:] == pytest.approx(y[4:], rel=1e-6, abs=2e-6)


def test_query_against_dictionaries(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    same(rows, op10_lm_scoring(spark, SF).collect(), ppm.ORDER)


TEXTS = ["the cat sat on the mat", "THE cat\tsat\n\non a hat", None, "", " \x0b ", "über élan", "zq", "the cat sat on the mat", "a" * 300, "x y \x85z"]


@pytest.mark.parametrize(("order", "limits"), [(1, {}), (3, {"common_keys": 0, "common_words": 0}), (5, {}), (4, {"common_keys": 60, "common_words": 7, "rated_keys": 40})])
def test_odd_texts_with_all_and_with_few_values_broadcast(spark, order, limits):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(None, "null id"), (5, "again"), (5, "again")]
    df = spark.createDataFrame([(i, t, 1.0, 2) for i, t in rows], "doc_id long, text string, score double, n_tokens int")
    same(rows, ppm.ppm_scores(df, order=order, **limits).collect(), order)


def test_blocks_of_a_long_text(spark, monkeypatch):
    text = " ".join(f"w{i * 7 % 31}" for i in range(400))
    whole = [b.keys() for b in ppm.blocks([text, "ab"], 5)]
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 50)
    parts = [b.keys() for b in ppm.blocks([text, "ab"], 5)]
    assert len(parts) > 10
    assert [k for p in parts for k in p[0].tolist()] == whole[0][0].tolist() and [w for p in parts for w in p[2].tolist()] == whole[0][2].tolist()


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ppm.ppm_scores(df).count() == 0
    only = next(i for i in range(50) if held(i))
    rows = [(only, "abc")]
    same(rows, ppm.ppm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect(), ppm.ORDER)
