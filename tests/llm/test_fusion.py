"""The fusion of evidence, row by row in plain Python."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from versetime.llm import language as L
from versetime.llm.queries import _MARKUP, LANGUAGES, op6_language_id

SF = "/root/testdata/sf0.001"


def plain_trigrams(text):
    raw = [c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.lower().encode()]
    own = [32] + [c for k, c in enumerate(raw) if c != 32 or k == 0 or raw[k - 1] != 32] + [32]
    return Counter((((a << 16 | b << 8 | c) * 2654435761) & 0xFFFFFFFF) >> 18 for a, b, c in zip(own, own[1:], own[2:], strict=False) if raw and (a, b) != (32, 32))


def soft(x):
    e = [math.exp(v - max(x)) for v in x]
    return [v / sum(e) for v in e]


def plain_fusion(rows, model):
    """(language, posterior, accepted) of each (text, declared, host)."""
    names = [*model.languages, L.UNKNOWN]
    n, seen = len(names), []
    for text, declared, host in rows:
        like = None
        if text and any(c.isalpha() for c in text):
            counts = plain_trigrams(text)
            total = sum(counts.values())
            few = min(total, L.EVIDENCE)
            like = [sum(w[b] * c for b, c in counts.items()) * few / total for w in model.weights] + [model.unknown * few + L.UNKNOWN_PRIOR]
        tag = re.match(r"\s*([A-Za-z]{2,3})(?:[-_]|\s*$)", declared or "")
        tag = tag[1].lower() if tag else None
        seen.append((like, soft(like) if like else None, tag and (tag if tag in names[:-1] else L.UNKNOWN), host and host.lower()))
    domain = lambda h: None if h is None else ".".join(h.split(".")[-2:])
    add = lambda sums, key, p: sums[key].__setitem__(slice(None), [a + b for a, b in zip(sums[key], p, strict=True)])
    hosts, domains, told, whole = defaultdict(lambda: [0.0] * n), defaultdict(lambda: [0.0] * n), {k: [0.5] * n for k in names}, {0: [1.0] * n}
    for like, p, tag, host in seen:
        if like:
            add(whole, 0, p)
            add(hosts, host, p)
            add(domains, domain(host), p)
            if tag:
                add(told, tag, p)
    general = [x / sum(whole[0]) for x in whole[0]]
    out = []
    for like, p, tag, host in seen:
        if not like:
            out.append((L.UNKNOWN, 0.0, False))
            continue
        own, near = hosts[host], domains[domain(host)]
        prior = general
        if host is not None:
            above = [(near[i] + L.DOMAIN_WEIGHT * general[i]) / (sum(near) + L.DOMAIN_WEIGHT) for i in range(n)]
            prior = [(max(own[i] - p[i], 0) + L.HOST_WEIGHT * above[i]) / (max(sum(own) - 1, 0) + L.HOST_WEIGHT) for i in range(n)]
        there = L.SUFFIXES.get((host or "").split(".")[-1])
        there = there and (there if there in names else L.UNKNOWN)
        said = [math.log(told[tag][i] / sum(told[k][i] for k in names)) if tag else 0.0 for i in range(n)]
        address = [0.0 if not there else math.log(L.SUFFIX_TRUST if x == there else (1 - L.SUFFIX_TRUST) / (n - 1)) for x in names]
        fused = [like[i] + said[i] + address[i] + math.log(prior[i]) for i in range(n)]
        best = fused.index(max(fused))
        out.append((names[best], max(soft(fused)), best < n - 1 and max(soft(fused)) >= L.LEAST_POSTERIOR))
    return out


def same(found, want):
    assert len(found) == len(want)
    for a, b in zip(found, want, strict=True):
        assert (a.language, a.accepted) == (b[0], b[2]) and a.posterior == pytest.approx(b[1], abs=1e-6)


def test_every_posterior_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.train(docs, LANGUAGES)
    host = F.concat("source", F.when(F.col("doc_id") % 5 > 0, F.element_at(F.array(*map(F.lit, (".A.example.de", ".b.example.com", ".example.pt", ".c.fr"))), (F.col("doc_id") % 4 + 1).cast("int"))))
    declared = F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit("-XX"))).when(F.col("doc_id") % 7 == 0, "pt")
    odd = spark.createDataFrame([(-1, None, "en", "src1"), (-2, "12 !", "de", None), (-3, "Zażółć gęślą jaźń", None, "src1")], "doc_id long, text string, lang string, source string")
    rows = docs.select("doc_id", "text", "lang", "source").unionByName(odd).select("doc_id", "text", declared.alias("_named"), host.alias("_host"))
    found = L.identify(rows, model, text=F.col("text"), declared=F.col("_named"), host=F.col("_host"), keep=["doc_id", "_host", "_named"]).orderBy("doc_id")
    assert found.columns[:3] == ["doc_id", "_host", "_named"]
    same(found.collect(), plain_fusion([(r.text, r._named, r._host) for r in rows.orderBy("doc_id").collect()], model))


def test_every_page(spark):
    docs, pages = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect()
    rows = []
    for r in pages:
        tag, host = re.search(r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", r.html or ""), re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", r.url or "")
        rows.append((re.sub(_MARKUP, " ", r.html or ""), tag and tag[1], host and host[1]))
    same(op6_language_id(spark, SF).orderBy("page_id").collect(), plain_fusion(rows, L.train(docs, LANGUAGES)))


def test_long_texts_are_counted_alike_in_any_blocks(monkeypatch):
    text = "Ein  Haus, 12 -- über der Straße! " * 200
    whole = L.trigram_counts(text)
    assert {k: n for k, n in enumerate(whole.tolist()) if n} == plain_trigrams(text)
    for size in (1, 2, 7, 1000):
        monkeypatch.setattr(L, "BLOCK_BYTES", size)
        assert (L.trigram_counts(text) == whole).all()
