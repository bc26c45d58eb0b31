import math
import re
import textwrap
from collections import Counter

import pytest

from versetime.llm import licences as L

SF = "/root/testdata/sf0.001"
# Wordings that are in no frame, and in no template.
REWORDED = ["We publish everything here under the {}, enjoy.", "Note that our sources fall under {} as of today.", "You get this package under the conditions of the {}.", "All examples of the book are covered by the {}."]


@pytest.fixture(scope="module")
def model(spark):
    return L.train(spark.read.parquet(f"{SF}/documents.parquet"))


def plain(model, rows):
    """The passages of every paragraph, n-grams listed one by one."""
    number, out = {g: k for k, g in enumerate(model.grams)}, []
    for doc, text in rows:
        for p, body in enumerate(re.split(r"\n(?:[ \t\r\x0b\f]*\n)+", text or "")):
            words = L.words_of(body)
            context = lambda i, e, words=words: (" ".join(words[max(0, i - L.BEFORE) : i]), " ".join(words[max(0, i - L.BEFORE) : e + L.AFTER]))
            hits = [(i, i + n, number[g]) for i in range(len(words)) for n in (1, 2, 3) if (g := tuple(words[i : i + n])) in number and len(g) == n]
            groups, end = [], None
            for hit in sorted(hits):
                if end is None or hit[0] - end > L.GAP:
                    groups.append([])
                groups[-1].append(hit)
                end = max(end or 0, hit[1])
            for group in groups:
                own = {k for _, _, k in group}
                scores = [(b + sum(model.weights[k][i] for k in own)) / model.temperature for i, b in enumerate(model.bias)]
                best = scores.index(max(scores))
                if best:
                    chance, grams = 1 / sum(math.exp(s - scores[best]) for s in scores), {model.grams[k] for k in own}
                    share = max([len(t & grams) / len(t) for f, _, t in model.templates if f == model.classes[best]], default=0.0)
                    near = [(len(t & grams), len(t & grams) / len(t), -k, f, s) for k, (f, s, t) in enumerate(model.templates) if len(t & grams) / len(t) >= L.LEAST_TEMPLATE]
                    _, _, _, nearest, sentence = max(near, default=(0, 0, 0, None, False))
                    around = [context(i, e) for i, e, _ in group]
                    against = any(re.search(L.DENIED, a) or re.search(L.CONFLICTS.get(model.classes[best], "^$x"), a) for _, a in around)
                    cued = len(words) <= L.HEADING or any(re.search(L.CUES, b) for b, _ in around)
                    family = model.classes[best] if chance >= L.LEAST_PROBABILITY and nearest == model.classes[best] and not against and (sentence or cued) else L.UNKNOWN
                    begin = min(h[0] for h in group)
                    out.append((str(doc), p, begin, max(h[1] for h in group) - begin, family, round(chance, 5), round(share, 5)))
    return Counter(out)


def found(df, model):
    return Counter((str(r.doc_id), r.paragraph, r.first_word, r.n_words, r.family, round(r.probability, 5), round(r.template_share, 5)) for r in L.licence_paragraphs(df, model).collect())


def test_query_against_listed_ngrams(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = found(docs, model)
    assert got == plain(model, [(r.doc_id, r.text) for r in docs.collect()])
    lines = Counter((str(r.doc_id), f) for r in docs.collect() for line in r.text.split("\n") for f, mark in {"MIT": "MIT License", "Apache-2.0": "Apache License", "GPL-3.0": "Public License, version 3", "CC-BY-NC": "CC BY-NC"}.items() if mark in line)
    assert {(k[0], k[4]) for k in got if k[4] != L.UNKNOWN} == set(lines) and len(lines) >= 3


def judged(spark, model, texts):
    """Recall and precision of the families of ``(family or None, text)``."""
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.family) for r in L.licence_paragraphs(df, model).collect() if r.family != L.UNKNOWN}
    right = sum((k, f) in got for k, (f, _) in enumerate(texts))
    return right / sum(f is not None for f, _ in texts), right / max(1, len(got))


def prose(text, k):
    return f"The first day was long and the second one was no better for us.\n{text}\nAfter that they went home by train, number {k}."


def test_held_out_and_reworded_notices(spark):
    held = L.FRAMES[2::3]
    own = L.train(spark.read.parquet(f"{SF}/documents.parquet"), frames=[f for f in L.FRAMES if f not in held])
    texts = [(f, prose(frame.format(name), k)) for k, frame in enumerate([*held, *REWORDED]) for f, names in L.NAMES.items() for name in names]
    texts += [(None, frame.format(name)) for frame in REWORDED for name in ("Ruby License", "Unicode License Agreement", "JSON License", "Vim License", "license of the city council")]
    texts += [(None, t) for t in ("She took her driving licence to the general store.", "The public may use the software of the library free of charge.", "Permission to copy is granted by the head of the school.", "No apache was seen near the source of the river.", "He works at MIT on version 3 of the map.")]
    recall, precision = judged(spark, own, texts)
    print("held-out and reworded notices: recall", round(recall, 3), "precision", round(precision, 3))
    assert recall >= 0.9 and precision >= 0.9


# Notices of licences near a family's, in words that no training notice has, and what only speaks of licences.
VARIANTS = [
    "Creative Commons Attribution-NoDerivatives 3.0 Unported License", "Creative Commons Attribution-NonCommercial-ShareAlike 3.0 License", "Creative Commons Attribution-NonCommercial-NoDerivatives 2.5 License", "CC BY-ND 3.0", "CC-BY-NC-SA 3.0", "CC BY-NC-ND 2.5",
    "Mozilla Public License 1.0", "Mozilla Public License, version 1.1", "MPL 1.0", "Apache License, Version 1.0", "Apache License 1.1", "GPL version 1", "GNU General Public License, version 1", "GNU Lesser General Public License, version 1", "AGPL version 1",
    "GNU Free Documentation License 1.2", "Boost Software License", "zlib License", "X11 License", "OpenLDAP Public License 2.8", "PostgreSQL License", "Eclipse Public License 1.0", "MIT No Attribution License", "Zero-Clause BSD License", "Microsoft Reciprocal License",
]
DENIALS = ["This project is not licensed under the {}.", "The files are no longer under the {}.", "We chose our own terms rather than the {}.", "Unlike the {} ours asks for a fee.", "The package was never released under the {}."]
OFFICES = ["The {} office on the second floor issues parking permits to all members.", "My friend wrote a long essay on the history of the {} last summer for school.", "A lecture about the {} takes place in the big hall on Monday evening."]
NOTICES = [
    "Permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation, and that the name of the author not be used in advertising.",
    "Redistribution and use of this software and associated documentation (Software), with or without modification, are permitted provided that the following conditions are met: Redistributions in source form must retain copyright statements and notices.",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS.",
]


def test_look_alikes_versions_and_denials(spark, model):
    texts = [(None, frame.format(name)) for name in VARIANTS for frame in (*REWORDED, "Licensed under the {}.")]
    texts += [(None, frame.format(name)) for names in L.NAMES.values() for name in names[:2] if "SPDX" not in name for frame in (*DENIALS, *OFFICES)]
    texts += [(None, prose(t, k)) for k, t in enumerate(NOTICES)]
    texts += [(f, prose(frame.format(name), k)) for k, frame in enumerate(REWORDED) for f, names in L.NAMES.items() for name in names[:3]]
    recall, precision = judged(spark, model, texts)
    print(f"{sum(f is None for f, _ in texts)} look-alikes, versions and denials among {len(texts)} notices: recall {recall:.3f} precision {precision:.3f}")
    assert sum(f is None for f, _ in texts) >= 200 and recall >= 0.9 and precision >= 0.9


def test_notices_that_are_not_of_a_family(spark, model):
    texts = [
        "Licensed under the Creative Commons Attribution-NoDerivatives License.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under the Mozilla Public License 1.1.", "This file is not licensed under the MIT License.",
        "The MIT License office issues parking permits.", *NOTICES,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [(r.doc_id, r.family) for r in L.licence_paragraphs(df, model).collect() if r.family != L.UNKNOWN] == []


def test_wrapped_notices(spark, model):
    texts = [(f, "Title\n\n" + textwrap.fill("Copyright 2021 A. Writer. " + " ".join(s), width) + "\n\nMore.") for f, s in L.SENTENCES.items() for width in (40, 72)]
    recall, precision = judged(spark, model, texts)
    assert recall >= 0.9 and precision >= 0.9


def test_odd_rows(spark, model):
    data = [(100, None), (101, ""), (102, "\n\n"), (None, L.SENTENCES["MIT"][0]), (103, "Nothing of the kind is said here."), (104, "word " * 100_000), (0, "Released under the MIT License."), (0, "Released under the MIT License."), (105, "?! MIT License\r\n \r\nGPLv3"), (106, "license " * 50_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in data], "doc_id long, text string, family int, gram string")
    got = found(df, model)
    assert got == plain(model, data)
    assert got[next(k for k in got if k[0] == "0")] == 2 and {(k[1], k[4]) for k in got if k[0] == "105"} == {(0, "MIT"), (1, "GPL-3.0")}
    assert not any(k[0] in ("100", "101", "102", "103", "104") for k in got)
    assert L.licence_paragraphs(df.limit(0), model).count() == 0


def test_no_python_on_the_main_path(spark, model):
    plan = L.licence_paragraphs(spark.read.parquet(f"{SF}/documents.parquet"), model)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
