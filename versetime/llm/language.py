"""Language identification: text likelihood, declared language, address suffix and host priors, fused by Bayes' rule."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versetime.llm.common import staged

#: Buckets of hashed byte trigrams, labelled rows a language is trained on at most, and bytes counted at once.
BUCKETS, TRAINING_ROWS, BLOCK_BYTES = 1 << 14, 3000, 1 << 20
#: A text's evidence is that of so many trigrams at most, as neighbouring trigrams are not independent.
EVIDENCE = 48
#: Rows that a host's or a domain's own counts weigh as much as what is above them.
HOST_WEIGHT, DOMAIN_WEIGHT = 4.0, 20.0
#: Certainty of an address suffix, and the smallest posterior of a language that is accepted.
SUFFIX_TRUST, LEAST_POSTERIOR = 0.7, 0.5
UNKNOWN = "und"
#: Another language or no language is one more hypothesis.  It gives each trigram the mean likelihood of the labelled row
#: at LOW_SHARE from below, less UNKNOWN_MARGIN, and starts with the log odds UNKNOWN_PRIOR, so a few odd trigrams don't
#: decide for it.
LOW_SHARE, UNKNOWN_MARGIN, UNKNOWN_PRIOR = 0.05, 2.4, -16.0
# Country suffixes and the language of most pages there.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl"}

_LETTERS = np.zeros(256, np.uint8)
for _c in range(128):
    _LETTERS[_c] = _c + 32 if 65 <= _c <= 90 else _c if 97 <= _c <= 122 else 32
_LETTERS[128:] = np.arange(128, 256)


def trigram_counts(text: str) -> np.ndarray:
    """Hashed counts of the byte trigrams of a text's letters; all else is one space."""
    out = np.zeros(BUCKETS, np.int64)
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    tail, before = np.array([32], np.uint32), 0
    for at in range(0, len(data), BLOCK_BYTES):
        raw = _LETTERS[data[at : at + BLOCK_BYTES]]
        once = (raw != 32) | (np.concatenate([[before], raw[:-1]]) != 32)
        own = np.concatenate([tail, raw[once], [32] if at + BLOCK_BYTES >= len(data) else []]).astype(np.uint32)
        key = ((own[:-2] << 16 | own[1:-1] << 8 | own[2:]) * np.uint32(2654435761)) >> np.uint32(18)
        out += np.bincount(key[(own[1:-1] != 32) | (own[:-2] != 32)], minlength=BUCKETS)
        tail, before = own[-2:], raw[-1]
    return out


@dataclass(frozen=True)
class TextModel:
    """Log probabilities of trigram buckets by language, and of any trigram of a text in none of them."""

    languages: tuple[str, ...]
    weights: np.ndarray
    unknown: float = -float(np.log(BUCKETS))

    def evidence(self, text: str | None) -> np.ndarray | None:
        """Log likelihood of each language and of none, tempered to ``EVIDENCE`` trigrams; None for a text without letters."""
        if not text or not any(c.isalpha() for c in text):
            return None
        counts = trigram_counts(text)
        seen = np.flatnonzero(counts)
        n = counts.sum()
        own = self.weights[:, seen] @ counts[seen] * (min(n, EVIDENCE) / n)
        return np.append(own, self.unknown * min(n, EVIDENCE) + UNKNOWN_PRIOR)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[language] = sums.get(language, 0) + trigram_counts(text)
    for language, counts in sums.items():
        at = np.flatnonzero(counts)
        yield pa.record_batch({"language": pa.array([language] * len(at)), "bucket": pa.array(at), "n": pa.array(counts[at])})


def train(labelled: DataFrame, languages: list[str], *, id_col: str = "doc_id", text_col: str = "text", language_col: str = "lang", rows: int = TRAINING_ROWS) -> TextModel:
    """A naive Bayes model from at most about ``rows`` labelled rows of each language, chosen by a hash of the id.

    Rows with a null text, or labelled with another language, are not used.  The same rows, those of ``EVIDENCE``
    trigrams or more, set how likely a trigram must be for a text to be in one of the languages.
    """
    own = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(language_col).alias("language"))
    own = own.where(F.col("language").isin(languages) & F.col("text").isNotNull())
    counts = {r["language"]: r["n"] for r in own.groupBy("language").agg(F.count("*").alias("n")).collect()}
    chosen = F.lit(False)
    for language in languages:
        share = max(1, -(-counts.get(language, 0) // rows))
        chosen = chosen | ((F.col("language") == language) & (F.pmod(F.xxhash64("id"), F.lit(share)) == 0))
    sums = own.where(chosen).select("language", "text").mapInArrow(_counted, "language string, bucket long, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    found = sums.toArrow()  # at most languages x buckets
    table = np.full((len(languages), BUCKETS), 0.5)
    at = [languages.index(x) for x in found.column("language").to_pylist()]
    np.add.at(table, (at, found.column("bucket").to_numpy()), found.column("n").to_numpy())
    weights = np.log(table / table.sum(axis=1, keepdims=True))

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [c for c in map(trigram_counts, batch.column(0).to_pylist()) if c.sum() >= EVIDENCE]
            yield pa.record_batch({"mean": pa.array([float((weights @ c).max() / c.sum()) for c in counts], pa.float64())})

    means = own.where(chosen).select("text").mapInArrow(rated, "mean double").toArrow().column("mean").to_numpy()  # a number for each chosen row
    if not len(means):
        return TextModel(tuple(languages), weights)
    return TextModel(tuple(languages), weights, float(np.quantile(means, LOW_SHARE)) - UNKNOWN_MARGIN)


def text_evidence(shared):
    """Column function: a broadcast model's log likelihoods of a text, then the posteriors by these alone.

    Null for a text without letters.
    """

    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts:
            found = shared.value.evidence(text.as_py())
            if found is not None:
                powers = np.exp(found - found.max())
                found = [*found.tolist(), *(powers / powers.sum()).tolist()]
            out.append(found)
        return pa.array(out, pa.list_(pa.float64()))

    return of


def primary_language(declared: Column) -> Column:
    """The first subtag of a declared language, in lower case: ``en`` of ``en-US``."""
    return F.lower(F.regexp_extract(declared, r"^\s*([A-Za-z]{2,3})(?:[-_]|\s*$)", 1))


def identify(rows: DataFrame, model: TextModel, *, text: Column, declared: Column, host: Column, keep: list[str], stage_rows: bool = True) -> DataFrame:
    """``keep`` columns with ``language``, ``posterior``, ``accepted`` and each kind of evidence by itself.

    * text: the trained likelihood of the text, tempered, and that of a text in none of the languages;
    * declared: how often rows that declare this language, or any other, have it by their text, from all rows;
    * suffix: the language of the host's country suffix, another one too, with trust ``SUFFIX_TRUST``;
    * host: the languages of the host's other rows, smoothed by those of its domain (the last two labels),
      which are smoothed by those of all rows.

    The counts are grouped sums of the text's posteriors, combined before their shuffles; hosts are joined
    back to the rows, where adaptive execution splits a host that has very many.  The likelihoods are written
    to the shared folder with the ``keep`` columns, so texts are read once; without ``stage_rows`` they are written
    alone and found again from the texts at the end, which spares the disk a copy of rows that are kept whole.

    ``und``, for any other language or none, is the last hypothesis and never accepted; ``text_posterior`` and
    ``host_prior`` have it last.  A text without letters (null and empty ones too) is ``und``, with posterior zero;
    other rows are accepted from posterior ``LEAST_POSTERIOR``.  Null declarations and hosts are no evidence; ties
    go to the first language of the model; repeated rows count as often as they occur; an empty table gives
    no rows.  A ``keep`` column named as an output is replaced; other columns are not read.
    """
    languages, share = (*model.languages, UNKNOWN), rows.sparkSession.sparkContext.broadcast
    n = len(languages)
    own = rows.select(F.struct(*keep).alias("_keep"), text.alias("_text"), F.nullif(primary_language(declared), F.lit("")).alias("_declared"), F.lower(host).alias("_host"))
    own = own.withColumn("_likelihood", text_evidence(share(model))("_text")).drop("_text")
    counted = staged(own if stage_rows else own.drop("_keep"), "evidence")
    parts = {f"_p{i}": F.col("_likelihood")[n + i] for i in range(n)} | {"_domain": F.substring_index("_host", ".", -2)}
    own = (counted if stage_rows else own).withColumns(parts)
    known = counted.withColumns(parts).where("_likelihood is not null")
    sums = [F.sum(f"_p{i}").alias(f"s{i}") for i in range(n)]
    added = [F.sum(f"s{i}").alias(f"s{i}") for i in range(n)]
    by_host = staged(known.groupBy("_domain", "_host").agg(*sums), "hosts")
    by_domain = by_host.groupBy("_domain").agg(*added)
    whole = by_host.agg(*added).first()
    totals = [float(x or 0.0) + 1.0 for x in whole]
    general = [x / sum(totals) for x in totals]
    # How a declaration and the text's language go together: languages x languages numbers, all others as one.
    named = F.when(F.col("_declared").isin(list(model.languages)), F.col("_declared")).when(F.col("_declared").isNotNull(), F.lit(UNKNOWN))
    own, known = own.withColumn("_named", named), known.withColumn("_named", named)
    pairs = known.where("_named is not null").groupBy("_named").agg(*sums).collect()
    confusion = np.full((n, n), 0.5)
    for r in pairs:
        confusion[languages.index(r["_named"])] += [r[f"s{i}"] for i in range(n)]
    told = np.log(confusion / confusion.sum(axis=0, keepdims=True))

    domain_total = sum((F.col(f"s{i}") for i in range(n)), F.lit(0.0))
    domains = by_domain.select("_domain", *(((F.col(f"s{i}") + DOMAIN_WEIGHT * general[i]) / (domain_total + DOMAIN_WEIGHT)).alias(f"d{i}") for i in range(n)))
    hosts = by_host.where("_host is not null").join(domains, "_domain").drop("_domain")
    own = own.join(hosts, "_host", "left")
    count = sum((F.col(f"s{i}") for i in range(n)), F.lit(0.0)) - 1
    prior = [
        F.coalesce((F.greatest(F.col(f"s{i}") - F.col(f"_p{i}"), F.lit(0.0)) + HOST_WEIGHT * F.col(f"d{i}")) / (F.greatest(count, F.lit(0.0)) + HOST_WEIGHT), F.lit(general[i]))
        for i in range(n)
    ]
    said = [
        F.coalesce(*(F.when(F.col("_named") == d, F.lit(float(told[k, i]))) for k, d in enumerate(languages)), F.lit(0.0)) for i in range(n)
    ]
    suffix = F.substring_index("_host", ".", -1)
    country = F.coalesce(*(F.when(suffix == s, F.lit(lang)) for s, lang in SUFFIXES.items()), F.lit(""))
    there = F.when((country == "") | country.isin(list(languages)), country).otherwise(UNKNOWN)
    near, far = float(np.log(SUFFIX_TRUST)), float(np.log((1 - SUFFIX_TRUST) / max(1, n - 1)))
    address = [F.when(there == "", 0.0).when(there == lang, near).otherwise(far) for lang in languages]
    fused = F.array(*(F.col("_likelihood")[i] + said[i] + address[i] + F.log(F.col(f"_prior{i}")) for i in range(n)))
    out = own.withColumns({f"_prior{i}": p for i, p in enumerate(prior)}).withColumn("_fused", fused).withColumn("_top", F.array_max("_fused"))
    best = 1 / F.aggregate("_fused", F.lit(0.0), lambda total, x: total + F.exp(x - F.col("_top")))
    names = F.array(*(F.lit(x) for x in languages))
    known_row = F.col("_likelihood").isNotNull()
    found = {
        "language": F.when(known_row, names[F.array_position("_fused", F.col("_top")).cast("int") - 1]).otherwise(UNKNOWN), "posterior": F.when(known_row, best).otherwise(0.0),
        "accepted": F.coalesce(known_row & (best >= LEAST_POSTERIOR) & (F.col("_fused")[n - 1] < F.col("_top")), F.lit(False)),
        "text_posterior": F.array(*(F.col(f"_p{i}") for i in range(n))), "declared": F.col("_declared"), "suffix_language": F.nullif(country, F.lit("")),
        "host_prior": F.array(*(F.col(f"_prior{i}") for i in range(n))),
    }
    return out.select(*(F.col(f"_keep.`{c}`") for c in keep if c not in found), *(value.alias(c) for c, value in found.items()))
