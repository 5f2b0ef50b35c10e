"""License scan by a trained paragraph classifier (operator 2, DataFrame functions and spark.ml only).

A paragraph is a run of lines up to a blank one; its line breaks count as spaces, so that wrapped notices
are read whole. Around every word pair of a template and every cue word windows of a few widths are classed
by sparse logistic regression on the word n-grams that they hold. It is trained on short notices of each
family, varied by cutting and by surroundings, against the unknown class: windows of the corpus at cue words
that are like no notice, and other paragraphs. A temperature fitted on held-out notices calibrates the
probabilities, the unknown class's included. A family counts only where the best template of it confirms it:
enough of the template's word pairs stand in the window.

A paragraph is passed over only where none of its windows could be confirmed: it holds too few pairs of every
template (``may_hold``, exact), which most texts show by a search for strings. The corpus gives at most
``NEGATIVES`` windows of either kind for training, those of lowest hash.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

NEGATIVES = 1_500
MIN_PROBABILITY, MIN_OVERLAP = 0.5, 0.6
#: Share of any template that a negative window may have at most.
UNLIKE = 0.34
UNKNOWN = "unknown"
#: Words to either side of a cue word in a window.
RADII = (6, 14, 32)
#: Words at which the training's negative windows stand, and strings of which one is in each of these.
CUES = "license licensed licence licenced spdx redistribution redistribute hereby permission obtaining binary unencumbered reserved reproduced cc0".split()
STEMS = "licen spdx redistribut hereby permission obtaining binary unencumbered reserved reproduced cc0".split()
#: Notices by family, lower case, words only.
TEMPLATES = (
    ("Apache-2.0", "licensed under the apache license version 2 0"),
    ("Apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("Apache-2.0", "spdx license identifier apache 2 0"),
    ("MIT", "released under the mit license"),
    ("MIT", "licensed under the mit license"),
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "spdx license identifier mit"),
    ("GPL-3.0", "this work is licensed under the gnu general public license version 3"),
    ("GPL-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3"),
    ("GPL-3.0", "spdx license identifier gpl 3 0 or later"),
    ("GPL-2.0", "licensed under the gnu general public license version 2"),
    ("GPL-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2"),
    ("GPL-2.0", "spdx license identifier gpl 2 0 only"),
    ("LGPL", "licensed under the gnu lesser general public license"),
    ("LGPL", "this library is free software you can redistribute it under the terms of the gnu lesser general public license"),
    ("AGPL-3.0", "licensed under the gnu affero general public license version 3"),
    ("BSD", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BSD", "use of this source code is governed by a bsd style license"),
    ("BSD", "licensed under the bsd 3 clause license"),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("CC-BY-4.0", "licensed under cc by 4 0"),
    ("CC-BY-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("CC-BY-SA-4.0", "licensed under cc by sa 4 0"),
    ("CC-BY-SA-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("CC-BY-NC-4.0", "licensed under cc by nc 4 0"),
    ("CC-BY-NC-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("CC0", "dedicated to the public domain under cc0 1 0 universal"),
    ("Proprietary", "all rights reserved no part of this publication may be reproduced without permission"),
    ("ISC", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC", "spdx license identifier isc"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("EPL-2.0", "made available under the terms of the eclipse public license 2 0"),
)
#: Notices and sentences that are like those of a family and belong to none, words only. They teach the unknown class.
NEAR_MISSES = (
    "licensed under the apache license version 1 1", "apache software license version 1 0", "licensed under the gnu general public license version 1",
    "licensed under the artistic license version 2 0", "licensed under the boost software license version 1 0", "licensed under the zlib license",
    "licensed under cc by nd 4 0", "licensed under cc by 3 0", "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    "this work is licensed under a creative commons attribution 2 5 license", "subject to the terms of the mozilla public license v 1 1",
    "made available under the terms of the eclipse public license 1 0", "released under the sleepycat license", "spdx license identifier zlib", "spdx license identifier bsl 1 0",
    "licensed under the academic free license version 3 0", "the driver must hold a license of version 2 at all times", "permission is hereby refused to any person",
    "this program is free of charge and you can read it under the terms of the library", "all rights reserved seats are sold", "the software is licensed not sold",
    "redistribution of wealth and use of public land are permitted", "use of this road is governed by local law", "the mit released a report on license fees",
)
FAMILIES = tuple(dict.fromkeys(f for f, _ in TEMPLATES))
BLANK = r"\n[\x20\x09\x0B-\x0D]*\n\s*"


def words(paragraph: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.array_remove(F.split(F.lower(paragraph), r"[^\p{L}\p{N}]+"), "")


def _pairs(w: Column) -> Column:
    """Word pairs, each as often as it stands there; element i begins at word i."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def _template_pairs(text: str) -> list[str]:
    w = text.split()
    return [f"{a} {b}" for a, b in dict.fromkeys(zip(w, w[1:], strict=False))]


def vocabulary() -> list[str]:
    """Words and word pairs of the templates."""
    seen: dict[str, None] = {}
    for _, t in TEMPLATES:
        seen.update(dict.fromkeys([*t.split(), *_template_pairs(t)]))
    return list(seen)


def _vector(df: DataFrame) -> DataFrame:
    """Column x: presence of each vocabulary entry among the words w and their pairs."""
    counter = CountVectorizerModel.from_vocabulary(vocabulary(), inputCol="grams", outputCol="x", minTF=1.0)
    return counter.setBinary(True).transform(df.withColumn("grams", F.array_distinct(F.concat("w", _pairs(F.col("w")))))).drop("grams")


def _shares(families: Column | None = None) -> Column:
    """Largest share of a template (of the row's family, where given) whose word pairs are among those of w, with the template's number.

    With a family, word pairs with a number (a version) must all be there: another version of a licence is another licence.
    """
    own = _pairs(F.col("w"))
    each = []
    for k, (f, text) in enumerate(TEMPLATES):
        found = _template_pairs(text)
        pairs = F.array(*map(F.lit, found))
        share = F.struct((F.size(F.array_intersect(own, pairs)) / F.size(pairs)).alias("share"), F.lit(-k).alias("k"))
        versions = [p for p in found if any(w.isdigit() for w in p.split())]
        confirmed = families == f if families is not None else F.lit(True)
        if families is not None and versions:
            confirmed = confirmed & (F.size(F.array_intersect(own, F.array(*map(F.lit, versions)))) == len(versions))
        each.append(F.when(confirmed, share))
    return F.greatest(*each)


def _needed(text: str) -> tuple[list[str], list[str], int]:
    """A template's word pairs, those with a number (all must be there), and how many of them confirm it at least."""
    pairs = _template_pairs(text)
    return pairs, [p for p in pairs if any(w.isdigit() for w in p.split())], math.ceil(MIN_OVERLAP * len(pairs) - 1e-9)


def _strings(text: str) -> tuple[list[str], list[str], int]:
    """Words without which no text confirms the template, words of which it has at least one, and how many of all it has at least.

    A part of the template's chain of words with k words has k - 1 pairs, and one more for each that closes a ring.
    """
    pairs, versions, need = _needed(text)
    left = lambda gone: [p for p in pairs if not set(p.split()) & gone]
    each = list(dict.fromkeys(sorted(text.split(), key=lambda w: (w.isdigit(), -len(w), w))))
    must = [w for w in each if len(left({w})) < need or any(w in p.split() for p in versions)]
    some: list[str] = []
    for w in each:
        if len(left(set(some))) >= need and len(left({*some, w})) < len(left(set(some))):
            some.append(w)
    return must, some, need + len(each) - len(pairs)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def may_name(low: Column) -> Column:
    """False only for a lower-case text none of whose windows can be confirmed: a search for strings."""
    each = []
    for text in dict.fromkeys(t for _, t in TEMPLATES):
        must, some, least = _strings(text)
        count = reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in dict.fromkeys(text.split())])
        each.append(reduce(lambda a, b: a & b, [*(F.contains(low, F.lit(w)) for w in must), _any([F.contains(low, F.lit(w)) for w in some]), count >= least]))
    return _any(each)


def may_hold(own: Column) -> Column:
    """True where the distinct template pairs ``own`` of a paragraph could confirm a template, were they in one window."""
    each = []
    for _, t in TEMPLATES:
        pairs, versions, need = _needed(t)
        ok = F.size(F.array_intersect(own, F.array(*map(F.lit, pairs)))) >= need
        each.append(ok & (F.size(F.array_intersect(own, F.array(*map(F.lit, versions)))) == len(versions)) if versions else ok)
    return _any(each)


def _paragraphs(docs: DataFrame, texts: Callable[[Column], Column]) -> DataFrame:
    """doc_id, th, place, all (words): paragraphs for which ``texts`` holds."""
    low = F.split(F.lower("text"), BLANK)
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(low).alias("place", "paragraph"))
    return rows.where(texts(F.col("paragraph"))).withColumn("all", words(F.col("paragraph"))).drop("paragraph")


def _around(rows: DataFrame, centres: Column) -> DataFrame:
    """doc_id, th, place (paragraph, from 0), at (first word), w: windows of ``RADII`` words around the given places."""
    rows = rows.select("doc_id", "th", "place", "all", F.explode(centres).alias("p"))
    r, before = F.col("r.to"), F.col("r.from")
    rows = rows.withColumn("r", F.explode(F.array(*(F.struct(F.lit(r).alias("to"), F.lit(b).alias("from")) for r, b in zip(RADII, (-1, *RADII), strict=False)))))
    # a wider window that holds nothing more is no other
    rows = rows.where((before < 0) | (F.col("p") > before) | (F.col("p") + before < F.size("all") - 1))
    at = F.greatest(F.col("p") - r, F.lit(0))
    return rows.select("doc_id", "th", "place", at.alias("at"), F.slice("all", at + 1, F.col("p") + r - at + 1).alias("w"))


def cue_windows(docs: DataFrame) -> DataFrame:
    """Windows around cue words, from which the training's negatives are taken."""
    rows = _paragraphs(docs, lambda t: _any([F.contains(t, F.lit(s)) for s in STEMS]))
    return _around(rows, F.array_compact(F.transform("all", lambda w, i: F.when(w.isin(*CUES), i))))


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, th, place (paragraph, from 0), at (first word), w: windows around every template pair and cue word, th the text's xxhash64.

    Only paragraphs that cannot confirm any template have none.
    """
    every = list(dict.fromkeys(p for _, t in TEMPLATES for p in _template_pairs(t)))
    rows = _paragraphs(docs, may_name)
    own = F.transform(_pairs(F.col("all")), lambda p: F.when(p.isin(*every), p))
    rows = rows.select("*", F.explode(F.array(own)).alias("own"))  # generated, so that it is computed once
    rows = rows.select("*", F.explode(F.array(F.array_distinct(F.array_compact("own")))).alias("held")).where(may_hold(F.col("held")))
    pairs = F.array_compact(F.transform("own", lambda p, i: F.when(p.isNotNull(), i)))
    return _around(rows, F.array_union(pairs, F.array_compact(F.transform("all", lambda w, i: F.when(w.isin(*CUES), i)))))


def _training(docs: DataFrame) -> DataFrame:
    """(w, y, fold) rows: varied notices, and near misses and windows of the corpus as the unknown class.

    Folds are dealt by form: each template and near miss stands in its pure form, cut, and in several surroundings, and a
    fifth of the forms of each (its pure one never) is fold 0, which is held out to fit the temperature. Of a paragraph
    that is like no notice one run of 40 words is taken, at a place that its hash names.
    """
    spark = docs.sparkSession
    # cut here: a filter above the limit would turn it into a sort of all texts
    lowest = cut(docs.where(F.col("text").isNotNull()).select("text", F.xxhash64("text").alias("h")).orderBy("h", "text").limit(NEGATIVES))
    blocks = F.split("text", BLANK)
    prose = lowest.select("h", words(F.element_at(blocks, (F.pmod("h", F.size(blocks)) + 1).cast("int"))).alias("w"))
    prose = prose.select("h", F.slice("w", (F.pmod("h", F.greatest(F.size("w") - 39, F.lit(1))) + 1).cast("int"), 40).alias("w"))
    hard = cue_windows(docs).select("w", F.xxhash64("w").alias("h")).where(_shares()["share"] <= UNLIKE)
    hard = hard.groupBy("h").agg(F.first("w").alias("w")).orderBy("h").limit(NEGATIVES).select("h", "w")
    negative = cut(prose.where(_shares()["share"] <= UNLIKE).unionByName(hard).where(F.size("w") > 0))
    around = [r["w"] for r in negative.orderBy("h", F.size("w")).limit(24).collect()]
    rows, y = [], {f: k for k, f in enumerate([UNKNOWN, *FAMILIES])}
    for k, (family, text) in enumerate([*TEMPLATES, *((UNKNOWN, t) for t in NEAR_MISSES)]):
        w = text.split()
        n = len(w)
        forms = [w, w[: max(4, n * 3 // 4)], w[: max(5, n // 2)] if n > 12 else w, w[1:], ["copyright", "2024"] + w, ["this", "document", "is"] + w]
        if family == UNKNOWN:
            forms = [w, ["copyright", "2024"] + w, ["this", "document", "is"] + w]
        for a in around:
            forms += [list(a[:10]) + w, w + list(a[-10:]), list(a[:20]) + w + list(a[-20:])]
        rows += [(f, y[family], 0 if j and (j + k) % 5 == 0 else 1) for j, f in enumerate(forms)]
    positive = spark.createDataFrame(rows, "w array<string>, y int, fold int")
    return positive.unionByName(negative.select("w", F.lit(0).alias("y"), F.pmod("h", F.lit(5)).cast("int").alias("fold")))


def fit(docs: DataFrame) -> tuple[LogisticRegressionModel, float]:
    """Classifier and temperature from (doc_id, text) rows of the corpus; null texts are left out, long ones give single windows."""
    rows = cut(_vector(_training(docs)).select("x", F.col("y").cast("double").alias("y"), "fold"))
    lr = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=2e-4, maxIter=20)
    first = lr.fit(rows.where("fold > 0"))
    held = first.transform(rows.where("fold = 0")).select("y", vector_to_array("rawPrediction").alias("z"))
    best = held.agg(*(F.avg(_loss(t)).alias(f"t{k}") for k, t in enumerate(TEMPERATURES))).first()
    temperature = min(zip((v if v is not None else 9e9 for v in best), TEMPERATURES, strict=True))[1]
    return lr.fit(rows), temperature


def _loss(t: float) -> Column:
    """Log loss of logits z divided by t."""
    top = F.array_max("z")
    total = F.aggregate("z", F.lit(0.0), lambda s, v: s + F.exp((v - top) / t))
    return F.log(total) - (F.get("z", F.col("y").cast("int")) - top) / t


TEMPERATURES = (0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0, 5.6, 8.0)


def _best(found: DataFrame) -> DataFrame:
    """Of hits that share words (first to last), one after the other, the one that is confirmed best, then the shortest, stays."""
    order = Window.partitionBy("doc_id", "th", "place").orderBy("first", "last", "family", "at", F.size("w"))
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("new", F.coalesce(F.col("first") > before, F.lit(True)).cast("int")).withColumn("group", F.sum("new").over(order))
    names = ["first", "last", "family", "probability", "overlap", "w"]
    best = F.max(F.struct("overlap", (F.col("first") - F.col("last")).alias("short"), "probability", F.struct(*names).alias("x"))).alias("b")
    return found.groupBy("doc_id", "th", "place", "group").agg(best).select("doc_id", "th", "place", *(f"b.x.{c}" for c in names))


def scan(docs: DataFrame) -> DataFrame:
    """One row per notice: doc_id, th, place (paragraph), first and last (words of it), family, probability, overlap, w (the window).

    th is xxhash64 of the text, which tells rows of one doc_id apart; rows equal in both are one. Null and
    empty texts have no notices. Of families that tie the one that is longer, then later in the alphabet counts.
    """
    slim = docs.select("doc_id", "text")
    model, temperature = fit(slim)
    found = model.transform(_vector(windows(slim))).where("prediction > 0")
    found = cut(found.select("doc_id", "th", "place", "at", "w", F.col("prediction").cast("int").alias("k"), vector_to_array("rawPrediction").alias("z")).distinct())
    p = 1 / F.aggregate("z", F.lit(0.0), lambda s, v: s + F.exp((v - F.array_max("z")) / temperature))
    family = F.element_at(F.array(*(F.lit(f) for f in FAMILIES)), F.col("k"))
    out = found.withColumn("family", family).withColumn("probability", p)
    out = out.withColumn("x", _shares(F.col("family"))).withColumn("overlap", F.col("x.share")).where((F.col("probability") >= MIN_PROBABILITY) & (F.col("overlap") >= MIN_OVERLAP))
    template = F.element_at(F.array(*(F.array(*map(F.lit, _template_pairs(t))) for _, t in TEMPLATES)), 1 - F.col("x.k"))
    hit = F.array_compact(F.transform(_pairs(F.col("w")), lambda pair, i: F.when(F.array_contains(F.col("template"), pair), i)))
    out = out.withColumn("template", template).withColumn("hit", hit)
    return _best(out.withColumn("first", F.col("at") + F.array_min("hit")).withColumn("last", F.col("at") + F.array_max("hit") + 1))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_licensed (notices), families (sorted), probability (highest, null without); one row per document row."""
    hits = scan(docs).groupBy("doc_id", "th").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"), F.max("probability").alias("probability")
    )
    hits = cut(hits.withColumnRenamed("doc_id", "i").withColumnRenamed("th", "g"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.when(F.col("text").isNotNull(), F.size(F.split("text", BLANK))).otherwise(0).cast("long").alias("n_paragraphs"))
    out = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("g")), "left")
    return out.select("doc_id", "n_paragraphs", F.coalesce("n", F.lit(0)).cast("long").alias("n_licensed"), F.coalesce("families", F.lit("")).alias("families"), "probability")
