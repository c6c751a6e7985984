"""License scans by diagonal voting: word grams that meet a template's grams vote for an offset, offsets become spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyfold.llm.common import ascii_lower, staged, text_of, within
from tallyfold.operators.labels import split_lookup
from tallyfold.operators.ranking import BROADCAST_ROWS

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases count wherever their words stand consecutively.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further phrases, and the words of public licence notices, which may be quoted with small changes: fixed values.
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd 2 clause license": "bsd",
    "bsd 3 clause license": "bsd",
    "creative commons zero": "cc0",
    "cc0 1 0 universal": "cc0",
}
NOTICES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
    "boost": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
    "epl": "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which accompanies this distribution",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
}
#: Words of a gram for phrases and for notices.
PHRASE_GRAM, NOTICE_GRAM = 2, 3
#: What a quoted notice may differ by, for a notice of W words and G grams.  A diagonal counts from max(2, G / WEAK) votes
#: on; diagonals up to max(NEAR, W / NEAR) apart belong to one span (so many words may be put in at one place); of the
#: grams max(MISSING, LOST of them) may be missing (a changed word costs three), yet LEAST_COVER must be there; the span may
#: be max(NEAR, W / 4) words longer than the notice.
NEAR, WEAK, MISSING, LOST, LEAST_COVER = 10, 50, 3, 0.3, 0.6
#: Up to so many different grams rolling grams are tried against a list of hashes; more are tried against a set of bits.
FEW_GRAMS = 10_000
#: Bits per template gram, and the most of all, in that set.
SET_BITS, MAX_SET_BITS = 256, 1 << 24


def templates(
    phrases: dict[str, str] | None = None, more_phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None
) -> list[tuple[int, str, bool, int, list[str]]]:
    """(number, label, base, words of a gram, words): base phrases, more phrases, notices."""
    made = [(label, True, PHRASE_GRAM, text) for text, label in (PHRASES if phrases is None else phrases).items()]
    made += [(label, False, PHRASE_GRAM, text) for text, label in (MORE_PHRASES if more_phrases is None else more_phrases).items()]
    made += [(label, False, NOTICE_GRAM, text) for label, text in (NOTICES if notices is None else notices).items()]
    return [(i, label, base, k, text.split()) for i, (label, base, k, text) in enumerate(made)]


def template_table(spark: SparkSession, known: list[tuple[int, str, bool, int, list[str]]] | None = None) -> DataFrame:
    """The templates as a table (template, label, base, k, words), the form in which catalogues of any size are taken."""
    return spark.createDataFrame(templates() if known is None else known, "template int, label string, base boolean, k int, words array<string>")


def license_texts(spark: SparkSession, path: str, first: int = 0) -> DataFrame:
    """Templates out of a folder of whole licence texts; a file's name without its ending is the label."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value"))
    number = F.row_number().over(Window.orderBy("name")) + F.lit(first - 1)  # one row per licence
    label = F.lower(F.regexp_replace("name", r"\.(txt|md)$", ""))
    return texts.select(number.alias("template"), label.alias("label"), F.lit(False).alias("base"), F.lit(NOTICE_GRAM).alias("k"), words_of(F.col("value")).alias("words"))


def template_grams(known: DataFrame) -> DataFrame:
    """(gram, places): one row per different gram of the templates, with all its places in them; a stored table.

    Words hold no spaces, so a gram's text tells its number of words.  Templates shorter than a gram have none.
    """
    k = F.col("k")
    starts = F.when(F.size("words") >= k, F.sequence(F.lit(0), F.size("words") - k)).otherwise(F.array().cast("array<int>"))
    grams = known.withColumn("tpos", F.explode(starts)).withColumn("gram", F.concat_ws(" ", F.slice("words", F.col("tpos") + 1, k)))
    place = F.struct("template", "label", "base", "k", (F.size("words") - k + 1).alias("grams"), "tpos")
    return staged(grams.groupBy("gram").agg(F.collect_list(place).alias("places")), "grams")


def gram_set(grams: DataFrame, n: int) -> dict[int, Column]:
    """Per number of words a test of a gram's hash that every template gram passes, and of others about one in ``SET_BITS``.

    Of few grams the hashes themselves are constants, which is faster to test.  Otherwise the set is a constant of at most ``MAX_SET_BITS`` bits (2 MB); beyond the size it is made for more grams pass, and
    the join with the templates sorts them out.
    """
    if n <= FEW_GRAMS:
        hashes: dict[int, list[int]] = {}
        for k, h in grams.select(F.explode(F.array_distinct("places.k")), F.xxhash64("gram")).collect():  # few
            hashes.setdefault(k, []).append(h)
        among = lambda wanted: lambda gram: F.xxhash64(gram).isin(wanted)
        return {k: among(wanted) for k, wanted in hashes.items()}
    bits = 64
    while bits < MAX_SET_BITS and bits < SET_BITS * n:
        bits *= 2
    place = F.pmod(F.xxhash64("gram"), F.lit(bits))
    word = F.shiftright(place, 6).cast("int").alias("word")
    # a shift by the whole place acts modulo 64
    found = grams.select(F.explode(F.array_distinct("places.k")).alias("k"), word, place.cast("int").alias("at"))
    found = found.groupBy("k", "word").agg(F.bit_or(F.expr("shiftleft(1L, at & 63)")).alias("bits")).collect()  # at most bits / 64 each
    words = {k: [0] * (bits // 64) for k in {r["k"] for r in found}}
    for r in found:
        words[r["k"]][r["word"]] = r["bits"]

    def test(held: list[int]):
        constant = F.expr(f"cast(split('{','.join(map(str, held))}', ',') as array<bigint>)")

        def has(h: Column) -> Column:
            at = F.pmod(h, F.lit(bits))
            return F.getbit(F.get(constant, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1

        return lambda gram: F.exists(F.array(F.xxhash64(gram)), has)

    return {k: test(held) for k, held in words.items()}


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def _gram(words: Column, at: Column, k: int) -> Column:
    return F.concat_ws(" ", *[F.get(words, at + j) for j in range(k)])


def license_votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list | DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs`` and diagonal with a vote (one without a template for rows without votes):
    row, doc_id, n_words, template, label, base, k, grams, diagonal, votes, tset, first_pos, last_pos.

    All rolling grams of a text are tried against a set of the templates' gram hashes; those that pass are joined, as
    text, to the places the gram has in the templates.  A diagonal is the offset between text and template, and ``tset``
    the places of the template that vote for it.  ``known`` is a list as :func:`templates` has it, or a table as
    :func:`template_table` makes it, of any size: up to ``BROADCAST_ROWS`` different grams are broadcast, more are looked
    up by shuffle, but for the hot ones.
    """
    known = known if isinstance(known, DataFrame) else template_table(docs.sparkSession, known)
    grams = template_grams(known)
    n = grams.count()
    tests = gram_set(grams, n)

    def found(words: Column, k: int) -> Column:
        places = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
        here = F.filter(places, lambda at: tests[k](_gram(words, at, k)))
        return F.transform(here, lambda at: F.struct(at.alias("pos"), _gram(words, at, k).alias("gram")))

    def hits(words: Column) -> Column:
        """Places of grams that some template may have, with the gram."""
        none = F.array().cast("array<struct<pos:int,gram:string>>")
        return F.struct(F.size(words).cast("bigint").alias("n_words"), F.concat(none, *[found(words, k) for k in sorted(tests)]).alias("hits"))

    # the row's own number keeps rows apart that repeat an id; it lives within this job, or in the stored table
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), within(words_of(text_of(text_col)), hits).alias("s"))
    rows = rows.select("row", "doc_id", "s.n_words", F.explode_outer("s.hits").alias("hit")).select("row", "doc_id", "n_words", "hit.*")
    named = grams.withColumnRenamed("gram", "tgram")
    if n <= BROADCAST_ROWS:
        met = rows.join(F.broadcast(named), F.col("gram") == F.col("tgram"), "left")
    else:
        met = split_lookup(staged(rows, "hits"), "gram", named, "tgram")
    voted = met.select("row", "doc_id", "n_words", "pos", F.explode_outer("places").alias("at")).select("row", "doc_id", "n_words", "pos", "at.*")
    voted = voted.withColumn("diagonal", F.col("pos") - F.col("tpos"))
    # one exchange, by row: what follows is all within a row
    return voted.repartition(F.col("row")).groupBy("row", "doc_id", "n_words", "template", "label", "base", "k", "grams", "diagonal").agg(
        F.count("*").alias("votes"), F.collect_list("tpos").alias("tset"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")
    )


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list | DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, n_words, spans (label, base, first, last, cover; places in words).

    A phrase is verified on a diagonal that all its grams vote for.  Of a notice, neighbouring diagonals merge into one
    span (words were put in or left out there), verified if enough different grams of the notice are there and the span is
    not much longer than it; what that means grows with the notice, see ``NEAR``.  Null and empty texts have no words and
    no spans; texts shorter than a gram have no spans; repeated rows give repeated rows; an empty table gives an empty
    result, and so do no templates; other columns are ignored.
    """
    votes = license_votes(docs, id_col, text_col, known)
    phrase = F.col("k") == PHRASE_GRAM
    strong = phrase | (F.col("votes") >= F.greatest(F.lit(2), F.expr(f"grams div {WEAK}")))
    # weak diagonals stay as rows without a template, so that no row of docs is lost
    votes = votes.withColumn("template", F.when(strong, F.col("template")))
    size = F.expr("grams + k - 1")
    by_template = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(by_template) > F.greatest(F.lit(NEAR), F.expr(f"(grams + k - 1) div {NEAR}"))
    merged = votes.withColumn("new", (phrase | F.coalesce(apart, F.lit(True))).cast("int"))
    merged = merged.withColumn("span", F.sum("new").over(by_template.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = merged.groupBy("row", "doc_id", "n_words", "template", "label", "base", "k", "grams", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("tset")))).alias("there"), F.min("first_pos").alias("first"), (F.max("last_pos") + F.max("k") - 1).alias("last")
    )
    cover = F.col("there") / F.col("grams")
    missing = F.col("grams") - F.col("there")
    length = F.col("last") - F.col("first") + 1
    notice = (missing <= F.greatest(F.lit(float(MISSING)), F.col("grams") * LOST)) & (cover >= LEAST_COVER) & (length <= size + F.greatest(F.lit(NEAR), F.expr("(grams + k - 1) div 4")))
    good = F.col("template").isNotNull() & F.when(phrase, missing == 0).otherwise(notice)
    span = F.when(good, F.struct("label", "base", "first", "last", cover.alias("cover")))
    return spans.groupBy("row", "doc_id", "n_words").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list | DataFrame | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for every row of ``docs``; see
    :func:`license_spans`.  score is the best cover of a verified span, 0 without one."""
    rows = license_spans(docs, id_col, text_col, known)
    base = F.filter("spans", lambda s: s["base"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["first"].cast("bigint"))
    return rows.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"),
        "spans",
    )
