"""Licence scans (DataFrame functions only): headers and licence files, then inheritance down the directory tree.

Statements are the lines of a text that speak of a licence (headers) and the whole text of such a file. Distinct
statements are compared once with every template by sparse TF-IDF cosine (IDF over all header lines of the corpus and
the templates). A file whose best header reaches ``header_least`` has its own licence; a file whose whole text reaches
``file_least`` is a licence file and covers its directory; a file without its own licence takes that of the nearest
ancestor directory that is covered.

Where no line reaches that, the first licence that an SPDX line names counts, or else the best of two to ``LINES``
adjoining lines (compared as one statement) and of the full texts and standard headers in ``licence_texts`` that the
file holds by its word shingles. A file that consists of such a text is a licence file too.

Defined results: null and empty texts have no statement, but inherit; a null path is a file at the root; of several
templates the most alike wins, ties go to the first name; of several licence files in a directory likewise; a file
is judged by its own text, whatever other rows have its id or path, and rows without an id too; repeated rows each get
their row; texts of any length count whole; only the three columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, read

# Short notices of well-known licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

#: What a line that speaks of a licence contains (lower case).
HINTS = ("licen", "copyright", "public domain", "spdx")

TOKEN = r"[a-z]+(?:-[a-z]+)*|[0-9]+(?:\.[0-9]+)*"


#: Words of a shingle of full texts; adjoining lines that are compared as one statement, at most.
SHINGLE, LINES = 5, 4


def full_texts() -> list[tuple[int, str, str]]:
    """``(number, licence, text)``: full licence texts and the standard headers of several lines, in lower case."""
    files = sorted((Path(__file__).resolve().parent / "licence_texts").glob("*.txt"))
    return [(i, f.name.removesuffix(".txt").removesuffix(".header"), f.read_text().lower()) for i, f in enumerate(files)]


def _hinted(text: Column) -> Column:
    out = F.lit(False)
    for hint in HINTS:
        out = out | F.contains(text, F.lit(hint))
    return out


def _terms(statements: DataFrame) -> DataFrame:
    """``(sid, term, tf)`` of distinct statements (sid, statement)."""
    words = F.regexp_extract_all("statement", F.lit(TOKEN), F.lit(0))
    return statements.select("sid", F.explode(words).alias("term")).groupBy("sid", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))


def statement_licences(lines: DataFrame, wholes: DataFrame) -> DataFrame:
    """``(sid, licence, cosine)``: the most alike template of every distinct statement (lower case).

    lines: ``(sid, statement, n)`` with n rows each, which also give the IDF; wholes: ``(sid, statement)``. sid stands
    for the statement, so that no term carries its text along.
    """
    spark = lines.sparkSession
    lines = cut(lines, "lines")
    templates = spark.createDataFrame([(name, text.lower()) for name, text in TEMPLATES], "sid string, statement string")
    known = cut(_terms(templates).withColumnRenamed("sid", "licence"), "templates")
    terms = cut(_terms(lines.select("sid", "statement").unionByName(wholes.select("sid", "statement")).dropDuplicates(["sid"])), "terms")
    seen = terms.join(lines.select("sid", "n"), "sid").select("term", "n").unionByName(known.select("term", F.lit(1).cast("long").alias("n")))
    total = lines.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all")).select((F.col("all") + len(TEMPLATES)).alias("all"))
    idf = cut(seen.groupBy("term").agg(F.sum("n").alias("df")).crossJoin(F.broadcast(total)).select("term", F.ln(1 + F.col("all") / F.col("df")).alias("idf")), "idf")
    rarest = F.ln(1 + F.col("all"))
    mine = terms.join(idf, "term", "left").crossJoin(F.broadcast(total)).select("sid", "term", (F.col("tf") * F.coalesce("idf", rarest)).alias("w"))
    theirs = known.join(idf, "term").select("licence", "term", (F.col("tf") * F.col("idf")).alias("v"))
    norms = theirs.groupBy("licence").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm_v"))
    lengths = mine.groupBy("sid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm_w"))
    # the templates are fixed values: a few hundred terms
    dots = mine.join(F.broadcast(theirs), "term").groupBy("sid", "licence").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cosine = dots.join(lengths, "sid").join(F.broadcast(norms), "licence").select("sid", "licence", F.round(F.col("dot") / F.col("norm_w") / F.col("norm_v"), 6).alias("cosine"))
    ordered = cosine.groupBy("sid").agg(F.max("cosine").alias("cosine"), F.min_by("licence", F.struct((-F.col("cosine")).alias("c"), "licence")).alias("licence"))
    return ordered.select("sid", "licence", "cosine")


def text_licences(wholes: DataFrame, block_least: float = 0.8) -> DataFrame:
    """``(sid, licence, held, covered)``: the licence whose text the statement (sid, statement) holds, wrapped in any way.

    held: the share of the licence's shingles that the statement has, ``block_least`` or more; covered: the share of
    the statement's own shingles, by place, that are of that text.
    """
    known = []
    for number, licence, text in full_texts():
        words = re.findall(TOKEN, text)
        every = {" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}
        known += [(number, licence, len(every), s) for s in sorted(every)]
    # fixed values: about ten thousand shingles
    known = cut(wholes.sparkSession.createDataFrame(known, "number int, licence string, size int, shingle string"), "texts")
    # written, so that words are taken apart once and not at every shingle
    words = cut(wholes.dropDuplicates(["sid"]).select("sid", F.regexp_extract_all("statement", F.lit(TOKEN), F.lit(0)).alias("words")), "words")
    starts = F.when(F.size("words") >= SHINGLE, F.sequence(F.lit(1), F.size("words") - SHINGLE + 1)).otherwise(F.array().cast("array<int>"))
    shingles = words.select("sid", F.transform(starts, lambda i: F.concat_ws(" ", *[F.get("words", i - 1 + k) for k in range(SHINGLE)])).alias("all"))
    mine = shingles.select("sid", F.size("all").alias("of"), F.explode("all").alias("shingle")).join(F.broadcast(known), "shingle")
    once = mine.groupBy("sid", "number", "licence", "size", "of", "shingle").agg(F.count(F.lit(1)).alias("places"))
    each = once.groupBy("sid", "number", "licence", "size", "of").agg(F.count(F.lit(1)).alias("n"), F.sum("places").alias("places"))
    each = each.where(F.col("n") >= block_least * F.col("size")).select("sid", "licence", F.round(F.col("n") / F.col("size"), 6).alias("held"), F.round(F.col("places") / F.col("of"), 6).alias("covered"))
    best = each.groupBy("sid").agg(F.min(F.struct((-F.col("covered")).alias("c"), (-F.col("held")).alias("h"), "licence")).alias("b"))
    return best.select("sid", "b.licence", (-F.col("b.h")).alias("held"), (-F.col("b.c")).alias("covered"))


def spdx_licence(text: Column) -> Column:
    """The first known licence that an SPDX line of the (lower case) text names."""
    names = {name.lower(): name for name, _ in TEMPLATES}
    known = "|".join(re.escape(n) for n in sorted(names))
    found = F.regexp_extract(text, rf"spdx-license-identifier:[^\n]*?(?<![\w.-])({known})(?:-only|-or-later|\+)?(?![\w.-])", 1)
    out = F.lit(None).cast("string")
    for low, name in names.items():
        out = F.when(found == low, name).otherwise(out)
    return out


def wrapped_lines(spoken: DataFrame) -> DataFrame:
    """``(file_id, path, statement)``: every two to LINES adjoining lines that speak of a licence, as one line."""
    lines = cut(spoken.select("file_id", "path", F.split("text", "\n").alias("lines")), "split")
    sizes = F.array(*[F.lit(k) for k in range(2, LINES + 1)])
    starts = F.sequence(F.lit(1), F.size("lines"))
    joined = F.flatten(F.transform(sizes, lambda k: F.transform(F.filter(starts, lambda i: i + k - 1 <= F.size("lines")), lambda i: F.concat_ws(" ", F.slice("lines", i, k)))))
    return lines.select("file_id", "path", F.explode(F.filter(joined, _hinted)).alias("statement"))


def scan(files: DataFrame, header_least: float = 0.8, file_least: float = 0.6) -> DataFrame:
    """Licences of files ``(file_id, path, text)``: one row each.

    Columns: file_id, path, licence, cosine (of the own header), is_file, inherited, from_dir.
    """
    # null ids are equal in a struct
    files = files.select(F.struct(F.col("file_id").alias("id"), F.xxhash64("text").alias("h")).alias("file_id"), "path", "text")
    path = F.coalesce("path", F.lit(""))
    low = F.lower(F.coalesce("text", F.lit("")))
    narrow = files.select("file_id", path.alias("path"), F.regexp_replace(path, r"[^/]*$", "").alias("dir"))
    spoken = files.select("file_id", path.alias("path"), low.alias("text")).where(_hinted(F.col("text")))
    spoken = cut(spoken, "spoken")
    sid = F.sha2(F.col("statement").cast("binary"), 256).alias("sid")
    per_file = spoken.select("file_id", "path", F.col("text").alias("statement"), F.lit(True).alias("whole"))
    per_line = spoken.select("file_id", "path", F.explode(F.split("text", "\n")).alias("statement"), F.lit(False).alias("whole")).where(_hinted(F.col("statement")))
    lines = per_line.select(sid, "statement").groupBy("sid").agg(F.first("statement").alias("statement"), F.count(F.lit(1)).alias("n"))
    licences = cut(statement_licences(lines, per_file.select(sid, "statement")), "licences")
    told = per_file.unionByName(per_line).select("file_id", "path", "whole", sid).join(licences, "sid")
    first = told.groupBy("file_id", "path").agg(
        F.max(F.when(~F.col("whole"), F.col("cosine"))).alias("cosine"),
        F.min(F.when(~F.col("whole") & (F.col("cosine") >= header_least), F.struct((-F.col("cosine")).alias("c"), "licence"))).alias("own"),
        F.min(F.when(F.col("whole") & (F.col("cosine") >= file_least), F.struct((-F.col("cosine")).alias("c"), "licence"))).alias("file"),
    )
    first = cut(first, "first")
    # where no line is a notice by itself: adjoining lines, SPDX lines and texts of several lines
    rest = cut(spoken.join(first.where("own is not null").select("file_id", "path"), ["file_id", "path"], "left_anti"), "rest")
    wrapped = cut(wrapped_lines(rest).select("file_id", "path", sid, "statement"), "wrapped")
    alike = statement_licences(lines, wrapped.select("sid", "statement")).where(F.col("cosine") >= header_least)
    score = lambda c: F.struct((-F.col(c)).alias("c"), "licence")
    blocks = wrapped.select("file_id", "path", "sid").join(alike, "sid").groupBy("file_id", "path").agg(F.min(score("cosine")).alias("block"))
    texts = text_licences(per_file.select(sid, "statement"))
    held = per_file.select("file_id", "path", sid).join(texts, "sid").groupBy("file_id", "path").agg(F.min(score("held")).alias("text"), F.min(F.when(F.col("covered") >= file_least, score("held"))).alias("text_file"))
    named = rest.select("file_id", "path", spdx_licence(F.col("text")).alias("licence")).where("licence is not null").groupBy("file_id", "path").agg(F.min(F.struct(F.lit(-1.0).alias("c"), "licence")).alias("spdx"))
    keys = ["file_id", "path"]
    first = spoken.select(*keys).distinct().join(first, keys, "left").join(named, keys, "left").join(blocks, keys, "left").join(held, keys, "left")
    other = F.coalesce("spdx", F.least("block", "text"))
    cosine = F.when(F.col("own").isNull() & other.isNotNull(), -other["c"]).otherwise(F.col("cosine"))
    first = first.select(*keys, cosine.alias("cosine"), F.coalesce("own", other).alias("own"), F.coalesce("text_file", "file").alias("file"))
    own = cut(first.select("file_id", "path", "cosine", F.col("own.licence").alias("licence"), "file"), "own")
    covers = own.where("file is not null").select(F.regexp_replace("path", r"[^/]*$", "").alias("from_dir"), "file").groupBy("from_dir").agg(F.min("file").alias("file")).select("from_dir", F.col("file.licence").alias("covered"))
    # the nearest covered ancestor, once per directory
    dirs = narrow.select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.concat(F.concat_ws("/", F.slice(parts, 1, i)), F.when(i > 0, "/").otherwise("")))
    nearest = dirs.select("dir", F.explode(F.array_distinct(above)).alias("from_dir")).join(covers, "from_dir").groupBy("dir").agg(F.max(F.struct(F.length("from_dir").alias("n"), "from_dir", "covered")).alias("got"))
    out = narrow.join(nearest.select("dir", "got.from_dir", "got.covered"), "dir", "left").join(own, ["file_id", "path"], "left")
    mine = F.col("licence").isNotNull()
    return out.select(F.col("file_id.id").alias("file_id"), "path", "licence", "cosine", F.col("file").isNotNull().alias("is_file"), F.when(~mine, F.col("covered")).alias("inherited"), F.when(~mine, F.col("from_dir")).alias("from_dir"))


def document_path(source: Column, doc_id: Column) -> Column:
    """The place of a document in a tree: source, ten thousands, thousands, id."""
    return F.concat_ws("/", F.coalesce(source, F.lit("none")), F.floor(doc_id / 10_000).cast("string"), F.floor(doc_id / 1000).cast("string"), doc_id.cast("string"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), document_path(F.col("source"), F.col("doc_id")).alias("path"), "text")
    return scan(docs).withColumnRenamed("file_id", "doc_id")
