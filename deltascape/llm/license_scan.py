"""License scans by ordered signature rules. DataFrame operations only.

Each family of licenses has a keyword, a name pattern and a label; five forms of wording turn it into rules, some
hundreds in all, in order of priority. A rule runs only on texts that hold its keyword, whatever white space stands
between the keyword's words. Names that are also those of programs and formats (php, ruby, json, ...) count only in texts
that name the license so ("php license", "php licence"): this is part of their rules. Where detections overlap, one
inside another of the same or a higher priority is dropped; what remains gives the labels and the score.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, select_present

#: The base phrases and their labels, fixed values.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
W = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
NOT_W = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Label, keyword and name pattern (of lower-case text; a space stands for any white space) of each family.
FAMILIES = (
    ("gpl", "general public", r"(?:gnu )?general public licen[sc]e"), ("gpl", "gpl", r"(?:gnu )?gpl"), ("gpl-2.0", "gpl-2", r"gpl-2(?:\.0)?(?:-only|-or-later|\+)?"),
    ("gpl-3.0", "gpl-3", r"gpl-3(?:\.0)?(?:-only|-or-later|\+)?"), ("lgpl", "lesser general", r"(?:gnu )?lesser general public licen[sc]e"), ("lgpl", "library general", r"(?:gnu )?library general public licen[sc]e"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl(?:-[0-9.]+)?(?:-only|-or-later|\+)?"), ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e"), ("agpl", "agpl", r"(?:gnu )?agpl(?:-[0-9.]+)?(?:-only|-or-later|\+)?"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[sc]e"), ("gfdl", "gfdl", r"(?:gnu )?gfdl(?:-[0-9.]+)?"), ("apache", "apache", r"apache(?: software)?(?: licen[sc]e)?"),
    ("apache-2.0", "apache-2", r"apache-2(?:\.0)?"), ("mit", "mit", r"(?:the )?mit(?:/expat| \(expat\))?"), ("mit", "expat", r"expat"), ("x11", "x11", r"x11"), ("bsd", "bsd", r"(?:new |modified |revised |simplified |original )?bsd"),
    ("bsd-2-clause", "clause", r"(?:bsd[- ]2|2|two)[- ]clause(?: bsd)?"), ("bsd-3-clause", "clause", r"(?:bsd[- ]3|3|three)[- ]clause(?: bsd)?"), ("bsd-4-clause", "clause", r"(?:bsd[- ]4|4|four)[- ]clause(?: bsd)?"), ("0bsd", "0bsd", r"0bsd"),
    ("isc", "isc", r"isc"), ("mpl", "mozilla", r"mozilla public licen[sc]e"), ("mpl", "mpl", r"mpl(?:-[0-9.]+)?"), ("epl", "eclipse", r"eclipse public licen[sc]e"), ("epl", "epl", r"epl(?:-[0-9.]+)?"),
    ("eclipse-distribution", "eclipse", r"eclipse distribution licen[sc]e"), ("cddl", "cddl", r"cddl(?:-[0-9.]+)?"), ("cddl", "development and distribution", r"common development and distribution licen[sc]e"),
    ("cpl", "common public", r"common public licen[sc]e"), ("ipl", "ibm public", r"ibm public licen[sc]e"), ("eupl", "eupl", r"eupl(?:-[0-9.]+)?"), ("eupl", "european union", r"european union public licen[sc]e"),
    ("artistic", "artistic", r"(?:the )?artistic"), ("perl", "same terms as perl", r"same terms as perl(?: itself)?"), ("zlib", "zlib", r"zlib(?:/libpng)?"), ("libpng", "libpng", r"libpng"), ("boost", "boost", r"boost(?: software)?(?: licen[sc]e)?"),
    ("boost", "bsl-1", r"bsl-1(?:\.0)?"), ("unlicense", "unlicense", r"(?:the )?unlicense"), ("wtfpl", "wtfpl", r"wtfpl"), ("wtfpl", "what the f", r"do what the f\S+ you want to public licen[sc]e"), ("psf", "python software", r"python software foundation"),
    ("psf", "psf", r"psf(?:-[0-9.]+)?"), ("php", "php licen", r"php"), ("ruby", "ruby licen", r"ruby"), ("openssl", "openssl", r"openssl"), ("ofl", "open font", r"(?:sil )?open font licen[sc]e"), ("ofl", "ofl", r"(?:sil )?ofl(?:-[0-9.]+)?"),
    ("ncsa", "ncsa", r"(?:university of illinois/)?ncsa(?: open source)?"), ("ms-pl", "microsoft public", r"microsoft public licen[sc]e"), ("ms-pl", "ms-pl", r"ms-pl"), ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[sc]e"),
    ("afl", "academic free", r"academic free licen[sc]e"), ("osl", "open software", r"open software licen[sc]e"), ("upl", "universal permissive", r"universal permissive licen[sc]e"), ("blueoak", "blue oak", r"blue oak model"),
    ("json", "json licen", r"json"), ("beerware", "beerware", r"beerware"), ("busl", "business source", r"business source licen[sc]e"), ("sspl", "server side public", r"server side public licen[sc]e"), ("sspl", "sspl", r"sspl(?:-[0-9.]+)?"),
    ("elastic", "elastic licen", r"elastic"), ("odbl", "odbl", r"odbl(?:-[0-9.]+)?"), ("odbl", "open database", r"open database licen[sc]e"), ("odc-by", "odc", r"odc[- ]by"), ("pddl", "pddl", r"pddl"), ("openrail", "openrail", r"(?:creativeml )?openrail(?:-\+?m)?"),
    ("cc0", "cc0", r"cc0(?:-[0-9.]+)?"), ("cc-by", "cc", r"cc[- ]by"), ("cc-by-sa", "cc", r"cc[- ]by[- ]sa"), ("cc-by-nd", "cc", r"cc[- ]by[- ]nd"), ("cc-by-nc", "cc", r"cc[- ]by[- ]nc"), ("cc-by-nc-sa", "cc", r"cc[- ]by[- ]nc[- ]sa"),
    ("cc-by-nc-nd", "cc", r"cc[- ]by[- ]nc[- ]nd"), ("cc-by", "creative commons", r"creative commons attribution"), ("cc-by-sa", "creative commons", r"creative commons attribution[- ]share[- ]?alike"),
    ("cc-by-nc", "creative commons", r"creative commons attribution[- ]non-?commercial"), ("cc-by-nc-sa", "creative commons", r"creative commons attribution[- ]non-?commercial[- ]share[- ]?alike"),
    ("cc-by-nd", "creative commons", r"creative commons attribution[- ]no[- ]?deriv(?:ative)?s"), ("cc0", "creative commons", r"creative commons zero"), ("cecill", "cecill", r"cecill(?:-[abc])?"), ("qpl", "q public", r"q public licen[sc]e"),
    ("unicode", "unicode licen", r"unicode"), ("vim", "vim licen", r"vim"), ("w3c", "w3c", r"w3c(?: software)?"), ("zpl", "zope", r"zope public licen[sc]e"), ("intel", "intel open source", r"intel open source"), ("curl", "curl licen", r"curl"),
    ("open-government", "open government", r"open government licen[sc]e"),
)
#: Pattern around a name, its own keyword, priority: a tag, a grant, a version, and the word license behind the name.
FORMS = (
    (r"spdx-licen[sc]e-identifier: *{name}(?:[-0-9.+a-z]*)", "spdx", 5),
    (r"(?:licen[sc]ed|released|distributed|available|published|provided|redistributed|covered) (?:to you )?under (?:the )?(?:terms of (?:the )?)?{name}(?: licen[sc]e)?(?:,? (?:version |v\.? ?)?[0-9]+(?:\.[0-9]+)*)?", "under", 4),
    (r"{name}(?: licen[sc]e)?,? version [0-9]+(?:\.[0-9]+)*", "version", 3),
    (r"{name} licen[sc]e", "licen", 2),
)
#: Whole patterns of their own: label, keyword, pattern, priority.
SINGLE = (
    ("public-domain", "public domain", r"(?:released|dedicated|placed|is) (?:in|into|to) the public domain", 3), ("public-domain", "public domain", r"public domain", 1), ("all-rights-reserved", "all rights reserved", r"all rights reserved", 2),
    ("proprietary", "proprietary", r"proprietary(?: and confidential| licen[sc]e| software)", 2), ("mit", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy", 4),
    ("isc", "permission to use, copy", r"permission to use, copy, modify, and(?:/or)? distribute this software", 4), ("bsd", "redistribution and use", r"redistribution and use in source and binary forms, with or without modification", 4),
    ("no-warranty", "without warrant", r"without warrant(?:y|ies)(?: or conditions)? of any kind", 1), ("cc", "creativecommons.org", r"creativecommons\.org/(?:licenses|publicdomain)/[a-z-]+(?:/[0-9.]+)?", 3), ("apache", "apache.org/licenses", r"apache\.org/licenses/[a-z]+-[0-9.]+", 3),
    ("gpl", "gnu.org/licenses", r"gnu\.org/licenses/[a-z0-9.-]+", 3), ("opensource", "opensource.org/licenses", r"opensource\.org/licenses/[a-z0-9.-]+", 3), ("gpl", "gpl", r"gpl", 1), ("gpl", "general public", r"gnu general public licen[sc]e", 1),
    ("lgpl", "lgpl", r"lgpl", 1), ("agpl", "agpl", r"agpl", 1), ("wtfpl", "wtfpl", r"wtfpl", 1), ("cc-by", "cc", r"cc[- ]by", 1), ("cc-by-nc", "cc", r"cc[- ]by[- ]nc", 1), ("cc-by-sa", "cc", r"cc[- ]by[- ]sa", 1), ("cc-by-nd", "cc", r"cc[- ]by[- ]nd", 1),
    ("cc0", "cc0", r"cc0", 1), ("mpl", "mozilla", r"mozilla public licen[sc]e", 1), ("copyleft", "copyleft", r"copyleft", 1),
)
#: A text without any of these has no detection: the forms' keywords, and those of the whole patterns.
GATE = tuple(sorted({own for _, own, _ in FORMS} | {keyword for _, keyword, *_ in SINGLE} - {"cc"} | {"cc by", "cc-by"}))
PRIORITIES = 5


def rules(spark: SparkSession) -> DataFrame:
    """The rules in order: rule, keyword and own (both must stand in a text), pattern, label, priority. A fixed table of some hundreds of rows."""
    # a name that ends in the word needs no second one
    filled = lambda form, name: form.replace("{name} licen[sc]e", "{name}") if name.endswith("licen[sc]e") else form
    found = [(keyword, own, filled(form, name).replace("{name}", f"(?:{name})"), label, priority) for form, own, priority in FORMS for label, keyword, name in FAMILIES]
    found += [(keyword, "", pattern, label, priority) for label, keyword, pattern, priority in SINGLE]
    spaced = lambda p: p.replace("[- ]", r"[-\s]").replace(" *", r"\s*").replace(" ?", r"\s?").replace(" ", r"\s+")
    rows = [(i, keyword, own, rf"(?i)(?<!{W}){spaced(p)}(?!{W})", label, n) for i, (keyword, own, p, label, n) in enumerate(found)]
    return spark.createDataFrame(rows, "rule int, keyword string, own string, pattern string, label string, priority int")


def phrase_pattern(phrase: str) -> str:
    return rf"(?<!{W}){f'{NOT_W}+'.join(phrase.split())}(?!{W})"


def folded(text: Column) -> Column:
    """text in lower case with each run of what the patterns take for white space as one space, to seek keywords in."""
    return F.regexp_replace(F.lower(text), r"[\s\x01\x02]{2,}|[\t\n\x0B\f\r\x01\x02]", " ")


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"{W}+")), F.lit(0)).cast("long")


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id and text are read): the base columns, labels and score, and found, the
    detections that stay: arrays of label, rule, start and end in code points.

    n_base counts the base phrases' places; first_word and last_word are the word numbers at which the first and last
    start, or null. A null or empty text has no words. The score is the highest priority that stays, as a share of the
    highest there is, and 0.5 at least with a base phrase. Rows that repeat an id each have a result; extra columns
    play no part; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text, small = F.coalesce(F.col("text"), F.lit("")), F.col("small")
    has = lambda k: F.contains(small, F.lit(k))
    rows = select_present(docs, "doc_id", "text").withColumn("row_uid", F.monotonically_increasing_id()).withColumn("small", folded(text))
    rows = rows.withColumn("gated", reduce(or_, [has(k) for k in GATE]))
    any_phrase = "(?:" + "|".join(phrase_pattern(p) for p, _ in PHRASES) + ")"
    # a phrase is sought where its rarest word stands
    counts = [F.when(has(max(p.split(), key=len)[:4]) & has(p.split()[0]), F.regexp_count(text, F.lit("(?i)" + phrase_pattern(p)))).otherwise(0) for p, _ in PHRASES]
    rows = rows.withColumn("n_words", words_in(text))
    for k, c in enumerate(counts):
        rows = rows.withColumn(f"n{k}", c.cast("long"))
    rows = rows.withColumn("n_base", sum((F.col(f"n{k}") for k in range(1, len(PHRASES))), F.col("n0")))
    rows = rows.withColumn("first_word", F.when(F.col("n_base") > 0, words_in(F.regexp_extract(text, f"(?is)^(.*?){any_phrase}", 1))))
    rows = rows.withColumn("last_word", F.when(F.col("n_base") > 0, words_in(F.regexp_extract(text, f"(?is)^(.*){any_phrase}", 1))))
    base = F.array_compact(F.array(*[F.when(F.col(f"n{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]))
    rows = rows.select("row_uid", "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_sort(base).alias("base"), F.when(F.col("gated"), F.translate(text, "\u0001\u0002", "  ")).alias("text"))
    rows = materialise(rows, "licenses")

    table = rules(spark)
    keywords = sorted({keyword for _, keyword, *_ in FAMILIES} | {keyword for _, keyword, *_ in SINGLE})
    held = F.array_compact(F.array(*[F.when(has(k), F.lit(k)) for k in keywords]))
    gated = rows.filter(F.col("text").isNotNull()).select("row_uid", "text", folded(F.col("text")).alias("small")).select("row_uid", "text", "small", F.explode(held).alias("keyword"))
    tried = gated.join(F.broadcast(table), (gated["keyword"] == table["keyword"]) & F.contains(gated["small"], table["own"]))
    # each detection between two marks; the lengths of the pieces give its place
    marked = F.regexp_replace(F.col("text"), F.col("pattern"), F.lit("\u0001$0\u0002"))
    pieces = tried.withColumn("marked", marked).filter(F.contains(F.col("marked"), F.lit("\u0001"))).select(
        "row_uid", "rule", "label", "priority", F.posexplode(F.transform(F.split("marked", "[\u0001\u0002]"), F.char_length)).alias("piece", "n")
    )
    before = Window.partitionBy("row_uid", "rule").orderBy("piece")
    spans = pieces.withColumn("end", F.sum("n").over(before)).filter(F.col("piece") % 2 == 1).withColumn("start", F.col("end") - F.col("n"))
    # one that holds another comes before it in this order
    order = Window.partitionBy("row_uid").orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.array(*[F.coalesce(F.max(F.when(F.col("priority") >= p, F.col("end"))).over(order), F.lit(-1).cast("long")) for p in range(1, PRIORITIES + 1)])
    kept = spans.withColumn("reach", reach).filter(F.element_at("reach", F.col("priority")) < F.col("end"))
    found = kept.groupBy("row_uid").agg(F.max("priority").alias("top"), F.array_sort(F.collect_list(F.struct("start", "end", "label", "rule"))).alias("found"))
    out = rows.drop("text").join(found, "row_uid", "left")
    own = F.coalesce(F.transform("found", lambda f: f["label"]), F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", own))), ",").alias("labels"),
        F.greatest(F.coalesce(F.col("top"), F.lit(0)) / F.lit(float(PRIORITIES)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"), "found",
    )
