"""Licence mentions: ordered signature rules behind keyword gates, overlaps resolved by containment. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.llm.common import id_and_text, let
from turnledger.llm.spans import RUN, find_spans, place_spans

# Fixed phrases of the base search and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Families: label, gate keyword, the name as a pattern, identifiers as a pattern, address as a pattern.
FAMILIES = (
    ("apache-2.0", "apache", r"apache(?: software)? licen[cs]e,?(?: version)? ?2(?:\.0)?", r"apache-2\.0", r"apache\.org/licenses/license-2\.0"),
    ("apache", "apache", r"apache(?: software)? licen[cs]e", r"apache-1\.[01]", r"apache\.org/licenses"),
    ("mit", "mit", r"mit(?: open source)? licen[cs]e", r"mit", r"opensource\.org/licenses/mit"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", r"agpl-[13]\.0(?:-only|-or-later)?", r"gnu\.org/licenses/agpl"),
    ("lgpl", "lesser", r"(?:gnu )?(?:lesser|library) general public licen[cs]e", r"lgpl-(?:2\.[01]|3\.0)(?:-only|-or-later)?", r"gnu\.org/licenses/lgpl"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[cs]e,?(?: as published by [^.]{0,60}[,;])?(?: either)? (?:version|v\.?) ?3(?:\.0)?", r"gpl-3\.0(?:-only|-or-later)?", r"gnu\.org/licenses/gpl-3"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[cs]e,?(?: as published by [^.]{0,60}[,;])?(?: either)? (?:version|v\.?) ?2(?:\.0)?", r"gpl-2\.0(?:-only|-or-later)?", r"gnu\.org/licenses/gpl-2|gnu\.org/licenses/old-licenses/gpl-2"),
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e", r"gpl-1\.0(?:-only|-or-later)?", r"gnu\.org/licenses/gpl"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[cs]e", r"gfdl-1\.[123](?:-only|-or-later)?", r"gnu\.org/licenses/fdl"),
    ("bsd-3-clause", "bsd", r"(?:3|three)[- ]clause bsd|(?:modified|new|revised) bsd licen[cs]e", r"bsd-3-clause", r"opensource\.org/licenses/bsd-3-clause"),
    ("bsd-2-clause", "bsd", r"(?:2|two)[- ]clause bsd|(?:simplified|freebsd) bsd licen[cs]e", r"bsd-2-clause", r"opensource\.org/licenses/bsd-2-clause"),
    ("bsd", "bsd", r"bsd[- ]?(?:style )?licen[cs]e", r"bsd-4-clause", r"opensource\.org/licenses/bsd"),
    ("0bsd", "bsd", r"zero[- ]clause bsd(?: licen[cs]e)?", r"0bsd", r"opensource\.org/licenses/0bsd"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e(?:,? (?:version|v\.?) ?[12]\.[01])?", r"mpl-[12]\.[01]", r"mozilla\.org/(?:en-us/)?mpl"),
    ("epl", "eclipse", r"eclipse public licen[cs]e(?:,? (?:version|v\.?) ?[12]\.0)?", r"epl-[12]\.0", r"eclipse\.org/legal/epl"),
    ("edl", "eclipse", r"eclipse distribution licen[cs]e", r"edl-1\.0", r"eclipse\.org/org/documents/edl"),
    ("cddl", "common development", r"common development and distribution licen[cs]e", r"cddl-1\.[01]", r"opensource\.org/licenses/cddl"),
    ("cpl", "common public", r"common public licen[cs]e", r"cpl-1\.0", r"opensource\.org/licenses/cpl"),
    ("isc", "isc", r"isc licen[cs]e", r"isc", r"opensource\.org/licenses/isc"),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[cs]e", r"zlib", r"opensource\.org/licenses/zlib"),
    ("artistic", "artistic", r"artistic licen[cs]e(?:,? (?:version|v\.?)? ?[12]\.0)?", r"artistic-[12]\.0", r"opensource\.org/licenses/artistic"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e", r"bsl-1\.0", r"boost\.org/license_1_0"),
    ("unlicense", "unlicense", r"the unlicense", r"unlicense", r"unlicense\.org"),
    ("wtfpl", "what the", r"do what the [a-z*]+ you want to public licen[cs]e", r"wtfpl", r"wtfpl\.net"),
    ("psf", "python software", r"python software foundation licen[cs]e", r"psf-2\.0|python-2\.0", r"docs\.python\.org/[0-9./]*license"),
    ("php", "php", r"php licen[cs]e", r"php-3\.0[01]?", r"php\.net/license"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[cs]e", r"ofl-1\.[01]", r"scripts\.sil\.org/ofl"),
    ("eupl", "european union public", r"european union public licen[cs]e", r"eupl-1\.[012]", r"joinup\.ec\.europa\.eu/[a-z/]*eupl"),
    ("odbl", "open database", r"open database licen[cs]e", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", "open data commons", r"open data commons attribution licen[cs]e", r"odc-by-1\.0", r"opendatacommons\.org/licenses/by"),
    ("pddl", "public domain dedication", r"public domain dedication and licen[cs]e", r"pddl-1\.0", r"opendatacommons\.org/licenses/pddl"),
    ("ms-pl", "microsoft public", r"microsoft public licen[cs]e", r"ms-pl", r"opensource\.org/licenses/ms-pl"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e", r"ms-rl", r"opensource\.org/licenses/ms-rl"),
    ("osl", "open software", r"open software licen[cs]e", r"osl-[123]\.[01]", r"opensource\.org/licenses/osl"),
    ("afl", "academic free", r"academic free licen[cs]e", r"afl-[123]\.[012]", r"opensource\.org/licenses/afl"),
    ("ecl", "educational community", r"educational community licen[cs]e", r"ecl-[12]\.0", r"opensource\.org/licenses/ecl"),
    ("upl", "universal permissive", r"universal permissive licen[cs]e", r"upl-1\.0", r"opensource\.org/licenses/upl"),
    ("ncsa", "ncsa", r"(?:university of illinois/)?ncsa open source licen[cs]e", r"ncsa", r"opensource\.org/licenses/ncsa"),
    ("sspl", "server side", r"server side public licen[cs]e", r"sspl-1\.0", r"mongodb\.com/licensing/server-side"),
    ("busl", "business source", r"business source licen[cs]e", r"busl-1\.1", r"mariadb\.com/bsl"),
    ("openssl", "openssl", r"openssl licen[cs]e", r"openssl", r"openssl\.org/source/license"),
    ("tcl", "tcl", r"tcl/tk licen[cs]e", r"tcl", r"tcl\.tk/software/tcltk/license"),
    ("vim", "vim", r"vim licen[cs]e", r"vim", r"vimhelp\.org/uganda"),
    ("ruby", "ruby", r"ruby licen[cs]e", r"ruby", r"ruby-lang\.org/[a-z/]*license"),
    ("curl", "curl", r"curl licen[cs]e", r"curl", r"curl\.se/docs/copyright"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", r"postgresql", r"postgresql\.org/about/licen[cs]e"),
    ("beerware", "beer", r"beer-?ware licen[cs]e", r"beerware", r"people\.freebsd\.org/~phk"),
)
# Attribution licences: one family per combination of terms, from most to least terms.
_TERMS = ("by-nc-sa", "by-nc-nd", "by-nc", "by-sa", "by-nd", "by")
_WORDS = {"by": "attribution", "nc": "non-?commercial", "sa": "share-?alike", "nd": "no-?deriv(?:ative)?s?"}
# Sentences of licence texts: label, gate keyword, pattern.
TEXTS = (
    ("mit", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms"),
    ("isc", "permission to use, copy", r"permission to use, copy, modify, and/?(?: ?or)? distribute this software for any purpose"),
    ("public-domain", "public domain", r"(?:dedicated to|released into|placed in|in) the public domain"),
    ("cc0", "cc0", r"\bcc0(?:[ -]1\.0)?(?: universal)?"),
    ("zlib", "provided 'as-is'", r"this software is provided 'as-is', without any express or implied warranty"),
    ("all-rights-reserved", "all rights reserved", r"all rights reserved"),
)
_ROOTS = ("licen", "spdx", "permission is hereby", "permission to use", "redistribution and use", "public domain", "creative commons",
          "creativecommons", "cc by", "cc-by", "cc0", "provided 'as-is'", "all rights reserved", ".org/", ".net/", ".com/", ".eu/", ".se/",
          ".tk/", "unlicense.org", "wtfpl.net", "gpl", "clause bsd")


# A whole licence expression, brackets included, and the identifiers in it.
SPDX = r"(?i)spdx-license-identifier:[\s(]*+[a-z0-9.+-]++(?:[ \t)]++(?:or|and|with)[\s(#*/;%!|]++[a-z0-9.+-]++)*+"
_IDENTIFIER = r"(?i)[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?"

# A space of a pattern: white space, over line ends with the comment marks that may follow.
_MARKS = r"\s*#/;%!|>-"
_GAP = rf"(?:\s[{_MARKS}]*)"


@dataclass(frozen=True)
class Signature:
    label: str
    keyword: str
    pattern: str
    priority: int
    score: float


def _spaced(pattern: str) -> str:
    """The pattern with a gap for every space, so that a mention may break over lines."""
    pattern = pattern.replace("[- ]+", f"[{_MARKS}]+")
    for either in ("[- ]", "[ -]"):
        pattern = pattern.replace(either, f"(?:-|{_GAP})")
    return pattern.replace(" ", _GAP)


def squeezed(lowered: Column) -> Column:
    """The text with one space for every gap; keywords are sought in it."""
    return F.regexp_replace(lowered, rf"\s[{_MARKS}]*+", " ")


def families() -> list[tuple[str, str, str, str, str]]:
    """The listed families and those of the attribution licences."""
    made = []
    for terms in _TERMS:
        spelled = "[- ]+".join(_WORDS[t] for t in terms.split("-"))
        made.append((f"cc-{terms}", "creative", rf"creative commons {spelled}(?: [0-9.]+)?(?: international| generic| unported)?(?: licen[cs]e)?",
                     rf"cc-{terms}-[0-9]\.[0-9]", rf"creativecommons\.org/licenses/{terms}/"))
    return [*FAMILIES, *made]


def signatures() -> list[Signature]:
    """All rules in order; the forms of a family are made from its patterns. The more a form says, the higher it ranks."""
    rules = [Signature(label, keyword, pattern, 60, 0.9) for label, keyword, pattern in TEXTS]
    for terms in _TERMS:
        short = terms.replace("-", "[- ]")
        rules += [Signature(f"cc-{terms}", gate, rf"\bcc[- ]{short}(?![- ]?(?:nc|sa|nd)\b)\b(?:[- ][0-9]\.[0-9])?", 30 + len(terms), 0.8)
                  for gate in ("cc by", "cc-by")]
        rules += [Signature(f"cc-{terms}", gate, rf"licen[cs]ed under (?:a |the )?cc[- ]{short}(?![- ]?(?:nc|sa|nd)\b)\b(?:[- ][0-9]\.[0-9])?", 70, 1.0)
                  for gate in ("cc by", "cc-by")]
    for label, keyword, name, _, address in families():
        rules += [
            Signature(label, keyword, rf"licen[cs]ed under (?:the (?:terms of )?(?:the )?|an? )?(?:{name})", 80, 1.0),
            Signature(label, keyword, rf"(?:released|distributed|available|published|provided) under (?:the (?:terms (?:and conditions )?of )?(?:the )?|an? )?(?:{name})", 75, 1.0),
            Signature(label, keyword, rf"(?:terms|conditions|copy) of (?:the )?(?:{name})", 65, 0.9),
            Signature(label, keyword, rf"\b(?:{name})", 40, 0.8),
            Signature(label, "://", rf"https?://(?:www\.|choosealicense\.)?(?:{address})", 50, 0.9)]
    return [replace(r, pattern=_spaced(r.pattern)) for r in rules]


def identifiers(text: Column, lowered: Column) -> Column:
    """``array<struct<start, end, label>>``: every known identifier of every licence expression, at its own place."""
    def labels_of(found: Column) -> Column:
        return F.array_compact(F.array(*[F.when(F.rlike(found, F.lit(f"(?i)^(?:{identifier})$")), F.lit(label)) for label, _, _, identifier, _ in families()]))

    def named(expression: Column) -> Column:
        return F.flatten(F.transform(find_spans(expression["found"], _IDENTIFIER), lambda s: F.transform(
            labels_of(s["found"]), lambda label: F.struct((expression["start"] + s["start"]).alias("start"),
                                                          (expression["start"] + s["end"]).alias("end"), label.alias("label")))))

    none = F.array().cast("array<struct<start: bigint, end: bigint, label: string>>")
    return F.when(F.contains(lowered, F.lit("spdx")), F.flatten(F.transform(find_spans(text, SPDX), named))).otherwise(none)


def _matches(text: Column, keywords: Column, rules: list[Signature]) -> Column:
    """Rules that match with what they match. Each has a pattern of its own in the plan, so that it is compiled once for a task."""
    return F.filter(F.array(*[F.struct(
        F.lit(i).alias("place"), F.lit(r.label).alias("label"), F.lit("(?i)" + r.pattern).alias("pattern"), F.lit(r.priority).alias("priority"),
        F.lit(r.score).alias("score"), F.when(F.contains(keywords, F.lit(r.keyword)), F.regexp_extract_all(
            text, F.lit("(?i)" + r.pattern), F.lit(0))).alias("found")) for i, r in enumerate(rules)]), lambda m: F.size(m["found"]) > 0)


def unhidden(found: Column, priorities: list[int]) -> Column:
    """Detections outside every interval that ranks higher, by one sweep.

    In the order start, longest, highest priority, first rule, whatever can hide a detection stands before it. The
    sweep carries the furthest end so far for each priority, so a detection costs the number of priorities and not
    the number of detections. Results are gathered run by run, which keeps appending cheap.
    """
    ranks = sorted(set(priorities))
    kept_type = "array<struct<start: bigint, backwards: bigint, below: int, place: int, end: bigint, priority: int, label: string, score: double>>"
    ordered = F.array_sort(F.transform(found, lambda d: F.struct(
        d["start"].alias("start"), (-d["end"]).alias("backwards"), (-d["priority"]).alias("below"), d["place"].alias("place"),
        d["end"].alias("end"), d["priority"].alias("priority"), d["label"].alias("label"), d["score"].alias("score"))))
    listed = F.array(*[F.lit(p) for p in ranks])

    def take(state: Column, d: Column) -> Column:
        hidden = F.exists(F.zip_with(listed, state["ends"], lambda p, end: (p >= d["priority"]) & (end >= d["end"])), lambda h: h)
        ends = F.zip_with(listed, state["ends"], lambda p, end: F.when(p == d["priority"], F.greatest(end, d["end"])).otherwise(end))
        return F.struct(ends.alias("ends"), F.when(hidden, state["kept"]).otherwise(F.concat(state["kept"], F.array(d))).alias("kept"))

    def sweep(items: Column) -> Column:
        start = F.struct(F.array(*[F.lit(-1).cast("long") for _ in ranks]).alias("ends"), F.array().cast(f"array<{kept_type}>").alias("runs"))

        def run(state: Column, b: Column) -> Column:
            inner = F.aggregate(F.slice(items, b * RUN + 1, RUN), F.struct(state["ends"].alias("ends"), F.array().cast(kept_type).alias("kept")), take)
            return let(inner, lambda done: F.struct(done["ends"].alias("ends"), F.concat(state["runs"], F.array(done["kept"])).alias("runs")))

        return F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / RUN).cast("int")), start, run, lambda state: state["runs"]))

    return F.transform(let(ordered, lambda items: F.when(F.size(items) > 0, sweep(items)).otherwise(F.array().cast(kept_type))), lambda d: F.struct(
        *[d[c].alias(c) for c in ("start", "end", "priority", "place", "label", "score")]))


def detections(text: Column, keywords: Column, rules: list[Signature]) -> Column:
    """What the rules find in a text: only rules whose keyword occurs in ``keywords`` (the squeezed text) are tried, and a detection inside the interval of
    one that ranks higher (priority, then length, then order of the rules) is dropped."""
    found = F.flatten(F.transform(_matches(text, keywords, rules), lambda r: F.transform(place_spans(text, r["pattern"], r["found"]), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), r["priority"].alias("priority"), r["place"].alias("place"),
        r["label"].alias("label"), r["score"].alias("score")))))
    return unhidden(found, [r.priority for r in rules])


def base_places(lowered: Column) -> Column:
    """``array<struct<at, label>>``: word numbers at which a fixed phrase starts."""
    words = F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), lambda w: w != "")

    def starts_of(listed: Column, phrase: str, label: str) -> Column:
        def here(i: Column) -> Column:
            test = F.lit(True)
            for k, part in enumerate(phrase.split()):
                test = test & F.coalesce(F.get(listed, i + k) == part, F.lit(False))
            return test

        found = F.filter(F.sequence(F.lit(0), F.size(listed) - 1), here)
        return F.transform(found, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))

    def places(listed: Column) -> Column:
        return F.concat(*[starts_of(listed, phrase, label) for phrase, label in PHRASES.items()])

    none = F.array().cast("array<struct<at: bigint, label: string>>")
    gate = (F.contains(lowered, F.lit("license")) & (F.contains(lowered, F.lit("gnu")) | F.contains(lowered, F.lit("apache")) | F.contains(
        lowered, F.lit("mit")))) | (F.contains(lowered, F.lit("cc")) & F.contains(lowered, F.lit("by")))
    return F.when(gate, let(words, lambda w: F.when(F.size(w) > 0, places(w)).otherwise(none))).otherwise(none)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: fixed phrases by word, detections of the rules, and the labels of both.

    ``n_words`` counts words of the whole text. ``base`` holds word numbers and labels of the fixed phrases,
    ``detections`` the intervals that remain after suppression, ``spdx`` every identifier of a licence expression;
    ``score`` is 1 with such an identifier, else the highest score of a detection, 0.5 for a text with fixed phrases
    only, else 0.

    All work is local to a row: no shuffle, and no row is dropped. A null text counts as empty and gives zeros, nulls
    and empty labels. Null keys and repeated rows are kept. Other columns are left out.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("lowered", F.lower("text")).withColumn("keywords", squeezed(F.col("lowered")))
    gate = F.lit(False)
    for root in _ROOTS:
        gate = gate | F.contains(F.col("keywords"), F.lit(root))
    none = F.array().cast("array<struct<start: bigint, end: bigint, priority: int, place: int, label: string, score: double>>")
    rows = rows.select(
        "doc_id", F.size(F.array_remove(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++", -1), "")).cast("long").alias("n_words"),
        base_places(F.col("lowered")).alias("base"), identifiers(F.col("text"), F.col("lowered")).alias("spdx"),
        F.when(gate, detections(F.col("text"), F.col("keywords"), signatures())).otherwise(none).alias("detections"))
    own = F.transform("base", lambda p: p["label"])
    return rows.select(
        "doc_id", "n_words", "base", "detections", "spdx", F.array_sort(F.array_distinct(own)).alias("base_labels"),
        F.array_sort(F.array_distinct(F.concat(own, *[F.transform(c, lambda d: d["label"]) for c in ("detections", "spdx")]))).alias("labels"),
        F.when(F.size("spdx") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("detections", lambda d: d["score"])), F.when(F.size("base") > 0, 0.5).otherwise(0.0))).alias("score"))
