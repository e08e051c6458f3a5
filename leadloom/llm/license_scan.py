"""Licence scans by sentence rules.

A text is cut into sentences, which are normalised and mapped to identifiers
of known licence sentences; the sequence of identifiers is matched against
ordered licence rules, and what a rule has matched is used up (the method of
sentence-based licence identification, German, Manabe and Inoue 2010).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNDER = r"(licensed|released|distributed|available|provided|published|covered|shared|made available|is|are) under (a |an |the )?(terms of |terms and conditions of |conditions of )*(the |a |an )?"

#: (identifier, pattern on the normalised sentence); of those that fit at one place the first counts.
#: ``{}`` in an identifier stands for the first group of the pattern.
SENTENCES = (
    ("spdx:{}", r"spdx-license-identifier ([a-z0-9.+-]*[a-z0-9+])"),
    ("mitPermit", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mitNotice", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("asIs", r"the software is provided as is without warranty of any kind"),
    ("iscPermit", r"permission to use copy modify (and or|and) distribute this software for any purpose with or without fee is hereby granted"),
    ("bsdRedist", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsdSource", r"redistributions of source code must retain the above copyright notice"),
    ("bsdBinary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsdAdvert", r"all advertising materials mentioning features or use of this software"),
    ("bsdEndorse", r"neither the names? of .{1,300}? (may|nor)"),
    ("bsdAsIs", r"this software is provided by .{1,300}? as is and any express or implied warranties"),
    ("apacheUse", r"you may not use this (file|work) except in compliance with the license"),
    ("apacheCopy", r"you may obtain a copy of the license at"),
    ("apacheAsIs", r"software distributed under the license is distributed on an as is basis"),
    ("Apache-2.0", UNDER + r"apache (software )?license (version |v)?2(\.0)?"),
    ("Apache-1.1", UNDER + r"apache (software )?license (version |v)?1\.1"),
    ("AGPL-{}", r"gnu affero general public license (?:as published by the free software foundation )?(?:either )?(?:version |v)([0-9.]*[0-9])"),
    ("agplAny", r"gnu affero general public license"),
    ("LGPL-{}", r"gnu (?:lesser|library) general public license (?:as published by the free software foundation )?(?:either )?(?:version |v)([0-9.]*[0-9])"),
    ("lgplAny", r"gnu (lesser|library) general public license"),
    ("GPL-{}", r"gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version |v)([0-9.]*[0-9])"),
    ("gplCopy", r"you should have received a copy of the gnu general public license"),
    ("gplNoWarranty", r"this program is distributed in the hope that it will be useful but without any warranty"),
    ("gplAny", r"gnu general public license"),
    ("orLater", r"any later version"),
    ("MPL-{}", r"mozilla public license (?:version |v\.? ?)([0-9.]*[0-9])"),
    ("EPL-{}", r"eclipse public license (?:version |v\.? ?)([0-9.]*[0-9])"),
    ("Unlicense", r"this is free and unencumbered software released into the public domain"),
    ("cc0", r"(creative commons zero|cc0)"),
    ("CC-BY-NC-SA-{}", r"(?:creative commons|cc) (?:by-nc-sa|attribution-noncommercial-sharealike)(?: license)?(?: version| v)? ?([0-9.]*[0-9])?"),
    ("CC-BY-NC-ND-{}", r"(?:creative commons|cc) (?:by-nc-nd|attribution-noncommercial-noderivatives)(?: license)?(?: version| v)? ?([0-9.]*[0-9])?"),
    ("CC-BY-NC-{}", r"(?:creative commons|cc) (?:by-nc|attribution-noncommercial)(?: license)?(?: version| v)? ?([0-9.]*[0-9])?"),
    ("CC-BY-SA-{}", r"(?:creative commons|cc) (?:by-sa|attribution-sharealike)(?: license)?(?: version| v)? ?([0-9.]*[0-9])?"),
    ("CC-BY-ND-{}", r"(?:creative commons|cc) (?:by-nd|attribution-noderivatives)(?: license)?(?: version| v)? ?([0-9.]*[0-9])?"),
    ("CC-BY-{}", r"(?:creative commons|cc) (?:by|attribution)(?: license)?(?: version| v)? ?([0-9.]*[0-9])?"),
    ("bsl", r"boost software license"),
    ("zlibAltered", r"altered source versions must be plainly marked as such"),
    ("zlibOrigin", r"the origin of this software must not be misrepresented"),
    ("wtfpl", r"do what the f[a-z*]+ you want to public license"),
    ("BSD-2-Clause", UNDER + r"(simplified|2-clause|freebsd|two-clause) bsd license"),
    ("BSD-2-Clause", UNDER + r"bsd (2-clause|2 clause)"),
    ("BSD-3-Clause", UNDER + r"(new|modified|revised|3-clause|three-clause) bsd license"),
    ("BSD-3-Clause", UNDER + r"bsd (3-clause|3 clause)"),
    ("bsdAny", UNDER + r"bsd license"),
    ("MIT", UNDER + r"mit (license|licence)"),
    ("ISC", UNDER + r"isc (license|licence)"),
    ("publicDomain", r"(in|into|to) the public domain"),
    ("noCopying", r"unauthorized (copying|use|distribution)"),
    ("allRights", r"all rights reserved"),
    ("copyright", r"copyright (c )?[0-9]{4}"),
    ("seeLicense", r"(see|read) (the )?(file )?license"),
)

#: (pattern on the sequence of <identifier>s, licence), in order; ``None`` names the licence by the identifier.
RULES = (
    (r"<spdx:([a-z0-9.+-]+)>", None),
    (r"<mitPermit>(<mitNotice>)?(<asIs>)?", "MIT"),
    (r"<iscPermit>(<asIs>)?", "ISC"),
    (r"<bsdRedist>(<bsdSource>)?(<bsdBinary>)?<bsdAdvert>(<bsdEndorse>)?(<bsdAsIs>)?", "BSD-4-Clause"),
    (r"<bsdRedist>(<bsdSource>)?(<bsdBinary>)?<bsdEndorse>(<bsdAsIs>)?", "BSD-3-Clause"),
    (r"<bsdRedist>(<bsdSource>)?(<bsdBinary>)?(<bsdAsIs>)?", "BSD-2-Clause"),
    (r"(<Apache-2.0>)?<apacheUse>(<apacheCopy>)?(<apacheAsIs>)?", "Apache-2.0"),
    (r"<zlibOrigin>(<zlibAltered>)?", "Zlib"),
    (r"<cc0>", "CC0-1.0"),
    (r"<bsl>", "BSL-1.0"),
    (r"<wtfpl>", "WTFPL"),
    (r"<(AGPL-[0-9.]+(?:-or-later)?)>(<gplNoWarranty>|<agplAny>)*", None),
    (r"<(LGPL-[0-9.]+(?:-or-later)?)>(<gplNoWarranty>|<lgplAny>)*", None),
    (r"<(GPL-[0-9.]+(?:-or-later)?)>(<gplNoWarranty>|<gplAny>|<gplCopy>)*", None),
    (r"<((?:Apache|MPL|EPL|CC|BSD)-[A-Za-z0-9.-]+)>", None),
    (r"<(MIT|ISC|Unlicense)>", None),
    (r"<bsdAny>", "BSD"),
    (r"<agplAny>", "AGPL"),
    (r"<lgplAny>", "LGPL"),
    (r"<gplAny>(<gplNoWarranty>|<gplAny>|<gplCopy>)*", "GPL"),
    (r"<publicDomain>", "public-domain"),
    (r"<noCopying>(<allRights>)?", "proprietary"),
)
#: Identifiers that name no licence by themselves.
NEUTRAL = r"<(copyright|allRights|asIs|orLater|seeLicense|mitNotice|bsdSource|bsdBinary|bsdEndorse|bsdAsIs|bsdAdvert|gplNoWarranty|gplCopy|apacheCopy|apacheAsIs|zlibAltered)>"


#: A version that a later one may stand for, in a sequence of identifiers.
OR_LATER = r"<([AL]?GPL-[0-9.]+)><orLater>"
#: What each sentence pattern needs, in lower case: one of these parts of words, or one of these pairs of words, whatever is between the two.
PARTS = ("licen", "copyright", "spdx", "permission", "redistribution", "warrant", "advertising", "neither", "unencumbered", "commons", "cc0", "plainly", "misrepresented", "unauthorized", "bsd")
PAIRS = ("cc[^a-z0-9]+(?:by|attribution)", "public[^a-z0-9]+domain", "rights[^a-z0-9]+reserved", "later[^a-z0-9]+version")
#: (identifier, beginning of those that name the same licence better).
GENERAL = (("gplAny", "GPL-"), ("gplAny", "gplCopy"), ("lgplAny", "LGPL-"), ("agplAny", "AGPL-"))


def normalised(sentence: Column) -> Column:
    """Lower-case words with one space between them; what stands alone between words (bullets, marks of comments) goes."""
    plain = F.regexp_replace(F.translate(sentence, UPPER, LOWER), r"[^a-z0-9.+-]+", " ")
    return F.regexp_replace(F.regexp_replace(plain, r"(?: [.+-]+)+ ", " "), r"^[ .+-]+|[ .+-]+$", "")


def sentences(text: Column) -> Column:
    """The normalised sentences of a text, in order. A sentence ends after ``.!?`` before white space and at an empty line."""
    lines = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\b([vV])\.[ \t\n]+([0-9])", "$1.$2")
    ends = F.regexp_replace(F.regexp_replace(lines, r"\n[ \t*#/;-]*\n", "\u0001"), r"([.!?])[ \t\n]+", "$1\u0001")
    return F.transform(F.split(ends, "\u0001"), normalised)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def _any(conditions) -> Column:
    first, *rest = conditions
    for c in rest:
        first = first | c
    return first


def hinted(lower: Column) -> Column:
    """Whether a lower-cased text has what some sentence pattern needs. Literals are looked for one by one, which is far quicker than one alternation."""
    return _any([*(F.contains(lower, F.lit(x)) for x in PARTS), *(lower.rlike(x) for x in PAIRS)])


def identifiers(sentence: Column) -> Column:
    """The identifiers of a normalised sentence, in the order of their first places.

    A sentence may hold several (a notice and, after it, a permission); of
    those at one place the first of the table counts, and a general one goes
    where a better one of the same licence is in the sentence.
    """

    def hit(rank: int, name: str, pattern: str) -> Column:
        names, head = F.array(F.lit(name)), F.lit(name.removesuffix("{}"))
        if "{}" in name:
            names = F.transform(F.regexp_extract_all(sentence, F.lit(pattern), F.lit(1)), lambda x: F.regexp_replace(F.concat(head, x), "-$", ""))
        place = F.regexp_instr(sentence, F.lit(pattern))
        return F.when(sentence.rlike(pattern), F.struct(place.alias("place"), F.lit(rank).alias("rank"), names.alias("names")))

    tried = [hit(rank, *row) for rank, row in enumerate(SENTENCES)]

    def chosen(hits: Column) -> Column:
        first = F.filter(hits, lambda x: ~F.exists(hits, lambda y: (y["place"] == x["place"]) & (y["rank"] < x["rank"])))
        return _let(F.flatten(F.transform(F.array_sort(first), lambda x: x["names"])), better)

    def better(names: Column) -> Column:
        among = lambda start: F.exists(names, lambda y: y.startswith(start))
        return F.filter(names, lambda x: ~_any((x == name) & among(start) for name, start in GENERAL))

    return _let(F.filter(F.array(*tried), lambda x: x.isNotNull()), chosen)


def license_scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, sentence_ids, licenses.

    sentence_ids is the sequence of identifiers as ``<id><id>...``; licenses
    are those of all rules that fit, in the order of the rules, joined by
    " AND ", ``UNKNOWN`` where licence sentences fit no rule, and ``NONE``
    where there is no licence sentence. Null and empty texts have none.
    Repeated rows get one answer each. Extra columns are ignored. A row needs
    nothing but itself: no shuffle. Texts, and then sentences, without any word
    that a pattern needs (``PARTS``, ``PAIRS``) are not looked at further; no pattern fits them.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    known = F.filter(sentences(body), hinted)
    sequence = F.array_join(F.transform(F.flatten(F.transform(known, identifiers)), lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    ids = F.when(_let(F.lower(body), hinted), sequence).otherwise("")
    rules = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(name).cast("string").alias("name")) for p, name in RULES))
    start = F.struct(F.regexp_replace("sentence_ids", OR_LATER, "<$1-or-later>").alias("rest"), F.array().cast("array<string>").alias("found"))

    def use(state: Column, rule: Column) -> Column:
        names = F.when(rule["name"].isNotNull(), F.array(rule["name"])).otherwise(F.regexp_extract_all(state["rest"], rule["p"], F.lit(1)))
        return F.when(
            F.rlike(state["rest"], rule["p"]),
            F.struct(F.regexp_replace(state["rest"], rule["p"], F.lit("|")).alias("rest"), F.concat(state["found"], names).alias("found")),
        ).otherwise(state)

    matched = F.when(F.col("sentence_ids") != "", F.aggregate(rules, start, use)).alias("matched")
    scanned = docs.select(F.col(doc_id).alias("doc_id"), ids.alias("sentence_ids")).select("doc_id", "sentence_ids", matched)
    left = F.regexp_replace("matched.rest", NEUTRAL + r"|\|", "")
    found = F.when(F.size("matched.found") > 0, F.array_join(F.array_distinct("matched.found"), " AND "))
    return scanned.select("doc_id", "sentence_ids", F.coalesce(found, F.when(left != "", "UNKNOWN"), F.lit("NONE")).alias("licenses"))


def oracle() -> str:
    """The same in DuckDB SQL, with every sentence of every text tried on every pattern; rules are common table expressions, one after another."""

    def q(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def named(name: str, p: str) -> str:
        if "{}" not in name:
            return f"[{q(name)}]"
        return f"list_transform(regexp_extract_all(s, {q(p)}, 1), lambda x: regexp_replace({q(name.removesuffix('{}'))} || x, '-$', ''))"

    hits = ", ".join(f"CASE WHEN regexp_matches(s, {q(p)}) THEN {{'place': strpos(s, regexp_extract(s, {q(p)}, 0)), 'rank': {k}, 'names': {named(name, p)}}} END" for k, (name, p) in enumerate(SENTENCES))
    general = " OR ".join(f"(x = {q(name)} AND len(list_filter(names, lambda y: starts_with(y, {q(start)}))) > 0)" for name, start in GENERAL)
    sql = rf"""
WITH b AS (SELECT doc_id, row_number() OVER () AS n, coalesce(text, '') AS t FROM documents
), m AS (
  SELECT doc_id, n, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '\b([vV])\.[ \t\n]+([0-9])', '\1.\2', 'g'), '\n[ \t*#/;-]*\n', chr(1), 'g'), '([.!?])[ \t\n]+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM b
), e AS (SELECT n, generate_subscripts(parts, 1) AS k, unnest(parts) AS x FROM m
), s AS (
  SELECT n, k, regexp_replace(regexp_replace(regexp_replace(translate(x, '{UPPER}', '{LOWER}'), '[^a-z0-9.+-]+', ' ', 'g'), '(?: [.+-]+)+ ', ' ', 'g'), '^[ .+-]+|[ .+-]+$', '', 'g') AS s FROM e
), h AS (SELECT n, k, list_filter([{hits}], lambda x: x IS NOT NULL) AS hits FROM s
), c AS (
  SELECT n, k, flatten(list_transform(list_sort(list_filter(hits, lambda x: len(list_filter(hits, lambda y: y.place = x.place AND y.rank < x.rank)) = 0)), lambda x: x.names)) AS names FROM h WHERE len(hits) > 0
), i AS (
  SELECT n, string_agg(array_to_string(list_transform(list_filter(names, lambda x: NOT ({general})), lambda x: '<' || x || '>'), ''), '' ORDER BY k) AS sentence_ids FROM c GROUP BY n
), r0 AS (
  SELECT doc_id, coalesce(sentence_ids, '') AS sentence_ids, regexp_replace(coalesce(sentence_ids, ''), {q(OR_LATER)}, '<\1-or-later>', 'g') AS rest, []::VARCHAR[] AS found FROM b LEFT JOIN i USING (n)
)"""
    for k, (p, name) in enumerate(RULES):
        new = f"[{q(name)}]" if name else f"regexp_extract_all(rest, {q(p)}, 1)"
        sql += rf""", r{k + 1} AS (SELECT doc_id, sentence_ids, CASE WHEN regexp_matches(rest, {q(p)}) THEN regexp_replace(rest, {q(p)}, '|', 'g') ELSE rest END AS rest,
  CASE WHEN regexp_matches(rest, {q(p)}) THEN list_concat(found, {new}) ELSE found END AS found FROM r{k})"""
    return sql + rf"""
SELECT doc_id, sentence_ids, CASE WHEN len(found) > 0 THEN array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ' AND ')
  WHEN regexp_replace(rest, {q(NEUTRAL + '|[|]')}, '', 'g') <> '' THEN 'UNKNOWN' ELSE 'NONE' END AS licenses FROM r{len(RULES)}
"""
