"""License scan: ordered signature rules behind literal keywords, overlaps settled by priority and containment.

DataFrame functions only."""

from __future__ import annotations

import json
from functools import cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import table
from weftline.llm.pii import STEP, let, running

#: Phrases that are always reported: words, label.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Hand-written signatures over words parted by one space: label | a literal that every match holds | pattern. L is
#: "licen[cs]e", V an optional word for version. Within a priority the earlier line comes first.
NAMES = """
gpl-1.0      | general public      | gnu general public L V1(?: 0)?
gpl-2.0      | general public      | gnu general public L V2(?: 0)?
gpl-3.0      | general public      | gnu general public L V3(?: 0)?
lgpl-2.0     | general public      | (?:gnu )?library general public L(?: V2(?: 0)?)?
lgpl-2.1     | general public      | (?:gnu )?lesser general public L V2 1
lgpl-3.0     | general public      | (?:gnu )?lesser general public L V3(?: 0)?
lgpl         | general public      | (?:gnu )?lesser general public L
agpl-3.0     | general public      | (?:gnu )?affero general public L V3(?: 0)?
agpl         | general public      | (?:gnu )?affero general public L
gpl          | general public      | (?:gnu )?general public L
fdl-1.2      | free documentation  | (?:gnu )?free documentation L V1 2
fdl-1.3      | free documentation  | (?:gnu )?free documentation L V1 3
fdl          | free documentation  | (?:gnu )?free documentation L
apache-1.0   | apache              | apache (?:software )?L V1(?: 0)?
apache-1.1   | apache              | apache (?:software )?L V1 1
apache-2.0   | apache              | apache (?:software )?L V2(?: 0)?
apache       | apache              | apache (?:software )?L
mit-0        | mit                 | mit (?:0|no attribution) L
mit          | mit                 | (?:expat|x11|x consortium) mit L|mit (?:expat |x11 |style )?L
bsd-4-clause | bsd                 | (?:original bsd|4 clause bsd|bsd 4 clause|four clause bsd) L
bsd-3-clause | bsd                 | (?:new bsd|modified bsd|revised bsd|3 clause bsd|bsd 3 clause|three clause bsd) L
bsd-2-clause | bsd                 | (?:simplified bsd|freebsd|2 clause bsd|bsd 2 clause|two clause bsd) L
0bsd         | bsd                 | (?:0bsd|zero clause bsd|bsd zero clause|0 clause bsd) L
bsd          | bsd                 | bsd (?:style )?L
isc          | isc                 | isc L
mpl-1.0      | mozilla public      | mozilla public L V1(?: 0)?
mpl-1.1      | mozilla public      | mozilla public L V1 1
mpl-2.0      | mozilla public      | mozilla public L V2(?: 0)?
mpl          | mozilla public      | mozilla public L
npl          | netscape public     | netscape public L(?: V1 [01])?
epl-1.0      | eclipse public      | eclipse public L V1(?: 0)?
epl-2.0      | eclipse public      | eclipse public L V2(?: 0)?
epl          | eclipse public      | eclipse public L
edl-1.0      | eclipse distrib     | eclipse distribution L(?: V1(?: 0)?)?
eupl-1.1     | european union      | european union public L V1 1
eupl-1.2     | european union      | european union public L V1 2
eupl         | european union      | european union public L
cddl-1.0     | common development  | common development and distribution L(?: V1(?: 0)?)?
cddl-1.1     | common development  | common development and distribution L V1 1
cpl-1.0      | common public       | common public L(?: V1(?: 0)?)?
cpal-1.0     | common public       | common public attribution L(?: V1(?: 0)?)?
ipl-1.0      | ibm public          | ibm public L(?: V1(?: 0)?)?
apsl-2.0     | apple public        | apple public source L(?: V2(?: 0)?)?
artistic-1.0 | artistic            | (?:the )?artistic L V1(?: 0)?
artistic-2.0 | artistic            | (?:the )?artistic L V2(?: 0)?
artistic     | artistic            | (?:perl )?artistic L
afl-3.0      | academic free       | academic free L(?: V[1-3](?: [0-2])?)?
osl-3.0      | open software       | open software L(?: V[1-3](?: [0-1])?)?
ecl-2.0      | educational comm    | educational community L(?: V2(?: 0)?)?
bsl-1.0      | boost software      | boost software L(?: V1(?: 0)?)?
busl-1.1     | business source     | business source L(?: V1(?: [01])?)?
sspl-1.0     | server side public  | server side public L(?: V1)?
elastic-2.0  | elastic             | elastic L V2(?: 0)?
zlib         | zlib                | zlib L|zlib libpng L
libpng       | libpng              | libpng L(?: V2)?
openssl      | openssl             | openssl L
php-3.01     | php                 | php L(?: V3(?: 0?1)?)?
python-2.0   | python software     | python software foundation L(?: V2(?: 0)?)?
ruby         | ruby                | ruby L
postgresql   | postgresql          | postgresql L
ncsa         | illinois            | university of illinois(?: ncsa)? open source L
zpl-2.1      | zope public         | zope public L(?: V2 [01])?
vim          | vim                 | vim L
w3c          | w3c                 | w3c software(?: notice and| and document)? L
unicode      | unicode             | unicode L(?: V3| agreement data files and software)?
tcl          | tcl                 | tcl tk L
sleepycat    | sleepycat           | sleepycat L
openldap     | openldap            | openldap public L(?: V2 [0-8])?
ms-pl        | microsoft public    | microsoft public L
ms-rl        | microsoft recip     | microsoft reciprocal L
lppl-1.3     | latex project       | latex project public L(?: V1 3[ac]?)?
ofl-1.1      | open font           | (?:sil )?open font L(?: V1(?: [01])?)?
cecill       | cecill              | cecill(?: b| c)? (?:free software )?L(?: agreement)?
mulan-2.0    | mulan               | mulan permissive software L(?: V2)?
odbl-1.0     | open database       | open database L(?: V1(?: 0)?)?
odc-by-1.0   | open data commons   | open data commons attribution L(?: V1(?: 0)?)?
pddl-1.0     | public domain ded   | public domain dedication and L(?: V1(?: 0)?)?
ogl-3.0      | open government     | open government L(?: V[1-3](?: 0)?)?
cc0-1.0      | commons             | creative commons (?:cc0|zero)(?: V1 0)?(?: universal)?(?: public domain dedication)? L
cc-by-nc-nd  | commons             | creative commons attribution non ?commercial no ?deriv(?:s|ative|atives)(?: works)?(?: V?[1-4] [05])?(?: international| unported)? L
cc-by-nc-sa  | commons             | creative commons attribution non ?commercial share ?alike(?: V?[1-4] [05])?(?: international| unported)? L
cc-by-nc     | commons             | creative commons attribution non ?commercial(?: V?[1-4] [05])?(?: international| unported)? L
cc-by-nd     | commons             | creative commons attribution no ?deriv(?:s|ative|atives)(?: works)?(?: V?[1-4] [05])?(?: international| unported)? L
cc-by-sa     | commons             | creative commons attribution share ?alike(?: V?[1-4] [05])?(?: international| unported)? L
cc-by        | commons             | creative commons attribution(?: V?[1-4] [05])?(?: international| unported)? L
llama        | llama               | llama(?: [0-9]){0,2} community L(?: agreement)?
openrail     | rail                | (?:creativeml |bigscience |bigcode )?open ?rail(?: m)? L
openrail     | responsible ai      | responsible ai L
gemma        | gemma               | gemma (?:terms of use )?L
proprietary  | proprietary         | proprietary (?:software )?L
"""
#: Short names, which count only where something says that a license follows.
IDS = """
gpl-1.0      | gpl         | gplV?1(?: 0)?(?: only| or later)?|gpl V1(?: 0)?(?: only| or later)?
gpl-2.0      | gpl         | gplv?2(?: 0)?(?: only| or later)?|(?:gnu )?gpl V2(?: 0)?(?: only| or later)?
gpl-3.0      | gpl         | gplv?3(?: 0)?(?: only| or later)?|(?:gnu )?gpl V3(?: 0)?(?: only| or later)?
lgpl-2.1     | lgpl        | lgplv?2 1|(?:gnu )?lgpl V2 1(?: only| or later)?
lgpl-3.0     | lgpl        | lgplv?3(?: 0)?|(?:gnu )?lgpl V3(?: 0)?(?: only| or later)?
lgpl         | lgpl        | (?:gnu )?lgpl
agpl-3.0     | agpl        | agplv?3(?: 0)?|(?:gnu )?agpl V3(?: 0)?(?: only| or later)?
agpl         | agpl        | (?:gnu )?agpl
gpl          | gpl         | (?:gnu )?gpl
fdl          | fdl         | gfdl(?: 1 [1-3])?(?: only| or later)?
apache-1.1   | apache      | apache V1 1
apache-2.0   | apache      | apache V2(?: 0)?
mit-0        | mit         | mit 0
mit          | mit         | mit
x11          | x11         | x11
bsd-4-clause | bsd         | bsd 4 clause|4 clause bsd
bsd-3-clause | bsd         | bsd 3 clause(?: clear)?|3 clause bsd
bsd-2-clause | bsd         | bsd 2 clause(?: patent)?|2 clause bsd
0bsd         | 0bsd        | 0bsd
bsd          | bsd         | bsd
isc          | isc         | isc
mpl-1.1      | mpl         | mpl V1 1
mpl-2.0      | mpl         | mpl V2(?: 0)?
mpl          | mpl         | mpl
epl-1.0      | epl         | epl V1(?: 0)?
epl-2.0      | epl         | epl V2(?: 0)?
eupl-1.2     | eupl        | eupl(?: V1 [12])?
cddl-1.0     | cddl        | cddl(?: V1 [01])?
cpl-1.0      | cpl         | cpl V1 0
artistic-2.0 | artistic    | artistic V2 0
artistic-1.0 | artistic    | artistic V1 0(?: perl)?
afl-3.0      | afl         | afl V[1-3] [0-2]
osl-3.0      | osl         | osl V[1-3] [01]
bsl-1.0      | bsl         | bsl V1 0
busl-1.1     | busl        | busl V1 1
sspl-1.0     | sspl        | sspl(?: V1(?: 0)?)?
elastic-2.0  | elastic     | elastic V2 0
zlib         | zlib        | zlib
openssl      | openssl     | openssl
php-3.01     | php         | php V3(?: 0?1)?
python-2.0   | psf         | psf(?: 2 0)?
python-2.0   | python      | python V2 0
postgresql   | postgresql  | postgresql
ncsa         | ncsa        | ncsa
unlicense    | unlicense   | unlicense
wtfpl        | wtfpl       | wtfpl
zpl-2.1      | zpl         | zpl V2 [01]
ms-pl        | ms pl       | ms pl
ms-rl        | ms rl       | ms rl
lppl-1.3     | lppl        | lppl V1 3[ac]?
ofl-1.1      | ofl         | (?:sil )?ofl(?: V1 [01])?
cecill       | cecill      | cecill(?: 2 [01]| b| c)?
mulan-2.0    | mulan       | mulanpsl 2 0
odbl-1.0     | odbl        | odbl(?: V1 0)?
odc-by-1.0   | odc by      | odc by(?: V1 0)?
pddl-1.0     | pddl        | pddl(?: V1 0)?
openrail     | rail        | (?:creativeml |bigscience |bigcode )?openrail(?: m)?
proprietary  | proprietary | proprietary
"""
#: Notices and names that speak for themselves.
TEXTS = """
mit          | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software
isc          | permission to use copy       | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee
bsd          | redistribution and use       | redistribution and use in source and binary forms(?: with or without modification)?
gpl          | free software you can        | this (?:program|library|file) is free software you can redistribute it and or modify it
gpl          | copyleft                     | copyleft
apache-2.0   | apache org licenses          | (?:http|https) (?:www )?apache org licenses license 2 0(?: txt| html)?
mit          | opensource org licen         | opensource org licenses? mit(?: license)?(?: php)?
bsd-3-clause | opensource org licen         | opensource org licenses? bsd (?:3 clause|license)(?: php)?
gpl          | gnu org licenses             | (?:www )?gnu org licenses(?: gpl)?(?: [1-3] 0)?(?: html| txt)?
lgpl         | gnu org licenses             | (?:www )?gnu org licenses lgpl(?: [23] [01])?(?: html| txt)?
agpl         | gnu org licenses             | (?:www )?gnu org licenses agpl(?: 3 0)?(?: html| txt)?
mpl-2.0      | mozilla org mpl              | mozilla org mpl 2 0
mpl-2.0      | source code form             | this source code form is subject to the terms of the mozilla public license(?: v 2 0)?
cc0-1.0      | creativecommons org          | creativecommons org publicdomain zero 1 0
cc-by-nc-nd  | creativecommons org          | creativecommons org licenses by nc nd [1-4] [05]
cc-by-nc-sa  | creativecommons org          | creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc     | creativecommons org          | creativecommons org licenses by nc [1-4] [05]
cc-by-nd     | creativecommons org          | creativecommons org licenses by nd [1-4] [05]
cc-by-sa     | creativecommons org          | creativecommons org licenses by sa [1-4] [05]
cc-by        | creativecommons org          | creativecommons org licenses by [1-4] [05]
cc-by-nc-nd  | cc by nc nd                  | cc by nc nd(?: [1-4] [05])?
cc-by-nc-sa  | cc by nc sa                  | cc by nc sa(?: [1-4] [05])?
cc-by-nc     | cc by nc                     | cc by nc(?: [1-4] [05])?
cc-by-nd     | cc by nd                     | cc by nd(?: [1-4] [05])?
cc-by-sa     | cc by sa                     | cc by sa(?: [1-4] [05])?
cc-by        | cc by                        | cc by [1-4] [05]
cc0-1.0      | cc0                          | cc0(?: 1 0)?(?: universal)?
unlicense    | unencumbered software        | free and unencumbered software released into the public domain
public       | public domain                | (?:released |placed |dedicated )?(?:in|into|to) the public domain
wtfpl        | do what the                  | do what the fuck you want to public L
beerware     | beer ware                    | the beer ware L
proprietary  | all rights reserved          | all rights reserved
"""
#: How a name is introduced: priority (0 is best), weight, a literal that every match holds, pattern around the name N.
FORMS = {
    "identifier": (0, 1.0, "spdx license identifier", "spdx license identifier N"),
    "grant": (1, 0.9, " under ", "(?:licensed|licenced|released|distributed|available|provided|published|covered) under (?:the )?(?:terms of )?(?:the )?N"),
    "declared": (1, 0.8, "licen", "(?:license|licence|licenses|licensing) (?:is |name |type |id |expression )?(?:the )?N"),
    "name": (2, 0.6, "licen", "N"),
    "text": (0, 0.95, "", "N"),
}
#: One of these is in every text in which a rule can match.
HINTS = ("licen", " under ", "cc by", "cc0", "creativecommons org", "permission", "redistribution", "free software", "free and unencumbered", "copyleft", "mozilla org", "public domain", "beer ware", "do what the", "rights reserved", "gnu org", "opensource org", "apache org")


class Rule(NamedTuple):
    rank: int
    level: int
    weight: float
    label: str
    keyword: str
    second: str
    pattern: str
    base: bool


@cache
def rules() -> tuple[Rule, ...]:
    """All signature rules in order: lines of the tables times the forms that introduce them."""
    out: list[Rule] = [Rule(k, 2, FORMS["name"][1], label, phrase, phrase, phrase, True) for k, (phrase, label) in enumerate(BASE.items())]
    for lines, forms in ((TEXTS, ("text",)), (NAMES, ("grant", "declared", "name")), (IDS, ("identifier", "grant", "declared"))):
        for line in filter(None, map(str.strip, lines.splitlines())):
            label, keyword, pattern = (x.strip() for x in line.split(" | ", 2))
            named = "(?:" + pattern.replace("L", "licen[cs]e").replace("V?", "V").replace("V", "(?:v|v |version |ver )?") + ")"
            for form in forms:
                level, weight, second, around = FORMS[form]
                out.append(Rule(len(out), level, weight, label, keyword, second or keyword, around.replace("N", named), False))
    return tuple(out)


def gates() -> Column:
    """Rules by keyword, as one constant array: keyword, rules (second keyword, pattern with what lies before it, ...)."""
    by: dict[str, list[dict]] = {}
    for r in rules():
        own = r._asdict() | {"pattern": rf"(?s)\G(.*?)((?<![^ ])(?:{r.pattern})(?![^ ]))"}
        by.setdefault(own.pop("keyword"), []).append(own)
    rule = "rank:int,level:int,weight:double,label:string,second:string,pattern:string,base:boolean"
    return F.from_json(F.lit(json.dumps([{"keyword": k, "rules": some} for k, some in by.items()])), f"array<struct<keyword:string,rules:array<struct<{rule}>>>>")


def words(text: Column) -> Column:
    """A text's words in lower case, parted by one space: letters, digits and all beyond ASCII."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")))


def spaces(s: Column) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")


DETECTIONS = "array<struct<start:bigint,less:bigint,level:int,rank:int,end:bigint,label:string,weight:double,base:boolean>>"
ENDS = "struct<e0:bigint,e1:bigint,e2:bigint>"


def placed(words: Column, rule: Column) -> Column:
    """All places of a rule that don't overlap, in words."""
    found = F.struct(F.transform(F.regexp_extract_all(words, rule["pattern"], F.lit(1)), spaces).alias("gap"), F.transform(F.regexp_extract_all(words, rule["pattern"], F.lit(2)), spaces).alias("hit"))

    def each(f: Column) -> Column:
        before = lambda lens: F.zip_with(running(lens), f["gap"], lambda a, g: a + g)
        starts = let(F.zip_with(f["gap"], f["hit"], lambda g, h: g + h), before)
        end = lambda s, h: s + h + 1
        return F.zip_with(starts, f["hit"], lambda s, h: F.struct(s.alias("start"), (-end(s, h)).alias("less"), rule["level"].alias("level"), rule["rank"].alias("rank"), end(s, h).alias("end"), rule["label"].alias("label"), rule["weight"].alias("weight"), rule["base"].alias("base")))

    return let(found, each)


def settled(found: Column) -> Column:
    """Detections without those that lie within another of the same or a better priority; base phrases stay.

    Sorted by start, then by falling end, priority and rule, a detection lies within another if an earlier one ends as
    late. Running ends for each priority are taken in pieces, so that many detections don't cost squares."""
    end = lambda x, level: F.when(x["level"] <= level, x["end"]).otherwise(F.lit(-1).cast("long"))
    step = lambda acc, x: F.struct(*(F.greatest(acc[f"e{k}"], end(x, k)).alias(f"e{k}") for k in range(3)))
    merge = lambda a, b: F.struct(*(F.greatest(a[f"e{k}"], b[f"e{k}"]).alias(f"e{k}") for k in range(3)))
    zero = F.struct(*(F.lit(-1).cast("long").alias(f"e{k}") for k in range(3)))
    own = lambda acc, x: F.when(x["level"] == 0, acc["e0"]).when(x["level"] == 1, acc["e1"]).otherwise(acc["e2"])

    def swept(items: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(items) / STEP).cast("int") - 1))
        piece = lambda c: F.slice(items, c * STEP + 1, STEP)
        sums = F.transform(cuts, lambda c: F.aggregate(piece(c), zero, step))
        heads = F.aggregate(sums, F.array(zero), lambda acc, s: F.concat(acc, F.array(merge(F.element_at(acc, -1), s))))
        none = F.expr(f"CAST(array() AS {DETECTIONS})")
        keep = lambda acc, x: F.when(x["base"] | (own(acc["at"], x) < x["end"]), F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"])
        within = lambda h, c: F.aggregate(piece(c), F.struct(F.element_at(h, c + 1).alias("at"), none.alias("kept")), lambda acc, x: F.struct(step(acc["at"], x).alias("at"), keep(acc, x).alias("kept")), lambda acc: acc["kept"])
        return F.flatten(let(heads, lambda h: F.transform(cuts, lambda c: within(h, c))))

    return let(F.array_sort(found), swept)


def detections(words: Column) -> Column:
    """The settled detections of a text's words. Rules run only where both of their literals occur."""
    own = F.flatten(F.transform(F.filter(gates(), lambda g: F.contains(words, g["keyword"])), lambda g: F.filter(g["rules"], lambda r: F.contains(words, r["second"]))))
    found = F.flatten(F.transform(own, lambda r: placed(words, r)))
    hinted = F.contains(words, F.lit(HINTS[0]))
    for h in HINTS[1:]:
        hinted = hinted | F.contains(words, F.lit(h))
    return F.when(hinted, settled(found)).otherwise(F.expr(f"CAST(array() AS {DETECTIONS})"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and licenses (start, end, label, rule, weight, base; in words, end exclusive) for each row of docs
    (doc_id, text).

    A detection is a rule's match; of overlapping ones, those within another of the same or a better priority go. Base
    phrases stay in any case. Null and empty texts have no words and no detections; repeated rows and null ids are kept
    as they are; no rows give no rows; other columns are not looked at. One pass without a shuffle or Python."""

    def told(w: Column) -> Column:
        n = F.when(w == "", F.lit(0).cast("long")).otherwise(spaces(w) + 1)
        spans = F.transform(detections(w), lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), d["label"].alias("label"), d["rank"].alias("rule"), d["weight"].alias("weight"), d["base"].alias("base")))
        return F.struct(n.alias("n_words"), spans.alias("licenses"))

    return docs.select("doc_id", let(words(F.col("text")), told).alias("x")).select("doc_id", "x.n_words", "x.licenses")


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    out = lambda s: F.struct(
        F.size(s["base"]).cast("long").alias("n_base"), F.array_min(F.transform(s["base"], lambda b: b["start"])).alias("first_word"), F.array_max(F.transform(s["base"], lambda b: b["start"])).alias("last_word"),
        joined(s["base"]).alias("base_labels"), joined(s["all"]).alias("labels"), F.coalesce(F.array_max(F.transform(s["all"], lambda b: b["weight"])), F.lit(0.0)).alias("score"),
    )
    spans = lambda l: F.struct(l.alias("all"), F.filter(l, lambda s: s["base"]).alias("base"))
    return found.select("doc_id", "n_words", let(F.col("licenses"), lambda l: let(spans(l), out)).alias("x")).select("doc_id", "n_words", "x.*")
