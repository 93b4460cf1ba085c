"""License scan: ordered signature rules on a text's words, each behind a keyword.

A text becomes its words, A-Z lower-cased, with one space between them. Rules are regular expressions over this line of words;
one is tried only where its keyword occurs. A license has rules for its SPDX tag, for what grants it and for its name;
besides, there are rules for well-known passages. Detections overlap: one that lies within another of a stronger priority, or of the
same priority and longer (or, of two at the same place, made by the earlier rule), is dropped. The base phrases
are looked for everywhere, whatever a rule finds.

A row needs no other row: one pass, no shuffle. Detections are found in time linear in the text but for backtracking over
a bounded number of words, and suppressed in one sweep of the sorted detections.

Defined cases: null and empty texts have no words and the score 0; texts of any length are scanned whole; of rules that match at
overlapping places of their own, the leftmost go; repeated rows give repeated rows; an empty table gives an empty result; further columns
are passed on, but for ones with the names of those added, which give way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import table

# fixed values: the base phrases and their labels
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Label; keyword; name, as a regular expression over words. The SPDX tag is the label's words.
LICENSES = r"""
mit; mit; (?:the )?(?:mit x11|mit|expat|x11)(?: style)?
mit-0; mit; mit (?:no attribution|0)
apache-2.0; apache; (?:apache (?:software )?licen[sc]e|apache(?: 2)?|asl)(?: (?:version|v)? ?v?2(?: 0)?)
apache-1.1; apache; apache (?:software )?licen[sc]e(?: version| v)? 1 1
apache; apache; apache (?:software )?licen[sc]e
gpl-3.0; public; (?:gnu )?general public licen[sc]e(?: gpl)?(?: as published by the free software foundation)?(?: either)? (?:version |v ?)?3(?: 0)?
gpl-3.0; gpl; (?:gnu )?gpl (?:version |v ?)?3(?: 0)?
gpl-3.0; gplv3; (?:gnu )?gplv3
gpl-2.0; public; (?:gnu )?general public licen[sc]e(?: gpl)?(?: as published by the free software foundation)?(?: either)? (?:version |v ?)?2(?: 0)?
gpl-2.0; gpl; (?:gnu )?gpl (?:version |v ?)?2(?: 0)?
gpl-2.0; gplv2; (?:gnu )?gplv2
gpl; gpl; gnu gpl
lgpl-3.0; lesser; (?:gnu )?lesser general public licen[sc]e(?: lgpl)?(?: as published by the free software foundation)?(?: either)? (?:version |v ?)?3(?: 0)?
lgpl-3.0; lgpl; lgpl (?:version |v ?)?3(?: 0)?
lgpl-3.0; lgplv3; lgplv3
lgpl-2.1; lesser; (?:gnu )?lesser general public licen[sc]e(?: lgpl)?(?: as published by the free software foundation)?(?: either)? (?:version |v ?)?2 1
lgpl-2.1; lgpl; lgpl (?:version |v ?)?2 1
lgpl-2.0; library; (?:gnu )?library general public licen[sc]e
lgpl; lesser; (?:gnu )?lesser general public licen[sc]e
agpl-3.0; affero; (?:gnu )?affero general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: (?:version |v ?)?3(?: 0)?)?
agpl-3.0; agpl; agpl(?: (?:version |v ?)?3(?: 0)?)?
agpl-3.0; agplv3; agplv3
gfdl-1.3; documentation; (?:gnu )?free documentation licen[sc]e(?: (?:version |v ?)?1 3)?
bsd-2-clause; bsd; (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)
bsd-3-clause; bsd; (?:bsd 3 clause|3 clause bsd|three clause bsd|(?:new|modified|revised) bsd)
bsd-4-clause; bsd; (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)
0bsd; bsd; (?:zero clause bsd|bsd zero clause|0bsd)
bsd; bsd; bsd(?: style)?
isc; isc; isc
zlib; zlib; zlib(?: libpng)?
libpng; libpng; libpng
bsl-1.0; boost; boost(?: software)?(?: 1 0)?
mpl-2.0; mozilla; mozilla public licen[sc]e(?: mpl)? (?:version |v ?)?2(?: 0)?
mpl-2.0; mpl; mpl (?:version |v ?)?2(?: 0)?
mpl-1.1; mozilla; mozilla public licen[sc]e(?: mpl)? (?:version |v ?)?1 1
mpl; mozilla; mozilla public licen[sc]e
epl-2.0; eclipse; eclipse public licen[sc]e(?: epl)? (?:version |v ?)?2(?: 0)?
epl-1.0; eclipse; eclipse public licen[sc]e(?: epl)? (?:version |v ?)?1(?: 0)?
epl; eclipse; eclipse public licen[sc]e
edl-1.0; eclipse; eclipse distribution licen[sc]e
cddl-1.0; cddl; cddl(?: (?:version |v ?)?1 0)?
cddl-1.0; distribution; common development and distribution licen[sc]e
cpl-1.0; common; common public licen[sc]e
ms-pl; microsoft; microsoft public licen[sc]e
ms-rl; microsoft; microsoft reciprocal licen[sc]e
artistic-2.0; artistic; artistic(?: licen[sc]e)? (?:version |v ?)?2(?: 0)?
artistic-1.0; artistic; artistic(?: licen[sc]e)? (?:version |v ?)?1 0
artistic; artistic; artistic licen[sc]e
eupl-1.2; european; european union public licen[sc]e(?: (?:version |v ?)?1 2)?
eupl-1.2; eupl; eupl(?: (?:version |v ?)?1 2)?
osl-3.0; open; open software licen[sc]e(?: (?:version |v ?)?3 0)?
afl-3.0; academic; academic free licen[sc]e(?: (?:version |v ?)?3 0)?
unlicense; unlicense; (?:the )?unlicense
wtfpl; wtfpl; wtfpl
cc0-1.0; cc0; (?:creative commons )?cc0(?: 1 0)?(?: universal)?
cc0-1.0; zero; creative commons zero
cc-by-nc-nd-4.0; cc; cc by nc nd 4 0
cc-by-nc-sa-4.0; cc; cc by nc sa 4 0
cc-by-nc-4.0; cc; cc by nc 4 0
cc-by-nd-4.0; cc; cc by nd 4 0
cc-by-sa-4.0; cc; cc by sa 4 0
cc-by-4.0; cc; cc by 4 0
cc-by-nc-nd-3.0; cc; cc by nc nd 3 0
cc-by-nc-sa-3.0; cc; cc by nc sa 3 0
cc-by-nc-3.0; cc; cc by nc 3 0
cc-by-nd-3.0; cc; cc by nd 3 0
cc-by-sa-3.0; cc; cc by sa 3 0
cc-by-3.0; cc; cc by 3 0
cc-by-nc-nd; cc; cc by nc nd
cc-by-nc-sa; cc; cc by nc sa
cc-by-nc; cc; cc by nc
cc-by-nd; cc; cc by nd
cc-by-sa; cc; cc by sa
cc-by-nc-nd-4.0; creative; creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works) (?:version )?4 0
cc-by-nc-sa-4.0; creative; creative commons attribution non ?commercial share ?alike (?:version )?4 0
cc-by-nc-4.0; creative; creative commons attribution non ?commercial (?:version )?4 0
cc-by-nd-4.0; creative; creative commons attribution no ?deriv(?:s|atives|ative works) (?:version )?4 0
cc-by-sa-4.0; creative; creative commons attribution share ?alike (?:version )?4 0
cc-by-4.0; creative; creative commons attribution (?:version )?4 0
cc; creative; creative commons
ofl-1.1; ofl; (?:sil )?ofl(?: 1 1)?
ofl-1.1; font; (?:sil )?open font licen[sc]e(?: (?:version |v ?)?1 1)?
odbl-1.0; odbl; odbl(?: (?:version |v ?)?1 0)?
odbl-1.0; database; open (?:data commons open )?database licen[sc]e
odc-by-1.0; commons; open data commons attribution licen[sc]e
pddl-1.0; dedication; (?:open data commons )?public domain dedication and licen[sc]e
cdla-permissive-2.0; community; community data licen[sc]e agreement permissive(?: (?:version )?2 0)?
psf-2.0; python; python software foundation(?: 2 0)?
ruby; ruby; ruby
php-3.01; php; php(?: (?:version |v ?)?3 01?)?
postgresql; postgresql; postgresql
openssl; openssl; openssl
curl; curl; curl
ncsa; ncsa; (?:university of illinois )?(?:ncsa|open source ncsa)
upl-1.0; upl; upl(?: 1 0)?
upl-1.0; universal; universal permissive licen[sc]e
busl-1.1; business; business source licen[sc]e(?: 1 1)?
sspl-1.0; server; server side public licen[sc]e
elastic-2.0; elastic; elastic(?: licen[sc]e)? (?:version )?2(?: 0)?
openrail; openrail; (?:bigscience |creativeml )?open ?rail(?: [a-z])?
"""

#: Label; keyword; passage: text that a license or its notice is known by.
PASSAGES = r"""
mit; hereby; permission is hereby granted free of charge to any person obtaining a copy of this software
mit; merchantability; the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
isc; hereby; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd; redistributions; redistribution and use in source and binary forms with or without modification are permitted
bsd; redistributions; redistributions of source code must retain the above copyright notice
bsd; redistributions; redistributions in binary form must reproduce the above copyright notice
bsd-3-clause; endorse; neither the name of(?: [^ ]+){1,12}? nor the names of its contributors may be used to endorse or promote products
bsd-4-clause; acknowledgement; all advertising materials mentioning features or use of this software must display the following acknowledgement
apache-2.0; compliance; you may not use this file except in compliance with the license
apache-2.0; www; www apache org licenses license 2 0
apache-2.0; distributed; distributed under the license is distributed on an as is basis without warranties or conditions of any kind
gpl; redistribute; this program is free software you can redistribute it and or modify it
lgpl; redistribute; this library is free software you can redistribute it and or modify it
gpl; copyleft; (?:strong )?copyleft licen[sc]e
gpl-3.0; www; www gnu org licenses gpl 3 0
gpl-2.0; www; www gnu org licenses (?:old licenses )?gpl 2 0
lgpl-2.1; www; www gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0; www; www gnu org licenses lgpl 3 0
agpl-3.0; www; www gnu org licenses agpl 3 0
mpl-2.0; mozilla; this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0; mozilla; mozilla org (?:en us )?mpl 2 0
epl; eclipse; this program and the accompanying materials are made available under the terms of the eclipse public license
zlib; altered; altered source versions must be plainly marked as such
bsl-1.0; www; www boost org license 1 0
unlicense; unencumbered; this is free and unencumbered software released into the public domain
wtfpl; www; www wtfpl net
cc-by-4.0; creativecommons; creativecommons org licenses by 4 0
cc-by-sa-4.0; creativecommons; creativecommons org licenses by sa 4 0
cc-by-nc-4.0; creativecommons; creativecommons org licenses by nc 4 0
cc-by-nd-4.0; creativecommons; creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0; creativecommons; creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0; creativecommons; creativecommons org licenses by nc nd 4 0
cc0-1.0; creativecommons; creativecommons org publicdomain zero 1 0
mit; opensource; opensource org licenses mit
isc; opensource; opensource org licenses isc
bsd-2-clause; opensource; opensource org licenses bsd 2 clause
bsd-3-clause; opensource; opensource org licenses bsd 3 clause
public-domain; public; (?:is|are|placed|released|dedicated|donated|put)(?: in| into| to)? the public domain
proprietary; proprietary; (?:proprietary and confidential|confidential and proprietary)
proprietary; unauthorized; unauthorized (?:copying|reproduction|distribution|use)(?: [^ ]+){0,8}? (?:is )?(?:strictly )?prohibited
proprietary; reproduced; no part of this (?:publication|work|book|document) may be reproduced
proprietary; permission; (?:reproduced|reprinted|used) (?:with|by) permission of
eula; licensed; (?:this )?software is licensed not sold
eula; agreement; end user licen[sc]e agreement
"""

GRANT = r"(?:licen[sc]ed|released|distributed|available|published|provided|offered|covered|governed|shared|dual licen[sc]ed)(?: [^ ]+){0,3}? under(?: the)?(?: terms)?(?: and conditions)?(?: of)?(?: the| an| a)?"
#: Keywords of names that are no ordinary words: such a name is a detection even with no "license" behind it.
DISTINCT = set("agpl agplv3 cc cc0 cddl creative eupl gpl gplv2 gplv3 lgpl lgplv3 odbl sspl unlicense wtfpl zero".split())


class Rule(NamedTuple):
    label: str
    keyword: bytes
    pattern: re.Pattern[bytes]
    priority: int
    weight: float


#: Priorities, the strongest first, and how sure a detection of each is.
WEIGHTS = (0.99, 0.97, 0.95, 0.8, 0.6)
PASSAGE, TAG, GRANTED, NAMED, MENTIONED = range(5)


def _lines(text: str) -> list[list[str]]:
    return [[part.strip() for part in line.split(";", 2)] for line in text.strip().splitlines()]


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in order: passages, then for each license its tag, grant, name and mention."""

    def rule(label: str, keyword: str, pattern: str, priority: int) -> Rule:
        return Rule(label, f" {keyword} ".encode(), re.compile(f"(?<= ){pattern}(?= )".encode()), priority, WEIGHTS[priority])

    made = [rule(label, keyword, pattern, PASSAGE) for label, keyword, pattern in _lines(PASSAGES)]
    tagged = set()
    for label, keyword, name in _lines(LICENSES):
        tag = label.replace("-", " ").replace(".", " ")
        if label not in tagged:
            tagged.add(label)
            made.append(rule(label, "spdx", f"spdx license identifier {tag}(?: only| or later)?", TAG))
            made.append(rule(label, "license", f"license(?: is| expression| name| id| type)? {tag}", GRANTED))
        made.append(rule(label, keyword, f"{GRANT} {name}(?: licen[sc]e)?", GRANTED))
        full = name if "licen[sc]e" in name or keyword in DISTINCT else f"{name}(?: software)?(?: public)? licen[sc]e"
        made.append(rule(label, keyword, full, NAMED))
        made.append(rule(label, keyword, f"(?:by|see|read|accept|terms of|copy of|subject to)(?: the)? {full}", MENTIONED))
    return tuple(made)


#: Bytes to words: A-Z lower-cased, all that is no word (of ASCII) a space. Bytes from 0x80 are parts of words.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Found(NamedTuple):
    start: int
    stop: int
    rule: int


def kept(found: list[Found], ordered: tuple[Rule, ...]) -> list[Found]:
    """The detections that no other suppresses, by place."""
    best = [-1] * len(WEIGHTS)  # for each priority, where the detections so far end at the latest
    out = []
    for d in sorted(found, key=lambda d: (d.start, -d.stop, ordered[d.rule].priority, d.rule)):
        priority = ordered[d.rule].priority
        if max(best[: priority + 1]) < d.stop:
            out.append(d)
        best[priority] = max(best[priority], d.stop)
    return out


def detect(line: bytes, ordered: tuple[Rule, ...]) -> list[Found]:
    """What the rules find in a line of words, as places in words."""
    present = {keyword: keyword in line for keyword in {r.keyword for r in ordered}}
    places = [(m.start(), m.end(), k) for k, r in enumerate(ordered) if present[r.keyword] for m in r.pattern.finditer(line)]
    word, at, out = 0, 0, []  # spaces before a place are counted from the place before
    for start, stop, k in sorted(places):
        word += line.count(b" ", at, start)
        at = start
        out.append(Found(word - 1, word + line.count(b" ", start, stop), k))
    return kept(out, ordered)


SPAN = "struct<label:string,start:bigint,stop:bigint>"
ADDED = {"n_words": "bigint", "base": f"array<{SPAN}>", "found": "array<struct<label:string,start:bigint,stop:bigint,rule:int,weight:double>>"}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ordered = rules()
    phrases = [(re.compile(f"(?<= ){phrase}(?= )".encode()), label, phrase.count(" ") + 1) for phrase, label in BASE]
    base_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
    found_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("rule", pa.int32()), ("weight", pa.float64())]))
    for batch in batches:
        counts, bases, founds = [], [], []
        for text in batch.column("_text").to_pylist():
            own = (text or "").encode().translate(WORDS).split()
            line = b" " + b" ".join(own) + b" "
            counts.append(len(own))
            base = []
            for pattern, label, size in phrases:
                word, at = 0, 0
                for m in pattern.finditer(line):
                    word, at = word + line.count(b" ", at, m.start()), m.start()
                    base.append({"label": label, "start": word - 1, "stop": word - 1 + size})
            bases.append(base)
            founds.append([{"label": ordered[d.rule].label, "start": d.start, "stop": d.stop, "rule": d.rule, "weight": ordered[d.rule].weight} for d in detect(line, ordered)])
        yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(counts, pa.int64()), pa.array(bases, base_type), pa.array(founds, found_type)], names=["_row", *ADDED])


def license_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs``, and n_words, base (places of the base phrases) and found (detections that were kept), in words from 0."""
    rest = [c for c in docs.columns if c not in ADDED]
    keyed = docs.select(F.struct(*rest).alias("_row"), F.col(text).alias("_text"))
    added = StructType.fromDDL(", ".join(f"{c} {kind}" for c, kind in ADDED.items()))
    scanned = keyed.mapInArrow(_scan, StructType([keyed.schema["_row"], *added]))
    return scanned.select(*[F.col("_row").getField(c).alias(c) for c in rest], *ADDED)


def score(found: str = "found", base: str = "base") -> Column:
    """How sure it is that a text states a license: 1 less the product of what each detection leaves in doubt; a base phrase counts as a mention."""
    doubt = F.aggregate(found, F.lit(1.0), lambda acc, d: acc * (1 - d["weight"]))
    return 1 - F.aggregate(base, doubt, lambda acc, _: acc * (1 - WEIGHTS[MENTIONED]))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases, labels and score of every whole text of ``documents``."""
    scanned = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts, labels = F.transform("base", lambda s: s["start"]), F.transform("base", lambda s: s["label"])
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    every = F.concat(labels, F.transform("found", lambda d: d["label"]))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        listed(labels).alias("base_labels"),
        listed(every).alias("labels"),
        score().alias("score"),
    )
