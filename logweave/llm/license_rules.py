"""Signature rules for licences, over text in lower case whose words are parted by one space.

A rule is a label, a priority (smaller wins), a confidence, two keywords that must occur for the pattern to
be tried (the second may be empty), and a pattern that matches whole words. Families of licences are written as a name and its
variants, from which the rules for identifiers, notices and full names follow in one order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    score: float
    keyword: str
    pattern: str
    also: str = ""


GRANT = r"(?:licensed|released|distributed|available|published|provided|covered) (?:\w+ ){0,4}?(?:under|by) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
TAG = r"spdx license identifier (?:\w+ (?:or|and|with) )?"
OR_LATER = r"(?: or (?:at your option )?(?:any )?(?:later|newer)(?: version)?| only)?"

#: Label, keyword, name, and identifier as words. Patterns are joined to notices and tags below.
NAMED = [
    ("apache-2.0", "apache", r"apache (?:software )?license (?:version |v )?2(?: 0)?", r"apache 2(?: 0)?"),
    ("apache-1.1", "apache", r"apache (?:software )?license (?:version |v )?1 1", r"apache 1 1"),
    ("apache-1.0", "apache", r"apache (?:software )?license (?:version |v )?1 0", r"apache 1 0"),
    ("mit", "mit|expat", r"(?:the )?mit x11 license|mit licence|mit expat license|expat license", r"mit"),
    ("mit-0", "mit", r"mit no attribution(?: license)?", r"mit 0"),
    ("x11", "x11|x consortium", r"x11 license|x consortium license", r"x11"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd|freebsd) license", r"bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd) license", r"bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|old bsd|bsd 4 clause|4 clause bsd|four clause bsd) license", r"bsd 4 clause"),
    ("0bsd", "bsd", r"(?:bsd zero clause|zero clause bsd|bsd 0 clause) license", r"0bsd"),
    ("isc", "isc", r"isc license", r"isc"),
    ("gpl-1.0", "gpl|general public", r"(?:gnu )?(?:general public license|gpl) (?:version |v )?1(?: 0)?", r"gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "gpl|general public", r"(?:gnu )?(?:general public license|gpl) (?:version |v )?2(?: 0)?|gplv2", r"gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "gpl|general public", r"(?:gnu )?(?:general public license|gpl) (?:version |v )?3(?: 0)?|gplv3", r"gpl 3 0(?: only| or later)?"),
    ("lgpl-2.0", "lgpl|general public", r"(?:gnu )?(?:library general public license|lgpl) (?:version |v )?2(?: 0)?", r"lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "lgpl|general public", r"(?:gnu )?(?:lesser general public license|lgpl) (?:version |v )?2 1|lgplv2 1", r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "lgpl|general public", r"(?:gnu )?(?:lesser general public license|lgpl) (?:version |v )?3(?: 0)?|lgplv3", r"lgpl 3 0(?: only| or later)?"),
    ("agpl-1.0", "agpl|general public", r"affero general public license (?:version |v )?1(?: 0)?", r"agpl 1 0"),
    ("agpl-3.0", "agpl|general public", r"(?:gnu )?(?:affero general public license|agpl) (?:version |v )?3(?: 0)?|agplv3", r"agpl 3 0(?: only| or later)?"),
    ("gfdl-1.1", "free documentation", r"gnu free documentation license (?:version |v )?1 1", r"gfdl 1 1"),
    ("gfdl-1.2", "free documentation", r"gnu free documentation license (?:version |v )?1 2", r"gfdl 1 2"),
    ("gfdl-1.3", "free documentation", r"gnu free documentation license (?:version |v )?1 3", r"gfdl 1 3"),
    ("mpl-1.0", "mozilla|mpl", r"mozilla public license (?:version |v )?1 0", r"mpl 1 0"),
    ("mpl-1.1", "mozilla|mpl", r"mozilla public license (?:version |v )?1 1", r"mpl 1 1"),
    ("mpl-2.0", "mozilla|mpl", r"mozilla public license (?:version |v )?2(?: 0)?", r"mpl 2 0"),
    ("epl-1.0", "eclipse|epl", r"eclipse public license (?:version |v )?1 0", r"epl 1 0"),
    ("epl-2.0", "eclipse|epl", r"eclipse public license (?:version |v )?2 0", r"epl 2 0"),
    ("cddl-1.0", "cddl|development and distribution", r"common development and distribution license(?: (?:version |v )?1 0)?", r"cddl 1 0"),
    ("cpl-1.0", "common public", r"common public license(?: (?:version |v )?1 0)?", r"cpl 1 0"),
    ("eupl-1.1", "european union|eupl", r"european union public licen[cs]e (?:version |v )?1 1", r"eupl 1 1"),
    ("eupl-1.2", "european union|eupl", r"european union public licen[cs]e (?:version |v )?1 2", r"eupl 1 2"),
    ("artistic-1.0", "artistic", r"artistic license (?:version |v )?1 0", r"artistic 1 0"),
    ("artistic-2.0", "artistic", r"artistic license (?:version |v )?2(?: 0)?", r"artistic 2 0"),
    ("bsl-1.0", "boost", r"boost software license(?: (?:version |v )?1 0)?", r"bsl 1 0"),
    ("busl-1.1", "business source", r"business source license(?: (?:version |v )?1 1)?", r"busl 1 1"),
    ("sspl-1.0", "server side", r"server side public license(?: (?:version |v )?1)?", r"sspl 1 0"),
    ("unlicense", "unlicense", r"the unlicense", r"unlicense"),
    ("wtfpl", "want to public|wtfpl", r"do what the fuck you want to public license", r"wtfpl"),
    ("zlib", "zlib", r"zlib(?: libpng)? license", r"zlib"),
    ("libpng", "libpng", r"libpng license", r"libpng(?: 2 0)?"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", r"postgresql"),
    ("psf-2.0", "python", r"python software foundation license(?: (?:version |v )?2)?", r"psf 2 0|python 2 0"),
    ("ruby", "ruby", r"ruby license", r"ruby"),
    ("php-3.01", "php", r"php license (?:version |v )?3 01", r"php 3 01"),
    ("openssl", "openssl", r"openssl license", r"openssl"),
    ("ncsa", "ncsa|illinois", r"university of illinois (?:ncsa )?open source license|ncsa open source license", r"ncsa"),
    ("ofl-1.1", "open font|ofl", r"(?:sil )?open font license(?: (?:version |v )?1 1)?", r"ofl 1 1"),
    ("odbl-1.0", "open database|odbl", r"open database license(?: (?:version |v )?1 0)?", r"odbl 1 0"),
    ("odc-by-1.0", "open data commons|odc", r"open data commons attribution license(?: (?:version |v )?1 0)?", r"odc by 1 0"),
    ("pddl-1.0", "public domain dedication|pddl", r"public domain dedication and license(?: (?:version |v )?1 0)?", r"pddl 1 0"),
    ("cc0-1.0", "cc0|creative commons", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?|creative commons zero(?: (?:version |v )?1 0)?(?: universal)?", r"cc0 1 0"),
    ("ms-pl", "microsoft", r"microsoft public license", r"ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license", r"ms rl"),
    ("mulan-psl-2.0", "mulan", r"mulan permissive software license (?:version |v )?2", r"mulanpsl 2 0"),
    ("upl-1.0", "universal permissive", r"universal permissive license(?: (?:version |v )?1 0)?", r"upl 1 0"),
    ("vim", "vim", r"vim license", r"vim"),
    ("curl", "curl", r"curl license", r"curl"),
    ("afl-3.0", "academic free", r"academic free license(?: (?:version |v )?3 0)?", r"afl 3 0"),
    ("osl-3.0", "open software license", r"open software license(?: (?:version |v )?3 0)?", r"osl 3 0"),
    ("ecl-2.0", "educational community", r"educational community license(?: (?:version |v )?2 0)?", r"ecl 2 0"),
    ("blueoak-1.0.0", "blue oak", r"blue oak model license(?: 1 0 0)?", r"blueoak 1 0 0"),
]

#: Creative Commons deeds: short label, words of the deed.
DEEDS = [("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nc", "attribution non ?commercial"), ("by-nd", "attribution no ?deriv(?:ative)?s?(?: works)?"), ("by-nc-sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?")]
DEED_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: Sentences of licence texts, and notices that name no version: label, confidence, keyword, pattern.
SENTENCES = [
    ("mit", 0.95, "free of charge", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", 0.8, "noninfringement", r"warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", 0.85, "mit", r"(?:released|licensed|distributed|available) under (?:the )?mit(?: license)?"),
    ("isc", 0.9, "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", 0.85, "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 0.6, "bsd", r"bsd(?: style)? license"),
    ("bsd-3-clause", 0.8, "endorse", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", 0.85, "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment"),
    ("apache-2.0", 0.95, "apache", r"licensed under the apache license version 2 0 the license"),
    ("apache-2.0", 0.8, "as is", r"distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache", 0.6, "apache", r"apache software license|apache style license"),
    ("gpl", 0.9, "free software", r"free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", 0.7, "general public", r"gnu general public license"),
    ("gpl", 0.5, "gpl", r"gnu gpl|gpl licensed|gpl license"),
    ("gpl-2.0", 0.85, "general public", r"general public license as published by the free software foundation either version 2"),
    ("gpl-3.0", 0.85, "general public", r"general public license as published by the free software foundation either version 3"),
    ("lgpl", 0.8, "lesser", r"(?:gnu )?lesser general public license"),
    ("lgpl", 0.8, "library general", r"(?:gnu )?library general public license"),
    ("lgpl", 0.5, "lgpl", r"gnu lgpl|lgpl licensed|lgpl license"),
    ("agpl", 0.8, "affero", r"(?:gnu )?affero general public license"),
    ("mpl", 0.7, "mozilla", r"mozilla public license"),
    ("mpl-2.0", 0.95, "mozilla", r"subject to the terms of the mozilla public license v 2 0"),
    ("epl", 0.7, "eclipse", r"eclipse public license"),
    ("eupl", 0.7, "european union", r"european union public licen[cs]e"),
    ("artistic", 0.6, "artistic", r"(?:perl )?artistic license"),
    ("cc", 0.6, "creative commons", r"creative commons(?: public)? license|creative commons"),
    ("cc", 0.7, "creativecommons", r"creativecommons org licenses"),
    ("cc0-1.0", 0.9, "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", 0.9, "public domain", r"(?:dedicated|released|placed|contributed) (?:\w+ ){0,3}?(?:to|into|in) the public domain"),
    ("public-domain", 0.5, "public domain", r"public domain"),
    ("unlicense", 0.95, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("zlib", 0.85, "misrepresented", r"the origin of this software must not be misrepresented"),
    ("bsl-1.0", 0.85, "boost", r"distributed under the boost software license"),
    ("ofl-1.1", 0.8, "reserved font", r"with reserved font name"),
    ("wtfpl", 0.8, "what the", r"do what the f\w* you want to"),
    ("proprietary", 0.7, "rights reserved", r"all rights reserved"),
    ("proprietary", 0.8, "proprietary", r"proprietary and confidential|confidential and proprietary"),
    ("proprietary", 0.8, "unauthori", r"unauthori[sz]ed (?:copying|use|reproduction|distribution) (?:\w+ ){0,12}?(?:is )?(?:strictly )?prohibited"),
    ("commercial", 0.6, "commercial", r"commercial license(?: agreement)?"),
    ("eula", 0.7, "end user", r"end user license agreement"),
    ("non-commercial", 0.6, "non commercial", r"for non commercial (?:use|purposes) only"),
    ("copyright-notice", 0.4, "copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?"),
]

#: Words of which a document must have one before any rule's keyword is looked for; every match of a rule has one.
STEMS = ("licen", "copyright", "gpl", "spdx", "rights reserved", "public domain", "common", "permission", "redistribution", "warrant", "proprietary", "prohibited", "apache", "mozilla", "unencumbered", "misrepresented", "advertising", "endorse", "reserved font", "non commercial", "cc0", "what the", " cc by ", " mit no attribution ", " under mit ", " under the mit ")


def rules() -> list[Rule]:
    """All rules in order: tags (1), versioned notices (2), versioned names (3), sentences (4), bare identifiers in a licence field (5)."""
    out: list[Rule] = []
    named = list(NAMED)
    for deed, words in DEEDS:
        for v in DEED_VERSIONS:
            dotted = v.replace(".", " ")
            named.append((f"cc-{deed}-{v}", "creative commons|cc by", rf"creative commons {words}(?: license)? (?:version |v )?{dotted}(?: international| unported| generic)?|cc {deed.replace('-', ' ')} {dotted}", rf"cc {deed.replace('-', ' ')} {dotted}"))
    for label, keyword, name, ident in named:
        for k in keyword.split("|"):
            k = f" {k} " if len(k) < 4 and label.startswith(k) and k not in ("gpl", "mpl", "epl", "bsd") else k
            out.append(Rule(label, 2, 0.95, k, rf"{GRANT}(?:{name}){OR_LATER}"))
            out.append(Rule(label, 3, 0.8, k, rf"(?:{name}){OR_LATER}"))
        out.append(Rule(label, 1, 1.0, "spdx license identifier", rf"{TAG}(?:{ident})"))
        out.append(Rule(label, 5, 0.5, "license", rf"license (?:is |type |name |field |id )?(?:{ident})", " " + re.match(r"\w+ ?", ident.split("|")[0])[0] if "|" not in ident else ""))
    out += [Rule(label, 4, score, keyword, pattern) for label, score, keyword, pattern in SENTENCES]
    return sorted(out, key=lambda r: r.priority)
