"""Signature rules for licence mentions, over lower-cased words joined by single blanks.

Every match of a rule holds the rule's keyword as a word; names without a common word have an entry for each.
FAMILIES is written by hand: label, keyword, name pattern and short names as written in tags. Each
family gives a tag rule, a grant rule and a name rule; PASSAGES are phrases of licence texts.
"""

from __future__ import annotations

import re

_L = "licen[sc]e"
_V = "(?:version |v|ver )?"

#: label, keyword that must stand in the text as a word, pattern of the name, pattern of short names in tags
FAMILIES = [
    ("mit", "mit", f"mit(?: x11)?(?: style)?(?: public| open source)? {_L}", "mit"),
    ("mit", "x11", "mit x11|x11 mit", "mit"),
    ("mit-0", "mit", f"mit no attribution(?: {_L})?|mit 0(?: {_L})?", "mit 0"),
    ("x11", "x11", f"x11 {_L}", "x11"),
    ("isc", "isc", f"isc {_L}", "isc"),
    ("apache", "apache", f"apache(?: software)?(?: foundation)? {_L}", "apache"),
    ("apache-1.0", "apache", f"apache(?: software)? {_L} {_V}1 0", "apache 1 0"),
    ("apache-1.1", "apache", f"apache(?: software)? {_L} {_V}1 1", "apache 1 1"),
    ("apache-2.0", "apache", f"apache(?: software)?(?: {_L})? {_V}2(?: 0)?", "apache 2 0"),
    ("bsd", "bsd", f"bsd(?: style| type| like)? {_L}", "bsd"),
    ("bsd-0-clause", "bsd", f"(?:zero clause|0 clause) bsd(?: {_L})?|bsd zero clause", "0bsd"),
    ("bsd-1-clause", "bsd", f"(?:1|one) clause bsd(?: {_L})?", "bsd 1 clause"),
    ("bsd-2-clause", "bsd", f"(?:2|two) clause bsd(?: {_L})?|(?:simplified|freebsd) bsd(?: {_L})?|bsd (?:2|two) clause(?: {_L})?", "bsd 2 clause(?: freebsd| netbsd| patent)?"),
    ("bsd-3-clause", "bsd", f"(?:3|three) clause bsd(?: {_L})?|(?:new|revised|modified) bsd(?: {_L})?|bsd (?:3|three) clause(?: {_L})?", "bsd 3 clause(?: clear| lbnl| attribution)?"),
    ("bsd-4-clause", "bsd", f"(?:4|four) clause bsd(?: {_L})?|(?:original|old) bsd(?: {_L})?|bsd (?:4|four) clause(?: {_L})?", "bsd 4 clause(?: uc)?"),
    ("gpl", "general", f"(?:gnu )?general public {_L}", "gpl"),
    ("gpl", "gpl", "gnu gpl|gpl", "gpl"),
    ("gpl-1.0", "general", f"(?:gnu )?general public {_L} {_V}1(?: 0)?", "gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "general", f"(?:gnu )?general public {_L} {_V}2(?: 0)?(?: or later| or any later version)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-2.0", "gplv2", "(?:gnu )?gplv2", "gplv2"),
    ("gpl-3.0", "general", f"(?:gnu )?general public {_L} {_V}3(?: 0)?(?: or later| or any later version)?", "gpl 3 0(?: only| or later)?"),
    ("gpl-3.0", "gplv3", "(?:gnu )?gplv3", "gplv3"),
    ("lgpl", "lesser", f"(?:gnu )?lesser general public {_L}", "lgpl"),
    ("lgpl", "library", f"(?:gnu )?library general public {_L}", "lgpl"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", "lgpl"),
    ("lgpl-2.0", "library", f"(?:gnu )?library general public {_L} {_V}2(?: 0)?", "lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "lesser", f"(?:gnu )?lesser general public {_L} {_V}2 1(?: or later)?", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "lesser", f"(?:gnu )?lesser general public {_L} {_V}3(?: 0)?(?: or later)?", "lgpl 3 0(?: only| or later)?"),
    ("agpl", "affero", f"(?:gnu )?affero general public {_L}", "agpl"),
    ("agpl", "agpl", "(?:gnu )?agpl", "agpl"),
    ("agpl-3.0", "affero", f"(?:gnu )?affero general public {_L} {_V}3(?: 0)?(?: or later)?", "agpl 3 0(?: only| or later)?"),
    ("agpl-3.0", "agplv3", "(?:gnu )?agplv3", "agplv3"),
    ("gfdl", "documentation", f"(?:gnu )?free documentation {_L}", "gfdl"),
    ("mpl", "mozilla", f"mozilla public {_L}", "mpl"),
    ("mpl-1.0", "mozilla", f"mozilla public {_L} {_V}1 0", "mpl 1 0"),
    ("mpl-1.1", "mozilla", f"mozilla public {_L} {_V}1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", f"mozilla public {_L} {_V}2(?: 0)?", "mpl 2 0(?: no copyleft exception)?"),
    ("npl", "netscape", f"netscape public {_L}", "npl 1 [01]"),
    ("epl", "eclipse", f"eclipse public {_L}", "epl"),
    ("epl-1.0", "eclipse", f"eclipse public {_L} {_V}1(?: 0)?", "epl 1 0"),
    ("epl-2.0", "eclipse", f"eclipse public {_L} {_V}2(?: 0)?", "epl 2 0"),
    ("edl", "eclipse", f"eclipse distribution {_L}", "edl 1 0"),
    ("cpl", "common", f"common public {_L}", "cpl 1 0"),
    ("cddl", "cddl", "cddl", "cddl 1 [01]"),
    ("cddl", "common", f"common development and distribution {_L}", "cddl"),
    ("cpal", "attribution", f"common public attribution {_L}", "cpal 1 0"),
    ("ibm-public", "ibm", f"ibm public {_L}", "ipl 1 0"),
    ("artistic", "artistic", f"artistic {_L}", "artistic"),
    ("artistic-1.0", "artistic", f"artistic {_L} {_V}1(?: 0)?", "artistic 1 0(?: perl| cl8)?"),
    ("artistic-2.0", "artistic", f"artistic {_L} {_V}2(?: 0)?", "artistic 2 0"),
    ("perl", "perl", f"same terms as perl(?: itself)?|perl {_L}", "perl"),
    ("python", "python", f"python(?: software foundation)? {_L}", "python 2 0"),
    ("psf", "psf", f"psf {_L}", "psf 2 0"),
    ("ruby", "ruby", f"ruby {_L}", "ruby"),
    ("php", "php", f"php {_L}", "php 3 0(?: 1)?"),
    ("zope", "zope", f"zope public {_L}", "zpl 2 [01]"),
    ("zlib", "zlib", f"zlib(?: libpng)? {_L}", "zlib(?: acknowledgement)?"),
    ("libpng", "libpng", f"libpng {_L}", "libpng(?: 2 0)?"),
    ("boost", "boost", f"boost(?: software)? {_L}", "bsl 1 0"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("beerware", "beerware", f"beerware(?: {_L})?", "beerware"),
    ("public-domain", "domain", "(?:released|placed|dedicated|dedicate|is|are) (?:in|into|to)?(?: )?(?:the )?public domain", "public domain"),
    ("cc0", "cc0", f"cc0(?: 1 0)?(?: universal)?(?: {_L})?", "cc0 1 0"),
    ("cc-by", "commons", f"creative commons attribution(?: {_L})?(?: [1234] 0)?(?: international| unported| generic)?(?: {_L})?", "cc by [1234] 0"),
    ("cc-by-sa", "commons", f"creative commons attribution share ?alike(?: {_L})?(?: [1234] 0)?(?: international| unported)?(?: {_L})?", "cc by sa [1234] 0"),
    ("cc-by-nd", "commons", f"creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: [1234] 0)?(?: {_L})?", "cc by nd [1234] 0"),
    ("cc-by-nc", "commons", f"creative commons attribution non ?commercial(?: [1234] 0)?(?: {_L})?", "cc by nc [1234] 0"),
    ("cc-by-nc-sa", "commons", f"creative commons attribution non ?commercial share ?alike(?: [1234] 0)?(?: {_L})?", "cc by nc sa [1234] 0"),
    ("cc-by-nc-nd", "commons", f"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1234] 0)?(?: {_L})?", "cc by nc nd [1234] 0"),
    ("cc", "commons", f"creative commons {_L}", "cc"),
    ("odbl", "odbl", f"odbl(?: {_L})?", "odbl 1 0"),
    ("odbl", "database", f"open (?:data commons open )?database {_L}", "odbl"),
    ("pddl", "pddl", "pddl", "pddl 1 0"),
    ("odc-by", "odc", f"odc(?: by| attribution)? {_L}", "odc by 1 0"),
    ("ofl", "font", f"(?:sil )?open font {_L}(?: 1 [01])?", "ofl 1 [01]"),
    ("afl", "academic", f"academic free {_L}", "afl [123] [012]"),
    ("osl", "osl", "osl 3 0", "osl [123] [01]"),
    ("osl", "open", f"open software {_L}", "osl"),
    ("ecl", "educational", f"educational community {_L}", "ecl [12] 0"),
    ("eupl", "eupl", "eupl", "eupl 1 [012]"),
    ("eupl", "european", f"european union public {_L}", "eupl"),
    ("cecill", "cecill", f"cecill(?: [bc])?(?: {_L})?", "cecill(?: [bc])?(?: [12] [01])?"),
    ("mulan", "mulan", f"mulan (?:permissive|public)(?: software)? {_L}", "mulanpsl [12] 0"),
    ("ms-pl", "microsoft", f"microsoft public {_L}", "ms pl"),
    ("ms-rl", "microsoft", f"microsoft reciprocal {_L}", "ms rl"),
    ("ncsa", "ncsa", f"(?:university of illinois )?ncsa(?: open source)? {_L}", "ncsa"),
    ("openssl", "openssl", f"openssl {_L}", "openssl"),
    ("ssleay", "ssleay", f"(?:original )?ssleay {_L}", "ssleay"),
    ("sspl", "side", f"server side public {_L}", "sspl 1 0"),
    ("elastic", "elastic", f"elastic {_L}(?: 2(?: 0)?)?", "elastic 2 0"),
    ("busl", "business", f"business source {_L}(?: 1 1)?", "busl 1 1"),
    ("polyform", "polyform", f"polyform (?:noncommercial|small business|strict|shield|perimeter)(?: {_L})?", "polyform \\w+ 1 0 0"),
    ("openrail", "openrail", f"(?:creativeml )?openrail(?: m| \\+\\+)?(?: {_L})?", "openrail(?: m)?"),
    ("llama", "llama", f"llama(?: [23])?(?: [123])? community {_L}", "llama[23]"),
    ("vim", "vim", f"vim {_L}", "vim"),
    ("tcl", "tcl", f"tcl(?: tk)? {_L}", "tcl"),
    ("curl", "curl", f"curl {_L}", "curl"),
    ("icu", "icu", f"icu {_L}", "icu"),
    ("unicode", "unicode", f"unicode(?: data files and software)? {_L}", "unicode (?:dfs 2016|3 0|tou)"),
    ("w3c", "w3c", f"w3c(?: software)?(?: notice and)? {_L}", "w3c(?: 20150513)?"),
    ("freetype", "freetype", f"freetype(?: project)? {_L}", "ftl"),
    ("postgresql", "postgresql", f"postgresql {_L}", "postgresql"),
    ("upl", "universal", f"universal permissive {_L}", "upl 1 0"),
    ("qpl", "q", f"q public {_L}", "qpl 1 0"),
    ("qpl", "qpl", "qpl", "qpl 1 0"),
    ("latex", "latex", f"latex project public {_L}", "lppl 1 [0123]c?"),
    ("lppl", "lppl", "lppl", "lppl"),
    ("sleepycat", "sleepycat", f"sleepycat {_L}", "sleepycat"),
    ("json", "json", f"json {_L}", "json"),
    ("proprietary", "proprietary", f"proprietary(?: and confidential| software)?(?: {_L})?", "proprietary"),
    ("commercial", "commercial", f"commercial {_L}", "commercial"),
    ("eula", "agreement", f"end user {_L} agreement", "eula"),
    ("eula", "eula", "eula", "eula"),
    ("shareware", "shareware", "shareware", "shareware"),
]

#: label, keyword, pattern of a passage of the licence's own text
PASSAGES = [
    ("mit", "obtaining", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "merchantability", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("isc", "hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", "neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "apache", f"licensed under the apache {_L} version 2 0 the {_L}"),
    ("apache-2.0", "compliance", f"you may not use this file except in compliance with the {_L}"),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("lgpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e"),
    ("agpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e"),
    ("mpl-2.0", "mozilla", f"this source code form is subject to the terms of the mozilla public {_L} v 2 0"),
    ("unlicense", "unencumbered", "free and unencumbered software released into the public domain"),
    ("boost", "boost", f"boost software {_L} version 1 0 17 august 2003|distributed under the boost software {_L}"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("cc-by", "commons", f"this work is licensed under a creative commons attribution .{{0,40}}?{_L}"),
    ("wtfpl", "fuck", "do what the fuck you want to public licen[sc]e"),
    ("ofl", "font", f"this font software is licensed under the sil open font {_L}"),
    ("proprietary", "reserved", "all rights reserved"),
    ("copyleft", "copyleft", "copyleft"),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)\\d\\d(?: (?:19|20)\\d\\d)?"),
    ("license-file", "see", f"see (?:the )?(?:accompanying )?(?:file )?{_L}(?: file| txt| md)? (?:file )?(?:in the|for|that)"),
    ("license-tag", "spdx", f"spdx {_L} identifier"),
    ("dual", "dual", f"dual {_L}d?|dual licensed"),
]

#: lower priority numbers win among detections of the same words; the confidence goes into the score
_TAG, _TEXT, _GRANT, _NAME = (0, 1.0), (1, 0.95), (2, 0.9), (3, 0.6)
_GRANTED = ("(?:licen[sc]ed|released|distributed|available|provided|published|covered|shared|governed)"
            "(?: to you| only)? (?:under|by|with)(?: the)?(?: terms of)?(?: the| an?)? ")

#: base phrases and labels
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]


def needed(pattern: str) -> str:
    """A piece that each match of a pattern holds besides the keyword: ``licen`` where every alternative has it
    outside of groups, else nothing."""
    before = None
    while before != pattern:
        before, pattern = pattern, re.sub(r"\(\?:[^()]*\)\??", "", pattern)
    return "licen" if all("licen" in part for part in pattern.split("|")) else ""


def rules() -> list[dict]:
    """All rules: ``label``, ``keyword``, ``needed`` piece, ``pattern``, ``priority`` and ``weight``."""
    found = []
    for label, keyword, name, short in FAMILIES:
        for (priority, weight), key, piece, pattern in (
                (_TAG, "spdx", "licen", f"spdx {_L} identifier (?:{short})"),
                (_GRANT, keyword, needed(name), f"{_GRANTED}(?:{name})"),
                (_NAME, keyword, needed(name), f"(?:{name})")):
            found.append({"label": label, "keyword": key, "needed": piece, "pattern": pattern, "priority": priority,
                          "weight": weight})
    for label, keyword, pattern in PASSAGES:
        found.append({"label": label, "keyword": keyword, "needed": needed(pattern), "pattern": f"(?:{pattern})",
                      "priority": _TEXT[0], "weight": _TEXT[1]})
    return found


#: all keywords: every text that any rule matches holds one of them as a word
ANCHORS = sorted({rule["keyword"] for rule in rules()})
