"""Signature rules of the license scan.

Every rule is (label, priority, confidence, keywords, expression).  Expressions are matched against a
text's words, lower-cased and joined by single spaces, and stand on word boundaries; a rule is tried
only in texts that hold all its keywords.  Names are combined with the phrases that grant, tag and
mention a license; sentences of the licenses themselves stand on their own.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    confidence: float
    keywords: tuple[str, ...]
    expression: str


#: The phrases that every scan counts, whatever else is found: label and words.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
BASE_PRIORITY, BASE_CONFIDENCE = 0, 0.5

_LICENSE = "licen[cs]e"
_V = "(?: (?:version|v|ver))?"
#: label, keyword, the license's name, its identifier in tags.
FAMILIES = (
    ("mit", "mit", f"mit(?: open source)? {_LICENSE}", "mit"),
    ("mit-0", "mit", f"mit no attribution(?: {_LICENSE})?", "mit 0"),
    ("x11", "x11", f"(?:mit x11|x11)(?: {_LICENSE})?", "x11"),
    ("isc", "isc", f"isc {_LICENSE}", "isc"),
    ("bsd-0-clause", "bsd", f"(?:zero|0) clause bsd(?: {_LICENSE})?", "0bsd"),
    ("bsd-2-clause", "bsd", f"(?:simplified bsd|freebsd|bsd 2 clause|(?:two|2) clause bsd)(?: {_LICENSE})?", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", f"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|(?:three|3) clause bsd)(?: {_LICENSE})?", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", f"(?:original bsd|bsd 4 clause|(?:four|4) clause bsd)(?: {_LICENSE})?", "bsd 4 clause"),
    ("bsd", "bsd", f"bsd(?: style)? {_LICENSE}", "bsd"),
    ("apache-1.0", "apache", f"apache(?: software)?(?: {_LICENSE})?{_V} 1 0", "apache 1 0"),
    ("apache-1.1", "apache", f"apache(?: software)?(?: {_LICENSE})?{_V} 1 1", "apache 1 1"),
    ("apache-2.0", "apache", f"apache(?: software)?(?: {_LICENSE})?{_V} 2(?: 0)?", "apache 2 0"),
    ("gpl-1.0", "gnu", f"(?:gnu )?(?:gpl|general public {_LICENSE}){_V} 1(?: 0)?", "gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "gnu", f"gnu (?:gpl|general public {_LICENSE}){_V} 2(?: 0)?", "gpl 2 0(?: only)?"),
    ("gpl-2.0-or-later", "gnu", f"gnu (?:gpl|general public {_LICENSE}){_V} 2(?: 0)? or(?: at your option)?(?: any)? later(?: version)?", "gpl 2 0 or later"),
    ("gpl-3.0", "gnu", f"gnu (?:gpl|general public {_LICENSE}){_V} 3(?: 0)?", "gpl 3 0(?: only)?"),
    ("gpl-3.0-or-later", "gnu", f"gnu (?:gpl|general public {_LICENSE}){_V} 3(?: 0)? or(?: at your option)?(?: any)? later(?: version)?", "gpl 3 0 or later"),
    ("lgpl-2.0", "lesser", f"(?:gnu )?(?:lesser|library) general public {_LICENSE}{_V} 2(?: 0)?", "lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "lesser", f"(?:gnu )?(?:lesser|library) general public {_LICENSE}{_V} 2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "lesser", f"(?:gnu )?(?:lesser|library) general public {_LICENSE}{_V} 3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("lgpl", "lesser", f"(?:gnu )?(?:lesser|library) general public {_LICENSE}", "lgpl"),
    ("agpl-1.0", "affero", f"affero general public {_LICENSE}{_V} 1(?: 0)?", "agpl 1 0(?: only| or later)?"),
    ("agpl-3.0", "affero", f"(?:gnu )?affero general public {_LICENSE}{_V} 3(?: 0)?", "agpl 3 0(?: only| or later)?"),
    ("agpl", "affero", f"(?:gnu )?affero general public {_LICENSE}", "agpl"),
    ("gfdl", "documentation", f"(?:gnu )?free documentation {_LICENSE}", "gfdl 1 [1-3](?: only| or later)?"),
    ("mpl-1.1", "mozilla", f"mozilla public {_LICENSE}{_V} 1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", f"mozilla public {_LICENSE}{_V} 2(?: 0)?", "mpl 2 0"),
    ("mpl", "mozilla", f"mozilla public {_LICENSE}", "mpl"),
    ("epl-1.0", "eclipse", f"eclipse public {_LICENSE}{_V} 1(?: 0)?", "epl 1 0"),
    ("epl-2.0", "eclipse", f"eclipse public {_LICENSE}{_V} 2(?: 0)?", "epl 2 0"),
    ("edl-1.0", "eclipse", f"eclipse distribution {_LICENSE}(?:{_V} 1(?: 0)?)?", "edl 1 0"),
    ("cddl-1.0", "cddl", f"(?:common development and distribution {_LICENSE} )?cddl{_V} 1(?: 0)?", "cddl 1 0"),
    ("cddl-1.1", "cddl", f"(?:common development and distribution {_LICENSE} )?cddl{_V} 1 1", "cddl 1 1"),
    ("cpl-1.0", "common", f"common public {_LICENSE}(?:{_V} 1(?: 0)?)?", "cpl 1 0"),
    ("ipl-1.0", "ibm", f"ibm public {_LICENSE}(?:{_V} 1(?: 0)?)?", "ipl 1 0"),
    ("eupl-1.1", "european", f"european union public {_LICENSE}{_V} 1 1", "eupl 1 1"),
    ("eupl-1.2", "european", f"european union public {_LICENSE}{_V} 1 2", "eupl 1 2"),
    ("osl-3.0", "open", f"open software {_LICENSE}{_V} 3(?: 0)?", "osl 3 0"),
    ("afl-3.0", "academic", f"academic free {_LICENSE}(?:{_V} 3(?: 0)?)?", "afl 3 0"),
    ("artistic-1.0", "artistic", f"artistic {_LICENSE}{_V} 1(?: 0)?", "artistic 1 0(?: perl)?"),
    ("artistic-2.0", "artistic", f"artistic {_LICENSE}{_V} 2(?: 0)?", "artistic 2 0"),
    ("artistic", "artistic", f"(?:perl )?artistic {_LICENSE}", "artistic"),
    ("boost-1.0", "boost", f"boost software {_LICENSE}(?:{_V} 1(?: 0)?)?", "bsl 1 0"),
    ("zlib", "zlib", f"zlib(?: libpng)? {_LICENSE}", "zlib"),
    ("libpng", "libpng", f"libpng {_LICENSE}(?:{_V} 2(?: 0)?)?", "libpng(?: 2 0)?"),
    ("python-2.0", "python", f"(?:python software foundation|psf|python) {_LICENSE}(?:{_V} 2(?: 0)?)?", "(?:python|psf) 2 0"),
    ("php-3.01", "php", f"php {_LICENSE}(?:{_V} 3(?: 0(?: )?1)?)?", "php 3 01"),
    ("ruby", "ruby", f"ruby(?: s)? {_LICENSE}", "ruby"),
    ("postgresql", "postgresql", f"postgresql {_LICENSE}", "postgresql"),
    ("openssl", "openssl", f"openssl {_LICENSE}", "openssl"),
    ("curl", "curl", f"curl {_LICENSE}", "curl"),
    ("ncsa", "ncsa", f"(?:university of illinois )?ncsa(?: open source)? {_LICENSE}", "ncsa"),
    ("w3c", "w3c", f"w3c(?: software(?: notice)?)?(?: and)? {_LICENSE}", "w3c(?: 20150513)?"),
    ("wtfpl", "wtfpl", f"wtfpl(?: {_LICENSE})?", "wtfpl"),
    ("beerware", "beer", f"beer(?: )?ware {_LICENSE}", "beerware"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    ("ms-pl", "microsoft", f"microsoft public {_LICENSE}", "ms pl"),
    ("ms-rl", "microsoft", f"microsoft reciprocal {_LICENSE}", "ms rl"),
    ("upl-1.0", "universal", f"universal permissive {_LICENSE}(?:{_V} 1(?: 0)?)?", "upl 1 0"),
    ("odbl-1.0", "database", f"open (?:data commons open )?database {_LICENSE}(?:{_V} 1(?: 0)?)?", "odbl 1 0"),
    ("odc-by-1.0", "attribution", f"open data commons attribution {_LICENSE}(?:{_V} 1(?: 0)?)?", "odc by 1 0"),
    ("ofl-1.1", "font", f"(?:sil )?open font {_LICENSE}(?:{_V} 1 1)?", "ofl 1 1"),
    ("cecill-2.1", "cecill", f"cecill(?: free software)?(?: {_LICENSE})?(?:{_V} 2(?: 1)?)?", "cecill 2 1"),
    ("sspl-1.0", "server", f"server side public {_LICENSE}(?:{_V} 1(?: 0)?)?", "sspl 1 0"),
    ("busl-1.1", "business", f"business source {_LICENSE}(?:{_V} 1 1)?", "busl 1 1"),
    ("elastic-2.0", "elastic", f"elastic {_LICENSE}(?:{_V} 2(?: 0)?)?", "elastic 2 0"),
    ("openrail-m", "openrail", f"openrail(?: m| \\+\\+)?(?: {_LICENSE})?", "openrail"),
)
#: Creative Commons: label of the variant, its words in full and in short.
COMMONS = (
    ("by", "attribution", "by"), ("by-sa", "attribution share(?: )?alike", "by sa"), ("by-nd", "attribution no(?: )?deriv(?:s|atives)", "by nd"),
    ("by-nc", "attribution non(?: )?commercial", "by nc"), ("by-nc-sa", "attribution non(?: )?commercial share(?: )?alike", "by nc sa"),
    ("by-nc-nd", "attribution non(?: )?commercial no(?: )?deriv(?:s|atives)", "by nc nd"),
)
COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Sentences of the licenses: label, keyword, expression.
SENTENCES = (
    ("mit", "sublicense", "permission is hereby granted free of charge to any person obtaining a copy of this software(?: [^ ]+){1,60} use copy modify merge publish distribute sublicense"),
    ("mit", "noninfringement", "warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("isc", "hereby", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", "neither the name of(?: [^ ]+){1,20} may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "acknowledgement", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("apache-2.0", "compliance", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "apache", "www apache org licenses license 2 0(?: txt| html)?"),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "copyleft", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("lgpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", "gnu", "www gnu org licenses(?: (?:old licenses )?gpl(?: [123](?: 0)?)?(?: txt| html)?)?"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl-2.0", "mozilla", "mozilla org mpl 2 0"),
    ("epl-2.0", "eclipse", "made available under the terms of the eclipse public license"),
    ("boost-1.0", "boost", "distributed under the boost software license version 1 0"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck", "do what the fuck you want to public license"),
    ("public-domain", "domain", "(?:released|placed|dedicated)(?: in)?(?:to)? the public domain"),
    ("public-domain", "domain", "(?:is|are) in the public domain"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("proprietary", "confidential", "proprietary and confidential"),
    ("proprietary", "reserved", "all rights reserved"),
    ("proprietary", "prohibited", "unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: [^ ]+){1,25} is strictly prohibited"),
    ("ofl-1.1", "sil", "scripts sil org ofl"),
    ("odbl-1.0", "opendatacommons", "opendatacommons org licenses odbl(?: 1 0)?"),
    ("openrail-m", "restrictions", "use based restrictions as referenced in(?: [^ ]+){1,8} openrail"),
)
GRANT = "(?:licen[cs]ed|released|distributed|available|provided|published|covered|shared|offered)(?: [^ ]+){0,3} (?:under|by)(?: the)?(?: terms? of(?: the)?)?"


def rules() -> list[Rule]:
    """All rules in order; of detections of one place the earlier rule wins at equal priority."""
    out = [Rule(label, 4, 0.95, (keyword,), expression) for label, keyword, expression in SENTENCES]
    families = list(FAMILIES)
    for version in COMMONS_VERSIONS:
        spaced = version.replace(".", " ")
        for label, words, short in COMMONS:
            out.append(Rule(f"cc-{label}-{version}", 4, 0.95, ("creativecommons",), f"creativecommons org licenses {short} {spaced}"))
            families.append((f"cc-{label}-{version}", "cc", f"(?:creative commons {short}|cc {short}){_V} {spaced}(?: international| unported)?(?: {_LICENSE})?", f"cc {short} {spaced}"))
            families.append((f"cc-{label}-{version}", "commons", f"creative commons {words}{_V} {spaced}(?: international| unported)?(?: {_LICENSE})?", f"cc {short} {spaced}"))
    for label, keyword, name, tag in families:
        out.append(Rule(label, 3, 0.9, (keyword, "under"), f"{GRANT} {name}"))
        if keyword == "commons":
            out.append(Rule(label, 2, 0.8, ("commons", "license"), f"{_LICENSE} {name}"))
        else:
            out.append(Rule(label, 3, 0.9, ("spdx",), f"spdx license identifier {tag}"))
        out.append(Rule(label, 1, 0.6, (keyword,), name))
    return out
