"""Hand-written license signatures, in order of priority inside a license.

Rules see a text as its lower-case alphanumeric words joined by one space, so
punctuation never matters: ``apache-2.0`` reads ``apache 2 0``. Each entry has a
label, a priority (higher suppresses what it contains or equals), a keyword that
every match of its patterns holds (they are tried only where it occurs), and patterns from the most to the
least telling: grant or title wording, identifiers, addresses, short mentions.
"""

from __future__ import annotations

V = r"(?: v| ver| version)? ?"  # an optional word for "version"
LIC = r"licen[cs]ed?"

#: label, priority, keyword, patterns
SIGNATURES: list[tuple[str, int, str, list[str]]] = [
    ("mit", 60, "mit", [rf"released under the mit licen[cs]e", rf"{LIC} under the (?:terms of the )?mit(?: x11)? licen[cs]e", r"the mit licen[cs]e mit", r"spdx licen[cs]e identifier mit\b(?! 0)", r"opensource org licen[cs]es mit\b", r"mit licen[cs]e", r"licen[cs]e mit\b"]),
    ("mit", 55, "permission", [r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"]),
    ("mit-0", 70, "mit", [r"spdx licen[cs]e identifier mit 0\b", r"mit no attribution(?: licen[cs]e)?", r"opensource org licen[cs]es mit 0\b"]),
    ("x11", 65, "x11", [r"spdx licen[cs]e identifier x11\b", r"\bx11 licen[cs]e"]),
    ("x11", 65, "consortium", [r"x consortium licen[cs]e"]),
    ("apache-2.0", 75, "apache", [rf"{LIC} under the apache licen[cs]e version 2 0", r"apache licen[cs]e version 2 0 january 2004", rf"apache (?:software )?licen[cs]e{V}2(?: 0)?\b", r"spdx licen[cs]e identifier apache 2 0\b", r"apache org licen[cs]es licen[cs]e 2 0\b", r"\bapache 2 0\b", r"opensource org licen[cs]es apache 2 0\b"]),
    ("apache-1.1", 72, "apache", [rf"apache (?:software )?licen[cs]e{V}1 1\b", r"spdx licen[cs]e identifier apache 1 1\b", r"apache org licen[cs]es licen[cs]e 1 1\b"]),
    ("apache-1.0", 72, "apache", [rf"apache (?:software )?licen[cs]e{V}1 0\b", r"spdx licen[cs]e identifier apache 1 0\b", r"apache org licen[cs]es licen[cs]e 1 0\b"]),
    ("apache", 50, "apache", [rf"{LIC} under the apache licen[cs]e", r"apache (?:software )?licen[cs]e"]),
    ("gpl-3.0-or-later", 86, "general", [rf"gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version", rf"gnu general public licen[cs]e{V}3(?: 0)? or (?:any )?later"]),
    ("gpl-3.0-or-later", 86, "gpl", [r"spdx licen[cs]e identifier gpl 3 0 or later", r"\bgpl ?v?3(?: 0)? or later", r"\bgplv3 or later"]),
    ("gpl-2.0-or-later", 86, "general", [rf"gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version", rf"gnu general public licen[cs]e{V}2(?: 0)? or (?:any )?later"]),
    ("gpl-2.0-or-later", 86, "gpl", [r"spdx licen[cs]e identifier gpl 2 0 or later", r"\bgpl ?v?2(?: 0)? or later", r"\bgplv2 or later"]),
    ("gpl-3.0", 80, "general", [rf"licen[cs]ed under the gnu general public licen[cs]e{V}3", r"gnu general public licen[cs]e version 3 29 june 2007", rf"(?:gnu )?general public licen[cs]e{V}3(?: 0)?\b"]),
    ("gpl-3.0", 80, "gpl", [r"spdx licen[cs]e identifier gpl 3 0(?: only)?\b", r"gnu org licen[cs]es gpl 3 0\b", r"\b(?:gnu )?gpl ?v?(?:ersion )?3(?: 0)?\b", r"opensource org licen[cs]es gpl 3 0\b"]),
    ("gpl-2.0", 80, "general", [rf"licen[cs]ed under the gnu general public licen[cs]e{V}2", r"gnu general public licen[cs]e version 2 june 1991", rf"(?:gnu )?general public licen[cs]e{V}2(?: 0)?\b"]),
    ("gpl-2.0", 80, "gpl", [r"spdx licen[cs]e identifier gpl 2 0(?: only)?\b", r"gnu org licen[cs]es (?:old licen[cs]es )?gpl 2 0\b", r"\b(?:gnu )?gpl ?v?(?:ersion )?2(?: 0)?\b", r"opensource org licen[cs]es gpl 2 0\b"]),
    ("gpl-1.0", 78, "general", [rf"(?:gnu )?general public licen[cs]e{V}1(?: 0)?\b"]),
    ("gpl-1.0", 78, "gpl", [r"spdx licen[cs]e identifier gpl 1 0(?: only| or later)?\b", r"\b(?:gnu )?gpl ?v?1(?: 0)?\b"]),
    ("gpl", 45, "general", [rf"{LIC} under the (?:terms of the )?gnu general public licen[cs]e", r"(?:gnu )?general public licen[cs]e"]),
    ("gpl", 45, "gpl", [r"\bgnu gpl\b", r"\bgpl licen[cs]ed?\b", r"under the gpl\b", r"gnu org licen[cs]es gpl\b"]),
    ("lgpl-3.0", 88, "lesser", [rf"(?:gnu )?lesser general public licen[cs]e{V}3(?: 0)?\b", r"lesser general public licen[cs]e version 3 29 june 2007"]),
    ("lgpl-3.0", 88, "lgpl", [r"spdx licen[cs]e identifier lgpl 3 0(?: only| or later)?\b", r"\blgpl ?v?3(?: 0)?\b", r"gnu org licen[cs]es lgpl 3 0\b"]),
    ("lgpl-2.1", 88, "lesser", [rf"(?:gnu )?lesser general public licen[cs]e{V}2 1\b", r"lesser general public licen[cs]e version 2 1 february 1999"]),
    ("lgpl-2.1", 88, "lgpl", [r"spdx licen[cs]e identifier lgpl 2 1(?: only| or later)?\b", r"\blgpl ?v?2 1\b", r"gnu org licen[cs]es (?:old licen[cs]es )?lgpl 2 1\b"]),
    ("lgpl-2.0", 87, "library", [rf"(?:gnu )?library general public licen[cs]e{V}2(?: 0)?\b", r"(?:gnu )?library general public licen[cs]e"]),
    ("lgpl-2.0", 87, "lgpl", [r"spdx licen[cs]e identifier lgpl 2 0(?: only| or later)?\b", r"\blgpl ?v?2(?: 0)?\b(?! 1)"]),
    ("lgpl", 58, "lesser", [r"(?:gnu )?lesser general public licen[cs]e"]),
    ("lgpl", 58, "lgpl", [r"\b(?:gnu )?lgpl\b", r"gnu org licen[cs]es lgpl\b"]),
    ("agpl-3.0", 88, "affero", [rf"(?:gnu )?affero general public licen[cs]e{V}3(?: 0)?\b", r"affero general public licen[cs]e version 3 19 november 2007", r"(?:gnu )?affero general public licen[cs]e"]),
    ("agpl-3.0", 88, "agpl", [r"spdx licen[cs]e identifier agpl 3 0(?: only| or later)?\b", r"\bagpl ?v?3(?: 0)?\b", r"gnu org licen[cs]es agpl(?: 3 0)?\b", r"\bagpl\b"]),
    ("gfdl", 82, "documentation", [rf"gnu free documentation licen[cs]e{V}1 [123]\b", r"(?:gnu )?free documentation licen[cs]e"]),
    ("gfdl", 82, "fdl", [r"spdx licen[cs]e identifier gfdl 1 [123](?: only| or later)?\b", r"gnu org (?:licen[cs]es|copyleft) fdl\b", r"\bgfdl\b"]),
    ("gpl-classpath-exception", 90, "classpath", [r"spdx licen[cs]e identifier gpl 2 0(?: only)? with classpath exception 2 0", r"(?:gnu )?classpath exception"]),
    ("gpl-classpath-exception", 90, "linking", [r"linking this library statically or dynamically with other modules"]),
    ("bsd-4-clause", 76, "bsd", [r"spdx licen[cs]e identifier bsd 4 clause\b", r"\bbsd 4 clause\b", r"\b4 clause bsd\b", r"original bsd licen[cs]e"]),
    ("bsd-4-clause", 76, "advertising", [r"all advertising materials mentioning features or use of this software must display the following acknowledgement"]),
    ("bsd-3-clause", 76, "bsd", [r"spdx licen[cs]e identifier bsd 3 clause\b", r"\bbsd 3 clause\b", r"\b3 clause bsd\b", r"(?:new|modified|revised) bsd licen[cs]e", r"opensource org licen[cs]es bsd 3 clause\b"]),
    ("bsd-3-clause", 74, "neither", [r"neither the name of (?:(?!neither the name of ).)+? nor the names of its contributors may be used to endorse or promote products"]),
    ("bsd-2-clause", 76, "bsd", [r"spdx licen[cs]e identifier bsd 2 clause\b", r"\bbsd 2 clause\b", r"\b2 clause bsd\b", r"(?:simplified|freebsd) bsd licen[cs]e", r"opensource org licen[cs]es bsd 2 clause\b"]),
    ("bsd", 48, "bsd", [rf"{LIC} under the bsd licen[cs]e", r"\bbsd(?: style)? licen[cs]e"]),
    ("bsd", 46, "redistribution", [r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"]),
    ("0bsd", 77, "bsd", [r"spdx licen[cs]e identifier 0bsd\b", r"\b0bsd\b", r"zero clause bsd"]),
    ("isc", 70, "isc", [r"spdx licen[cs]e identifier isc\b", r"\bisc licen[cs]e", r"opensource org licen[cs]es isc\b"]),
    ("isc", 66, "permission", [r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"]),
    ("mpl-2.0", 78, "mozilla", [r"this source code form is subject to the terms of the mozilla public licen[cs]e v(?:ersion)? ?2 0", rf"mozilla public licen[cs]e{V}2(?: 0)?\b", r"mozilla org mpl 2 0\b"]),
    ("mpl-2.0", 78, "mpl", [r"spdx licen[cs]e identifier mpl 2 0\b", r"\bmpl ?v?2(?: 0)?\b", r"opensource org licen[cs]es mpl 2 0\b"]),
    ("mpl-1.1", 78, "mozilla", [rf"mozilla public licen[cs]e{V}1 1\b", r"mozilla org mpl mpl 1 1\b"]),
    ("mpl-1.1", 78, "mpl", [r"spdx licen[cs]e identifier mpl 1 1\b", r"\bmpl ?v?1 1\b"]),
    ("mpl", 52, "mozilla", [r"mozilla public licen[cs]e"]),
    ("epl-2.0", 78, "eclipse", [rf"eclipse public licen[cs]e{V}2(?: 0)?\b", r"eclipse org legal epl 2 0\b", r"eclipse org org documents epl 2 0\b"]),
    ("epl-2.0", 78, "epl", [r"spdx licen[cs]e identifier epl 2 0\b", r"\bepl ?v?2(?: 0)?\b"]),
    ("epl-1.0", 78, "eclipse", [rf"eclipse public licen[cs]e{V}1(?: 0)?\b", r"eclipse org legal epl v10\b"]),
    ("epl-1.0", 78, "epl", [r"spdx licen[cs]e identifier epl 1 0\b", r"\bepl ?v?1(?: 0)?\b"]),
    ("epl", 52, "eclipse", [r"eclipse public licen[cs]e"]),
    ("edl-1.0", 78, "eclipse", [rf"eclipse distribution licen[cs]e(?:{V}1 0)?", r"eclipse org org documents edl v10\b"]),
    ("cddl-1.1", 78, "cddl", [r"spdx licen[cs]e identifier cddl 1 1\b", r"\bcddl ?v?1 1\b"]),
    ("cddl-1.0", 78, "cddl", [r"spdx licen[cs]e identifier cddl 1 0\b", r"\bcddl ?v?1 0\b", r"\bcddl\b"]),
    ("cddl-1.0", 77, "distribution", [rf"common development and distribution licen[cs]e(?:{V}1 0)?"]),
    ("cc0-1.0", 84, "cc0", [r"spdx licen[cs]e identifier cc0 1 0\b", r"\bcc0(?: 1 0)?(?: universal)?\b"]),
    ("cc0-1.0", 84, "commons", [r"creative commons zero", r"creative commons public domain dedication", r"creativecommons org publicdomain zero 1 0\b"]),
    ("cc-by-nc-nd-4.0", 90, "commons", [r"creative commons attribution non ?commercial no ?deriv(?:ative)?s? 4 0", r"creativecommons org licen[cs]es by nc nd 4 0\b"]),
    ("cc-by-nc-nd-4.0", 90, "cc", [r"\bcc by nc nd 4 0\b"]),
    ("cc-by-nc-sa-4.0", 90, "commons", [r"creative commons attribution non ?commercial share ?alike 4 0", r"creativecommons org licen[cs]es by nc sa 4 0\b"]),
    ("cc-by-nc-sa-4.0", 90, "cc", [r"\bcc by nc sa 4 0\b"]),
    ("cc-by-nc-4.0", 86, "commons", [r"creative commons attribution non ?commercial 4 0", r"creativecommons org licen[cs]es by nc 4 0\b"]),
    ("cc-by-nc-4.0", 86, "cc", [r"\bcc by nc 4 0\b"]),
    ("cc-by-nd-4.0", 86, "commons", [r"creative commons attribution no ?deriv(?:ative)?s? 4 0", r"creativecommons org licen[cs]es by nd 4 0\b"]),
    ("cc-by-nd-4.0", 86, "cc", [r"\bcc by nd 4 0\b"]),
    ("cc-by-sa-4.0", 86, "commons", [r"creative commons attribution share ?alike 4 0", r"creativecommons org licen[cs]es by sa 4 0\b"]),
    ("cc-by-sa-4.0", 86, "cc", [r"\bcc by sa 4 0\b", r"spdx licen[cs]e identifier cc by sa 4 0\b"]),
    ("cc-by-sa-3.0", 86, "commons", [r"creative commons attribution share ?alike 3 0", r"creativecommons org licen[cs]es by sa 3 0\b"]),
    ("cc-by-sa-3.0", 86, "cc", [r"\bcc by sa 3 0\b"]),
    ("cc-by-4.0", 82, "commons", [r"creative commons attribution 4 0(?: international)?", r"creativecommons org licen[cs]es by 4 0\b"]),
    ("cc-by-4.0", 82, "cc", [r"\bcc by 4 0\b", r"spdx licen[cs]e identifier cc by 4 0\b"]),
    ("cc-by-3.0", 82, "commons", [r"creative commons attribution 3 0(?: unported)?", r"creativecommons org licen[cs]es by 3 0\b"]),
    ("cc-by-3.0", 82, "cc", [r"\bcc by 3 0\b"]),
    ("cc-by-2.0", 82, "commons", [r"creative commons attribution 2 [05]", r"creativecommons org licen[cs]es by 2 [05]\b"]),
    ("cc-by-nc-sa", 64, "cc", [r"\bcc by nc sa\b"]),
    ("cc-by-nc-nd", 64, "cc", [r"\bcc by nc nd\b"]),
    ("cc-by-nc", 62, "cc", [r"\bcc by nc\b"]),
    ("cc-by-sa", 62, "cc", [r"\bcc by sa\b"]),
    ("cc-by-nd", 62, "cc", [r"\bcc by nd\b"]),
    ("cc-by", 54, "cc", [r"\bcc by\b"]),
    ("cc-by", 54, "commons", [r"creative commons attribution licen[cs]e"]),
    ("creative-commons", 44, "commons", [rf"{LIC} under (?:a|the) creative commons", r"creative commons licen[cs]e", r"creativecommons org licen[cs]es"]),
    ("unlicense", 74, "unlicen", [r"spdx licen[cs]e identifier unlicen[cs]e\b", r"\bthe unlicen[cs]e\b", r"\bunlicen[cs]e org\b"]),
    ("unlicense", 73, "domain", [r"this is free and unencumbered software released into the public domain"]),
    ("public-domain", 46, "domain", [r"(?:released|placed|dedicated) (?:in|into|to) the public domain", r"this (?:work|file|software|code) is in the public domain", r"no copyright .{0,40}?public domain"]),
    ("wtfpl", 74, "wtfpl", [r"spdx licen[cs]e identifier wtfpl\b", r"\bwtfpl\b"]),
    ("wtfpl", 74, "fuck", [r"do what the fuck you want to public licen[cs]e"]),
    ("zlib", 74, "zlib", [r"spdx licen[cs]e identifier zlib\b", r"\bzlib licen[cs]e", r"\bzlib libpng licen[cs]e", r"opensource org licen[cs]es zlib\b"]),
    ("zlib", 72, "warranty", [r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"]),
    ("libpng", 75, "libpng", [r"spdx licen[cs]e identifier libpng(?: 2 0)?\b", r"\blibpng licen[cs]e"]),
    ("boost-1.0", 76, "boost", [rf"boost software licen[cs]e(?:{V}1 0)?", r"boost org licen[cs]e 1 0\b"]),
    ("boost-1.0", 76, "bsl", [r"spdx licen[cs]e identifier bsl 1 0\b"]),
    ("busl-1.1", 76, "business", [rf"business source licen[cs]e(?:{V}1 1)?"]),
    ("busl-1.1", 76, "busl", [r"spdx licen[cs]e identifier busl 1 1\b", r"\bbusl 1 1\b"]),
    ("sspl-1.0", 78, "sspl", [r"spdx licen[cs]e identifier sspl 1 0\b", r"\bsspl(?: v?1(?: 0)?)?\b"]),
    ("sspl-1.0", 78, "server", [rf"server side public licen[cs]e(?:{V}1)?"]),
    ("elastic-2.0", 76, "elastic", [rf"elastic licen[cs]e(?:{V}2(?: 0)?)?", r"spdx licen[cs]e identifier elastic 2 0\b"]),
    ("artistic-2.0", 78, "artistic", [rf"artistic licen[cs]e{V}2(?: 0)?\b", r"spdx licen[cs]e identifier artistic 2 0\b"]),
    ("artistic-1.0", 74, "artistic", [rf"artistic licen[cs]e{V}1(?: 0)?\b", r"spdx licen[cs]e identifier artistic 1 0(?: perl)?\b", r"the clarified artistic licen[cs]e"]),
    ("artistic", 50, "artistic", [r"artistic licen[cs]e"]),
    ("perl", 72, "perl", [r"under the same terms as perl itself", r"same terms as the perl 5 programming language"]),
    ("psf-2.0", 76, "python", [rf"python software foundation licen[cs]e(?:{V}2)?", r"spdx licen[cs]e identifier python 2 0\b"]),
    ("psf-2.0", 76, "psf", [r"spdx licen[cs]e identifier psf 2 0\b", r"\bpsf licen[cs]e"]),
    ("postgresql", 76, "postgresql", [r"spdx licen[cs]e identifier postgresql\b", r"postgresql licen[cs]e"]),
    ("php-3.01", 76, "php", [rf"php licen[cs]e{V}3 01\b", r"spdx licen[cs]e identifier php 3 01\b", r"php net licen[cs]e 3 01\b"]),
    ("ruby", 74, "ruby", [r"spdx licen[cs]e identifier ruby\b", r"\bruby licen[cs]e", r"under the same terms as ruby"]),
    ("openssl", 76, "openssl", [r"spdx licen[cs]e identifier openssl\b", r"openssl licen[cs]e", r"openssl toolkit http www openssl org"]),
    ("curl", 74, "curl", [r"spdx licen[cs]e identifier curl\b", r"\bcurl licen[cs]e"]),
    ("icu", 74, "icu", [r"spdx licen[cs]e identifier icu\b", r"\bicu licen[cs]e"]),
    ("unicode", 74, "unicode", [r"spdx licen[cs]e identifier unicode (?:dfs 201[56]|3 0|tou)\b", r"unicode licen[cs]e agreement", r"unicode licen[cs]e v3"]),
    ("ofl-1.1", 78, "font", [rf"sil open font licen[cs]e(?:{V}1 1)?", r"open font licen[cs]e"]),
    ("ofl-1.1", 78, "ofl", [r"spdx licen[cs]e identifier ofl 1 1\b", r"scripts sil org ofl\b", r"\bofl 1 1\b"]),
    ("odbl-1.0", 78, "database", [rf"open (?:data commons open )?database licen[cs]e(?:{V}1 0)?"]),
    ("odbl-1.0", 78, "odbl", [r"spdx licen[cs]e identifier odbl 1 0\b", r"opendatacommons org licen[cs]es odbl\b", r"\bodbl\b"]),
    ("odc-by-1.0", 78, "commons", [r"open data commons attribution licen[cs]e", r"opendatacommons org licen[cs]es by\b"]),
    ("pddl-1.0", 78, "pddl", [r"spdx licen[cs]e identifier pddl 1 0\b", r"opendatacommons org licen[cs]es pddl\b", r"\bpddl\b"]),
    ("eupl-1.2", 78, "european", [rf"european union public licen[cs]e(?:{V}1 2)?"]),
    ("eupl-1.2", 78, "eupl", [r"spdx licen[cs]e identifier eupl 1 [12]\b", r"\beupl(?: v?1 [12])?\b"]),
    ("ms-pl", 76, "microsoft", [r"microsoft public licen[cs]e"]),
    ("ms-pl", 76, "pl", [r"spdx licen[cs]e identifier ms pl\b", r"\bms pl\b"]),
    ("ms-rl", 76, "microsoft", [r"microsoft reciprocal licen[cs]e"]),
    ("cpl-1.0", 76, "common", [rf"common public licen[cs]e(?:{V}1 0)?"]),
    ("cpl-1.0", 76, "cpl", [r"spdx licen[cs]e identifier cpl 1 0\b"]),
    ("ipl-1.0", 76, "ibm", [rf"ibm public licen[cs]e(?:{V}1 0)?"]),
    ("ipl-1.0", 76, "ipl", [r"spdx licen[cs]e identifier ipl 1 0\b"]),
    ("afl-3.0", 76, "academic", [rf"academic free licen[cs]e(?:{V}3 0)?"]),
    ("afl-3.0", 76, "afl", [r"spdx licen[cs]e identifier afl 3 0\b"]),
    ("osl-3.0", 76, "open", [rf"open software licen[cs]e(?:{V}3 0)?"]),
    ("osl-3.0", 76, "osl", [r"spdx licen[cs]e identifier osl 3 0\b"]),
    ("ncsa", 76, "ncsa", [r"university of illinois ncsa open source licen[cs]e", r"spdx licen[cs]e identifier ncsa\b"]),
    ("w3c", 76, "w3c", [r"w3c software (?:notice and )?licen[cs]e", r"spdx licen[cs]e identifier w3c\b"]),
    ("upl-1.0", 76, "universal", [rf"universal permissive licen[cs]e(?:{V}1 0)?"]),
    ("upl-1.0", 76, "upl", [r"spdx licen[cs]e identifier upl 1 0\b", r"oss oracle com licen[cs]es upl\b"]),
    ("blueoak-1.0.0", 76, "blue", [r"blue oak model licen[cs]e(?: 1 0 0)?"]),
    ("mulan-2.0", 76, "mulan", [rf"mulan (?:psl|permissive software licen[cs]e)(?:{V}2)?", r"spdx licen[cs]e identifier mulanpsl 2 0\b"]),
    ("vim", 74, "vim", [r"spdx licen[cs]e identifier vim\b", r"\bvim licen[cs]e"]),
    ("beerware", 74, "beer", [r"the beer ?ware licen[cs]e", r"spdx licen[cs]e identifier beerware\b", r"you can buy me a beer in return"]),
    ("json", 74, "evil", [r"the software shall be used for good not evil"]),
    ("ecl-2.0", 76, "educational", [rf"educational community licen[cs]e(?:{V}2 0)?"]),
    ("ecl-2.0", 76, "ecl", [r"spdx licen[cs]e identifier ecl 2 0\b"]),
    ("bigscience-rail-1.0", 76, "rail", [r"bigscience (?:open )?rail(?: m)? licen[cs]e", r"\bopenrail(?: m)?\b"]),
    ("bigscience-rail-1.0", 76, "responsible", [r"responsible ai licen[cs]e"]),
    ("llama-community", 76, "llama", [r"llama [23](?: 1| 2| 3)? community licen[cs]e"]),
    ("polyform", 74, "polyform", [r"polyform (?:noncommercial|small business|perimeter|strict|shield) licen[cs]e(?: 1 0 0)?"]),
    ("commons-clause", 76, "clause", [r"commons clause licen[cs]e condition", r"\bcommons clause\b"]),
    ("proprietary", 42, "rights", [r"all rights reserved (?:unauthorized|no part)"]),
    ("proprietary", 42, "confidential", [r"proprietary and confidential"]),
    ("proprietary", 42, "copying", [r"unauthorized copying of this file"]),
    ("proprietary", 41, "proprietary", [r"proprietary licen[cs]e"]),
    ("copyright-notice", 20, "copyright", [r"copyright (?:c )?(?:19|20)\d\d\b", r"copyright (?:c )?by\b"]),
    ("spdx-other", 30, "spdx", [r"spdx licen[cs]e identifier [a-z0-9]+"]),
    ("license-mention", 10, "licen", [r"see (?:the )?licen[cs]e (?:file )?for (?:more )?(?:details|information)", r"licen[cs]ed under the terms of", r"subject to the terms of the .{1,40}? licen[cs]e"]),
]
