"""Hand-written licence rules over words in lower case joined by one space.

A row is (label, keyword, expression for the name). The keyword is a plain string that every match holds. Each name
gives three rules: a grant in words (priority 1), a machine-readable tag (priority 0, the strongest) and the bare name
(priority 3). Rules that are no name follow below with priorities of their own.
"""

from __future__ import annotations

NAMES = (
    ("mit", "mit", r"mit(?: x11| expat)? licen[sc]e|expat licen[sc]e mit"),
    ("mit-0", "mit", r"mit no attribution(?: licen[sc]e)?|mit 0 licen[sc]e"),
    ("apache-1.0", "apache", r"apache(?: software)? licen[sc]e(?: version)? 1 0"),
    ("apache-1.1", "apache", r"apache(?: software)? licen[sc]e(?: version)? 1 1"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: public)? licen[sc]e(?: version| v)?(?: 2 0| 2|2)(?: 0)?|apache 2(?: 0)? licen[sc]e"),
    ("apache", "apache", r"apache(?: software)? licen[sc]e"),
    ("bsd-2-clause", "bsd", r"(?:simplified|freebsd|2 clause|two clause) bsd(?: licen[sc]e)?|bsd 2 clause(?: licen[sc]e)?"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|3 clause|three clause) bsd(?: licen[sc]e)?|bsd 3 clause(?: licen[sc]e)?"),
    ("bsd-4-clause", "bsd", r"(?:original|old|4 clause|four clause) bsd(?: licen[sc]e)?|bsd 4 clause(?: licen[sc]e)?"),
    ("bsd-0-clause", "bsd", r"(?:zero clause|0 clause) bsd(?: licen[sc]e)?|0bsd"),
    ("bsd", "bsd", r"bsd(?: style)? licen[sc]e"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public licen[sc]e(?: version| v)? ?1(?: 0)?"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[sc]e(?: version| v)? ?2(?: 0)?"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[sc]e(?: version| v)? ?3(?: 0)?"),
    ("gpl", "general public", r"(?:gnu )?general public licen[sc]e"),
    ("gpl-2.0", "gpl", r"gpl(?: version)? ?v?2(?: 0)?|gnu gpl(?: version)? ?v?2(?: 0)?"),
    ("gpl-3.0", "gpl", r"gpl(?: version)? ?v?3(?: 0)?|gnu gpl(?: version)? ?v?3(?: 0)?"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("lgpl-2.0", "general public", r"(?:gnu )?library general public licen[sc]e(?:(?: version| v)? 2(?: 0)?)?"),
    ("lgpl-2.1", "general public", r"(?:gnu )?lesser general public licen[sc]e(?: version| v)? 2 1"),
    ("lgpl-3.0", "general public", r"(?:gnu )?lesser general public licen[sc]e(?: version| v)? 3(?: 0)?"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl(?: v?[23](?: [01])?)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[sc]e"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[sc]e(?: version| v)? ?3(?: 0)?"),
    ("agpl", "affero", r"(?:gnu )?affero(?: general)? public licen[sc]e"),
    ("agpl", "agpl", r"(?:gnu )?agpl(?: v?3(?: 0)?)?"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[sc]e(?:(?: version)? 1 [0-3])?"),
    ("mpl-1.0", "mozilla", r"mozilla public licen[sc]e(?: version| v)? ?1 0"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e(?: version| v)? ?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e(?: version| v)? ?2 0"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e"),
    ("npl", "netscape", r"netscape public licen[sc]e(?: version)?(?: 1 [01])?"),
    ("epl-1.0", "eclipse", r"eclipse public licen[sc]e(?: version| v)? ?1 0"),
    ("epl-2.0", "eclipse", r"eclipse public licen[sc]e(?: version| v)? ?2 0"),
    ("epl", "eclipse", r"eclipse public licen[sc]e"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[sc]e(?: version| v)?(?: 1 0)?"),
    ("cddl-1.0", "common development", r"common development and distribution licen[sc]e(?:(?: version)? 1 0)?"),
    ("cddl-1.1", "common development", r"common development and distribution licen[sc]e(?: version)? 1 1"),
    ("cpl-1.0", "common public", r"common public licen[sc]e(?:(?: version)? 1 0)?"),
    ("cpal-1.0", "attribution", r"common public attribution licen[sc]e(?:(?: version)? 1 0)?"),
    ("ipl-1.0", "ibm", r"ibm public licen[sc]e(?:(?: version)? 1 0)?"),
    ("eupl-1.1", "european", r"european union public licen[sc]e(?: version| v)? ?1 1"),
    ("eupl-1.2", "european", r"european union public licen[sc]e(?: version| v)? ?1 2"),
    ("eupl", "european", r"european union public licen[sc]e"),
    ("artistic-1.0", "artistic", r"(?:perl )?artistic licen[sc]e(?: version)?(?: 1 0)?"),
    ("artistic-2.0", "artistic", r"artistic licen[sc]e(?: version)? 2 0"),
    ("psf-2.0", "python", r"python software foundation licen[sc]e(?:(?: version)? 2)?"),
    ("psf-2.0", "psf", r"psf licen[sc]e"),
    ("python-2.0", "python", r"python licen[sc]e(?:(?: version)? 2(?: 0)?)?"),
    ("php-3.01", "php", r"php licen[sc]e(?: version| v)? ?3 0?1"),
    ("php", "php", r"php licen[sc]e"),
    ("ruby", "ruby", r"ruby licen[sc]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e"),
    ("libpng", "libpng", r"libpng licen[sc]e(?:(?: version)? 2)?"),
    ("isc", "isc", r"isc licen[sc]e"),
    ("boost-1.0", "boost", r"boost software licen[sc]e(?:(?: version)? 1 0)?"),
    ("unlicense", "unlicen", r"the unlicen[sc]e"),
    ("wtfpl", "wtfpl", r"wtfpl(?:(?: version)? 2)?"),
    ("x11", "x11", r"x11 licen[sc]e"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[sc]e"),
    ("afl-3.0", "academic free", r"academic free licen[sc]e(?:(?: version| v)? ?3 0)?"),
    ("osl-3.0", "open software", r"open software licen[sc]e(?:(?: version| v)? ?3 0)?"),
    ("ecl-2.0", "educational", r"educational community licen[sc]e(?:(?: version)? 2 0)?"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e"),
    ("apsl-2.0", "apple", r"apple public source licen[sc]e(?:(?: version)? 2 0)?"),
    ("openssl", "openssl", r"openssl licen[sc]e"),
    ("curl", "curl", r"curl licen[sc]e"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("sleepycat", "sleepycat", r"sleepycat(?: public)? licen[sc]e"),
    ("vim", "vim", r"vim licen[sc]e"),
    ("w3c", "w3c", r"w3c(?: software)?(?: notice and)? licen[sc]e"),
    ("zpl-2.1", "zope", r"zope public licen[sc]e(?:(?: version)? 2 1)?"),
    ("qpl-1.0", "q public", r"q public licen[sc]e(?:(?: version)? 1 0)?"),
    ("sspl-1.0", "server side", r"server side public licen[sc]e(?:(?: version| v)? ?1)?"),
    ("bsl-1.1", "business source", r"business source licen[sc]e(?:(?: version)? 1 1)?"),
    ("elastic-2.0", "elastic", r"elastic licen[sc]e(?: version)?(?: 2(?: 0)?)?"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|strict|shield|perimeter) licen[sc]e(?: 1 0 0)?"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[sc]e(?:(?: version)? 1 1)?"),
    ("ofl-1.1", "sil ", r"sil ofl(?: 1 1)?"),
    ("odbl-1.0", "open database", r"open database licen[sc]e(?:(?: v)? ?1 0)?"),
    ("odc-by-1.0", "open data commons", r"open data commons attribution licen[sc]e(?: v?1 0)?"),
    ("pddl-1.0", "public domain dedication", r"(?:open data commons )?public domain dedication and licen[sc]e"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", "creative commons", r"creative commons zero(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", "cc by", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "cc by", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by-1.0", "cc by", r"cc by 1 0"),
    ("cc-by-2.0", "cc by", r"cc by 2 [05]"),
    ("cc-by-3.0", "cc by", r"cc by 3 0"),
    ("cc-by-4.0", "cc by", r"cc by 4 0"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| generic| unported)?"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| generic| unported)?"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| generic| unported)?"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| generic| unported)?"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1-4] [05])?(?: international| generic| unported)?"),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1-4] [05])?(?: international| generic| unported)?"),
    ("creative-commons", "creative commons", r"creative commons(?: licen[sc]e)?"),
    ("mulan-psl-2.0", "mulan", r"mulan (?:psl|permissive software licen[sc]e)(?: v?2)?"),
    ("upl-1.0", "universal permissive", r"universal permissive licen[sc]e(?: v?1 0)?"),
    ("cecill-2.1", "cecill", r"cecill(?: b| c)?(?: v?2(?: [01])?)?(?: licen[sc]e)?"),
    ("lppl-1.3", "latex project", r"latex project public licen[sc]e(?: v?1 3c?)?"),
    ("beerware", "beerware", r"beerware(?: licen[sc]e)?"),
    ("json", "json", r"json licen[sc]e"),
    ("unicode", "unicode", r"unicode (?:data files and software )?licen[sc]e(?: agreement)?"),
    ("icu", "icu", r"icu licen[sc]e"),
    ("intel", "intel", r"intel open source licen[sc]e"),
    ("nasa-1.3", "nasa", r"nasa open source agreement(?: 1 3)?"),
    ("rpl-1.5", "reciprocal", r"reciprocal public licen[sc]e(?: 1 [15])?"),
    ("simple-public", "simple public", r"simple public licen[sc]e(?: 2 0)?"),
    ("sun-public", "sun public", r"sun public licen[sc]e(?: 1 0)?"),
    ("watcom", "watcom", r"sybase open watcom public licen[sc]e(?: 1 0)?"),
    ("wxwindows", "wxwindows", r"wxwindows(?: library)? licen[sc]e"),
    ("xnet", "x net", r"x net licen[sc]e"),
    ("blueoak-1.0.0", "blue oak", r"blue oak model licen[sc]e(?: 1 0 0)?"),
    ("openrail", "openrail", r"(?:creativeml )?openrail(?: m| s)?(?: licen[sc]e)?"),
    ("bigscience-rail", "bigscience", r"bigscience rail licen[sc]e(?: v?1 0)?"),
    ("ogl-uk-3.0", "open government", r"open government licen[sc]e(?: v?[1-3](?: 0)?)?"),
    ("etalab-2.0", "ouverte", r"(?:etalab )?licence ouverte(?: 2 0)?(?: etalab)?"),
    ("opl-1.0", "open publication", r"open publication licen[sc]e(?: v?1 0)?"),
    ("osgeo", "osgeo", r"osgeo licen[sc]e"),
    ("hpnd", "historical permission", r"historical permission notice and disclaimer"),
    ("fair", "fair licen", r"fair licen[sc]e"),
    ("motosoto", "motosoto", r"motosoto open source licen[sc]e"),
    ("naumen", "naumen", r"naumen public licen[sc]e"),
    ("ntp", "ntp", r"ntp licen[sc]e"),
    ("oclc-2.0", "oclc", r"oclc research public licen[sc]e(?: 2 0)?"),
    ("real-1.0", "realnetworks", r"realnetworks public source licen[sc]e(?: v?1 0)?"),
    ("sissl", "sun industry", r"sun industry standards source licen[sc]e(?: 1 [12])?"),
    ("tmate", "tmate", r"tmate open source licen[sc]e"),
    ("vostrom", "vostrom", r"vostrom public licen[sc]e"),
    ("ypl-1.1", "yahoo", r"yahoo public licen[sc]e(?: v?1 [01])?"),
    ("zimbra-1.3", "zimbra", r"zimbra public licen[sc]e(?: v?1 [34])?"),
)

#: (label, keyword, expression, priority)
NOTICES = (
    ("public-domain", "public domain", r"(?:released|placed|dedicated|is|are|into|to|in) (?:in |into |to )?the public domain", 2),
    ("public-domain", "public domain", r"public domain", 4),
    ("copyright", "copyright", r"copyright(?: c)?(?: by)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", 2),
    ("copyright", "copyright", r"copyright holders?|copyright owner", 4),
    ("reserved", "reserved", r"all rights reserved(?: worldwide)?", 2),
    ("reserved", "reserved", r"(?:some|no) rights reserved", 2),
    ("no-warranty", "warrant", r"without (?:any )?warrant(?:y|ies)(?: or conditions)? of any kind", 2),
    ("no-warranty", "as is", r"provided as is|provided by the copyright holders and contributors as is", 2),
    ("no-warranty", "merchantab", r"implied warrant(?:y|ies) of merchantability", 3),
    ("no-liability", "liab", r"in no event shall (?:[^ ]+ ){0,20}?be liable", 3),
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 0),
    ("isc", "permission to use copy modify", r"permission to use copy modify and(?: or)? distribute this software", 0),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted", 0),
    ("bsd-3-clause", "neither the name", r"neither the name of .{0,80}? may be used to endorse or promote products", 1),
    ("gpl", "free software", r"free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e", 0),
    ("lgpl", "free software", r"free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e", 0),
    ("apache-2.0", "apache", r"licensed under the apache licen[sc]e version 2 0 the licen[sc]e", 0),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0", 0),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 0),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such", 1),
    ("boost-1.0", "machine executable", r"machine executable object code generated by a source language processor", 1),
    ("copyleft", "copyleft", r"copyleft", 4),
    ("proprietary", "proprietary", r"proprietary and confidential|confidential and proprietary", 2),
    ("proprietary", "unauthori", r"unauthori[sz]ed (?:copying|reproduction|distribution|use)(?: of this)?", 3),
    ("proprietary", "permission", r"without (?:the )?(?:prior )?(?:express )?(?:written )?permission", 4),
    ("non-commercial", "commercial", r"(?:for )?non ?commercial (?:use|purposes)(?: only)?", 3),
    ("terms-of-use", "terms", r"terms (?:of (?:use|service)|and conditions)", 4),
    ("licensed", "licens", r"(?:licensed|sublicensed) under", 5),
    ("licence", "licen", r"licen[sc]e agreement|end user licen[sc]e(?: agreement)?", 4),
    # licence texts, by a sentence that stands in them
    ("mit", "substantial portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 1),
    ("mit", "deal in the software", r"to deal in the software without restriction", 1),
    ("bsd", "redistributions of source code", r"redistributions of source code must retain the above copyright notice this list of conditions", 1),
    ("bsd", "redistributions in binary", r"redistributions in binary form must reproduce the above copyright notice", 1),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display", 0),
    ("bsd-3-clause", "endorse or promote", r"may (?:not )?be used to endorse or promote products derived from this software", 1),
    ("apache-2.0", "compliance with the licen", r"you may not use this file except in compliance with the licen[sc]e", 1),
    ("apache-2.0", "unless required by applicable", r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e", 0),
    ("apache-2.0", "apache org", r"www apache org licen[sc]es licen[sc]e 2 0(?: txt| html)?", 0),
    ("apache", "apache software foundation", r"licensed to the apache software foundation(?: asf)? under one or more contributor licen[sc]e agreements", 1),
    ("gpl", "useful but without", r"in the hope that it will be useful but without any warranty", 1),
    ("gpl", "received a copy", r"you should have received a copy of the gnu general public licen[sc]e", 0),
    ("lgpl", "received a copy", r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e", 0),
    ("agpl", "received a copy", r"you should have received a copy of the gnu affero general public licen[sc]e", 0),
    ("gpl-2.0", "either version 2", r"either version 2 of the licen[sc]e or at your option any later version", 1),
    ("gpl-3.0", "either version 3", r"either version 3 of the licen[sc]e or at your option any later version", 1),
    ("lgpl-2.1", "either version 2 1", r"either version 2 1 of the licen[sc]e or at your option any later version", 0),
    ("gpl", "gnu org", r"www gnu org licen[sc]es(?: gpl| lgpl| agpl| fdl)?(?: [1-3] [0-9])?(?: html| txt)?", 2),
    ("gfdl", "invariant sections", r"with no invariant sections(?: with)?(?: no)? front cover texts", 0),
    ("gfdl", "granted to copy distribute", r"permission is granted to copy distribute and or modify this document under the terms", 0),
    ("mpl-1.1", "subject to the mozilla", r"the contents of this file are subject to the mozilla public licen[sc]e version 1 1", 0),
    ("mpl-2.0", "mozilla org", r"mozilla org mpl 2 0", 0),
    ("epl-1.0", "eclipse org", r"www eclipse org legal epl v10(?: html)?", 0),
    ("epl-2.0", "eclipse org", r"www eclipse org legal epl (?:v20|2 0)(?: html)?", 0),
    ("cddl", "subject to the terms of the common development", r"subject to the terms of the common development and distribution licen[sc]e", 0),
    ("zlib", "origin of this software", r"the origin of this software must not be misrepresented", 1),
    ("zlib", "held liable for any damages", r"in no event will the authors be held liable for any damages", 1),
    ("isc", "above copyright notice and this permission", r"provided that the above copyright notice and this permission notice appear in all copies", 1),
    ("unlicense", "anyone is free to copy", r"anyone is free to copy modify publish use compile sell or distribute this software", 0),
    ("unlicense", "unlicense org", r"(?:http )?unlicense org", 1),
    ("wtfpl", "do what the", r"do what the (?:f[a-z]+|hell) you want to public licen[sc]e", 0),
    ("boost-1.0", "boost org", r"www boost org licen[sc]e 1 0 txt", 0),
    ("python-2.0", "beopen", r"beopen python open source licen[sc]e agreement", 0),
    ("artistic-1.0", "same terms as perl", r"under the same terms as perl(?: itself)?", 1),
    ("ruby", "same terms as ruby", r"under the same terms as ruby(?: itself)?", 1),
    ("x11", "x consortium", r"except as contained in this notice the name of the x consortium shall not be used", 0),
    ("openssl", "openssl project", r"this product includes software developed by the openssl project", 0),
    ("jpeg", "independent jpeg", r"this software is based in part on the work of the independent jpeg group", 0),
    ("freetype", "freetype", r"(?:the )?freetype (?:project )?licen[sc]e", 2),
    ("cc0-1.0", "waived all", r"has waived all copyright and related or neighboring rights", 0),
    ("cc0-1.0", "publicdomain zero", r"creativecommons org publicdomain zero 1 0", 0),
    ("public-domain", "publicdomain mark", r"creativecommons org publicdomain mark 1 0", 1),
    ("cc-by-4.0", "licenses by 4", r"creativecommons org licenses by 4 0", 0),
    ("cc-by-3.0", "licenses by 3", r"creativecommons org licenses by 3 0", 0),
    ("cc-by-sa", "licenses by sa", r"creativecommons org licenses by sa [1-4] [05]", 0),
    ("cc-by-nc", "licenses by nc", r"creativecommons org licenses by nc [1-4] [05]", 0),
    ("cc-by-nd", "licenses by nd", r"creativecommons org licenses by nd [1-4] [05]", 0),
    ("cc-by-nc-sa", "licenses by nc sa", r"creativecommons org licenses by nc sa [1-4] [05]", 0),
    ("cc-by-nc-nd", "licenses by nc nd", r"creativecommons org licenses by nc nd [1-4] [05]", 0),
    ("ofl-1.1", "reserved font name", r"with reserved font names?", 0),
    ("ofl-1.1", "scripts sil", r"scripts sil org ofl", 0),
    ("elastic-2.0", "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service", 1),
    ("sspl-1.0", "sspl", r"sspl(?: v?1)?", 2),
    ("bsl-1.1", "additional use grant", r"additional use grant", 2),
    ("bsl-1.1", "change date", r"change date (?:[^ ]+ ){1,6}?change licen[sc]e", 1),
    ("commons-clause", "commons clause", r"(?:the )?commons clause(?: licen[sc]e)?(?: condition)?", 1),
    ("fair-source", "fair source", r"fair source licen[sc]e(?: v?0 9)?", 1),
    ("llama", "llama", r"llama (?:[23](?: [0-9])? )?community licen[sc]e(?: agreement)?", 1),
    ("gemma", "gemma terms", r"gemma terms of use", 1),
    ("openrail", "use based restrictions", r"use based restrictions", 3),
    ("odbl-1.0", "opendatacommons", r"opendatacommons org licen[sc]es (?:odbl|by|pddl)(?: 1 0)?", 0),
    ("ogl-uk-3.0", "nationalarchives", r"nationalarchives gov uk doc open government licen[sc]e", 0),
    # what is said about rights without naming a licence
    ("copyright", "copyright notice", r"(?:the )?(?:above )?copyright notice", 4),
    ("copyright", "copyrighted", r"copyrighted (?:material|work|software)", 4),
    ("reserved", "rights not expressly", r"(?:all )?rights not expressly granted(?: herein)?(?: are reserved)?", 2),
    ("no-warranty", "warranties", r"disclaims? (?:all|any) warranties(?: express or implied)?", 3),
    ("no-warranty", "fitness", r"warrant(?:y|ies) (?:[^ ]+ ){0,8}?fitness for a particular purpose", 3),
    ("no-warranty", "own risk", r"use (?:of this software |it |this )?(?:is )?at your own risk", 3),
    ("no-liability", "consequential", r"liable for any (?:[^ ]+ ){0,8}?consequential damages", 3),
    ("no-liability", "limitation of liab", r"limitation of liability", 4),
    ("proprietary", "trade secret", r"(?:contains )?(?:confidential (?:and|or) )?trade secrets?(?: and confidential)? (?:information|of)", 3),
    ("proprietary", "reverse engineer", r"(?:not|or) (?:decompile |disassemble )?(?:or )?reverse engineer", 3),
    ("proprietary", "internal use", r"(?:for )?internal use only", 3),
    ("proprietary", "not be reproduced", r"(?:may|must|shall) not be reproduced(?: (?:or|and) (?:copied|distributed|published|transmitted))?", 3),
    ("proprietary", "strictly prohibited", r"(?:copying|reproduction|distribution|redistribution|use) (?:[^ ]+ ){0,6}?(?:is|are) strictly prohibited", 3),
    ("evaluation", "evaluation", r"(?:for )?evaluation (?:use|purposes) only", 3),
    ("non-commercial", "commercially", r"(?:may|must) not be (?:used|sold|exploited) commercially", 2),
    ("non-commercial", "not for resale", r"not for resale(?: or redistribution)?", 3),
    ("no-derivatives", "derivative works", r"(?:no|not create|without) derivative works", 3),
    ("share-alike", "same licen", r"under the same licen[sc]e(?: terms)?", 4),
    ("attribution", "attribution", r"with (?:proper|due|appropriate) attribution", 4),
    ("attribution", "appropriate credit", r"you must give appropriate credit", 2),
    ("patent", "patent licen", r"(?:royalty free |worldwide |perpetual |irrevocable )*patent licen[sc]e", 3),
    ("patent", "patent", r"patents? pending", 4),
    ("trademark", "trademark", r"(?:registered )?trademarks? of", 4),
    ("fair-use", "fair use", r"(?:under |constitutes |considered )?fair use", 4),
    ("fair-dealing", "fair dealing", r"fair dealing", 4),
    ("dmca", "dmca", r"dmca(?: takedown)?(?: notice)?", 3),
    ("dmca", "digital millennium", r"digital millennium copyright act", 2),
    ("dual-licence", "dual licen", r"dual licensed|dual licen[sc]e", 3),
    ("exception", "exception", r"(?:with )?(?:the )?(?:classpath|linking|runtime library|bootloader|font) exception(?: 2 0)?", 2),
    ("contributor", "contributor licen", r"contributor licen[sc]e agreement", 3),
    ("contributor", "certificate of origin", r"developer certificate of origin(?: 1 1)?", 3),
    ("open-source", "open source software", r"(?:free and )?open source software", 5),
    ("licensed", "licensed ", r"licensed (?:material|content|work)s?", 5),
)

#: Every match of every rule holds one of these, or all words of a base phrase; a document without any has no rule to try.
HEADS = (
    "licen", "gpl", "cc0", "creative", "copyright", "reserved", "domain", "warrant", "provided", "merchantab", "liab", "permission", "redistribution", "neither", "software", "unencumbered", "altered", "executable",
    "copyleft", "proprietary", "unauthori", "commercial", "terms", "bsd", "wtfpl", "cecill", "mulan", "beerware", "agreement", "openrail", "attribution", "ofl",
    "invariant", "mozilla", "eclipse", "consortium", "sspl", "grant", "clause", "restrictions", "risk", "secret", "engineer", "internal", "reproduced", "prohibited", "evaluation", "resale", "derivative", "credit",
    "patent", "trademark", "fair", "dmca", "exception", "certificate",
)


def rules() -> list[tuple[int, str, str, str, int]]:
    """(number, label, keyword, expression, priority) of every rule."""
    found = []
    for label, keyword, name in NAMES:
        found.append((label, keyword, rf"(?:(?:is|are|be|was|were) )?(?:licensed|released|distributed|available|provided|published|covered|offered|governed|made available) (?:under|by) (?:(?:the|a|an) )?(?:terms (?:and conditions )?of (?:the )?)?(?:version [0-9](?: [0-9])? of (?:the )?)?(?:{name})", 1))
        found.append((label, keyword, rf"spdx licen[sc]e identifier (?:{name})", 0))
        found.append((label, keyword, name, 3))
    found += NOTICES
    return [(n, *r) for n, r in enumerate(found)]
