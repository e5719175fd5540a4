"""Signature rules of licenses: sentences of their texts and notices, and names in a few sentence forms."""

from __future__ import annotations

# Label, keyword that a text must hold, pattern of the name in lower case (a blank: any separators), SPDX ids.
NAMES = [
    ("apache-2.0", "apache", "apache(?: license)?(?: version| v)? ?2(?: 0)?", "apache-2.0"),
    ("apache-1.1", "apache", "apache(?: software)?(?: license)?(?: version)? 1 1", "apache-1.1"),
    ("apache", "apache", "apache(?: software)? license", ""),
    ("gpl-1.0", "gnu", "gnu general public license (?:version|v) ?1", "gpl-1.0 gpl-1.0-only gpl-1.0-or-later"),
    ("gpl-2.0", "gnu", "gnu general public license (?:version|v) ?2", "gpl-2.0 gpl-2.0-only gpl-2.0-or-later"),
    ("gpl-3.0", "gnu", "gnu general public license (?:version|v) ?3", "gpl-3.0 gpl-3.0-only gpl-3.0-or-later"),
    ("gpl", "gnu", "gnu general public license", ""),
    ("gpl-2.0", "gpl", "gpl ?v? ?2(?: 0)?", ""),
    ("gpl-3.0", "gpl", "gpl ?v? ?3(?: 0)?", ""),
    ("lgpl-2.0", "gnu", "gnu (?:lesser|library) general public license (?:version|v) ?2(?: 0)?(?! 1)", "lgpl-2.0 lgpl-2.0-only lgpl-2.0-or-later"),
    ("lgpl-2.1", "lesser", "gnu lesser general public license (?:version|v) ?2 1", "lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later"),
    ("lgpl-3.0", "lesser", "gnu lesser general public license (?:version|v) ?3", "lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later"),
    ("lgpl", "lesser", "gnu lesser general public license", ""),
    ("agpl-3.0", "affero", "gnu affero general public license(?: (?:version|v) ?3)?", "agpl-3.0 agpl-3.0-only agpl-3.0-or-later"),
    ("gfdl", "gnu", "gnu free documentation license", "gfdl-1.1 gfdl-1.2 gfdl-1.3"),
    ("mit", "mit", "mit license", "mit"),
    ("mit-0", "mit", "mit no attribution", "mit-0"),
    ("mit", "expat", "expat license", ""),
    ("x11", "x11", "(?:mit )?x11 license", "x11"),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: license)?", "bsd-2-clause"),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: license)?", "bsd-3-clause"),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?", "bsd-4-clause"),
    ("bsd", "bsd", "bsd license", ""),
    ("0bsd", "bsd", "(?:0bsd|zero clause bsd)(?: license)?", "0bsd"),
    ("isc", "isc", "isc license", "isc"),
    ("mpl-1.1", "mozilla", "mozilla public license(?: version)? 1 1", "mpl-1.0 mpl-1.1"),
    ("mpl-2.0", "mozilla", "mozilla public license(?: version| v)? ?2(?: 0)?", "mpl-2.0"),
    ("mpl", "mozilla", "mozilla public license", ""),
    ("epl-1.0", "eclipse", "eclipse public license(?: version| v)? ?1(?: 0)?", "epl-1.0"),
    ("epl-2.0", "eclipse", "eclipse public license(?: version| v)? ?2(?: 0)?", "epl-2.0"),
    ("cddl-1.0", "common", "common development and distribution license(?: 1 0)?", "cddl-1.0"),
    ("cpl-1.0", "common", "common public license", "cpl-1.0"),
    ("artistic-1.0", "artistic", "artistic license(?: 1 0)?(?! 2)", "artistic-1.0"),
    ("artistic-2.0", "artistic", "artistic license(?: version)? 2(?: 0)?", "artistic-2.0"),
    ("bsl-1.0", "boost", "boost software license", "bsl-1.0"),
    ("busl-1.1", "business", "business source license", "busl-1.1"),
    ("zlib", "zlib", "zlib(?: libpng)? license", "zlib libpng"),
    ("unlicense", "unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("cc0-1.0", "cc", "cc ?0(?: 1 0)?(?: universal)?", "cc0-1.0"),
    ("cc0-1.0", "creative", "creative commons zero", ""),
    ("cc-by-4.0", "cc", "cc by 4 0", "cc-by-4.0"),
    ("cc-by-3.0", "cc", "cc by 3 0", "cc-by-3.0"),
    ("cc-by-2.0", "cc", "cc by 2 [05]", "cc-by-2.0 cc-by-2.5"),
    ("cc-by-sa-4.0", "cc", "cc by sa 4 0", "cc-by-sa-4.0"),
    ("cc-by-sa-3.0", "cc", "cc by sa 3 0", "cc-by-sa-3.0"),
    ("cc-by-nc-4.0", "cc", "cc by nc 4 0", "cc-by-nc-4.0"),
    ("cc-by-nc-3.0", "cc", "cc by nc 3 0", "cc-by-nc-3.0"),
    ("cc-by-nc-sa-4.0", "cc", "cc by nc sa 4 0", "cc-by-nc-sa-4.0"),
    ("cc-by-nc-nd-4.0", "cc", "cc by nc nd 4 0", "cc-by-nc-nd-4.0"),
    ("cc-by-nd-4.0", "cc", "cc by nd 4 0", "cc-by-nd-4.0"),
    ("cc-by-nc-nd", "cc", "cc by nc nd", ""),
    ("cc-by-nc-sa", "cc", "cc by nc sa", ""),
    ("cc-by-nc", "cc", "cc by nc", ""),
    ("cc-by-nd", "cc", "cc by nd", ""),
    ("cc-by-sa", "cc", "cc by sa", ""),
    ("cc-by", "cc", "cc by", ""),
    ("cc-by-sa", "creative", "creative commons attribution share ?alike", ""),
    ("cc-by-nc", "creative", "creative commons attribution non ?commercial", ""),
    ("cc-by-nd", "creative", "creative commons attribution no ?deriv(?:ative)?s", ""),
    ("cc-by", "creative", "creative commons attribution", ""),
    ("odbl-1.0", "database", "open(?: data)? database license", "odbl-1.0"),
    ("odc-by-1.0", "commons", "open data commons attribution license", "odc-by-1.0"),
    ("pddl-1.0", "dedication", "public domain dedication and license", "pddl-1.0"),
    ("ofl-1.1", "font", "sil open font license", "ofl-1.0 ofl-1.1"),
    ("psf-2.0", "python", "python software foundation license", "psf-2.0 python-2.0"),
    ("php-3.01", "php", "php license(?: version)?(?: 3 01)?", "php-3.0 php-3.01"),
    ("ruby", "ruby", "ruby license", "ruby"),
    ("postgresql", "postgresql", "postgresql license", "postgresql"),
    ("openssl", "openssl", "openssl license", "openssl"),
    ("eupl-1.2", "european", "european union public licen[cs]e(?: v?1 [12])?", "eupl-1.1 eupl-1.2"),
    ("ms-pl", "microsoft", "microsoft public license", "ms-pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal license", "ms-rl"),
    ("afl-3.0", "academic", "academic free license", "afl-3.0"),
    ("osl-3.0", "open", "open software license", "osl-3.0"),
    ("ncsa", "illinois", "university of illinois(?: ncsa)? open source license", "ncsa"),
    ("sspl-1.0", "server", "server side public license", "sspl-1.0"),
    ("elastic-2.0", "elastic", "elastic license(?: 2 0)?", "elastic-2.0"),
    ("upl-1.0", "universal", "universal permissive license", "upl-1.0"),
    ("vim", "vim", "vim license", "vim"),
    ("ecl-2.0", "educational", "educational community license", "ecl-2.0"),
    ("proprietary", "reserved", "all rights reserved", ""),
    ("public-domain", "domain", "public domain", ""),
]
# Sentence forms around a name: priority, confidence, before it, after it.
FORMS = [
    (40, 0.6, "", ""),
    (60, 0.8, "", " (?:licen[cs]es?|terms)"),
    (80, 0.95, "licen[cs]ed (?:under|by) (?:the )?(?:terms of (?:the )?)?", "(?: licen[cs]e)?"),
    (80, 0.95, "(?:released|distributed|available|published|provided) (?:under|by) (?:the )?(?:terms of (?:the )?)?", "(?: licen[cs]e)?"),
    (70, 0.9, "licen[cs]e (?:is )?(?:the )?", ""),
]
# Sentences of license texts, notices, exceptions and addresses: label, keyword that a text must hold, pattern
# in lower case (a blank: any separators), priority, confidence.
TEXTS = [
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 90, 0.97),
    ("mit", "permission", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 90, 0.95),
    ("mit", "warrant", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose", 85, 0.9),
    ("mit", "copyright", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", 85, 0.9),
    ("mit", "software", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons", 60, 0.7),
    ("bsd", "redistribut", "redistribution and use in source and binary forms with or without modification are permitted", 88, 0.95),
    ("bsd", "redistribut", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 88, 0.95),
    ("bsd", "redistribut", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", 88, 0.95),
    ("bsd-3-clause", "permission", "may be used to endorse or promote products derived from this software without specific prior written permission", 92, 0.96),
    ("bsd-3-clause", "contributors", "neither the names? of (?:the )?(?:copyright holders?|authors?|organization|company) nor the names of (?:its|their|any) contributors may be used", 92, 0.96),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 94, 0.97),
    ("bsd", "warrant", "this software is provided by the (?:copyright holders|regents|authors?) and contributors as is and any express or implied warranties", 86, 0.9),
    ("isc", "permission", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", 90, 0.97),
    ("isc", "warrant", "the software is provided as is and the author disclaims all warranties with regard to this software", 88, 0.95),
    ("0bsd", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software", 91, 0.9),
    ("hpnd", "permission", "permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted", 90, 0.95),
    ("zlib", "warrant", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", 92, 0.97),
    ("zlib", "permission", "permission is granted to anyone to use this software for any purpose including commercial applications", 90, 0.96),
    ("zlib", "licen", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software under this license", 80, 0.9),
    ("bsl-1.0", "permission", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 92, 0.97),
    ("ncsa", "software", "to deal with the software without restriction including without limitation the rights to use copy modify", 80, 0.85),
    ("x11", "advertising", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization", 86, 0.93),
    ("unlicense", "public domain", "this is free and unencumbered software released into the public domain", 95, 0.98),
    ("unlicense", "copyright", "the author or authors of this software dedicate any and all copyright interest in the software to the public domain", 95, 0.98),
    ("wtfpl", "licen", "do what the fuck you want to public license", 95, 0.98),
    ("beerware", "licen", "the beer ?ware license", 95, 0.97),
    ("beerware", "retain", "as long as you retain this notice you can do whatever you want with this stuff", 90, 0.9),
    ("apache-2.0", "licen", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 95, 0.99),
    ("apache-2.0", "licen", "you may not use this file except in compliance with the license", 75, 0.85),
    ("apache-2.0", "licen", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 75, 0.88),
    ("apache-2.0", "licen", "www apache org licenses license 2 0", 90, 0.97),
    ("apache-2.0", "licen", "licensed to the apache software foundation asf under one or more contributor license agreements", 92, 0.97),
    ("apache-2.0", "copyright", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce", 92, 0.97),
    ("apache-1.1", "permission", "the names? apache(?: software foundation)?(?: and apache software foundation)? must not be used to endorse or promote products derived from this software without prior written permission", 90, 0.92),
    ("gpl-2.0", "licen", "either version 2 of the license or at your option any later version", 70, 0.85),
    ("gpl-3.0", "licen", "either version 3 of the license or at your option any later version", 70, 0.85),
    ("gpl", "gnu", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", 88, 0.96),
    ("gpl-2.0", "gnu", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", 93, 0.97),
    ("gpl-3.0", "gnu", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", 93, 0.97),
    ("gpl-2.0", "gnu", "under the terms of the gnu general public license version 2(?: only)? as published by the free software foundation", 93, 0.97),
    ("gpl-3.0", "gnu", "under the terms of the gnu general public license version 3(?: only)? as published by the free software foundation", 93, 0.97),
    ("gpl", "gnu", "you should have received a copy of the gnu general public license along with this (?:program|library|software|file)", 85, 0.94),
    ("gpl", "gnu", "see the gnu general public license for more details", 82, 0.9),
    ("gpl", "licen", "the licenses for most software are designed to take away your freedom to share and change it", 88, 0.95),
    ("gpl-3.0", "licen", "the gnu general public license is a free copyleft license for software and other kinds of works", 93, 0.97),
    ("gpl-2.0", "gnu", "gnu general public license version 2 june 1991", 94, 0.98),
    ("gpl-3.0", "gnu", "gnu general public license version 3 29 june 2007", 94, 0.98),
    ("gpl", "gpl", "www gnu org (?:licenses|copyleft) gpl", 84, 0.93),
    ("gpl-2.0", "gpl", "www gnu org licenses (?:old licenses )?gpl 2 0", 90, 0.96),
    ("gpl-3.0", "gpl", "www gnu org licenses gpl 3 0", 90, 0.96),
    ("lgpl", "gnu", "under the terms of the gnu lesser general public license as published by the free software foundation", 90, 0.96),
    ("lgpl-2.1", "gnu", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license", 94, 0.97),
    ("lgpl-3.0", "gnu", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license", 94, 0.97),
    ("lgpl-2.0", "gnu", "under the terms of the gnu library general public license as published by the free software foundation", 92, 0.96),
    ("lgpl", "gnu", "you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:program|library|software|file)", 88, 0.94),
    ("lgpl", "gpl", "www gnu org (?:licenses|copyleft) lgpl", 86, 0.93),
    ("lgpl-2.1", "gpl", "www gnu org licenses (?:old licenses )?lgpl 2 1", 90, 0.96),
    ("lgpl-3.0", "gpl", "www gnu org licenses lgpl 3 0", 90, 0.96),
    ("agpl-3.0", "affero", "under the terms of the gnu affero general public license as published by the free software foundation", 92, 0.97),
    ("agpl-3.0", "affero", "you should have received a copy of the gnu affero general public license along with this (?:program|library|software|file)", 90, 0.96),
    ("agpl-3.0", "gpl", "www gnu org licenses agpl", 88, 0.95),
    ("gfdl", "gnu", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 94, 0.98),
    ("classpath-exception-2.0", "permission", "as a special exception the copyright holders of this library give you permission to link this library with independent modules", 96, 0.98),
    ("classpath-exception-2.0", "licen", "subject to the classpath exception as provided (?:by oracle )?in the license file that accompanied this code", 96, 0.97),
    ("classpath-exception-2.0", "gpl", "gpl ?v?2 with (?:the )?classpath exception", 96, 0.97),
    ("gcc-exception-3.1", "gcc", "gcc runtime library exception(?: version)? 3 1", 96, 0.97),
    ("gcc-exception-3.1", "permission", "under section 7 of gpl version 3 you are granted additional permissions described in the gcc runtime library exception", 96, 0.98),
    ("openssl-exception", "permission", "(?:the authors?|the copyright holders?) gives? permission to link (?:the code of )?(?:this|portions of this) (?:program|software) with the openssl library", 96, 0.97),
    ("font-exception-2.0", "licen", "this font does not by itself cause the resulting document to be covered by the gnu general public license", 96, 0.97),
    ("autoconf-exception-2.0", "permission", "this configure script is free software the free software foundation gives unlimited permission to copy distribute and modify it", 94, 0.96),
    ("bison-exception-2.2", "bison", "you may create a larger work that contains part or all of the bison parser skeleton and distribute that work under terms of your choice", 94, 0.96),
    ("llvm-exception", "licen", "apache license v2 0 with llvm exceptions", 97, 0.98),
    ("linux-syscall-note", "copyright", "this copyright does not cover user programs that use kernel services by normal system calls", 96, 0.98),
    ("mpl-2.0", "licen", "this source code form is subject to the terms of the mozilla public license v 2 0", 95, 0.99),
    ("mpl-2.0", "distributed", "if a copy of the mpl was not distributed with this file you can obtain one at", 93, 0.96),
    ("mpl-1.1", "licen", "the contents of this file are subject to the mozilla public license version 1 1", 95, 0.98),
    ("mpl-1.0", "licen", "the contents of this file are subject to the mozilla public license version 1 0", 95, 0.98),
    ("mpl", "licen", "the contents of this file are subject to the mozilla public license", 88, 0.94),
    ("npl-1.1", "licen", "the contents of this file are subject to the netscape public license", 92, 0.96),
    ("epl-1.0", "licen", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", 94, 0.98),
    ("epl-2.0", "licen", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?)?2 0", 94, 0.98),
    ("epl", "licen", "this program and the accompanying materials are made available under the terms of the eclipse public license", 88, 0.94),
    ("epl-1.0", "eclipse", "www eclipse org legal epl v10", 88, 0.9),
    ("epl-2.0", "eclipse", "www eclipse org legal epl 2 0", 88, 0.9),
    ("cddl-1.0", "licen", "the contents of this file are subject to the terms of (?:either the gnu general public license version 2 only gpl or )?the common development and distribution license", 94, 0.97),
    ("cddl-1.0", "licen", "you can obtain a copy of the license at (?:usr src opensolaris license|http www opensolaris org os licensing)", 92, 0.96),
    ("cpl-1.0", "licen", "the accompanying program is provided under the terms of this common public license", 93, 0.97),
    ("ipl-1.0", "licen", "the accompanying program is provided under the terms of this ibm public license", 93, 0.97),
    ("artistic-1.0", "copyright", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains", 93, 0.97),
    ("artistic-2.0", "licen", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed", 93, 0.97),
    ("artistic-1.0-perl", "perl", "this (?:program|library|module) is free software you can redistribute it and or modify it under the same terms as perl itself", 90, 0.93),
    ("ofl-1.1", "licen", "this font software is licensed under the sil open font license version 1 1", 95, 0.99),
    ("ofl-1.1", "software", "the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself", 90, 0.93),
    ("ofl-1.1", "permission", "permission is hereby granted free of charge to any person obtaining a copy of the font software", 93, 0.97),
    ("cc-by-4.0", "commons", "creative commons attribution 4 0 international(?: public)? license", 93, 0.98),
    ("cc-by-sa-4.0", "commons", "creative commons attribution share ?alike 4 0 international(?: public)? license", 93, 0.98),
    ("cc-by-nc-4.0", "commons", "creative commons attribution non ?commercial 4 0 international(?: public)? license", 93, 0.98),
    ("cc-by-nc-sa-4.0", "commons", "creative commons attribution non ?commercial share ?alike 4 0 international(?: public)? license", 93, 0.98),
    ("cc-by-nc-nd-4.0", "commons", "creative commons attribution non ?commercial no ?derivatives 4 0 international(?: public)? license", 93, 0.98),
    ("cc-by-nd-4.0", "commons", "creative commons attribution no ?derivatives 4 0 international(?: public)? license", 93, 0.98),
    ("cc-by-3.0", "commons", "creative commons attribution 3 0 unported license", 93, 0.98),
    ("cc-by-sa-3.0", "commons", "creative commons attribution share ?alike 3 0 unported license", 93, 0.98),
    ("cc-by-nc-3.0", "commons", "creative commons attribution non ?commercial 3 0 unported license", 93, 0.98),
    ("cc-by-4.0", "commons", "creativecommons org licenses by 4 0", 91, 0.97),
    ("cc-by-3.0", "commons", "creativecommons org licenses by 3 0", 91, 0.97),
    ("cc-by-2.0", "commons", "creativecommons org licenses by 2 [05]", 91, 0.97),
    ("cc-by-sa-4.0", "commons", "creativecommons org licenses by sa 4 0", 91, 0.97),
    ("cc-by-sa-3.0", "commons", "creativecommons org licenses by sa 3 0", 91, 0.97),
    ("cc-by-nc-4.0", "commons", "creativecommons org licenses by nc 4 0", 91, 0.97),
    ("cc-by-nc-sa-4.0", "commons", "creativecommons org licenses by nc sa 4 0", 91, 0.97),
    ("cc-by-nc-nd-4.0", "commons", "creativecommons org licenses by nc nd 4 0", 91, 0.97),
    ("cc-by-nd-4.0", "commons", "creativecommons org licenses by nd 4 0", 91, 0.97),
    ("cc0-1.0", "commons", "creativecommons org publicdomain zero 1 0", 91, 0.97),
    ("cc0-1.0", "copyright", "to the extent possible under law(?: the)? (?:author|person who associated cc0 with this work) has waived all copyright and related or neighboring rights", 95, 0.98),
    ("public-domain", "public", "creativecommons org publicdomain mark 1 0", 91, 0.96),
    ("public-domain", "public", "(?:this (?:file|work|software|code)|the (?:file|work|software|code)) (?:is|has been placed|is hereby placed) in the public domain", 80, 0.93),
    ("public-domain", "public", "released (?:in|in ?to) the public domain", 78, 0.9),
    ("public-domain", "copyright", "the author disclaims copyright to this source code", 90, 0.96),
    ("public-domain", "copyright", "no copyright is claimed", 70, 0.8),
    ("us-gov-public-domain", "copyright", "works? of the united states government (?:is|are) not subject to (?:domestic )?copyright protection", 88, 0.95),
    ("odbl-1.0", "licen", "made available under the open database license", 92, 0.97),
    ("odbl-1.0", "licen", "opendatacommons org licenses odbl", 91, 0.97),
    ("odc-by-1.0", "licen", "opendatacommons org licenses by", 91, 0.96),
    ("pddl-1.0", "licen", "opendatacommons org licenses pddl", 91, 0.97),
    ("ogl-uk-3.0", "licen", "contains public sector information licensed under the open government licence v3 0", 94, 0.98),
    ("ogl-uk-3.0", "licen", "open government licen[cs]e(?: v ?3 0)?", 80, 0.9),
    ("etalab-2.0", "licen", "licence ouverte(?: version)? 2 0", 88, 0.95),
    ("dl-de-by-2.0", "datenlizenz", "datenlizenz deutschland namensnennung(?: version)? 2 0", 88, 0.95),
    ("python-2.0", "licen", "psf license agreement for python", 92, 0.96),
    ("python-2.0", "licen", "psf is making python available to licensee on an as is basis", 92, 0.96),
    ("php-3.01", "licen", "this source file is subject to version 3 0 ?1? of the php license", 93, 0.97),
    ("ruby", "redistribut", "you can redistribute it and or modify it under either the terms of the (?:2 clause bsdl?|gpl)(?: version 2)?", 84, 0.88),
    ("postgresql", "permission", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 94, 0.98),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", 92, 0.96),
    ("ssleay", "cryptographic", "this product includes cryptographic software written by eric young", 92, 0.96),
    ("curl", "copyright", "copyright c 1996 (?:2[0-9][0-9][0-9] )?daniel stenberg", 84, 0.9),
    ("libpng", "libpng", "this copy of the libpng notices is provided for your convenience", 92, 0.96),
    ("ijg", "jpeg", "this software is based in part on the work of the independent jpeg group", 90, 0.95),
    ("ftl", "freetype", "portions of this software are copyright c the freetype project", 88, 0.93),
    ("ftl", "licen", "the freetype project license", 88, 0.94),
    ("unicode", "permission", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", 93, 0.97),
    ("unicode", "licen", "unicode license(?: agreement)?(?: data files and software)?(?: v3)?", 86, 0.92),
    ("icu", "licen", "icu license(?: icu 1 8 1 and later)?", 88, 0.94),
    ("w3c", "licen", "w3c software (?:and document )?(?:notice and )?license", 90, 0.96),
    ("sissl", "licen", "sun industry standards source license", 90, 0.96),
    ("eupl-1.2", "licen", "licensed under the eupl(?: version 1 2| v ?1 2)", 93, 0.97),
    ("cecill-2.1", "licen", "cecill free software license agreement", 92, 0.97),
    ("cecill-b", "licen", "cecill b free software license agreement", 94, 0.97),
    ("cecill-c", "licen", "cecill c free software license agreement", 94, 0.97),
    ("mulan-psl-2.0", "mulan", "mulan psl v ?2", 90, 0.95),
    ("mulan-psl-2.0", "licen", "mulan permissive software license", 90, 0.95),
    ("sspl-1.0", "licen", "server side public license version 1", 92, 0.97),
    ("busl-1.1", "licen", "use of this software is governed by the business source license", 93, 0.97),
    ("elastic-2.0", "licen", "licensed under the elastic license 2 0 you may not use this file except in compliance with the elastic license", 95, 0.98),
    ("commons-clause", "licen", "commons clause license condition", 94, 0.97),
    ("polyform-noncommercial", "licen", "polyform noncommercial license", 94, 0.97),
    ("polyform-shield", "licen", "polyform shield license", 94, 0.97),
    ("prosperity-3.0", "licen", "the prosperity public license", 92, 0.96),
    ("parity-7.0", "licen", "the parity public license", 92, 0.96),
    ("openrail", "open rail", "(?:creativeml |bigscience |bigcode )open rail m", 90, 0.94),
    ("openrail", "licen", "openrail m license", 90, 0.94),
    ("llama", "licen", "llama (?:2|3|3 1) community license(?: agreement)?", 92, 0.96),
    ("dual-mit-apache", "licen", "licensed under either of apache license version 2 0 (?:[a-z]+ )?or mit license", 98, 0.98),
    ("dual-mit-apache", "licen", "(?:dual )?licensed under (?:the )?(?:mit (?:or|and) apache 2 0|apache 2 0 (?:or|and) mit)(?: licenses?)?", 98, 0.97),
    ("dual-mit-gpl", "licen", "dual licensed under the mit and gpl(?: version 2)? licenses", 98, 0.97),
    ("dual-bsd-gpl", "licen", "dual licensed under (?:the )?bsd (?:or|and) gpl(?: license)?", 98, 0.96),
    ("dual-license", "licen", "this (?:program|software|file|library|project) is dual licensed", 70, 0.8),
    ("multi-license", "licen", "(?:this|the) (?:program|software|file|library|project) is (?:available|distributed|released) under multiple licenses", 70, 0.8),
    ("commercial", "licen", "a commercial license is (?:also )?available", 70, 0.8),
    ("commercial", "licen", "contact (?:us|sales) for (?:a )?commercial licen[cs](?:e|ing)", 70, 0.8),
    ("proprietary", "permission", "no part of this (?:software|document|file|publication) may be reproduced (?:or transmitted )?in any form without (?:the )?(?:prior )?(?:written )?permission", 85, 0.9),
    ("proprietary", "proprietary", "this software is (?:the )?(?:confidential and )?proprietary (?:information )?of", 75, 0.85),
    ("proprietary", "unauthori", "unauthori[sz]ed copying of this file via any medium is strictly prohibited", 85, 0.92),
    ("proprietary", "licen", "use of this software is subject to the terms of (?:the|your) end user license agreement", 82, 0.9),
    ("no-warranty", "warrant", "without even the implied warranty of merchantability or fitness for a particular purpose", 50, 0.6),
]
# Separators and word characters of lower-cased text.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
# Each match of a rule holds one of these; finding them in a whole text is cheap.
PARTS = [
    "licen", "spdx", "gpl", "wtfpl", "bsd", "cc", "rights", "public", "commons", "apache", "attribution", "redistribut", "permission", "warrant", "copyright", "advertising", "contributors", "software", "gcc", "distributed", "perl",
    "datenlizenz", "openssl", "cryptographic", "libpng", "jpeg", "freetype", "mulan", "creativeml", "bigscience", "bigcode", "proprietary", "unauthori", "retain", "bison", "eclipse",
]
#: A match of any rule, with one separator between words, is shorter than this.
REACH = 200


def samples(pattern: str) -> list[str]:
    """All texts that a pattern of the tables stands for: groups, alternatives, classes and options written out; look-aheads match nothing."""

    def either(i: int) -> tuple[list[str], int]:
        whole, row = [], [""]
        while i < len(pattern) and pattern[i] != ")":
            if pattern[i] == "|":
                whole, row, i = whole + row, [""], i + 1
                continue
            if pattern[i] == "(":
                ahead = pattern.startswith("(?!", i)
                some, i = either(i + 3)
                some = [""] if ahead else some
            elif pattern[i] == "[":
                some = list(pattern[i + 1 : pattern.index("]", i)])
                i = pattern.index("]", i)
            else:
                some = [pattern[i]]
            i += 1
            if i < len(pattern) and pattern[i] == "?":
                some, i = ["", *some], i + 1
            row = [x + y for x in row for y in some]
        return whole + row, i

    return either(0)[0]


def literal(pattern: str) -> str:
    """The longest run of characters that every match of a pattern of the tables holds as it stands."""
    runs, run, depth, i = [], "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        if depth or c in "()[]?":
            runs, run = [*runs, run], ""
        elif pattern[i + 1 : i + 2] == "?":
            runs, run, i = [*runs, run], "", i + 1
        else:
            run += c
        i += 1
    return max([*runs, run], key=len)


def _regex(pattern: str) -> str:
    """For lower-cased text in which each run of separators is one blank."""
    return f"(?<!{WORD})(?:{pattern.replace(' ?', ' ?+')})(?!{WORD})"


def rules() -> list[tuple[str, str, str, int, str, float]]:
    """(keyword, literal, regex, priority, label, confidence) of several hundred rules, the same in every run.

    Every match holds the rule's keyword, which many rules share, and its literal.
    """
    made = [(keyword, text, priority, label, confidence) for label, keyword, text, priority, confidence in TEXTS]
    for label, keyword, name, ids in NAMES:
        made += [(keyword, before + name + after, priority, label, confidence) for priority, confidence, before, after in FORMS]
        made += [("spdx", "spdx license identifier " + x.replace("-", " ").replace(".", " "), 100, label, 1.0) for x in ids.split()]
    return [(keyword, max(keyword, literal(pattern), key=len), _regex(pattern), priority, label, confidence) for keyword, pattern, priority, label, confidence in made]
